"""Risk rules over (decision, symbol). A rule can only hold a target down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.operators.joins import asof_top_k

# Fixed values of the rules. Flows are known for two assets only, and the gate speaks of no other.
FLOW_ASSETS = ("BTC", "ETH")
FLOW_LOOKBACK, FLOW_MIN_ROWS, FLOW_BLOCK, FLOW_HALVE = 5, 3, 300.0, 1000.0
NO_ADD_SEVERITY, HALVE_SEVERITY = 4, 5


def flow_gate(
    days: DataFrame,
    flows: DataFrame,
    day: str = "day",
    lookback: int = FLOW_LOOKBACK,
    min_rows: int = FLOW_MIN_ROWS,
    block: float = FLOW_BLOCK,
    halve: float = FLOW_HALVE,
    assets: tuple[str, ...] | None = FLOW_ASSETS,
) -> DataFrame:
    """Per (day, asset) with enough rows: trailing net flow and the action it asks for.

    Only ``assets`` are gated; None gates every asset of the flow table.
    """
    if assets is not None:
        flows = flows.where(F.col("asset").isin(*assets))
    last = asof_top_k(days, flows.select("asset", "date", "net_flow_usd_m"), day, "date", "asset", lookback)
    net = F.sum("net_flow_usd_m")
    out = last.groupBy(day, "asset").agg(
        net.alias("net_usd_m"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("net_flow_usd_m") < 0).alias("n_out"),
    ).where(F.col("n_rows") >= min_rows)
    action = F.when(-F.col("net_usd_m") >= halve, "halve").when(-F.col("net_usd_m") >= block, "block")
    return out.withColumn("action", action)


def apply_rules(decisions: DataFrame) -> DataFrame:
    """The cascade, as ordered column rewrites of one row.

    Expects target, current (null = 0), event_blocked, cold_start, flow_action,
    flags_unknown, asset_severity, market_severity. Adds adjusted and notes.
    """
    cur = F.coalesce("current", num(0))
    cap = lambda x: F.least(x, cur)
    unset = F.lit(False)
    gate = F.coalesce("event_blocked", unset)
    cold = F.coalesce("cold_start", unset)
    unknown = F.coalesce("flags_unknown", unset)
    asset = F.coalesce("asset_severity", F.lit(0))
    market = F.coalesce("market_severity", F.lit(0))

    d = decisions.withColumn("_t0", F.col("target"))
    d = d.withColumn("_t1", F.when(gate & ~cold, cap(F.col("_t0"))).otherwise(F.col("_t0")))
    flow = F.coalesce("flow_action", F.lit(""))
    d = d.withColumn(
        "_t2",
        F.when(flow == "halve", cap(F.col("_t1")) * num(0.5))
        .when((flow == "block") & (F.col("_t1") > cur), cur)
        .otherwise(F.col("_t1")),
    )
    halve = asset >= HALVE_SEVERITY
    hold = ((asset >= NO_ADD_SEVERITY) | (market >= HALVE_SEVERITY)) & (F.col("_t2") > cur)
    d = d.withColumn(
        "adjusted",
        F.when(unknown, cap(F.col("_t2")))
        .when(halve, cap(F.col("_t2")) * num(0.5))
        .when(hold, cur)
        .otherwise(F.col("_t2")),
    )
    note = lambda c, text: F.when(c, F.lit(text))
    notes = F.array_compact(
        F.array(
            note(gate & cold, "event_gate bypassed"),
            note(gate & ~cold, "event_gate"),
            note(flow == "halve", "flow halve"),
            note((flow == "block") & (F.col("_t1") > cur), "flow block"),
            note(unknown, "flags unknown"),
            note(~unknown & halve, "severity halve"),
            note(~unknown & ~halve & hold, "severity no add"),
        )
    )
    return d.withColumn("notes", notes).drop("_t0", "_t1", "_t2")
