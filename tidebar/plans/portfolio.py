"""Cross-sectional selections and holdings accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.operators import windows as win
from tidebar.plans.universe import member_series

# Fixed values of the selection rule.
SLOTS, EXIT_RANK, SLOT_WEIGHT = 5, 10, 0.20
UNKNOWN_COST = 0.0011


def equal_weight_members(panel: DataFrame) -> DataFrame:
    """1/N over the members of each date."""
    m = panel.where(F.col("member"))
    n = F.count(F.lit(1)).over(W.partitionBy("date"))
    return m.select("date", "symbol", (num(1) / n).alias("weight"))


def rank_band(
    panel: DataFrame,
    score: str,
    confident: Column,
    enter: int = SLOTS,
    leave: int = EXIT_RANK,
    weight: float = SLOT_WEIGHT,
) -> DataFrame:
    """Per-symbol membership in a rank band: in at rank <= enter with confidence, out at
    rank > leave, without confidence or without membership. There is no slot cap:
    more than ``enter`` names can be held at once. A symbol that is never a member
    is never held, so only the others' rows are read.
    """
    s = F.when(F.col("member"), F.col(score))
    ranked = member_series(panel).withColumn("_s", s)
    by_date = W.partitionBy("date").orderBy(F.col("_s").desc_nulls_last(), "symbol")
    ranked = ranked.withColumn("_rank", F.when(F.col("_s").isNotNull(), F.row_number().over(by_date)))
    sure = F.coalesce(confident, F.lit(False)) & F.col("_s").isNotNull()
    come = sure & (F.col("_rank") <= enter)
    go = ~sure | (F.col("_rank") > leave)
    # a date on which the symbol has no row ends the holding too
    grid = panel.select("date").distinct().withColumn("_g", F.row_number().over(W.orderBy("date")))
    marked = ranked.withColumn("_come", F.coalesce(come, F.lit(False))).withColumn(
        "_go", F.coalesce(go, F.lit(True))
    ).join(F.broadcast(grid), "date")
    w = win.series("symbol", order="date")
    gap = F.coalesce(F.lag("_g").over(w) < F.col("_g") - 1, F.lit(False))
    marked = marked.withColumn("_gap", gap)
    # a run of grid-adjacent rows is one spell; state never crosses a gap
    spell = F.sum(F.col("_gap").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("_spell", spell)
    ws = W.partitionBy("symbol", "_spell").orderBy("date")
    held = win.state(F.col("_come"), F.col("_go"), ws)
    return (
        marked.withColumn("_held", held).where(F.col("_held") == 1)
        .select("date", "symbol", F.col("_rank").cast("long").alias("rank"), num(weight).alias("weight"))
    )


def holdings_account(
    weights: DataFrame,
    panel: DataFrame,
    keys: list[str] | None = None,
    funding: DataFrame | None = None,
    cost_scale: Column | float = 1.0,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Daily net, gross, cost and turnover of given weights (date, symbol, weight).

    A weight decided at a date earns that date's next return. A held name without
    one earns nothing and is closed with cost (which adds no turnover), so the
    next date starts from zero. Cost rates come from the panel; the default rate
    covers unknown ones. Longs pay funding, shorts receive it. ``panel`` may lack
    symbols without a weight if ``calendar`` has the dates of all of them.
    """
    keys = keys or []
    dates = W.orderBy("date")
    days = (panel if calendar is None else calendar).select("date").distinct()
    grid = days.withColumns({"_g": F.row_number().over(dates), "_exit": F.lead("date").over(dates)})
    # a row of the panel knows the symbol's rate on the next date, at which a name that leaves is sold
    by_symbol = win.series("symbol", order="date")
    priced = panel.join(F.broadcast(grid), "date")  # one row per date
    adjacent = F.lead("_g").over(by_symbol) == F.col("_g") + 1
    info = priced.select(
        "date", "symbol", "ret_next", "cost_rate", F.when(adjacent, F.lead("cost_rate").over(by_symbol)).alias("_exit_rate"))
    live = weights.where(F.col("weight") != 0).join(F.broadcast(grid), "date")
    cells = live.join(info, ["date", "symbol"], "left").select(
        *keys, "date", "_g", "_exit", "symbol", "weight", "ret_next", "cost_rate", "_exit_rate"
    )
    cells = cells.withColumn("_closed", F.col("ret_next").isNull())
    w = W.partitionBy(*keys, "symbol").orderBy("_g")
    # the previous date's carried weight: zero after a gap or a forced close
    carried = F.when(
        (F.lag("_g").over(w) == F.col("_g") - 1) & ~F.lag("_closed").over(w), F.lag("weight").over(w)
    )
    follows = F.lead("_g").over(w) == F.col("_g") + 1
    cells = cells.withColumns({"_prev": F.coalesce(carried, num(0)), "_stays": F.coalesce(follows, F.lit(False))})
    scale = cost_scale if isinstance(cost_scale, Column) else num(cost_scale)
    rate = F.coalesce("cost_rate", num(UNKNOWN_COST)) * scale
    traded = F.abs(F.col("weight") - F.col("_prev"))
    size = F.abs("weight")

    def entry(date, gross, turnover, cost, kept):
        return F.struct(*[c.cast(k).alias(n) for n, k, c in (
            ("date", panel.schema["date"].dataType, date), ("gross", "double", gross), ("turnover", "double", turnover), ("cost", "double", cost), ("_w", "double", kept))])

    held = entry(
        F.col("date"), F.col("weight") * F.coalesce("ret_next", num(0)), traded,
        traded * rate + F.when(F.col("_closed"), size * rate).otherwise(num(0)),
        F.when(F.col("_closed"), num(0)).otherwise(F.col("weight")))
    # a name still carried that is absent on the next grid date
    leaves = ~F.col("_stays") & ~F.col("_closed") & F.col("_exit").isNotNull()
    sold = entry(F.col("_exit"), num(0), size, size * F.coalesce("_exit_rate", num(UNKNOWN_COST)) * scale, num(0))
    rows = cells.select(*keys, "symbol", F.explode(F.array_compact(F.array(held, F.when(leaves, sold)))).alias("_r"))
    rows = rows.select(*keys, "symbol", "_r.*")
    if funding is not None:
        rows = rows.join(funding.select("date", "symbol", "funding"), ["date", "symbol"], "left")
        paid = F.coalesce(F.col("_w") * F.col("funding"), num(0))
        rows = rows.withColumn("gross", F.col("gross") - paid)
    out = rows.groupBy(*keys, "date").agg(
        F.sum("gross").alias("gross"), F.sum("cost").alias("cost"), F.sum("turnover").alias("turnover"),
        F.count_if(F.col("_w") != 0).alias("n_held"),
    )
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def contributions(weights: DataFrame, panel: DataFrame) -> DataFrame:
    """weight times next return per (date, symbol)."""
    j = weights.join(panel.select("date", "symbol", "ret_next"), ["date", "symbol"])
    return j.where("ret_next is not null").select(
        "date", "symbol", (F.col("weight") * F.col("ret_next")).alias("contribution")
    )


def last_holdings(log: DataFrame) -> DataFrame:
    """Names held at each variant's last decision, with their side.

    The last decision per variant is one partial aggregate joined back, so no
    variant's whole log meets in one task.
    """
    last = log.groupBy("variant").agg(F.max("decision_ts").alias("decision_ts"))
    now = log.join(last, ["variant", "decision_ts"], "left_semi")
    return now.where(F.col("weight") != 0).select(
        "variant", "symbol", F.when(F.col("weight") > 0, "long").otherwise("short").alias("side"), "weight"
    )


def log_rows(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows to log for a new decision: every target, and weight 0 for names dropped."""
    old = last_holdings(log).select("variant", "symbol", F.lit(True).alias("_was"))
    out = targets.join(old, ["variant", "symbol"], "full")
    return out.select("variant", "symbol", F.coalesce("weight", num(0)).alias("weight"))


def cost_stress(
    weights: DataFrame, panel: DataFrame, scales: list[float] | None = None, keys: list[str] | None = None,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Holdings accounting under every cost scale at once (a scenario dimension)."""
    spark = weights.sparkSession
    keys = keys or []
    dim = spark.createDataFrame([(float(s),) for s in (scales or [1.0, 2.0])], "cost_scale double")
    spread = weights.crossJoin(F.broadcast(dim))
    return holdings_account(spread, panel, [*keys, "cost_scale"], cost_scale=F.col("cost_scale"), calendar=calendar)


def turnover_rule(a: DataFrame, b: DataFrame) -> DataFrame:
    """Gross edge, cost increment and verdict of portfolio a over b (daily tables)."""
    j = a.select("date", F.col("gross").alias("_ga"), F.col("net").alias("_na")).join(
        b.select("date", F.col("gross").alias("_gb"), F.col("net").alias("_nb")), "date"
    )
    out = j.agg(
        F.avg(F.col("_ga") - F.col("_gb")).alias("gross_edge"),
        F.avg(F.col("_na") - F.col("_nb")).alias("net_edge"),
    )
    out = out.withColumn("incremental_cost", F.col("gross_edge") - F.col("net_edge"))
    killed = (F.col("gross_edge") > 0) & (F.col("incremental_cost") > 0.5 * F.col("gross_edge"))
    return out.withColumn("passes", ~killed)


def block_increments(a: DataFrame, b: DataFrame, block_days: int = 182) -> DataFrame:
    """Mean daily gain of a over b in consecutive near-equal blocks of the common dates."""
    j = a.select("date", F.col("net").alias("_a")).join(b.select("date", F.col("net").alias("_b")), "date")
    d = j.select("date", (F.col("_a") - F.col("_b")).alias("diff"))
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    # one row per date, so the numbering runs over the calendar, not over the data
    numbered = d.withColumn("_i", F.row_number().over(W.orderBy("date")) - 1).crossJoin(F.broadcast(n))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(block_days)).cast("int"))
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    # the first r blocks have one row more
    cut = r * (q + 1)
    block = F.when(F.col("_i") < cut, F.floor(F.col("_i") / (q + 1))).otherwise(
        r + F.floor((F.col("_i") - cut) / q)
    )
    return numbered.groupBy(block.cast("long").alias("block")).agg(
        F.avg("diff").alias("increment"), F.count(F.lit(1)).alias("n_days")
    )
