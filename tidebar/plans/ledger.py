"""Event-logged books: replay, valuation, targets, rebalance plan, run registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.functions.times import plus_days
from tidebar.operators.blocks import BLOCK, ROWS, running_sum, with_blocks
from tidebar.operators.joins import asof_join
from tidebar.operators.selection import sells_first

DUST = 1e-12


def signed(trades: DataFrame) -> DataFrame:
    """Cash and quantity effect of each trade: a buy pays notional and fee."""
    buy = F.col("side") == "buy"
    cash = F.when(buy, -F.col("notional") - F.col("fee")).otherwise(F.col("notional") - F.col("fee"))
    qty = F.when(buy, F.col("qty")).otherwise(-F.col("qty"))
    return trades.withColumns({"cash_flow": cash, "qty_flow": qty})


def positions_now(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Open quantity per symbol, dust removed; plain sums, combined map-side."""
    out = signed(trades).groupBy(*keys, "symbol").agg(F.sum("qty_flow").alias("qty"))
    return out.where(F.abs("qty") > DUST)


def cash_now(trades: DataFrame, keys: list[str], capital: float) -> DataFrame:
    flow = signed(trades)
    g = flow.groupBy(*keys) if keys else flow.groupBy()
    return g.agg((num(capital) + F.coalesce(F.sum("cash_flow"), num(0))).alias("cash"))


def running_book(
    trades: DataFrame, keys: list[str], order: list[str], capital: float, span: str = "month", rows: int = ROWS
) -> DataFrame:
    """Cash after every trade of a book and quantity after every trade of a symbol.

    A book's log has no bound, so both run block-wise, in time blocks that are cut above ``rows`` rows. The blocks of a
    book serve its symbols too, whose trades are some of the book's.
    """
    d = with_blocks(signed(trades), keys, order[0], span, rows)
    d = running_sum(d, keys, order, {"_cash": "cash_flow"}, block=F.col(BLOCK))
    d = running_sum(d, [*keys, "symbol"], order, {"position": "qty_flow"}, block=F.col(BLOCK)).drop(BLOCK)
    return d.withColumn("cash", num(capital) + F.col("_cash")).drop("_cash", "cash_flow", "qty_flow")


def daily_equity(
    trades: DataFrame, marks: DataFrame, keys: list[str], capital: float
) -> DataFrame:
    """End-of-day cash, position value and equity at the last mark at or before each day.

    Trades are summed per day first; each (book, symbol) then carries its quantity
    over the days of the book.
    """
    flows = signed(trades).groupBy(*keys, "symbol", "day").agg(
        F.sum("qty_flow").alias("_q"), F.sum("cash_flow").alias("_c")
    )
    days = flows.select(*keys, "day").distinct()
    cash_day = flows.groupBy(*keys, "day").agg(F.sum("_c").alias("_c"))
    wk = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    cash = cash_day.select(*keys, "day", (num(capital) + F.sum("_c").over(wk)).alias("cash"))
    symbols = flows.select(*keys, "symbol").distinct()
    cells = days.join(symbols, keys) if keys else days.crossJoin(symbols)
    ws = W.partitionBy(*keys, "symbol").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    held = (
        cells.join(flows.drop("_c"), [*keys, "symbol", "day"], "left")
        .withColumn("qty", F.sum(F.coalesce("_q", num(0))).over(ws)).drop("_q")
    )
    priced = asof_join(held, marks, "day", "day", ["symbol"], ["price"], span="year")
    value = priced.groupBy(*keys, "day").agg(
        F.sum(F.when(F.abs("qty") > DUST, F.col("qty") * F.coalesce("price", num(0))).otherwise(num(0))).alias("positions_value")
    )
    out = cash.join(value, [*keys, "day"])
    return out.withColumn("equity", F.col("cash") + F.col("positions_value"))


def book_weights(positions: DataFrame, marks: DataFrame, cash: DataFrame, keys: list[str]) -> DataFrame:
    """Position weights at given marks; all 0 once equity is not positive."""
    v = positions.join(marks.select("symbol", "price"), "symbol", "left")
    v = v.withColumn("value", F.col("qty") * F.coalesce("price", num(0)))
    total = v.groupBy(*keys).agg(F.sum("value").alias("_v")) if keys else v.agg(F.sum("value").alias("_v"))
    eq = cash.join(total, keys, "left") if keys else cash.crossJoin(total)
    eq = eq.withColumn("equity", F.col("cash") + F.coalesce("_v", num(0))).drop("_v", "cash")
    out = v.join(eq, keys) if keys else v.crossJoin(F.broadcast(eq))
    weight = F.when(F.col("equity") <= 0, num(0)).otherwise(F.try_divide(F.col("value"), F.col("equity")))
    return out.select(*keys, "symbol", "qty", "value", "equity", weight.alias("weight"))


def strict_targets(weights: DataFrame, symbols: DataFrame, date: str = "ts") -> DataFrame:
    """Targets per trading day = the decision of the day before, whole or not at all.

    A date with a missing or null leg yields no targets: unknown is not flat.
    """
    n = symbols.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_n"))
    full = weights.groupBy(date).agg(F.count("weight").alias("_have")).crossJoin(F.broadcast(n))
    ok = full.where("_have = _n").select(date)
    return weights.join(ok, date, "left_semi").select(
        plus_days(date, 1).alias("day"), "symbol", F.col("weight").alias("target")
    )


def lenient_targets(weights: DataFrame, days: DataFrame, date: str = "ts") -> DataFrame:
    """Targets per day from the latest decision at or before the day before; null legs are 0."""
    rows = weights.groupBy(date).agg(
        F.map_from_entries(F.collect_list(F.struct("symbol", F.coalesce("weight", num(0))))).alias("_w")
    )
    want = days.select("day").distinct().withColumn("_d", plus_days("day", -1))
    hit = asof_join(want, rows, "_d", date, cols=["_w"], span="year")
    return hit.select("day", F.explode("_w").alias("symbol", "target"))


def missing_decision_bars(bars: DataFrame, days: DataFrame, symbols: DataFrame) -> DataFrame:
    """(day, symbol) whose decision bar of the day before is absent or has no open or close."""
    valid = bars.where("open is not null and close is not null").select(
        plus_days("ts", 1).alias("day"), "symbol"
    )
    return days.select("day").crossJoin(symbols.select("symbol").distinct()).join(
        valid, ["day", "symbol"], "left_anti"
    )


def rebalance_plan(
    targets: DataFrame, current: DataFrame, keys: list[str], threshold: float = 0.02
) -> DataFrame:
    """Trades to place: only moves beyond the threshold, sells listed before buys.

    ``targets`` has keys, symbol, target; ``current`` has keys, symbol, weight.
    """
    on = [*keys, "symbol"]
    j = targets.join(current.select(*on, "weight"), on, "left")
    cur = F.coalesce("weight", num(0))
    plan = j.withColumn("current", cur).where(F.abs(F.col("target") - F.col("current")) > threshold)
    plan = plan.withColumn("side", F.when(F.col("target") < F.col("current"), "sell").otherwise("buy"))
    return plan.select(*on, "current", "target", "side")


def with_target_qty(plan: DataFrame, equity: Column, price: Column) -> DataFrame:
    return plan.withColumn("target_qty", F.try_divide(F.col("target") * equity, price))


def ordered_plan(plan: DataFrame, tie: list[str]) -> DataFrame:
    return sells_first(plan, "side", tie)


def catch_up_days(
    days: DataFrame, runs: DataFrame, valid_days: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Days still to process, in order, up to (not including) the first incomplete day.

    ``days`` is the expected spine, ``runs`` the registry, ``valid_days`` the days
    with complete bars. A rerun after success returns nothing.
    """
    keys = keys or []
    on = [*keys, "day"]
    todo = days.join(runs.select(*on).distinct(), on, "left_anti")
    bad = todo.join(valid_days.select("day").distinct(), "day", "left_anti")
    if keys:
        stop = bad.groupBy(*keys).agg(F.min("day").alias("_stop"))
        j = todo.join(stop, keys, "left")
    else:
        j = todo.crossJoin(F.broadcast(bad.agg(F.min("day").alias("_stop"))))
    return j.where(F.col("_stop").isNull() | (F.col("day") < F.col("_stop"))).select(*on)


def settled_only(equity: DataFrame) -> DataFrame:
    return equity.where(F.col("note") == "settled")
