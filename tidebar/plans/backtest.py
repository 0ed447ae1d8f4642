"""Positions to net returns.

One timing rule: a position decided at a bar's close is held from the next bar.
Costs fall on changes of the held position; longs pay positive funding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import clip, cost_rate, num, slippage_bps
from tidebar.operators import windows as win


def bar_inputs(bars: DataFrame, window: int = 20, fill_ahead: bool = False) -> DataFrame:
    """Per bar: return, rolling volatility (0.02 while unknown) and rolling median dollar volume.

    ``fill_ahead`` fills the volume warm-up with the series' own median, which
    looks ahead; by default the warm-up stays null and costs fall to the floor.
    """
    w = win.series("symbol")
    ret = bars.withColumn("ret", win.pct_change("close", w))
    vol = F.coalesce(win.rolling_std("ret", w, window), num(0.02))
    dv = win.rolling_median("quote_volume", w, window)
    if fill_ahead:
        ret = ret.withColumn("_dv", dv)
        dv = win.median_fill(F.col("_dv"), "_dv", ["symbol"])
    out = ret.withColumn("daily_vol", vol).withColumn("dollar_volume", dv)
    return out.withColumn("ret", F.coalesce("ret", num(0))).drop("_dv")


def account(
    decided: DataFrame,
    keys: list[str],
    fee_bps: float | Column = 10.0,
    floor_bps: float | Column = 1.0,
    funding: str | None = None,
) -> DataFrame:
    """Net return per bar of rows that carry ret, daily_vol, dollar_volume and pos.

    One window pass per series: every lag shares the partitioning ``keys``.
    """
    w = win.series(*keys)
    staged = decided.withColumn("pos", bounded("pos")).withColumn("held", win.held("pos", w))
    return charge(staged.withColumn("turnover", win.turnover("held", w)), fee_bps, floor_bps, funding)


def bounded(pos: Column | str) -> Column:
    return clip(F.coalesce(pos, num(0)), -3, 3)


def charge(
    staged: DataFrame, fee_bps: float | Column = 10.0, floor_bps: float | Column = 1.0, funding: str | None = None
) -> DataFrame:
    """Gross, cost, funding and net of rows that carry ret, daily_vol, dollar_volume, held and turnover."""
    slip = slippage_bps("daily_vol", "dollar_volume", floor_bps=floor_bps)
    fund = -F.col("held") * F.coalesce(F.col(funding), num(0)) if funding else num(0)
    out = (
        staged.withColumn("gross", F.col("held") * F.col("ret"))
        .withColumn("cost", F.col("turnover") * cost_rate(fee_bps, slip))
        .withColumn("funding_pnl", fund)
    )
    return out.withColumn("net", F.col("gross") - F.col("cost") + F.col("funding_pnl"))


def run(
    bars: DataFrame,
    positions: DataFrame,
    keys: list[str] | None = None,
    fee_bps: float | Column = 10.0,
    floor_bps: float | Column = 1.0,
    funding: DataFrame | None = None,
    fill_ahead: bool = False,
) -> DataFrame:
    """Backtest of a position table (symbol, ts, pos, plus variant keys) on its bars.

    A variant with no position on a bar is flat there. Variants are completed to
    the bar grid only through the (symbol, ts) join, never by looping.
    """
    keys = keys or ["symbol"]
    extra = [k for k in keys if k != "symbol"]
    inputs = bar_inputs(bars, fill_ahead=fill_ahead).select(
        "symbol", "ts", "close", "ret", "daily_vol", "dollar_volume"
    )
    if extra:
        variants = positions.select("symbol", *extra).distinct()
        inputs = inputs.join(variants, "symbol")
    joined = inputs.join(positions.select(*keys, "ts", "pos"), [*keys, "ts"], "left")
    name = None
    if funding is not None:
        name = "funding"
        day = F.date_trunc("day", "ts")
        joined = joined.withColumn("_day", day).join(
            funding.select("symbol", F.col("ts").alias("_day"), "funding"), ["symbol", "_day"], "left"
        ).drop("_day")
    return account(joined, keys, fee_bps, floor_bps, name)


def variant_returns(
    bars: DataFrame,
    families: list[str] | None = None,
    fee_bps: float = 10.0,
    floor_bps: float = 1.0,
    funding: DataFrame | None = None,
    long_short: bool = False,
    max_lev: float = 1.0,
    fill_ahead: bool = False,
) -> DataFrame:
    """Net return of every grid variant at every bar: the long trials table.

    Bar inputs ride along through the grid explosion, so there is no join back to
    the bars. The positions of all variants are lagged as one array per bar before
    they are exploded: one shuffle by symbol, and the 32 times longer rows are never
    sorted. The number of symbols bounds the parallelism.
    """
    from tidebar.plans.signals import positions

    inputs = bar_inputs(bars, fill_ahead=fill_ahead)
    keep = ["ret", "daily_vol", "dollar_volume"]
    if funding is not None:
        day = F.date_trunc("day", "ts")
        inputs = inputs.withColumn("_day", day).join(
            funding.select("symbol", F.col("ts").alias("_day"), "funding"), ["symbol", "_day"], "left"
        )
        keep.append("funding")
    pos = positions(inputs, families, long_short, max_lev, keep, lags=bounded)
    return charge(pos, fee_bps, floor_bps, "funding" if funding is not None else None)
