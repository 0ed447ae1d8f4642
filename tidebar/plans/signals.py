"""Positions of every grid variant, in one job.

What depends on the bar alone (each distinct rolling length) is computed once
per bar, *before* the grid multiplies the rows. Variants are then laid out as an
array of structs and exploded: one row per (symbol, variant, ts), with the
state-carrying families forward-filled in the same partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import num, sign, vol_target_scale
from tidebar.operators import windows as win
from tidebar.plans import grids

ANNUAL = 365.0


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", num(1).alias("pos"))


def _sma_event(fast: int, slow: int, w) -> Column:
    a, b = win.rolling_mean("close", w, fast), win.rolling_mean("close", w, slow)
    return F.coalesce((a > b).cast("double"), num(0))


def donchian_event(n_entry: int, n_exit: int, w) -> Column:
    """1 on a close above the channel of the bars before, 0 below it, else null."""
    up = F.col("close") > win.rolling_max("close", w, n_entry, lag=1)
    down = F.col("close") < win.rolling_min("close", w, n_exit, lag=1)
    return F.when(down, num(0)).when(up, num(1))


def tsmom_position(lookback: int, target: float, w, max_lev: float = 1.0, long_short: bool = False) -> Column:
    mom = win.pct_change("close", w, lookback)
    raw = sign(mom) if long_short else F.coalesce((mom > 0).cast("double"), num(0))
    realised = win.rolling_std("_ret", w, 20) * F.sqrt(num(ANNUAL))
    return F.coalesce(raw * vol_target_scale(realised, target, max_lev), num(0))


def rsi(gain: Column, loss: Column) -> Column:
    """100 - 100/(1+gain/loss); 50 where there is no average loss."""
    rs = F.try_divide(gain, F.nullif(loss, num(0)))
    return F.coalesce(num(100) - num(100) / (num(1) + rs), num(50))


def _with_rsi(bars: DataFrame) -> DataFrame:
    """Recursive averages for each RSI length in a single grouped pass."""
    w = win.series("symbol")
    d = F.col("close") - F.lag("close").over(w)
    # the first bar has no change: null seeds nothing in the recursion
    base = bars.withColumn("_up", F.when(d.isNotNull(), F.greatest(d, num(0)))).withColumn(
        "_dn", F.when(d.isNotNull(), -F.least(d, num(0)))
    )
    lengths = sorted({n for n, _, _ in grids.RSI})
    fields = base.schema
    from pyspark.sql import types as T

    schema = T.StructType(
        [*fields.fields, *[T.StructField(f"_{k}{n}", T.DoubleType()) for n in lengths for k in ("g", "l")]]
    )

    def one(pdf):
        pdf = pdf.sort_values("ts")
        for n in lengths:
            for k, c in (("g", "_up"), ("l", "_dn")):
                pdf[f"_{k}{n}"] = pdf[c].astype(float).ewm(alpha=1.0 / n, adjust=False).mean()
        return pdf

    return base.groupBy("symbol").applyInPandas(one, schema)


def rsi_event(n: int, buy_below: float, exit_above: float) -> Column:
    r = rsi(F.col(f"_g{n}"), F.col(f"_l{n}"))
    return F.when(r > exit_above, num(0)).when(r < buy_below, num(1))


def positions(
    bars: DataFrame,
    families: list[str] | None = None,
    long_short: bool = False,
    max_lev: float = 1.0,
    keep: list[str] | None = None,
    lags: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Decided position of every variant at every bar, plus the bar columns in ``keep``.

    Columns: symbol, ts, family, params, grid_order, pos. ``lags`` bounds a position; with it come held (the
    bounded position of the bar before) and turnover (its change), read from whole arrays before the explosion.
    """
    families = families or list(grids.FAMILY_SIZES)
    keep = keep or []
    w = win.series("symbol")
    cols = ["symbol", "ts", "close", *[c for c in keep if c not in ("symbol", "ts", "close")]]
    base = bars.select(*cols).withColumn("_ret", win.pct_change("close", w))
    if "rsi_meanrev" in families:
        base = _with_rsi(base)

    order = {(r[0], r[1]): r[2] for r in grids._rows()}
    variants: list[Column] = []
    made: dict[str, Column] = {}

    def add(family: str, label: str, value: Column, is_event: bool) -> None:
        name = f"_p{len(made)}"
        made[name] = value if not is_event else F.coalesce(win.ffill(value, w), num(0))
        variants.append(
            F.struct(
                F.lit(family).alias("family"), F.lit(label).alias("params"),
                F.lit(order[(family, label)]).cast("long").alias("grid_order"), F.col(name).alias("pos"),
            )
        )

    events: dict[str, Column] = {}
    if "sma_cross" in families:
        for n in sorted({n for p in grids.SMA for n in p}):
            events[f"_m{n}"] = win.rolling_mean("close", w, n)
    if "donchian" in families:
        for n, x in grids.DONCHIAN:
            events[f"_d{n}"] = donchian_event(n, x, w)
    if "tsmom" in families:
        events["_vol"] = win.rolling_std("_ret", w, 20) * F.sqrt(num(ANNUAL))
        for lb in sorted({lb for lb, _ in grids.TSMOM}):
            events[f"_k{lb}"] = win.pct_change("close", w, lb)
    staged = base.withColumns(events) if events else base

    if "sma_cross" in families:
        for f, s in grids.SMA:
            above = (F.col(f"_m{f}") > F.col(f"_m{s}")).cast("double")
            add("sma_cross", f"fast={f},slow={s}", F.coalesce(above, num(0)), False)
    if "donchian" in families:
        for n, x in grids.DONCHIAN:
            add("donchian", f"n_entry={n},n_exit={x}", F.col(f"_d{n}"), True)
    if "tsmom" in families:
        for lb, tv in grids.TSMOM:
            mom = F.col(f"_k{lb}")
            raw = sign(mom) if long_short else F.coalesce((mom > 0).cast("double"), num(0))
            pos = F.coalesce(raw * vol_target_scale(F.col("_vol"), tv, max_lev), num(0))
            add("tsmom", f"lookback={lb},target_vol={tv}", pos, False)
    if "rsi_meanrev" in families:
        for n, b, e in grids.RSI:
            add("rsi_meanrev", f"n={n},buy_below={b},exit_above={e}", rsi_event(n, b, e), True)

    wide = staged.withColumns(made)
    rest = [c for c in cols if c not in ("symbol", "ts")]
    fields = ["pos"]
    if lags is not None:
        fields += ["held", "turnover"]
        wide = wide.withColumns({n: lags(F.col(n)) for n in made}).withColumn("_now", F.array(*made))
        wide = wide.withColumns({"_one": F.lag("_now", 1).over(w), "_two": F.lag("_now", 2).over(w)})
        for i, v in enumerate(variants):
            before, earlier = [F.coalesce(F.get(c, F.lit(i)), num(0)) for c in ("_one", "_two")]
            variants[i] = F.struct(
                *[v[f].alias(f) for f in ("family", "params", "grid_order", "pos")],
                before.alias("held"), F.abs(before - earlier).alias("turnover"),
            )
    return wide.select("symbol", "ts", *rest, F.explode(F.array(*variants)).alias("_v")).select(
        "symbol", "ts", "_v.family", "_v.params", "_v.grid_order", *rest, *[f"_v.{f}" for f in fields],
    )


def single(bars: DataFrame, family: str, **p) -> DataFrame:
    """Position of one parameter choice: symbol, ts, pos."""
    w = win.series("symbol")
    base = bars.select("symbol", "ts", "close").withColumn("_ret", win.pct_change("close", w))
    if family == "sma_cross":
        out = base.withColumn("pos", _sma_event(p["fast"], p["slow"], w))
    elif family == "donchian":
        staged = base.withColumn("_e", donchian_event(p["n_entry"], p["n_exit"], w))
        out = staged.withColumn("pos", F.coalesce(win.ffill("_e", w), num(0)))
    elif family == "tsmom":
        out = base.withColumn(
            "pos", tsmom_position(p["lookback"], p["target_vol"], w, p.get("max_lev", 1.0), p.get("long_short", False))
        )
    elif family == "rsi_meanrev":
        staged = _with_rsi(base).withColumn("_e", rsi_event(p["n"], p["buy_below"], p["exit_above"]))
        out = staged.withColumn("pos", F.coalesce(win.ffill("_e", w), num(0)))
    else:
        raise KeyError(f"unknown family {family!r}; known: {sorted(grids.FAMILY_SIZES)}")
    return out.select("symbol", "ts", "pos")
