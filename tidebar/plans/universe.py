"""Point-in-time universe and the cross-sectional ranker panel.

All state stays long: one row per (date, symbol). Series windows are bounded by
the date grid, date windows by the number of symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import cost_rate, num, slippage_bps
from tidebar.operators import windows as win
from tidebar.operators.joins import next_on_spine

# Base assets that are not tradable universe members.
STABLE_FIAT_BASES = [
    "DAI", "UST", "USTC", "PAX", "PAXG", "EUR", "GBP", "AUD", "TRY", "BRL",
    "RUB", "UAH", "NGN", "ZAR", "BIDR", "IDRT", "VAI", "AEUR", "EURI", "XUSD",
]
WRAPPED_BASES = ["WBTC", "WETH", "WBETH", "WSOL", "STETH", "CBETH", "BETH", "WNXM"]
LEVERAGED = r"(UP|DOWN|BULL|BEAR)$"

# Fixed values of the ranker protocol.
ADV_FLOOR, TOP_RANK, MIN_BARS, MIN_MEMBERS, ADV_WINDOW = 5e6, 50, 110, 30, 30


def eligible(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Symbols quoted in USDT whose base is no stable, fiat, wrapped or leveraged asset."""
    s = F.col(symbol)
    base = F.regexp_replace(s, "USDT$", "")
    keep = (
        s.endswith("USDT") & (s != "USDT") & ~base.contains("USD")
        & ~base.isin(STABLE_FIAT_BASES + WRAPPED_BASES) & ~base.rlike(LEVERAGED)
    )
    return symbols.where(keep)


def volumes(bars: DataFrame, adv_window: int = ADV_WINDOW) -> DataFrame:
    """The rows of the panel, unranked: those of a symbol with a full trailing volume window on the date."""
    w = win.series("symbol")
    adv = win.rolling_mean("quote_volume", w, adv_window)
    return bars.select(
        F.col("ts").alias("date"), "symbol", "close", F.col("quote_volume").alias("dollar_vol"),
        adv.alias("adv30"), F.row_number().over(w).cast("long").alias("n_bars"),
    ).where(F.col("adv30").isNotNull())


def volume_rank() -> Column:
    return win.first_tie_rank("adv30", "date", "symbol").cast("long")


def panel(bars: DataFrame, adv_window: int = ADV_WINDOW, top_n: int = TOP_RANK) -> DataFrame:
    """Ranked daily panel: only symbols with a full trailing volume window on the date; n_bars counts a symbol's bars so far."""
    return volumes(bars, adv_window).withColumn("rank", volume_rank()).withColumn("in_universe", F.col("rank") <= top_n)


def member_series(panel: DataFrame) -> DataFrame:
    """All rows of the symbols that are members on some date. The top ranks of the dates bound these symbols, however many
    the panel has, so rules about members need no window over the others."""
    return panel.join(F.broadcast(panel.where("member").select("symbol").distinct()), "symbol", "left_semi")


def bar_counts_on_spine(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Bars each symbol has had by each date, carried over dates without a bar."""
    w = win.series("symbol")
    counted = bars.select(
        F.col("ts").alias("date"), "symbol", F.row_number().over(w).cast("long").alias("n_bars")
    )
    from tidebar.operators.joins import asof_join

    cells = dates.select("date", "symbol")
    return asof_join(cells, counted, "date", "date", ["symbol"], ["n_bars"], span="year")


def ranker_panel(
    bars: DataFrame,
    members_per_date: int = MIN_MEMBERS,
    adv_floor: float = ADV_FLOOR,
    top_rank: int = TOP_RANK,
    min_bars: int = MIN_BARS,
    adv_window: int = ADV_WINDOW,
    start: Column | None = None,
) -> DataFrame:
    """Returns, volatility, membership, label against the member median, cost rate, momentum.

    Returns and rolling statistics follow the date grid of the panel: a symbol
    absent on a date breaks its one-step return and its full windows. What follows
    a series comes first and what compares a date last, so the rows are shuffled to
    their series and to their dates once each.
    """
    p = volumes(bars, adv_window)
    if start is not None:
        p = p.where(F.col("date") >= start)
    # position of each date on the shared grid; consecutive grid steps make a valid return
    grid = p.select("date").distinct()
    grid = grid.withColumn("_g", F.row_number().over(W.orderBy("date")).cast("long"))
    p = p.join(F.broadcast(grid), "date")
    w = W.partitionBy("symbol").orderBy("date")
    adjacent = F.lag("_g").over(w) == F.col("_g") - 1
    p = p.withColumn("ret", F.when(adjacent, F.ln("close") - F.lag(F.ln("close")).over(w)))

    def on_grid(fn, width: int) -> Column:
        f = win.frame(w, width)
        unbroken = F.col("_g") - F.first("_g").over(f) == width - 1
        return F.when(unbroken & (F.count("ret").over(f) == width), fn("ret").over(f))

    ahead = F.lead("_g").over(w) == F.col("_g") + 1
    p = p.withColumns({
        "sigma20": on_grid(F.stddev_samp, 20), "mom21": on_grid(F.sum, 21),
        "ret_next": F.when(ahead, F.try_divide(F.lead("close").over(w), F.col("close")) - 1),
    })
    p = p.withColumn("rank", volume_rank())
    raw_member = (
        (F.col("adv30") >= adv_floor) & (F.col("rank") <= top_rank)
        & (F.col("n_bars") >= min_bars) & F.col("close").isNotNull()
    )
    by_date = W.partitionBy("date")
    p = p.withColumn("_m", raw_member)
    p = p.withColumn("_n", F.count_if("_m").over(by_date))
    p = p.withColumn("member", F.col("_m") & (F.col("_n") >= members_per_date))
    masked = F.when(F.col("member"), F.col("ret_next"))
    p = p.withColumn("_med", F.median(masked).over(by_date))
    label = F.when(masked.isNotNull(), (masked > F.col("_med")).cast("double"))
    slip = slippage_bps("sigma20", "dollar_vol")
    p = p.withColumn("label", label).withColumn("cost_rate", cost_rate(10.0, slip))
    return p.select(
        "date", "symbol", "close", "dollar_vol", "adv30", "rank", "n_bars", "ret", "sigma20", "mom21",
        "member", "ret_next", "label", "cost_rate",
    )


def return_channels(p: DataFrame, floor: Column | float) -> DataFrame:
    """Normalised return r / max(sigma, floor) and its percent rank among members."""
    f = floor if isinstance(floor, Column) else num(floor)
    z = F.when(F.col("sigma20").isNotNull(), F.col("ret") / F.greatest(F.col("sigma20"), f))
    out = p.withColumn("z", z)
    return out.withColumn("z_rank", win.pct_rank("z", "date", F.col("member")))


__all__ = [
    "bar_counts_on_spine", "eligible", "member_series", "next_on_spine", "panel", "ranker_panel", "return_channels",
]
