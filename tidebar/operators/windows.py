"""Window expressions over one series.

A bar or session table holds at most one row per series and grid step, so a
series window is bounded by the calendar (a century of hourly bars is under
900,000 rows), however large the table. Tables without that bound (logs, trades,
headlines) use ``tidebar.operators.blocks``, which splits a series by time.

All expressions of one series share a partitioning and an ordering, so Catalyst
plans one shuffle and one sort for any number of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.columns import col, div, num


def series(*keys: str, order: str = "ts") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def frame(w: WindowSpec, width: int, lag: int = 0) -> WindowSpec:
    """The ``width`` rows that end ``lag`` rows before the current one."""
    return w.rowsBetween(-(width - 1) - lag, -lag)


def rolling(
    fn: Callable[[Column], Column],
    x: Column | str,
    w: WindowSpec,
    width: int,
    min_rows: int | None = None,
    lag: int = 0,
) -> Column:
    """``fn`` over a full frame; null until ``min_rows`` (default all) rows are non-null."""
    f = frame(w, width, lag)
    need = width if min_rows is None else min_rows
    return F.when(F.count(col(x)).over(f) >= need, fn(col(x)).over(f))


def rolling_mean(x, w, width, min_rows=None):
    return rolling(F.avg, x, w, width, min_rows)


def rolling_std(x, w, width, min_rows=None):
    return rolling(F.stddev_samp, x, w, width, min_rows)


def rolling_sum(x, w, width, min_rows=None):
    return rolling(F.sum, x, w, width, min_rows)


def rolling_max(x, w, width, lag=0):
    return rolling(F.max, x, w, width, lag=lag)


def rolling_min(x, w, width, lag=0):
    return rolling(F.min, x, w, width, lag=lag)


def rolling_median(x, w, width):
    return rolling(lambda c: F.percentile(c, 0.5), x, w, width)


def rolling_pair(fn, x: Column | str, y: Column | str, w: WindowSpec, width: int) -> Column:
    """A two-column statistic, null unless every row of the frame has both values."""
    f = frame(w, width)
    both = F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), F.lit(1))).over(f)
    return F.when(both == width, fn(col(x), col(y)).over(f))


def rolling_corr(x, y, w, width):
    return rolling_pair(F.corr, x, y, w, width)


def rolling_cov(x, y, w, width):
    return rolling_pair(F.covar_samp, x, y, w, width)


def rolling_var(x, w, width):
    return rolling(F.var_samp, x, w, width)


def rolling_beta(y, x, w, width):
    """Slope of y on x."""
    return div(rolling_cov(y, x, w, width), rolling_var(x, w, width))


def rolling_zscore(x, w, width):
    return div(col(x) - rolling_mean(x, w, width), F.nullif(rolling_std(x, w, width), num(0)))


def pct_change(x: Column | str, w: WindowSpec, k: int = 1) -> Column:
    return div(x, F.lag(col(x), k).over(w)) - num(1)


def log_diff(x: Column | str, w: WindowSpec, k: int = 1) -> Column:
    return F.ln(col(x)) - F.lag(F.ln(col(x)), k).over(w)


def running_count(x: Column | str, w: WindowSpec) -> Column:
    return F.count(col(x)).over(w.rowsBetween(W.unboundedPreceding, 0))


def rolling_log_return(price: Column | str, n_known: str, w: WindowSpec, width: int) -> Column:
    """Sum of the last ``width`` log returns as one difference of log prices.

    ``n_known`` is the running count of non-null log returns; the sum exists when
    all ``width`` of them do. Two lags per row instead of a frame of that length.
    """
    full = F.col(n_known) - F.lag(F.col(n_known), width, 0).over(w) == width
    return F.when(full, F.ln(col(price)) - F.lag(F.ln(col(price)), width).over(w))


def held(position: Column | str, w: WindowSpec) -> Column:
    """Position in force: decided one row earlier, flat before the first decision."""
    return F.coalesce(F.lag(col(position)).over(w), num(0))


def turnover(position: Column | str, w: WindowSpec) -> Column:
    return F.abs(col(position) - F.coalesce(F.lag(col(position)).over(w), num(0)))


def ffill(x: Column | str, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def state(enter: Column, leave: Column, w: WindowSpec) -> Column:
    """Two-event state machine: 1 from enter until leave; leave wins a tie; starts at 0.

    Exact while a row's enter and leave conditions exclude each other or leave
    is meant to win, because the last fired event then decides the state.
    """
    event = F.when(leave, num(0)).when(enter, num(1))
    return F.coalesce(ffill(event, w), num(0))


def median_fill(x: Column, value: Column | str, keys: list[str]) -> Column:
    """Fill warm-up nulls with the series' own median. Looks ahead: off by default everywhere."""
    return F.coalesce(x, F.percentile(value if isinstance(value, Column) else F.col(value), 0.5)
                      .over(W.partitionBy(*keys)))


def forward_log_vol(ret: Column | str, w: WindowSpec, horizon: int = 5) -> Column:
    """log RMS of the next ``horizon`` returns; null when one is absent."""
    ahead = [F.lead(col(ret), h).over(w) for h in range(1, horizon + 1)]
    total = ahead[0] * ahead[0]
    for a in ahead[1:]:
        total = total + a * a
    return F.ln(F.sqrt(total / num(horizon)))


def forward_min_z(log_price: Column, sigma: Column | str, w: WindowSpec, horizon: int = 5) -> Column:
    """Smallest forward move in units of sigma * sqrt(h); null when one is absent."""
    moves = [
        div(F.lead(log_price, h).over(w) - log_price, col(sigma) * F.sqrt(num(h)))
        for h in range(1, horizon + 1)
    ]
    known = moves[0].isNotNull()
    for m in moves[1:]:
        known = known & m.isNotNull()
    return F.when(known, F.least(*moves))


def cum_growth(ret: Column | str, w: WindowSpec) -> Column:
    """Running product of 1 + r."""
    return F.product(num(1) + col(ret)).over(w.rowsBetween(W.unboundedPreceding, 0))


def sequence_window(value: Column, w: WindowSpec, width: int, valid: Column) -> Column:
    """The last ``width`` values as an array, null unless every one of them is valid."""
    f = frame(w, width)
    return F.when(F.sum(valid.cast("int")).over(f) == width, F.collect_list(value).over(f))


def pct_rank(score: str, date: str, member: Column | None = None) -> Column:
    """Average-tie percent rank of a score within a date, among members only.

    Null scores and non-members get null and do not count.
    """
    s = F.col(score) if member is None else F.when(member, F.col(score))
    by_date = W.partitionBy(date)
    ordered = by_date.orderBy(s.asc_nulls_last())
    ties = W.partitionBy(F.col(date), s)
    average = F.rank().over(ordered) + (F.count(s).over(ties) - 1) / F.lit(2.0)
    return F.when(s.isNotNull(), average / F.count(s).over(by_date))


def first_tie_rank(score: Column | str, date: str, tie: str) -> Column:
    """Descending rank within a date; equal scores rank by the tie column."""
    return F.row_number().over(W.partitionBy(date).orderBy(col(score).desc_nulls_last(), tie))


# ---------------- sequential kernels (Arrow, one series per group) ----------------


def ewm(df: DataFrame, keys: list[str], order: str, value: list[str], n: str | int) -> DataFrame:
    """Recursive mean with alpha = 1/n, first value as seed, null carries the mean.

    Sequential within a series by nature; series run in parallel. ``n`` is a
    number or a column constant within the series. Adds ``<value>_ewm``.
    """
    fields = [*df.schema.fields, *[T.StructField(f"{v}_ewm", T.DoubleType()) for v in value]]

    def one(pdf):
        pdf = pdf.sort_values(order)
        span = float(pdf[n].iloc[0]) if isinstance(n, str) else float(n)
        for v in value:
            pdf[f"{v}_ewm"] = (
                pdf[v].astype(float).ewm(alpha=1.0 / span, adjust=False).mean()
            )
        return pdf

    return df.groupBy(*keys).applyInPandas(one, T.StructType(fields))


def expanding_pct_rank(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, min_rows: int = 60
) -> DataFrame:
    """Percent rank of each value among the rows up to it (average ties), per series.

    Each series is one bounded Arrow group kept sorted by bisection, n log n per
    series instead of the quadratic self range join.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def one(pdf):
        from bisect import bisect_left, bisect_right, insort

        pdf = pdf.sort_values(order)
        seen: list[float] = []
        ranks = []
        for x in pdf[value].to_numpy(dtype=float):
            if x != x:
                ranks.append(None)
                continue
            insort(seen, x)
            lo, hi = bisect_left(seen, x), bisect_right(seen, x)
            n = len(seen)
            ranks.append(((lo + 1 + hi) / 2.0) / n if n >= min_rows else None)
        pdf[out] = ranks
        pdf[out] = pdf[out].astype(float)
        return pdf

    return df.groupBy(*keys).applyInPandas(one, schema)


def hysteresis(
    df: DataFrame, keys: list[str], order: str, target: str, out: str, threshold: float = 0.02
) -> DataFrame:
    """Held value moves to the target only when they differ by more than the threshold.

    True path dependence, so one ordered fold per series; null targets count as 0.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def one(pdf):
        pdf = pdf.sort_values(order)
        now, path = 0.0, []
        for x in pdf[target].fillna(0.0).to_numpy(dtype=float):
            if abs(x - now) > threshold:
                now = x
            path.append(now)
        pdf[out] = path
        return pdf

    return df.groupBy(*keys).applyInPandas(one, schema)
