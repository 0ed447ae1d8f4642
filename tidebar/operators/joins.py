"""Point-in-time, interval, spine and alignment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import col, num
from tidebar.functions.times import hours_before, plus_days, seconds
from tidebar.operators.blocks import BLOCK, ROWS, carry_forward

def asof_many(
    left: DataFrame,
    rights: list[tuple[DataFrame, str, dict[str, str]]],
    left_ts: str,
    by: list[str] | None = None,
    max_age_hours: float | None = None,
    span: str = "month",
    tie: list[str] | None = None,
    bounded: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Backward as-of join of several right tables at once.

    Each entry of ``rights`` is (table, its time column, {output name: column}).
    All sides are unioned and forward-filled together, so any number of right
    tables costs one pass: no range join, and no task that holds a whole key,
    since the fill runs in time blocks; without keys, or with ``rows``, blocks above
    so many rows are cut again. ``bounded`` declares that a key's rows are
    limited by the calendar (daily decisions, sessions); then a single window is
    the cheaper plan. Right rows sort before left rows at equal time; ``tie``
    orders right rows of equal time. An older match than ``max_age_hours`` is null.
    """
    tie = tie or []
    keys = by or ["_all"]
    prep = (lambda d: d) if by else (lambda d: d.withColumn("_all", F.lit(1)))
    lhs = prep(left)
    none = [F.lit(None).cast("string") for _ in tie]
    parts = [
        lhs.select(
            *keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
            *[n.alias(f"_tie{i}") for i, n in enumerate(none)],
            F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
        )
    ]
    for i, (right, right_ts, cols) in enumerate(rights):
        payload = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c).alias(o) for o, c in cols.items()])
        parts.append(
            prep(right).where(F.col(right_ts).isNotNull()).select(
                *keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
                *[F.col(c).alias(f"_tie{j}") for j, c in enumerate(tie)], payload.alias(f"_r{i}"),
            )
        )
    both = parts[0]
    if tie:
        for j, c in enumerate(tie):
            both = both.withColumn(f"_tie{j}", F.lit(None).cast(rights[0][0].schema[c].dataType))
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_tie{j}" for j in range(len(tie))]]
    hits = {f"_h{i}": f"_r{i}" for i in range(len(rights))}
    if bounded:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        filled = both.select("*", *[F.last(r, ignorenulls=True).over(w).alias(h) for h, r in hits.items()])
    else:
        filled = carry_forward(both, keys, order, hits, span, rows if by or rows else ROWS)
    out = filled.where(F.col("_side") == 1)
    picked = []
    for i, (_, _, cols) in enumerate(rights):
        hit = F.col(f"_h{i}")
        if max_age_hours is not None:
            hit = F.when(hit["_rts"] >= hours_before(F.col("_t"), max_age_hours), hit)
        picked += [hit[o].alias(o) for o in cols]
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns], *picked)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    by: list[str] | None = None,
    cols: list[str] | None = None,
    max_age_hours: float | None = None,
    span: str = "month",
    tie: list[str] | None = None,
    bounded: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Backward as-of join: for each left row the latest right row at or before it.

    A right column whose name the left table already has gets the suffix ``_right``.
    """
    cols = cols or [c for c in right.columns if c not in (by or [])]
    names = {(f"{c}_right" if c in left.columns else c): c for c in cols}
    return asof_many(left, [(right, right_ts, names)], left_ts, by, max_age_hours, span, tie, bounded, rows)


def asof_top_k(
    days: DataFrame, rows: DataFrame, day: str, row_day: str, by: str, k: int
) -> DataFrame:
    """For each day and key, the last ``k`` rows at or before the day.

    Only distinct days meet rows, and only rows that can still be among the last
    ``k``: each row serves the days from its own until its ``k``-th successor, an
    interval, so a day finds its rows by carrying an array of k payloads forward.
    """
    w = W.partitionBy(by).orderBy(row_day)
    payload = F.struct(*[F.col(c) for c in rows.columns])
    trailing = rows.select(
        by, row_day, F.collect_list(payload).over(w.rowsBetween(-(k - 1), 0)).alias("_last")
    )
    keys = rows.select(by).distinct()
    spine = days.select(day).distinct().crossJoin(keys)
    hit = asof_join(spine, trailing, day, row_day, [by], ["_last"])
    exploded = hit.select(day, F.explode("_last").alias("_r"))
    return exploded.select(day, "_r.*")


def event_gate(
    points: DataFrame, events: DataFrame, at: str = "ts", before_hours: float = 36, after_hours: float = 1,
    span: str = "month",
) -> DataFrame:
    """Per distinct instant: is a scheduled event near, and which one comes first.

    An instant asks twice on the events' time line: how many events lie before its window opens, and how many
    until it closes. The difference is the number of near events, and the first event after the opening is the
    first near one. Running counts in time blocks answer both, so no (instant, event) pair is ever formed. The
    windows over blocks see one row per ``span``.
    """
    asks = F.array(
        F.struct(hours_before(F.col(at), after_hours).alias("_t"), F.lit(0).alias("_side")),
        F.struct(hours_before(F.col(at), -before_hours).alias("_t"), F.lit(2).alias("_side")),
    )
    asked = points.select(at).distinct().select(at, F.inline(asks))
    known = events.where(F.col("utc").isNotNull()).groupBy("utc").agg(
        F.min(F.struct("utc", "name")).alias("_e"), F.count(F.lit(1)).alias("_n")
    )
    listed = known.select(F.col("utc").alias("_t"), F.lit(1).alias("_side"), "_e", "_n")
    line = asked.unionByName(listed, allowMissingColumns=True).withColumn(BLOCK, F.date_trunc(span, "_t"))
    per = line.groupBy(BLOCK).agg(F.sum("_n").alias("_bn"), F.min("_e").alias("_be"))
    earlier = W.orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    later = W.orderBy(F.col(BLOCK).desc()).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(BLOCK, F.sum("_bn").over(earlier).alias("_bn"), F.min("_be").over(later).alias("_be"))
    up = W.partitionBy(BLOCK).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(BLOCK).orderBy(F.col("_t").desc(), F.col("_side").desc()).rowsBetween(W.unboundedPreceding, 0)
    line = line.select(
        at, "_side", BLOCK, F.sum("_n").over(up).alias("_un"), F.last("_e", ignorenulls=True).over(down).alias("_de")
    ).where(F.col("_side") != 1)
    line = line.join(per, BLOCK, "left").withColumns(
        {"_upto": F.coalesce("_un", F.lit(0)) + F.coalesce("_bn", F.lit(0)), "_next": F.coalesce("_de", "_be")}
    )
    opens, closes = F.col("_side") == 0, F.col("_side") == 2
    both = line.groupBy(at).agg(
        (F.max(F.when(closes, F.col("_upto"))) - F.max(F.when(opens, F.col("_upto")))).alias("n_events"),
        F.max(F.when(opens, F.col("_next"))).alias("_e"),
    )
    near = F.col("n_events") > 0
    return both.select(
        at, near.alias("blocked"), F.when(near, F.col("_e.name")).alias("event_name"),
        F.when(near, F.col("_e.utc")).alias("event_utc"), "n_events",
    )


def fill_join(left: DataFrame, right: DataFrame, on: list[str], fill: dict[str, float]) -> DataFrame:
    """Left equi-join with default values for rows without a partner."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), num(v)) for c, v in fill.items()})


def align_outer(df: DataFrame, date: str, key: str, value: str) -> DataFrame:
    """Every (date, key) cell of the observed dates and keys; absent cells stay null."""
    spine = df.select(date).distinct().crossJoin(df.select(key).distinct())
    return spine.join(df.select(date, key, value), [date, key], "left")


def complete_dates(df: DataFrame, date: str, key: str, value: str) -> DataFrame:
    """Dates on which every key of the table has a value."""
    n_keys = df.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    per_date = df.where(F.col(value).isNotNull()).groupBy(date).agg(F.countDistinct(key).alias("_have"))
    return per_date.crossJoin(F.broadcast(n_keys)).where("_have = _n").select(date)


def missing_days(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """UTC days with no row at all between a series' first and last day."""
    present = df.select(*keys, F.col(ts).cast("date").alias("day")).distinct()
    span = present.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    spine = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    return spine.join(present, [*keys, "day"], "left_anti")


def missing_cells(days: DataFrame, keys: DataFrame, valid: DataFrame, on: list[str]) -> DataFrame:
    """(day, key) cells of the spine without a valid row."""
    return days.crossJoin(keys).join(valid.select(*on), on, "left_anti")


def compare_sources(ours: DataFrame, theirs: DataFrame, on: list[str], value: str) -> DataFrame:
    """Inner join of two sources with the absolute deviation in percent of the second."""
    a = ours.select(*on, F.col(value).alias("ours")).where("ours is not null")
    b = theirs.select(*on, F.col(value).alias("theirs")).where("theirs is not null")
    gap = F.abs(F.col("ours") - F.col("theirs"))
    return a.join(b, on).withColumn("diff_pct", F.try_divide(num(100) * gap, F.col("theirs")))


def source_fill(
    primary: DataFrame, secondary: DataFrame, key: str, ts: str, through: Column
) -> DataFrame:
    """Primary rows, then secondary rows after each key's last primary row, up to a limit."""
    last = primary.groupBy(key).agg(F.max(ts).alias("_last"))
    tail = (
        secondary.join(last, key)
        .where((F.col(ts) > F.col("_last")) & (F.col(ts) <= through))
        .drop("_last")
        .withColumn("quote_volume", F.col("volume") * F.col("close"))
    )
    return primary.withColumn("origin", F.lit("primary")).unionByName(
        tail.withColumn("origin", F.lit("secondary")), allowMissingColumns=True
    )


def next_on_spine(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Value of the same key on the next date of the shared date grid, null if absent there.

    The grid's successor map is built from distinct dates (bounded by the calendar).
    """
    dates = df.select(date).distinct()
    succ = dates.withColumn("_next", F.lead(date).over(W.orderBy(date)))
    ahead = df.select(key, F.col(date).alias("_next"), F.col(value).alias("_ahead"))
    return (
        df.join(F.broadcast(succ), date, "left")
        .join(ahead, [key, "_next"], "left")
        .drop("_next")
        .withColumnRenamed("_ahead", f"{value}_next")
    )


__all__ = [
    "align_outer", "asof_join", "asof_many", "asof_top_k", "col", "compare_sources",
    "complete_dates", "event_gate", "fill_join",
    "missing_cells", "missing_days", "next_on_spine", "plus_days", "seconds", "source_fill",
]
