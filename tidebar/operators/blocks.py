"""Series operators that never put one whole series in one task.

A log table (trades, events, headlines) has no bound on rows per key: one key
may hold a third of the table. These operators cut a series into time blocks,
work inside blocks, and pass a one-row summary per block forward:

1. inside: a window partitioned by (keys, block);
2. across: an aggregate per (keys, block), combined map-side, then a window over
   those summaries (rows = blocks per key, bounded by the calendar);
3. an equi-join of the summaries back on (keys, block).

A calendar block can hold most of a log itself. With ``rows``, blocks above that many rows are cut again: their instants
are summed up to edges with about equally many rows between, so a day with 90% of all rows spreads like any other. One
count per block, combined map-side, tells which blocks these are. Rows of one instant stay together.

The results equal those of the plain unbounded window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import col
from tidebar.session import cut_lineage

BLOCK = "_block"
ROWS = 1 << 20  # rows of a calendar block above which it is cut
CUTS = 256  # parts of such a block


def with_blocks(df: DataFrame, keys: list[str], ts: str, span: str, rows: int | None = None) -> DataFrame:
    """Add ``_block``, a value that does not decrease with time: the calendar's ``span``, and above ``rows`` rows a part of it."""
    named = df.withColumn(BLOCK, F.date_trunc(span, F.col(ts)))
    if rows is None:
        return named
    parts = [*keys, BLOCK]
    large = cut_lineage(named.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).drop("_n"))
    if large.isEmpty():
        return named
    instant = F.col(ts).cast("timestamp").cast("double")
    edges = F.percentile_approx(instant, [i / CUTS for i in range(1, CUTS)], 20 * CUTS)
    times = _join_summary(named.select(*parts, ts), large.withColumn("_large", F.lit(True)), keys).where("_large")
    cuts = cut_lineage(times.groupBy(*parts).agg(edges.alias("_edges")))
    out = _join_summary(named, cuts, keys)
    return out.withColumn(BLOCK, F.struct(BLOCK, F.coalesce(_step(instant), F.lit(0)).alias("part"))).drop("_edges")


def _step(x: Column) -> Column:
    """Number of ``_edges`` below x, sought among every ``step``-th and then among the ``step`` behind it."""
    step = int(CUTS**0.5)
    coarse = F.transform(F.sequence(F.lit(step), F.greatest(F.size("_edges"), F.lit(step)), F.lit(step)), lambda i: F.get("_edges", i - 1))
    full = F.size(F.filter(coarse, lambda e: e < x))
    return full * step + F.size(F.filter(F.slice("_edges", full * step + 1, F.lit(step)), lambda e: e < x))


def _join_summary(inner: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe on keys, so rows with a null key keep their summary."""
    on = [inner[k].eqNullSafe(summary[k]) for k in [*keys, BLOCK]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = inner.join(summary, cond, "left")
    for k in [*keys, BLOCK]:
        joined = joined.drop(summary[k])
    return joined


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column | str],
    span: str = "month",
    block: Column | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``name`` = running sum of each value in ``order`` (first element is the time).

    ``block`` replaces the calendar block where the order is not a time; it must
    not decrease along the order.
    """
    d = with_blocks(df, keys, order[0], span, rows) if block is None else df.withColumn(BLOCK, block)
    for name, v in values.items():
        d = d.withColumn(f"_v_{name}", F.coalesce(col(v), F.lit(0.0)))
    totals = d.groupBy(*keys, BLOCK).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]
    )
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, BLOCK,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0.0)).alias(f"_c_{n}") for n in values],
    )
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = d.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_r_{n}") for n in values])
    out = _join_summary(inner, carried, keys)
    return out.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_r_{n}") + F.col(f"_c_{n}")).alias(n) for n in values],
    )


def row_positions(
    df: DataFrame, keys: list[str], order: list[str], out: str = "pos", span: str = "month", rows: int | None = None
) -> DataFrame:
    """1-based position of each row in its series."""
    d = with_blocks(df, keys, order[0], span, rows)
    totals = d.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_t"))
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, BLOCK, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_c"))
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order)
    inner = d.withColumn("_r", F.row_number().over(inside))
    out_df = _join_summary(inner, carried, keys)
    return out_df.select(*[F.col(c) for c in df.columns], (F.col("_r") + F.col("_c")).alias(out))


def rolling_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    width: int,
    exprs: Callable[[object], dict[str, Column]],
    rows_per_block: int = 65_536,
    span: str = "month",
) -> DataFrame:
    """Row-framed rolling expressions over a long series, split into row blocks.

    Each block is computed with the ``width - 1`` rows before it copied in as a
    halo, so at most ``width / rows_per_block`` of the rows move twice.
    """
    if rows_per_block < width:
        rows_per_block = width
    placed = row_positions(df, keys, order, "_pos", span)
    own = F.floor((F.col("_pos") - 1) / F.lit(rows_per_block)).cast("long")
    last = F.floor((F.col("_pos") - 1 + width - 1) / F.lit(rows_per_block)).cast("long")
    copies = placed.withColumn("_own", own).withColumn(BLOCK, F.explode(F.sequence("_own", last)))
    w = W.partitionBy(*keys, BLOCK).orderBy("_pos")
    made = exprs(w)
    done = copies.select("*", *[c.alias(n) for n, c in made.items()])
    return done.where(F.col("_own") == F.col(BLOCK)).select(*df.columns, *made)


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    span: str = "month",
    rows: int | None = None,
) -> DataFrame:
    """Add ``out`` = last non-null ``value`` at or before each row, per series."""
    d = with_blocks(df, keys, order[0], span, rows)
    inside = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    where = F.struct(*order)
    summary = d.groupBy(*keys, BLOCK).agg(
        *[
            F.max_by(F.col(v), F.when(F.col(v).isNotNull(), where)).alias(f"_s_{o}")
            for o, v in values.items()
        ]
    )
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *keys, BLOCK,
        *[F.last(f"_s_{o}", ignorenulls=True).over(earlier).alias(f"_c_{o}") for o in values],
    )
    inner = d.select(
        "*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_r_{o}") for o, v in values.items()]
    )
    out = _join_summary(inner, carried, keys)
    return out.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_r_{o}", f"_c_{o}").alias(o) for o in values],
    )


def value_blocks(x: str, n_blocks: int) -> tuple[Column, Column]:
    """(aggregate, block): edges with about equally many of a key's rows between them, and the block of ``x`` by these
    edges, which are to be found in ``_edges``.

    The edges may be approximate, as only the size of the blocks depends on them. They are sought in two steps,
    among every ``step``-th and then among the ``step`` behind it.
    """
    step = max(1, int(n_blocks**0.5))
    edges = F.percentile_approx(x, [i / n_blocks for i in range(1, n_blocks)], 20 * n_blocks)
    coarse = F.transform(
        F.sequence(F.lit(step), F.greatest(F.size("_edges"), F.lit(step)), F.lit(step)), lambda i: F.get("_edges", i - 1)
    )
    full = F.size(F.filter(coarse, lambda e: e < F.col(x)))
    rest = F.size(F.filter(F.slice("_edges", full * step + 1, F.lit(step)), lambda e: e < F.col(x)))
    return edges, (full * step + rest).cast("long")


def with_value_blocks(levels: DataFrame, keys: list[str], x: str, n_blocks: int) -> DataFrame:
    """Add ``_block``, which grows with ``x`` and holds about 1/``n_blocks`` of a key's rows."""
    edges, block = value_blocks(x, n_blocks)
    g = levels.groupBy(*keys) if keys else levels.groupBy()
    span = g.agg(edges.alias("_edges"))
    both = levels.join(span, keys) if keys else levels.crossJoin(F.broadcast(span))
    return both.withColumn(BLOCK, block).drop("_edges")


def quantiles(
    df: DataFrame, keys: list[str], value: Column | str, wanted: dict[str, float], n_blocks: int = 256
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, without gathering a key in one task.

    The ``percentile`` aggregate keeps every distinct value of a group in one
    buffer. Here equal values are counted first, the counts run up in blocks of about
    equally many distinct values, however far an outlier lies, and the two order
    statistics around each quantile are read off the counts.
    """
    v = df.select(*keys, col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    levels = v.groupBy(*keys, "_x").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    edges, block = value_blocks("_x", n_blocks)
    span = levels.groupBy(*keys).agg(F.sum("_c").cast("long").alias("_n"), edges.alias("_edges"))
    j = levels.join(span, keys).withColumn("_vb", block).drop("_edges")
    block = F.col("_vb")
    run = running_sum(j, keys, ["_x"], {"_cum": "_c"}, block=block)
    aggs = []
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (pos < F.col("_cum")) & (pos >= F.col("_cum") - F.col("_c"))
            aggs.append(F.max(F.when(here, F.col("_x"))).alias(f"_{name}_{side}"))
    out = run.groupBy(*keys, "_n").agg(*aggs)
    made = []
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        made.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*keys, F.col("_n").alias("n_values"), *made)
