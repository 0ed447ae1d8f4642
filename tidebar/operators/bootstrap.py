"""Reproducible bootstraps over blocks: draws are MD5 hashes of (seed, draw, block), so any task, retry, partitioning or
other engine produces the same sample.

A draw is a list of blocks, not of rows: its statistics follow from sums, or products, over index ranges of the series,
which are read off running totals at the blocks' ends. So a draw over T rows costs about T / (block length) rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.operators.metrics import sharpe_pp


def draw(*parts: Column | str | int) -> Column:
    """An integer in [0, 2^52): the first 13 hexadecimal digits of the parts' MD5, joined by a bar."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def _indexed(returns: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Rows with their index _i in the series and its length _t."""
    whole = W.partitionBy(*keys)
    at = (F.row_number().over(whole.orderBy(ts)) - 1).cast("bigint")
    return returns.select(*keys, at.alias("_i"), F.count(F.lit(1)).over(whole).cast("bigint").alias("_t"), *values)


def block_band(
    returns: DataFrame, keys: list[str], ts: str, ret: str, horizon: int,
    n_boot: int = 4000, block: int = 10, seed: int = 42,
) -> DataFrame:
    """Quantiles of the cumulative return over ``horizon`` bars from block resampling.

    The growth over the ``block`` rows from each index on is one frame per series; a path multiplies those of its drawn
    starts, the last one shortened to the horizon. At the end of a series shorter than a block, a block runs on from
    the first row.
    """
    rows = _indexed(returns.where(F.col(ret).isNotNull()), keys, ts, [ret])
    n_blocks = max(1, math.ceil(horizon / block))
    last = horizon - (n_blocks - 1) * block
    # rows behind the end, for short series: the series over again, once per block length
    r, i, t = F.col(ret).cast("double"), F.col("_i"), F.col("_t")
    again = F.sequence(F.lit(0).cast("bigint"), F.when(t < 2 * block, F.ceil(F.lit(block) / t)).otherwise(0).cast("bigint"))
    long = rows.select(*keys, "_t", r.alias("_r"), F.explode(again).alias("_lap"), i.alias("_first")).withColumn("_i", F.col("_first") + F.col("_lap") * t)
    w = W.partitionBy(*keys).orderBy("_i")
    growth = lambda n: F.product(num(1) + F.col("_r")).over(w.rowsBetween(0, n - 1))
    starts = long.select(*keys, "_lap", "_i", "_t", growth(block).alias("_full"), growth(last).alias("_part")).where("_lap = 0")
    size = rows.groupBy(*keys).agg(F.max("_t").alias("_t")) if keys else rows.agg(F.max("_t").alias("_t"))
    paths = returns.sparkSession.range(n_boot).select(F.col("id").alias("_path"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_b"))
    room = F.greatest(F.lit(1).cast("bigint"), t - F.lit(block))
    drawn = size.where("_t > 0").crossJoin(F.broadcast(paths)).select(*keys, "_path", "_b", (draw(seed, F.col("_path"), F.col("_b")) % room).alias("_i"))
    met = drawn.join(starts.drop("_t", "_lap"), [*keys, "_i"])
    step = F.when(F.col("_b") == n_blocks - 1, F.col("_part")).otherwise(F.col("_full"))
    # multiplied up in the path's own order: a product in arrival order differs in its last bits from run to run
    sims = met.groupBy(*keys, "_path").agg(F.array_sort(F.collect_list(F.struct("_b", step.alias("_g")))).alias("_s"))
    sims = sims.withColumn("_sim", F.aggregate("_s", num(1), lambda acc, x: acc * x["_g"]) - num(1))
    g = sims.groupBy(*keys) if keys else sims.groupBy()
    names = {"p2_5": 0.025, "p10": 0.10, "p50": 0.50, "p90": 0.90, "p97_5": 0.975}
    return g.agg(*[F.percentile("_sim", q).alias(n) for n, q in names.items()], F.count(F.lit(1)).alias("n_paths"))


def paired_test(
    pairs: DataFrame, keys: list[str], ts: str, a: str, b: str,
    n_boot: int = 2000, mean_block: float = 20.0, seed: int = 7, min_rows: int = 100,
) -> DataFrame:
    """Paired stationary bootstrap of the Sharpe and mean difference of a over b.

    Blocks have a random start and a geometric length of mean ``mean_block``; a draw takes blocks until it has as many
    rows as the series, and the last of the blocks at hand runs on to the end. Sums over a block, which may pass the end
    of the series and go on at its beginning, are differences of running sums about the series' means.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    whole = W.partitionBy(*keys)
    rows = _indexed(both, keys, ts, [F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")]).where(F.col("_t") >= min_rows)
    rows = rows.withColumns({"_ma": F.avg("_a").over(whole), "_mb": F.avg("_b").over(whole)})
    x, y = F.col("_a") - F.col("_ma"), F.col("_b") - F.col("_mb")
    upto = whole.orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    sums = {"sa": x, "sb": y, "qa": x * x, "qb": y * y}
    run = F.struct(*[F.sum(v).over(upto).alias(n) for n, v in sums.items()])
    ends = rows.select(*keys, (F.col("_i") + 1).alias("_at"), run.alias("_s"))  # what lies before index _at
    size = rows.groupBy(*keys).agg(F.max("_t").alias("_t"), F.max("_ma").alias("_ma"), F.max("_mb").alias("_mb"))
    n_blocks = F.ceil(F.lit(1.5 / mean_block) * F.col("_t")).cast("int") + 40
    draws = pairs.sparkSession.range(n_boot).select(F.col("id").alias("_draw"))
    t, j, d = F.col("_t"), F.col("_j"), F.col("_draw")
    grid = size.crossJoin(F.broadcast(draws)).withColumn("_last", n_blocks - 1).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    u = (draw(seed, d, j, "l") + num(0.5)) / num(float(1 << 52))
    length = (F.floor(F.ln(u) / num(math.log(1 - 1 / mean_block))) + 1).cast("bigint")
    grid = grid.select(*keys, "_draw", "_t", "_ma", "_mb", "_last", "_j", (draw(seed, d, j, "s") % t).alias("_start"), length.alias("_len"))
    before = F.coalesce(F.sum("_len").over(W.partitionBy(*keys, "_draw").orderBy("_j").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = grid.withColumn("_done", before).where(F.col("_done") < t)
    takes = F.when(j == F.col("_last"), t - F.col("_done")).otherwise(F.least("_len", t - F.col("_done")))
    used = used.withColumn("_end", F.col("_start") + takes)
    # a block's sums: up to its end, less up to its start, and for what passes the end of the series from its beginning
    over = F.col("_end") > t
    edges = F.array(
        F.struct(F.col("_start").alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.least("_end", "_t").alias("_at"), F.lit(1).alias("_sign")),
        F.struct(F.when(over, F.col("_end") - t).otherwise(0).alias("_at"), F.lit(1).alias("_sign")),
    )
    asked = used.select(*keys, "_draw", "_t", "_ma", "_mb", F.inline(edges)).where("_at > 0")
    total = [F.sum(F.col("_sign") * F.col(f"_s.{n}")).alias(n) for n in sums]
    per = asked.join(ends, [*keys, "_at"]).groupBy(*keys, "_draw", "_t", "_ma", "_mb").agg(*total)

    def ratio(side: str) -> Column:
        """Sharpe ratio per period of a draw, from its sums about the series' mean."""
        s, q = F.col(f"s{side}"), F.col(f"q{side}")
        var = (q - s * s / t) / (t - 1)
        return F.when(var <= 0, num(0)).otherwise((F.col(f"_m{side}") + s / t) / F.sqrt(var))

    mean = (F.col("_ma") - F.col("_mb")) + (F.col("sa") - F.col("sb")) / t
    per = per.select(*keys, (ratio("a") - ratio("b")).alias("_d_sr"), mean.alias("_d_mu"))
    g = per.groupBy(*keys) if keys else per.groupBy()
    tests = g.agg(
        F.avg((F.col("_d_sr") <= 0).cast("double")).alias("sharpe_p"),
        F.avg((F.col("_d_mu") <= 0).cast("double")).alias("mean_p"),
    )
    o = both.groupBy(*keys) if keys else both.groupBy()
    observed = o.agg(
        F.count(F.lit(1)).alias("n"), (sharpe_pp(a) - sharpe_pp(b)).alias("sharpe_diff"),
        F.avg(F.col(a) - F.col(b)).alias("mean_diff"),
    )
    return observed.join(tests, keys, "left") if keys else observed.crossJoin(tests)
