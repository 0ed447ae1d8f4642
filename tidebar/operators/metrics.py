"""Performance statistics over long return tables.

``ret`` is a per-bar net return; keys name the series. Null returns are ignored.
All moments are ordinary aggregates, so they combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import col, num
from tidebar.functions.normal import expected_max_sharpe, normal_cdf
from tidebar.operators.blocks import BLOCK, quantiles, running_sum, with_value_blocks

BARS_PER_YEAR = {"1d": 365, "4h": 6 * 365, "1h": 24 * 365}


def sharpe_pp(ret: Column | str) -> Column:
    """Per-period Sharpe ratio; 0 below three observations or without dispersion."""
    sd = F.stddev_samp(col(ret))
    return F.when((F.count(col(ret)) < 3) | (sd == 0), num(0)).otherwise(
        F.coalesce(F.try_divide(F.avg(col(ret)), sd), num(0))
    )


def merged_moments(parts: Column) -> Column:
    """(n, mean, m2) of an array of such, n above 0 in each; m2 is the sum of squared deviations from the mean.

    Means are moved by their difference, so equal ones stay exactly equal.
    """
    def merge(a: Column, b: Column) -> Column:
        n, delta = a["n"] + b["n"], b["mean"] - a["mean"]
        mean = a["mean"] + F.when(n > 0, delta * b["n"] / n).otherwise(num(0))
        m2 = a["m2"] + b["m2"] + F.when(n > 0, delta * delta * a["n"] * b["n"] / n).otherwise(num(0))
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), num(0).alias("mean"), num(0).alias("m2"))
    return F.aggregate(F.slice(parts, 2, 1 << 30), F.coalesce(F.get(parts, F.lit(0)), zero), merge)


def sharpe_of_moments(parts: Column) -> Column:
    """``sharpe_pp`` of the rows that an array of moments stands for."""
    m = merged_moments(parts)
    sd = F.sqrt(m["m2"] / F.nullif(m["n"] - 1, F.lit(0)))
    return F.when((m["n"] < 3) | (sd == 0), num(0)).otherwise(F.coalesce(F.try_divide(m["mean"], sd), num(0)))


def sharpe(ret: Column | str, timeframe: str = "1d") -> Column:
    return sharpe_pp(ret) * F.sqrt(num(BARS_PER_YEAR[timeframe]))


def growth(ret: Column | str) -> Column:
    return F.product(num(1) + col(ret))


def cagr(ret: Column | str, timeframe: str = "1d") -> Column:
    """Annualised growth; -1 once the product of growth factors is not positive."""
    total, n = growth(ret), F.count(col(ret))
    years = F.greatest(n / num(BARS_PER_YEAR[timeframe]), num(1e-9))
    return (
        F.when(n == 0, num(0)).when(total <= 0, num(-1)).otherwise(F.pow(total, num(1) / years) - num(1))
    )


def ann_vol(ret: Column | str, timeframe: str = "1d") -> Column:
    return F.when(
        F.count(col(ret)) > 2, F.stddev_samp(col(ret)) * F.sqrt(num(BARS_PER_YEAR[timeframe]))
    ).otherwise(num(0))


def with_drawdown(df: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """Add equity (running product), its running peak and the drawdown."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    eq = df.where(F.col(ret).isNotNull()).withColumn("equity", F.product(num(1) + F.col(ret)).over(w))
    peaked = eq.withColumn("peak", F.max("equity").over(w))
    return peaked.withColumn("drawdown", F.try_divide(F.col("equity"), F.col("peak")) - num(1))


def summary(df: DataFrame, keys: list[str], order: str, ret: str = "net", timeframe: str = "1d") -> DataFrame:
    """Sharpe, CAGR, volatility, maximum drawdown and bar count per series."""
    return with_drawdown(df, keys, order, ret).groupBy(*keys).agg(
        sharpe(ret, timeframe).alias("sharpe"),
        (num(100) * cagr(ret, timeframe)).alias("cagr_pct"),
        (num(100) * ann_vol(ret, timeframe)).alias("ann_vol_pct"),
        (num(100) * F.coalesce(F.min("drawdown"), num(0))).alias("max_dd_pct"),
        F.count(ret).alias("n_bars"),
    )


def rounded_summary(s: DataFrame) -> DataFrame:
    return s.withColumns(
        {
            "sharpe": F.round("sharpe", 2), "cagr_pct": F.round("cagr_pct", 1),
            "ann_vol_pct": F.round("ann_vol_pct", 1), "max_dd_pct": F.round("max_dd_pct", 1),
        }
    )


def downside(df: DataFrame, keys: list[str], ret: str = "net", q: float = 0.05) -> DataFrame:
    """Sortino ratio and expected shortfall of the worst ``q`` share of bars."""
    cut = quantiles(df, keys, ret, {"_q": q}).drop("n_values")
    r = F.col(ret)
    loss = F.when(r < 0, r)
    sd = F.stddev_samp(loss)
    sortino = F.when((F.count(loss) < 3) | (sd == 0), num(0)).otherwise(
        F.try_divide(F.avg(r), sd) * F.sqrt(num(365))
    )
    tail = F.when(r <= F.col("_q"), r)
    return df.join(cut, keys).groupBy(*keys).agg(
        sortino.alias("sortino"), (num(100) * F.coalesce(F.avg(tail), num(0))).alias("es_pct")
    )


def trial_variance(per_trial: DataFrame, keys: list[str], sr: str = "sr") -> DataFrame:
    g = per_trial.groupBy(*keys) if keys else per_trial.groupBy()
    return g.agg(
        F.coalesce(F.var_samp(sr), num(0)).alias("sr_variance"), F.count(sr).alias("n_trials")
    )


def moments(df: DataFrame, keys: list[str], ret: str = "net") -> DataFrame:
    """Count, per-period Sharpe and the bias-corrected skewness and excess kurtosis."""
    n = F.count(ret).cast("double")
    g1, g2 = F.skewness(ret), F.kurtosis(ret)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, num(0)))
    kurt = F.when(
        n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), num(0)) * ((n + 1) * g2 + num(6))
    )
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(
        F.count(ret).alias("n"), sharpe_pp(ret).alias("sr"),
        F.coalesce(skew, num(0)).alias("skew"), F.coalesce(kurt, num(0)).alias("ex_kurt"),
    )


def deflated_z(m: DataFrame, n_trials: int, variance: Column | str) -> Column:
    """z statistic of the Deflated Sharpe Ratio on a ``moments`` row."""
    sr, n = F.col("sr"), F.col("n")
    sr0 = expected_max_sharpe(n_trials, col(variance))
    inner = num(1) - F.col("skew") * sr + (F.col("ex_kurt") + num(2)) / num(4) * sr * sr
    return (sr - sr0) * F.sqrt((n - 1).cast("double")) / F.sqrt(F.greatest(inner, num(1e-12)))


def deflated_sharpe(m: DataFrame, n_trials: int, variance: Column | str, out: str = "dsr") -> DataFrame:
    """Confidence that the Sharpe beats the best of ``n_trials`` lucky ones; 0 under 20 bars."""
    z = m.withColumn("_z", deflated_z(m, n_trials, variance))
    return z.withColumn(out, F.when(F.col("n") < 20, num(0)).otherwise(normal_cdf("_z"))).drop("_z")


def pbo(
    df: DataFrame, keys: list[str], variant: str, variant_order: str, ts: str, ret: str, n_blocks: int = 10
) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    Returns become ten block moments per variant; each of the C(10, 5) half
    splits then works on those moments alone, so the returns are read once and
    what is crossed with the splits is ten numbers per variant.
    """
    data = df.where(F.col(ret).isNotNull())
    grid = data.select(*keys, ts).distinct()
    by_key = W.partitionBy(*keys).orderBy(ts)
    grid = grid.withColumn("_b", F.ntile(n_blocks).over(by_key))
    sizes = grid.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    size_map = sizes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_b", "_n"))).alias("_sizes"), F.sum("_n").alias("n_bars")
    )
    cells = (
        data.join(grid, [*keys, ts])
        .groupBy(*keys, variant, variant_order, "_b")
        .agg(F.count(ret).alias("_c"), F.sum(ret).alias("_s"), (F.var_pop(ret) * F.count(ret)).alias("_q"))
    )
    per_variant = cells.groupBy(*keys, variant, variant_order).agg(
        F.collect_list(F.struct("_b", "_c", "_s", "_q")).alias("_cells")
    )
    masks = (
        df.sparkSession.range(1 << n_blocks)
        .where(F.bit_count("id") == n_blocks // 2)
        .select(F.col("id").alias("_mask"))
    )
    crossed = per_variant.join(size_map, keys).crossJoin(F.broadcast(masks))

    def inside(arr: str, train: bool) -> Column:
        want = F.lit(1 if train else 0)
        bit = lambda e: F.call_function("getbit", F.col("_mask"), (e["_b"] - 1).cast("int")).cast("int")
        return F.filter(arr, lambda e: bit(e) == want)

    def total(arr: Column, field: str) -> Column:
        return F.aggregate(arr, num(0), lambda acc, e: acc + e[field].cast("double"))

    sides = {"tr": True, "te": False}
    for s, train in sides.items():
        cells, n = inside("_cells", train), total(inside("_sizes", train), "_n")
        crossed = crossed.withColumns({f"_c{s}": cells, f"_n{s}": n})
        crossed = crossed.withColumn(f"_m{s}", total(F.col(f"_c{s}"), "_s") / F.col(f"_n{s}"))

    def half(s: str) -> Column:
        n, mean = F.col(f"_n{s}"), F.col(f"_m{s}")

        # squared deviations of the blocks and of their means; a bar without a return counts as 0
        def spread(acc: Column, e: Column) -> Column:
            gap = e["_s"] / e["_c"] - mean
            return acc + e["_q"] + e["_c"] * (gap * gap - mean * mean)

        var = F.greatest(F.aggregate(f"_c{s}", n * mean * mean, spread) / (n - 1), num(0))
        # sums differ in the last bits with the order of addition: equal columns must tie
        sr = F.when(var > 0, mean / F.sqrt(var)).otherwise(num(0))
        return F.round(sr, 10)

    usable = (F.col("n_bars") >= n_blocks * 5) & (F.col("_trials") >= 2)
    halves = crossed.select(
        *keys, "_mask", "n_bars", F.struct(
            half("tr").alias("tr"), (-F.col(variant_order)).alias("o"), half("te").alias("te")
        ).alias("_e"),
    )
    splits = halves.groupBy(*keys, "_mask", "n_bars").agg(
        F.max_by(F.col("_e.te"), F.struct("_e.tr", "_e.o")).alias("_best"),
        F.collect_list("_e.te").alias("_te"),
    )
    less = F.size(F.filter("_te", lambda x: x < F.col("_best")))
    same = F.size(F.filter("_te", lambda x: x == F.col("_best")))
    omega = (less + F.lit(0.5) * same) / F.size("_te")
    g = splits.groupBy(*keys, "n_bars") if keys else splits.groupBy("n_bars")
    out = g.agg(
        F.avg((omega < 0.5).cast("double")).alias("_p"),
        F.count(F.lit(1)).alias("n_splits"), F.max(F.size("_te")).alias("_trials"),
    )
    return out.select(*keys, "n_splits", F.when(usable, F.col("_p")).alias("pbo"))


def average_precision(
    df: DataFrame, keys: list[str], label: str, score: str, min_rows: int = 20
) -> DataFrame:
    """Average precision (ties grouped by score) and Brier score per group.

    Null unless there are more than ``min_rows`` scored rows and both classes.
    Rows are first summed per distinct score; the cumulative counts then run in
    blocks of about equally many scores, so a group of any size spreads over tasks.
    """
    ok = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    # one score level per group: counts of rows and of positives
    levels = ok.groupBy(*keys, (-F.col(score)).alias("_neg")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(label).cast("double").alias("_pos")
    )
    levels = with_value_blocks(levels, keys, "_neg", 256)
    cum = running_sum(levels, keys, ["_neg"], {"_cn": "_n", "_cp": "_pos"}, block=F.col(BLOCK))
    ap = cum.groupBy(*keys).agg(
        F.sum(F.col("_pos") * F.try_divide(F.col("_cp"), F.col("_cn"))).alias("_apn"),
        F.sum("_n").alias("_rows"), F.sum("_pos").alias("_p"),
    )
    brier = ok.groupBy(*keys).agg(
        F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("_brier")
    )
    good = (F.col("_rows") > min_rows) & (F.col("_p") > 0) & (F.col("_p") < F.col("_rows"))
    return ap.join(brier, keys).select(
        *keys,
        F.col("_rows").cast("long").alias("n"),
        F.when(good, F.try_divide(F.col("_apn"), F.col("_p"))).alias("pr_auc"),
        F.when(good, F.col("_brier")).alias("brier"),
    )
