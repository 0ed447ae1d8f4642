"""Walk-forward selection and date-fold schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import col, num
from tidebar.operators import metrics
from tidebar.operators.selection import best_variant

TRAIN_BARS, TEST_BARS, MIN_TEST_BARS = 730, 182, 30


def fold_bounds(
    bar_counts: DataFrame, keys: list[str], train: int, test: int, min_test: int
) -> DataFrame:
    """Folds of each series: train rows (test_from - train, test_from], test rows up to test_to."""
    n = F.col("n_bars")
    k_max = F.floor((n - train - 1) / F.lit(test)).cast("int")
    folds = F.when(n > train, F.sequence(F.lit(0), k_max)).otherwise(F.array().cast("array<int>"))
    out = bar_counts.select(*keys, "n_bars", F.explode(folds).alias("fold"))
    lo = (F.lit(train) + F.col("fold") * F.lit(test)).cast("long")
    out = out.withColumn("test_from", lo).withColumn("test_to", F.least(lo + F.lit(test), F.col("n_bars")))
    return out.where(F.col("test_to") - F.col("test_from") >= min_test)


def walk_forward(
    returns: DataFrame,
    keys: list[str],
    ts: str = "ts",
    variant: str = "params",
    order: str = "grid_order",
    ret: str = "net",
    train: int = TRAIN_BARS,
    test: int = TEST_BARS,
    min_test: int = MIN_TEST_BARS,
) -> tuple[DataFrame, DataFrame]:
    """(stitched out-of-sample returns, fold ledger).

    Bars are cut where any fold begins or ends to train, so a piece lies in a train window whole or not at all. Each
    piece is summed up once, to moments that merge without cancellation (count, mean, squared deviations), and only these
    are dealt to the folds that it trains: no bar is copied. A piece of a test window also keeps its rows, of which the
    best variant's are unpacked. All this follows one pass over the trials, dealt by series and variant. The best variant
    by train Sharpe is deployed when its Sharpe is positive; else flat.
    """
    w = W.partitionBy(*keys, variant).orderBy(ts)
    numbered = returns.select(
        *keys, variant, order, ts, ret, (F.row_number().over(w) - 1).cast("long").alias("_i"),
        F.count(F.lit(1)).over(W.partitionBy(*keys, variant)).cast("long").alias("_bars"),
    )
    i, n, lo = F.col("_i"), F.count(col(ret)), F.col("_lo")
    mean = F.when(F.min(ret) == F.max(ret), F.min(ret)).otherwise(F.avg(ret))  # equal returns have no dispersion at all
    pieces = numbered.groupBy(
        *keys, variant, order, F.floor(i / F.lit(test)).alias("_start"),
        F.when(i >= train, F.floor((i - train) / F.lit(test)).cast("int")).alias("_test"),
    ).agg(
        F.max("_bars").alias("_bars"), F.min("_i").alias("_lo"),
        F.struct(n.alias("n"), mean.alias("mean"), (F.var_pop(ret) * n).alias("m2")).alias("_m"),
        F.when(F.min("_i") >= train, F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(ret).alias("ret")))).alias("_rows"),
    )

    def live(fold: Column) -> Column:
        at = F.lit(train) + fold * F.lit(test)
        return (at < F.col("_bars")) & (F.least(at + test, F.col("_bars")) - at >= min_test)

    first = F.greatest(F.lit(0), F.ceil((lo - train + 1) / F.lit(test)).cast("int"))
    trained = F.filter(
        F.sequence(first, F.greatest(first, F.floor(lo / F.lit(test)).cast("int"))),
        lambda k: (k * test <= lo) & (lo < k * test + train) & live(k),
    )
    none = F.lit(None).cast("int")
    roles = F.concat(
        F.transform(trained, lambda k: F.struct(k.alias("fold"), F.lit(True).alias("train"))),
        F.filter(F.array(F.struct(F.coalesce("_test", none).alias("fold"), F.lit(False).alias("train"))), lambda r: r["fold"].isNotNull() & live(r["fold"])),
    )
    dealt = pieces.withColumn("_r", F.explode(roles))
    trains = F.col("_r.train")
    scored = dealt.groupBy(*keys, F.col("_r.fold").alias("fold"), variant, order).agg(
        F.collect_list(F.when(trains & (F.col("_m.n") > 0), F.col("_m"))).alias("_parts"),
        F.flatten(F.collect_list(F.when(~trains, F.col("_rows")))).alias("_rows"),
    ).withColumn("train_sr", metrics.sharpe_of_moments(F.col("_parts")))
    chosen = best_variant(scored, [*keys, "fold"], "train_sr", order, [variant, "_rows"])
    rows = chosen.withColumn("deployed", F.col("train_sr") > 0).withColumn("_row", F.explode("_rows"))
    oos = rows.select(
        *keys, "fold", F.col("_row.ts").alias(ts),
        F.when(F.col("deployed"), F.col(variant)).otherwise(F.lit("(flat)")).alias("chosen"),
        F.when(F.col("deployed"), F.col("_row.ret")).otherwise(num(0)).alias(ret),
        "train_sr", "deployed",
    )
    ledger = oos.groupBy(*keys, "fold", "chosen", "train_sr", "deployed").agg(
        F.min(ts).alias("fold_start"), F.max(ts).alias("fold_end"),
        metrics.sharpe_pp(ret).alias("oos_sr"), F.count(F.lit(1)).alias("n_test"),
    )
    return oos.select(*keys, "fold", ts, ret), ledger


def fold_schedule(
    bounds: DataFrame, train_days: int, val_days: int = 182, test_days: int = 182, stop_days: int = 30
) -> DataFrame:
    """Expanding date folds from one-row-per-key (t0, t_end).

    Fold k trains up to t0 + train_days + k*test_days, validates for val_days and
    tests for test_days; it exists while validation ends more than ``stop_days``
    before t_end.
    """
    keys = [c for c in bounds.columns if c not in ("t0", "t_end")]
    span = F.datediff("t_end", "t0")
    k_max = F.greatest(F.lit(0), F.floor((span - train_days - val_days) / F.lit(test_days))).cast("int")
    step = lambda n: F.make_dt_interval(n)
    out = bounds.select("*", F.explode(F.sequence(F.lit(0), k_max)).alias("fold"))
    k = F.col("fold")
    out = out.withColumn("train_end", F.col("t0") + step(F.lit(train_days) + k * F.lit(test_days)))
    out = out.withColumn("val_end", F.col("train_end") + step(F.lit(val_days)))
    full = F.col("val_end") + step(F.lit(test_days))
    out = out.withColumn("test_end", F.least(full, F.col("t_end")))
    out = out.withColumn("complete", F.col("test_end") == full)
    out = out.where(F.col("val_end") < F.col("t_end") - step(F.lit(stop_days)))
    return out.select(*keys, F.col("fold").cast("long").alias("fold"), "train_end", "val_end", "test_end", "complete")


def split_rows(df: DataFrame, folds: DataFrame, ts: str, embargo_days: int = 5) -> DataFrame:
    """(fold, split) of each row. The label horizon is embargoed before each boundary.

    The fold table has one row per half year of the calendar, so a broadcast range
    condition is exact and keeps the large side in place.
    """
    emb = F.make_dt_interval(F.lit(embargo_days))
    t = F.col(ts)
    split = (
        F.when(t <= F.col("train_end") - emb, "train")
        .when((t > F.col("train_end")) & (t <= F.col("val_end") - emb), "val")
        .when((t > F.col("val_end")) & (t <= F.col("test_end")), "test")
    )
    crossed = df.join(F.broadcast(folds), t <= F.col("test_end"))
    return crossed.withColumn("split", split).where("split is not null")


def usable_folds(
    tagged: DataFrame, min_train: int = 500, min_val: int = 100, min_test: int = 50
) -> DataFrame:
    """Folds whose three splits are large enough, with their sizes."""
    n = lambda s: F.count_if(F.col("split") == s)
    sizes = tagged.groupBy("fold").agg(
        n("train").alias("n_train"), n("val").alias("n_val"), n("test").alias("n_test")
    )
    ok = (F.col("n_train") >= min_train) & (F.col("n_val") >= min_val) & (F.col("n_test") >= min_test)
    return sizes.where(ok)


# Half-open calendar regimes.
REGIMES = [
    ("pre2020_decoupled", None, "2020-03-01"),
    ("coupled_qe_qt", "2020-03-01", "2023-01-01"),
    ("etf_era", "2023-01-01", "2025-10-01"),
    ("post_crash_recoupling", "2025-10-01", None),
]


def regime_slices(
    returns: DataFrame, keys: list[str], ts: str, ret: str,
    regimes: list[tuple[str, str | None, str | None]] = REGIMES, min_rows: int = 60,
) -> DataFrame:
    """Row count and Sharpe per regime; Sharpe only with more than ``min_rows`` rows."""
    label = None
    for name, _, end in regimes:
        cond = F.col(ts) < F.lit(end).cast("timestamp") if end else F.lit(True)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    g = returns.withColumn("regime", label).groupBy(*keys, "regime")
    return g.agg(
        F.count(ret).alias("n"), F.when(F.count(ret) > min_rows, metrics.sharpe(ret)).alias("sharpe")
    )
