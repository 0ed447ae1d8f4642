"""Grouped aggregates. Every one combines map-side before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.functions.text import ASSET_PATTERNS
from tidebar.operators.blocks import quantiles

LEVELS = ["P0", "P1", "P2", "P3"]  # fixed values: incident levels


def daily_funding(funding: DataFrame) -> DataFrame:
    """Sum of the settlement rates of each UTC day."""
    day = F.date_trunc("day", "ts").alias("ts")
    return funding.groupBy("symbol", day).agg(F.sum("funding_rate").alias("funding"))


def inventory(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def month_gaps(bars: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """Months without bars from ``start`` to each series' last bar, split into
    leading (before the first bar) and mid-series gaps."""
    ym = F.trunc("ts", "month").alias("ym")
    present = bars.select(*keys, ym).distinct()
    span = present.groupBy(*keys).agg(F.min("ym").alias("first_ym"), F.max("ym").alias("last_ym"))
    months = F.sequence(
        F.least(F.trunc(start, "month"), F.col("first_ym")), F.col("last_ym"), F.expr("interval 1 month")
    )
    spine = span.select(*keys, "first_ym", F.explode(months).alias("ym"))
    gone = spine.join(present, [*keys, "ym"], "left_anti")
    return gone.select(
        *keys, F.date_format("ym", "yyyy-MM").alias("month"), (F.col("ym") < F.col("first_ym")).alias("leading")
    )


def incident_counts(incidents: DataFrame, since: Column) -> DataFrame:
    """Counts by level since a day; levels without incidents appear with 0."""
    spark = incidents.sparkSession
    levels = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in LEVELS])).alias("level"))
    seen = incidents.where(F.col("day") >= since).groupBy("level").agg(F.count(F.lit(1)).alias("_n"))
    return levels.join(seen, "level", "left").select("level", F.coalesce("_n", F.lit(0)).alias("n"))


def universe_coverage(panel: DataFrame, date: str = "date", enough: int = 30) -> DataFrame:
    """Median over a year's dates of the number of ranked symbols, truncated."""
    per_date = panel.groupBy(F.year(date).alias("year"), date).agg(F.count("symbol").alias("_n"))
    med = per_date.groupBy("year").agg(F.floor(F.percentile("_n", 0.5)).cast("long").alias("assets_median"))
    return med.withColumn("enough", F.col("assets_median") >= enough)


def ensemble_weights(positions: DataFrame, keys: list[str], scale: float = 1.0 / 3.0) -> DataFrame:
    """Mean position over the variants of a family, scaled to the symbol's share."""
    return positions.groupBy(*keys).agg((F.avg("pos") * num(scale)).alias("weight"))


def portfolio(legs: DataFrame, keys: list[str], value: str = "net", need: int | None = None) -> DataFrame:
    """Equal-weight mean over symbols; with ``need`` only dates where that many legs exist."""
    out = legs.groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("_legs"))
    return (out if need is None else out.where(F.col("_legs") == need)).drop("_legs")


def negative_severity(scored: DataFrame) -> DataFrame:
    """Largest negative severity per asset and for the market as a whole ('ALL')."""
    spark = scored.sparkSession
    names = [a for a, _ in ASSET_PATTERNS] + ["ALL"]
    assets = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in names])).alias("asset"))
    hits = (
        scored.where(F.col("direction") == "neg")
        .select(F.explode("assets").alias("asset"), "severity")
        .groupBy("asset").agg(F.max("severity").alias("_s"))
    )
    return assets.join(hits, "asset", "left").select("asset", F.coalesce("_s", F.lit(0)).alias("severity"))


def flag_snapshot(scored: DataFrame, top: int = 10, tie: str = "title") -> DataFrame:
    """One-row risk-flag snapshot: severity map, market severity and the top negatives."""
    sev = negative_severity(scored)
    whole = F.col("asset") == "ALL"
    severities = sev.agg(  # both from one pass over the texts
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~whole, F.struct("asset", "severity"))))).alias("asset_neg_severity"),
        F.max(F.when(whole, F.col("severity"))).alias("market_neg_severity"),
    )
    worst = scored.where("direction = 'neg'").orderBy(F.col("severity").desc(), tie).limit(top)
    listed = worst.agg(F.collect_list(F.struct("severity", "title", "category")).alias("top_negative"))
    total = scored.agg(F.count(F.lit(1)).alias("n_scored"), F.max("scorer").alias("scorer"))
    return severities.crossJoin(listed).crossJoin(total)


def predictive_scores(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (variant, fold): log-volatility error, QLIKE and tail counts.

    ``labels`` carries decision_ts, symbol, label_logvol5, label_minz5, c_sigma20d.
    """
    from tidebar.functions.columns import tail_label

    m = preds.join(labels, ["decision_ts", "symbol"], "left")
    m = m.withColumn("y_tail", tail_label("label_minz5", "c_sigma20d", "sigma_floor"))
    m = m.where(F.col("label_logvol5").isNotNull())
    s2 = F.greatest(F.col("sigma_hat") * F.col("sigma_hat"), num(1e-12))
    realised = F.exp(num(2) * F.col("label_logvol5"))
    return m.groupBy("variant", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.ln("sigma_hat") - F.col("label_logvol5"))).alias("vol_mae_log"),
        F.avg(F.ln(s2) + realised / s2).alias("qlike"),
        F.coalesce(F.sum("y_tail"), num(0)).cast("long").alias("tail_positives"),
    )


def pooled_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("variant").agg(
        F.sum("n").alias("n"), F.avg("vol_mae_log").alias("vol_mae_log"),
        F.avg("qlike").alias("qlike"), F.sum("tail_positives").alias("tail_positives"),
    )


def sigma_floor(train: DataFrame, keys: list[str], sigma: str = "c_sigma20d") -> DataFrame:
    """Fifth percentile of the positive volatilities per key; 1e-4 where there is none."""
    positive = F.when(F.col(sigma) > 0, F.col(sigma))
    q = quantiles(train, keys, positive, {"_q": 0.05})
    out = train.select(*keys).distinct().join(q, keys, "left")
    return out.select(*keys, F.coalesce("_q", num(1e-4)).alias("sigma_floor"))


def sigma_reference(train: DataFrame, keys: list[str], label: str = "label_logvol5") -> DataFrame:
    """Median realised forward volatility per key."""
    return quantiles(train, keys, F.exp(label), {"sigma_ref": 0.5}).drop("n_values")


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("fee").alias("fees"),
        F.count_if(F.col("mode") == "live").alias("n_live"),
        F.count_if(F.col("mode") == "catchup").alias("n_catchup"),
    )


def duplicate_counts(df: DataFrame, keys: list[str], on: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(on).alias("n_distinct"),
        (F.count(on) - F.countDistinct(on)).alias("n_dup"),
    )


def multiplier_stats(preds: DataFrame) -> DataFrame:
    below = (F.col("multiplier") < 0.999).cast("double")
    return preds.groupBy("variant").agg(
        F.avg("multiplier").alias("mult_mean"), F.avg(below).alias("mult_below_1")
    )


def concentration(contributions: DataFrame, keys: list[str], symbol: str, value: str) -> DataFrame:
    """Largest single-asset share of the positive gross profit (0 when none is positive)."""
    per = contributions.groupBy(*keys, symbol).agg(F.sum(value).alias("_c"))
    gain = F.when(F.col("_c") > 0, F.col("_c"))
    out = per.groupBy(*keys) if keys else per.groupBy()
    share = F.coalesce(F.try_divide(F.max(gain), F.sum(gain)), num(0))
    return out.agg(share.alias("max_share"))
