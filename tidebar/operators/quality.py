"""Data-quality checks: each is one grouped aggregate over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.functions.times import seconds
from tidebar.operators.joins import compare_sources

STEP_SECONDS = {"1h": 3_600, "4h": 14_400, "1d": 86_400}
EPS = 1e-12


def bar_structure(
    bars: DataFrame, keys: list[str], timeframe: str, max_missing_pct: float = 0.2
) -> DataFrame:
    """Null rows, off-grid rows, duplicates, missing share of the grid and price violations."""
    step = STEP_SECONDS[timeframe]
    sec = F.unix_micros("ts")
    aligned = (sec % F.lit(step * 1_000_000)) == 0
    full = F.lit(True)
    for c in ["open", "high", "low", "close", "volume"]:
        full = full & F.col(c).isNotNull()
    lo, hi = F.least("open", "close"), F.greatest("open", "close")
    bad = (
        (F.col("low") > lo + num(EPS)) | (F.col("high") < hi - num(EPS))
        | (F.col("low") > F.col("high")) | (F.col("volume") < 0)
    )
    on_grid = F.when(aligned, sec)
    stats = bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~full).alias("null_rows"),
        F.count_if(~aligned).alias("off_grid"),
        (F.count(F.lit(1)) - F.countDistinct("ts")).alias("n_dup"),
        F.countDistinct(on_grid).alias("_have"),
        ((F.max(on_grid) - F.min(on_grid)) / F.lit(step * 1_000_000)).alias("_span"),
        F.count_if(full & bad).alias("ohlc_violations"),
    )
    expected = F.floor(F.col("_span")).cast("long") + 1
    missing = F.when(F.col("_span").isNull(), F.col("n_rows")).otherwise(
        F.greatest(F.lit(0), expected - F.col("_have"))
    )
    pct = F.when(F.col("_span").isNull(), num(100)).otherwise(num(100) * missing / expected)
    out = stats.withColumn("missing", missing).withColumn("missing_pct", pct)
    passed = (
        (F.col("missing_pct") <= max_missing_pct) & (F.col("n_dup") == 0)
        & (F.col("ohlc_violations") == 0) & (F.col("null_rows") == 0) & (F.col("off_grid") == 0)
    )
    return out.withColumn("passed", passed).drop("_have", "_span")


def freshness(bars: DataFrame, keys: list[str], today: Column, max_age_days: int = 3) -> DataFrame:
    age = F.datediff(today, F.max("ts").cast("date"))
    return bars.groupBy(*keys).agg(F.max("ts").alias("last_ts"), age.cast("long").alias("age_days")).withColumn(
        "passed", F.col("age_days") <= max_age_days
    )


def cross_source(
    ours: DataFrame, theirs: DataFrame, keys: list[str], day: str, value: str,
    last_day: Column, window: int = 30, limit_pct: float = 0.5,
) -> DataFrame:
    """Deviation over our last ``window`` settled days against a second source."""
    settled = ours.where(F.col(day) <= last_day)
    w = W.partitionBy(*keys).orderBy(F.col(day).desc())
    recent = settled.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window).drop("_rn")
    diff = compare_sources(recent, theirs, [*keys, day], value)
    out = diff.groupBy(*keys).agg(
        F.count("diff_pct").alias("n_days"),
        F.max("diff_pct").alias("max_pct"),
        F.percentile("diff_pct", 0.5).alias("median_pct"),
    )
    ok = (F.col("n_days") >= num(window * 0.8)) & (F.col("max_pct") < limit_pct)
    return out.withColumn("passed", ok)


def last_common_day(
    ours: DataFrame, theirs: DataFrame, keys: list[str], day: str, value: str, limit_pct: float = 0.5
) -> DataFrame:
    diff = compare_sources(ours, theirs, [*keys, day], value)
    out = diff.groupBy(*keys).agg(
        F.max(day).alias("last_day"), F.max_by("diff_pct", day).alias("diff_pct")
    )
    return out.withColumn("passed", F.col("diff_pct") < limit_pct)


def funding_sanity(funding: DataFrame, key: str = "symbol") -> DataFrame:
    """Median settlement gap within half an hour to 12.5 hours and no rate above 3%."""
    w = W.partitionBy(key).orderBy("ts")
    gap = (seconds("ts") - F.lag(seconds("ts")).over(w)) / num(3600)
    out = funding.withColumn("_gap", gap).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.percentile("_gap", 0.5).alias("median_gap_h"),
        F.count_if(F.abs("funding_rate") > 0.03).alias("extreme"),
    )
    ok = F.col("median_gap_h").between(0.5, 12.5) & (F.col("extreme") == 0)
    return out.withColumn("passed", ok)


def session_issues(sessions: DataFrame, is_etf: Column, max_gap_days: int = 7) -> DataFrame:
    """Issue codes of each symbol's session table.

    Monotonic checks compare a row with the one stored before it by session date.
    """
    w = W.partitionBy("symbol").orderBy("session_date", "bar_end")
    prev = lambda c: F.lag(c).over(w)
    lo, hi = F.least("open", "close"), F.greatest("open", "close")
    flagged = sessions.select(
        "symbol",
        is_etf.alias("_etf"),
        (F.col("session_date") == prev("session_date")).alias("_dup"),
        (F.col("bar_end") < prev("bar_end")).alias("_mono_end"),
        (F.col("available_at") < prev("available_at")).alias("_mono_avail"),
        (F.col("available_at") < F.col("bar_end")).alias("_early"),
        ((F.col("low") > lo) | (hi > F.col("high"))).alias("_ohlc"),
        (F.coalesce("volume", num(0)) < 0).alias("_vol"),
        (F.least("open", "high", "low", "close") <= 0).alias("_neg"),
        (F.datediff("session_date", prev("session_date")) > max_gap_days).alias("_gap"),
    )
    n = flagged.groupBy("symbol").agg(
        F.bool_or("_etf").alias("_etf"),
        *[F.count_if(c).alias(c) for c in
          ["_dup", "_mono_end", "_mono_avail", "_early", "_ohlc", "_vol", "_neg", "_gap"]],
    )
    code = lambda c, name: F.when(c, F.lit(name))
    issues = F.array_compact(
        F.array(
            code(F.col("_dup") > 0, "duplicate_session"),
            code(F.col("_mono_end") > 0, "bar_end_order"),
            code(F.col("_mono_avail") > 0, "available_at_order"),
            code(F.col("_early") > 0, "available_before_end"),
            code(F.col("_etf") & (F.col("_ohlc") > 0), "ohlc_order"),
            code(F.col("_etf") & (F.col("_vol") > 0), "negative_volume"),
            code(F.col("_neg") > 0, "non_positive_price"),
            code(F.col("_gap") > 0, "session_gap"),
        )
    )
    return n.select("symbol", issues.alias("issues"), F.col("_gap").alias("n_gaps"), F.col("_ohlc").alias("n_ohlc"))


def second_source_check(
    ours: DataFrame, theirs: DataFrame, is_level: Column, lookback: int = 40,
    ret_tol: float = 0.006, level_tol: float = 0.005, min_overlap: int = 10,
) -> DataFrame:
    """Recent agreement with a second source: by level for an index, by log return else."""
    w = W.partitionBy("symbol").orderBy(F.col("session_date").desc())
    tail = ours.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= lookback).drop("_rn")
    both = compare_sources(tail, theirs, ["symbol", "session_date"], "close")
    up = W.partitionBy("symbol").orderBy("session_date")
    step = lambda c: F.ln(c) - F.lag(F.ln(c)).over(up)
    gap = F.abs(step(F.col("ours")) - step(F.col("theirs")))
    marked = both.select(
        "symbol", is_level.alias("_level"), gap.alias("_ret_gap"),
        F.abs(F.try_divide(F.col("ours"), F.col("theirs")) - num(1)).alias("_lvl_gap"),
    )
    out = marked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_overlap"),
        F.bool_or("_level").alias("_level"),
        F.count_if(F.col("_lvl_gap") > level_tol).alias("_n_lvl"),
        F.count_if(F.col("_ret_gap") > ret_tol).alias("_n_ret"),
    )
    n_bad = F.when(F.col("_level"), F.col("_n_lvl")).otherwise(F.col("_n_ret"))
    bad = F.when(F.col("_level"), F.col("_n_lvl") > 0).otherwise(F.col("_n_ret") > 2)
    issue = F.when(F.col("n_overlap") < min_overlap, F.lit("few_overlaps")).when(bad, F.lit("deviation"))
    return out.select("symbol", "n_overlap", n_bad.alias("n_bad"), issue.alias("issue"))


def gate(checks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All gating checks pass; informational ones do not count."""
    g = checks.groupBy(*keys) if keys else checks.groupBy()
    return g.agg(
        F.every(F.col("passed") | ~F.col("gate")).alias("gate_passed"),
        F.count_if(F.col("gate") & ~F.col("passed")).alias("n_failed"),
        F.count(F.lit(1)).alias("n_checks"),
    )


def sessions_behind(
    stored: DataFrame, calendar: DataFrame, now: Column, max_stale: int = 1
) -> DataFrame:
    """Expected sessions that closed since each symbol's last stored one.

    ``calendar`` has session_date and available_at of every expected session.
    """
    last = stored.groupBy("symbol").agg(F.max("session_date").alias("last_session"))
    # the calendar is one short array, so no (symbol, session) pairs are formed
    closed = calendar.where(F.col("available_at") <= now)
    listed = closed.agg(F.collect_set("session_date").alias("_closed"))
    missed = F.size(F.filter("_closed", lambda d: d > F.col("last_session")))
    out = last.crossJoin(F.broadcast(listed)).withColumn("n_missed", missed)
    return out.select(
        "symbol", "last_session", "n_missed",
        F.datediff(now.cast("date"), "last_session").cast("long").alias("days_since"),
        F.when(F.col("n_missed") <= max_stale, F.lit("ok")).otherwise(F.lit("stale")).alias("status"),
    )


def status_rollup(fresh: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: fresh everywhere and no quality issue anywhere."""
    f = fresh.agg(F.every(F.col("status") == "ok").alias("fresh"))
    q = issues.agg(F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("n_issues"))
    return f.crossJoin(q).withColumn("ok", F.col("fresh") & (F.col("n_issues") == 0))
