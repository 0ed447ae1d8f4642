"""Time column functions. Every timestamp is UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import col

NEW_YORK = "America/New_York"
DAY_SECONDS = 86_400.0


def seconds(ts: Column | str) -> Column:
    """Epoch seconds with the fraction kept."""
    return F.unix_micros(col(ts)) / F.lit(1e6)


def hours_before(ts: Column, hours: float) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(hours) * 3600))


def plus_days(ts: Column | str, n: int) -> Column:
    return col(ts) + F.make_dt_interval(F.lit(n))


def plus_minutes(ts: Column | str, n: Column | int) -> Column:
    m = n if isinstance(n, Column) else F.lit(n)
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))


# Magnitudes above which an epoch column is ns, us or ms.
NS_ABOVE, US_ABOVE, MS_ABOVE = 1e17, 1e14, 1e11


def epoch_to_ts(value: Column, magnitude: Column) -> Column:
    """Convert epoch integers whose unit follows from the column's median magnitude."""
    v = value.cast("long")
    micros = (
        F.when(magnitude > NS_ABOVE, F.floor(v / F.lit(1000)).cast("long"))
        .when(magnitude > US_ABOVE, v)
        .when(magnitude > MS_ABOVE, v * F.lit(1000))
        .otherwise(v * F.lit(1_000_000))
    )
    return F.timestamp_micros(micros)


def normalize_epochs(df: DataFrame, value: str, source: list[str], out: str = "ts") -> DataFrame:
    """Detect the unit per source with one partial aggregate, then convert every row.

    The per-source medians are approximate-free: ``percentile`` merges counts of
    distinct values, and only order of magnitude is used.
    """
    unit = df.groupBy(*source).agg(
        F.percentile_approx(F.abs(col(value).try_cast("double")), 0.5, 1000).alias("_mag")
    )
    return (
        df.join(unit, source, "left")
        .withColumn(out, epoch_to_ts(col(value).try_cast("long"), F.col("_mag")))
        .drop("_mag")
    )


def parse_pubdate(x: Column | str) -> Column:
    """RFC-822 date, else ISO; a text without a zone is UTC."""
    t = F.trim(col(x))
    bare = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(t),
    )


def availability_floor(session_date: Column | str, hour: int = 21, minute: int = 30) -> Column:
    """Earliest instant a completed session may be used: 21:30 UTC of its date."""
    midnight = col(session_date).cast("timestamp")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))


def exchange_clock(session_date: Column | str, hour: int, minute: int, zone: str = NEW_YORK) -> Column:
    """UTC instant of a wall-clock time at the exchange, DST-aware."""
    local = col(session_date).cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(hour), F.lit(minute)
    )
    return F.to_utc_timestamp(local, zone)


def session_bounds(session_date: Column | str, close_hour: int = 16, close_minute: int = 0) -> tuple[Column, Column]:
    return exchange_clock(session_date, 9, 30), exchange_clock(session_date, close_hour, close_minute)


def month_range(first: Column, last: Column) -> Column:
    """Array of the months 'yyyy-MM' from first to last, both included."""
    months = F.sequence(
        F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")
    )
    return F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))


def last_complete_month(today: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(today, "month"), -1), "yyyy-MM")


def staleness_days(now: Column | str, then: Column | str) -> Column:
    return (seconds(now) - seconds(then)) / F.lit(DAY_SECONDS)
