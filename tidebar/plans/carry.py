"""Delta-neutral funding carry with an enter/exit switch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.operators import metrics
from tidebar.operators import windows as win

# Fixed values: (name, enter APR, exit APR); null thresholds mean always in.
SUITE = [("always_on", None, None), ("filter_5/0", 0.05, 0.00), ("filter_10/2", 0.10, 0.02)]
SPOT_SIDE_BPS, PERP_SIDE_BPS = 11.0, 7.0


def carry_returns(funding_by_day: DataFrame) -> DataFrame:
    """Daily carry return of each rule: half the capital earns funding while in the market.

    The switch decides at a day's close on the 7-day annualised rate and acts
    the next day; every switch pays half of both sides' costs.
    """
    spark = funding_by_day.sparkSession
    rules = spark.createDataFrame(SUITE, "rule string, enter_apr double, exit_apr double")
    w0 = win.series("symbol")
    apr = F.coalesce(win.rolling_mean("funding", w0, 7) * num(365), num(0))
    crossed = funding_by_day.withColumn("apr", apr).crossJoin(F.broadcast(rules))
    w = win.series("symbol", "rule")
    switch = win.state(F.col("apr") > F.col("enter_apr"), F.col("apr") < F.col("exit_apr"), w)
    always = F.col("enter_apr").isNull()
    staged = crossed.withColumn("in_market", F.when(always, num(1)).otherwise(switch))
    staged = staged.withColumn("held", win.held("in_market", w))
    staged = staged.withColumn("switches", win.turnover("held", w))
    per_switch = 0.5 * (SPOT_SIDE_BPS + PERP_SIDE_BPS) / 1e4
    net = num(0.5) * F.col("funding") * F.col("held") - F.col("switches") * num(per_switch)
    return staged.withColumn("net", net)


def carry_suite(funding_by_day: DataFrame) -> DataFrame:
    daily = carry_returns(funding_by_day)
    base = daily.groupBy("symbol", "rule").agg(
        F.avg("held").alias("time_in_market"),
        F.floor(F.sum("switches") / num(2)).cast("long").alias("n_roundtrips"),
        (num(36_500) * F.avg("net")).alias("net_apr_pct"),
        (num(36_500) * F.avg("funding")).alias("avg_funding_apr_pct"),
    )
    stats = metrics.summary(daily, ["symbol", "rule"], "ts").select("symbol", "rule", "sharpe", "max_dd_pct")
    return base.join(stats, ["symbol", "rule"])
