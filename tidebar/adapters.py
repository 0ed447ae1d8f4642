"""The driver tables as model tables, so every operator runs on given data.

All of them are partial aggregates or row-wise shapes of one table scan that
reads only the columns named here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import exact_sum, num
from tidebar.functions.times import availability_floor, plus_minutes, session_bounds


def _ohlc(px: Column, order: Column) -> list[Column]:
    return [
        F.min_by(px, order).alias("open"), F.max(px).alias("high"),
        F.min(px).alias("low"), F.max_by(px, order).alias("close"),
    ]


def daily_bars(lineitem: DataFrame, key: Column | None = None, span: str = "day", total: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Bars per (flag+status or supplier, day or week); price is extended price per unit, ``total`` sums the extended price."""
    symbol = key if key is not None else F.concat("l_returnflag", "l_linestatus")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ts = F.date_trunc(span, F.col("l_shipdate").cast("timestamp"))
    return lineitem.groupBy(symbol.alias("symbol"), ts.alias("ts")).agg(
        *_ohlc(px, order), F.sum("l_quantity").alias("volume"),
        total(F.col("l_extendedprice")).alias("quote_volume"), F.count(F.lit(1)).alias("trades"),
    )


def weekly_panel_bars(lineitem: DataFrame) -> DataFrame:
    """Bars that are ranked by quote volume: a rank must not hang on the order in which it was summed."""
    key = F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    return daily_bars(lineitem, key, "week", exact_sum)


def hourly_bars(events: DataFrame) -> DataFrame:
    order = F.struct("ts", "event_id")
    ts = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return events.groupBy(F.col("event_type").alias("symbol"), ts.alias("ts")).agg(
        *_ohlc(F.col("value"), order), F.sum("value").alias("volume"),
        F.sum(F.col("value") * 10).alias("quote_volume"), F.count(F.lit(1)).alias("trades"),
    )


def funding(events: DataFrame) -> DataFrame:
    """Rates per eight-hour settlement."""
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    ts = F.timestamp_seconds(F.floor(sec / F.lit(28_800)) * F.lit(28_800))
    return events.groupBy(F.col("event_type").alias("symbol"), ts.alias("ts")).agg(
        (F.avg(F.col("value") - num(50)) / num(1e5)).alias("funding_rate")
    )


def sessions(orders: DataFrame) -> DataFrame:
    """Weekday sessions per order priority; price is the order total."""
    day = F.col("o_orderdate").cast("date")
    weekdays = orders.where(F.weekday(day) < 5)
    raw = weekdays.groupBy(
        F.col("o_orderpriority").alias("symbol"), day.alias("session_date")
    ).agg(*_ohlc(F.col("o_totalprice"), F.col("o_orderkey")), F.count(F.lit(1)).cast("double").alias("volume"))
    start, end = session_bounds("session_date")
    return raw.select(
        "symbol", "session_date", start.alias("bar_start"), end.alias("bar_end"),
        availability_floor("session_date").alias("available_at"), "open", "high", "low", "close", "volume",
    )


def flows(events: DataFrame) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return events.groupBy(F.col("event_type").alias("asset"), day.alias("date")).agg(
        F.sum(F.col("value") - num(50)).alias("net_flow_usd_m")
    )


def headlines(documents: DataFrame) -> DataFrame:
    """Whole texts as titles, one a minute; every fourth belongs to the curated feed."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    feed = F.when(F.col("doc_id") % 4 == 0, "curated").otherwise("open")
    return documents.select(
        "doc_id", F.col("text").alias("title"), "source", "lang", feed.alias("feed"),
        plus_minutes(base, F.col("doc_id")).alias("t"),
    )


def trades(orders: DataFrame) -> DataFrame:
    """Orders as ledger trades: status O buys, others sell; customers spread over three books."""
    buy = F.col("o_orderstatus") == "O"
    qty = F.round(num(1) + F.col("o_orderkey") % 7, 4)
    price = F.round(F.col("o_totalprice") / num(1000) + num(1e-9), 4)
    notional = F.round(qty * price, 4)
    ts = plus_minutes(F.col("o_orderdate").cast("timestamp"), (F.col("o_orderkey") % 1440).cast("int"))
    return orders.select(
        F.col("o_orderkey").alias("trade_id"), ts.alias("ts"), F.col("o_orderdate").cast("date").alias("day"),
        F.concat(F.lit("book"), (F.col("o_custkey") % 3).cast("string")).alias("book"),
        F.col("o_orderpriority").alias("symbol"), F.when(buy, "buy").otherwise("sell").alias("side"),
        qty.alias("qty"), price.alias("price"), notional.alias("notional"),
        F.round(notional * num(0.001) + num(1e-9), 6).alias("fee"),
        F.when(F.col("o_orderkey") % 5 == 0, "catchup").otherwise("live").alias("mode"),
    )


def calendar(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A scheduled event per nation, 97 days apart."""
    base = F.lit("1995-03-01 12:30:00").cast("timestamp")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"), F.col("r_name").alias("kind"),
        (base + F.make_dt_interval(F.col("n_nationkey") * 97)).alias("utc"),
    )


__all__ = [
    "calendar", "daily_bars", "flows", "funding", "headlines", "hourly_bars", "sessions",
    "trades", "weekly_panel_bars",
]
