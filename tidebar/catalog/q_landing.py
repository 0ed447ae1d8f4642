"""Landing jobs: streams over files cut from the events, archives, funding files, and what reports on them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebar import schemas
from tidebar.catalog import q_books, q_tables
from tidebar.catalog.base import query
from tidebar.catalog.q_books import _ACC, account_sql
from tidebar.catalog.tables_sql import donchian_pos
from tidebar.functions.columns import num
from tidebar.operators import aggregates, sets
from tidebar.plans import ledger
from tidebar.session import scratch_path
from tidebar.sources import readers
from tidebar.streaming import jobs

# ---------------- streams ----------------

PARTS = 3


def landed(t, name: str, start: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Land the events in ``PARTS`` parts, the earlier ones first, and after each run the job on what is new.

    ``start`` takes the file stream and the job's checkpoint, which lives on from run to run.
    """
    src, offsets = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-offsets")
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    at = F.unix_micros("ts")
    span = F.broadcast(e.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi")))  # one row
    share = F.try_divide(at - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    cut = e.crossJoin(span).withColumn("_part", F.least(F.floor(F.coalesce(share, num(0)) * PARTS), F.lit(PARTS - 1)))
    for i in range(PARTS):
        cut.where(F.col("_part") == i).select(*e.columns).write.mode("append").parquet(src)
        start(t.spark.readStream.schema(e.schema).parquet(src), offsets).awaitTermination()


@query("t1_stream_dedup", "event_type user_id:i", "SELECT DISTINCT event_type, user_id FROM events")
def _t1(t):
    path = scratch_path(t.spark, "t1-out")

    def start(stream, offsets):
        once = jobs.dedup_recent(stream.withColumn("hash", F.concat_ws("|", "event_type", "user_id")), "hash", "ts", "36500 days")
        out = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", offsets)
        return out.trigger(availableNow=True).start()

    landed(t, "t1", start)
    return t.spark.read.parquet(path)


@query("t2_first_write_log", "event_type user_id:i event_id:i", """
SELECT event_type, user_id, arg_min(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def _t2(t):
    path = scratch_path(t.spark, "t2-out")
    sink = jobs.append_first(path, ["event_type", "user_id"], ["ts", "event_id"])
    landed(t, "t2", lambda stream, offsets: jobs.run_batches(stream, sink, offsets))
    return t.spark.read.parquet(path)


@query("t3_last_write_bars", "event_type ts:t value:6", """
SELECT event_type, date_trunc('hour', ts) AS ts, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def _t3(t):
    path = scratch_path(t.spark, "t3-out")
    sink = jobs.upsert_partitions(path, ["event_type", "hour"], ["seen", "event_id"], "month")
    hour = F.date_trunc("hour", "ts")

    def start(stream, offsets):
        bars = stream.select(
            "event_type", hour.alias("hour"), F.date_format(hour, "yyyy-MM").alias("month"), F.col("ts").alias("seen"), "event_id", "value")
        return jobs.run_batches(bars, sink, offsets)

    landed(t, "t3", start)
    return t.spark.read.parquet(path).withColumnRenamed("hour", "ts")


@query("t8_late_rows", "symbol session_date:d run:i", """
SELECT symbol, session_date, CASE WHEN session_date < DATE '1996-01-01' THEN 0 ELSE 1 END AS run FROM sessions""")
def _t8(t):
    """Two runs over one landing zone: what was not yet available in the first is admitted by the second."""
    path = scratch_path(t.spark, "t8-out")
    landing = t.sessions.select("symbol", "session_date", "available_at")
    sink = jobs.append_first(path, ["symbol", "session_date"], ["available_at"])
    for run, now in enumerate(("1996-01-01 06:00:00", "2100-01-01 00:00:00")):
        sink(jobs.admit_available(landing, F.lit(now).cast("timestamp")), run)
    return t.spark.read.parquet(path).withColumnRenamed("batch", "run")


_TTL = "INTERVAL 24 HOUR"


# what the watermark, an hour behind the last flag, has passed
@query("t4_flag_stream", "asset ts:t severity:i status", f"""
WITH f AS (SELECT event_type AS asset, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, max(CAST(floor(value) AS BIGINT)) AS severity FROM events WHERE value > 150 GROUP BY 1, 2),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM f),
l AS (SELECT f.*, lead(ts) OVER (PARTITION BY asset ORDER BY ts) AS nxt, wm FROM f, m WHERE ts <= wm)
SELECT asset, ts, severity, 'known' AS status FROM l
UNION ALL SELECT asset, ts + {_TTL}, NULL, 'unknown' FROM l WHERE CASE WHEN nxt IS NULL THEN ts + {_TTL} <= wm ELSE nxt > ts + {_TTL} END""")
def _t4_stream(t):
    path = scratch_path(t.spark, "t4-out")

    def start(stream, offsets):
        flags = stream.where("value > 150").select(F.col("event_type").alias("asset"), "ts", F.floor("value").alias("severity"))
        return jobs.append_rows(jobs.flag_history(flags), path, offsets)

    landed(t, "t4", start)
    return t.spark.read.parquet(path)


@query("t8_late_stream", "symbol session_date:d run:i", """
SELECT symbol, session_date, CASE WHEN session_date < DATE '1996-01-01' THEN 0 WHEN session_date < DATE '1996-07-01' THEN 1 ELSE 2 END AS run FROM sessions""")
def _t8_stream(t):
    """Three runs of one stream: rows land in the first and last; the second only has a later clock."""
    src, ticks, path, held, offsets = (scratch_path(t.spark, f"t8-{n}") for n in ("src", "ticks", "out", "held", "offsets"))
    landing = t.sessions.select("symbol", "session_date", "available_at")
    sink = jobs.admit_when_available(path, held, ["symbol", "session_date"], ["available_at"])
    first, late = F.col("session_date") < "1997-01-01", F.col("session_date") >= "1997-01-01"
    for part, now in ((first, "1996-01-01 06:00:00"), (None, "1996-07-01 12:00:00"), (late, "2100-01-01 00:00:00")):
        if part is not None:
            landing.where(part).write.mode("append").parquet(src)
        t.spark.range(1).select(F.lit(now).cast("timestamp").alias("tick")).write.mode("append").parquet(ticks)
        stream = jobs.with_clock(t.spark.readStream.schema(landing.schema).parquet(src), t.spark.readStream.schema("tick timestamp").parquet(ticks))
        jobs.run_batches(stream, sink, offsets).awaitTermination()
    return t.spark.read.parquet(path).withColumnRenamed("batch", "run")


# ---------------- archives and funding files ----------------


def kline_strings(t):
    ms = F.unix_millis("ts")
    text = [F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")]
    return t.hbars.select(
        "symbol", ms.alias("open_time"), *text, (ms + 3_599_999).alias("close_time"), "quote_volume", "trades",
        F.lit("0").alias("taker_buy_base"), F.lit("0").alias("taker_buy_quote"), F.lit("0").alias("ignore"))


_KLINES = "SELECT symbol, ts, open, high, low, close, volume, trades FROM hbars"


@query("s3_kline_headerless", "symbol ts:t open:6 high:6 low:6 close:6 volume:4 trades:i", _KLINES)
def _s3_bare(t):
    path = scratch_path(t.spark, "s3-bare")
    kline_strings(t).write.partitionBy("symbol").csv(path)
    raw = t.spark.read.schema(f"{schemas.KLINE_STRINGS.simpleString()[7:-1].replace(':', ' ')}, symbol string").csv(path)
    return readers.shape_klines(raw, ["symbol"])


@query("s3_kline_zip", "symbol ts:t open:6 high:6 low:6 close:6 volume:4 trades:i", _KLINES)
def _s3_zip(t):
    """One archive per symbol and month, packed by the tasks and read through the archive reader."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("bars.csv", pdf[schemas.KLINE_COLUMNS].to_csv(index=False, header=pdf["symbol"].iloc[0] < "e"))
        return pd.DataFrame({"path": [pdf["symbol"].iloc[0]], "content": [body.getvalue()]})

    month = F.date_trunc("month", F.timestamp_millis("open_time"))
    files = kline_strings(t).groupBy("symbol", month.alias("m")).applyInPandas(pack, "path string, content binary")
    return readers.shape_klines(readers.unzipped(files, schemas.KLINE_COLUMNS), ["file"]).withColumnRenamed("file", "symbol")


@query("s4_funding_headed", "symbol ts:t funding_rate:9 interval_hours:1", "SELECT symbol, ts, funding_rate, 8.0 AS interval_hours FROM funding")
def _s4_headed(t):
    """Headed files whose columns stand in another order for every other symbol."""
    turned = F.col("symbol") < "e"
    head = t.funding.select("symbol").distinct().select(
        "symbol", *[F.when(turned, a).otherwise(b).alias(c) for c, a, b in (
            ("c0", "last_funding_rate", "funding_interval_hours"), ("c1", "calc_time", "last_funding_rate"), ("c2", "funding_interval_hours", "calc_time"))])
    ms, rate, hours = F.unix_millis("ts").cast("string"), F.col("funding_rate").cast("string"), F.lit("8")
    body = t.funding.select(
        "symbol", F.when(turned, rate).otherwise(hours).alias("c0"), F.when(turned, ms).otherwise(rate).alias("c1"),
        F.when(turned, hours).otherwise(ms).alias("c2"))
    path = scratch_path(t.spark, "s4-headed")
    head.unionByName(body).write.partitionBy("symbol").csv(path)
    back = t.spark.read.schema("c0 string, c1 string, c2 string, symbol string").csv(path)
    return readers.shape_funding(back, "symbol")


# ---------------- reports ----------------


@query("a8_flag_snapshot", "btc:i eth:i sol:i market_neg_severity:i n_scored:i scorer top_negative", """
SELECT max(CASE WHEN asset = 'BTC' THEN s ELSE 0 END) AS btc, max(CASE WHEN asset = 'ETH' THEN s ELSE 0 END) AS eth, 0 AS sol, max(CASE WHEN asset = 'ALL' THEN s ELSE 0 END) AS market_neg_severity,
 (SELECT count(*) FROM scored) AS n_scored, 'keywords' AS scorer,
 (SELECT string_agg(severity || ' ' || category || ' ' || md5(title), ',' ORDER BY severity DESC, title)
  FROM (SELECT severity, category, title || CASE doc_id % 3 WHEN 0 THEN ' btc' WHEN 1 THEN ' ethereum' ELSE ' ' END AS title FROM scored WHERE direction = 'neg' ORDER BY severity DESC, 3 LIMIT 10)) AS top_negative
FROM (SELECT asset, CASE WHEN direction = 'neg' THEN severity ELSE 0 END AS s FROM scored)""")
def _a8_flags(t):
    s = aggregates.flag_snapshot(q_tables._scored(t))
    by = lambda a: F.col("asset_neg_severity")[a]
    line = F.transform("top_negative", lambda x: F.concat_ws(" ", x["severity"], x["category"], F.md5(x["title"])))
    return s.select(
        by("BTC").alias("btc"), by("ETH").alias("eth"), by("SOL").alias("sol"), "market_neg_severity", "n_scored", "scorer",
        F.array_join(line, ",").alias("top_negative"))


@query("u5_new_flow_rows", "n_new:i", "SELECT count(*) AS n_new FROM flows WHERE day(date) > 15")
def _u5(t):
    return sets.new_row_count(t.flows.where(F.dayofmonth("date") <= 15), t.flows, ["asset", "date"])


@query("x13_target_quantity", "symbol ts:t side target_qty:6", f"""
SELECT a.symbol, a.ts, CASE WHEN tgt < cur THEN 'sell' ELSE 'buy' END AS side, tgt * 10000.0 / close AS target_qty FROM (
 SELECT a.symbol, a.ts, a.pos * 0.3 AS tgt, b.pos * 0.25 AS cur FROM ({donchian_pos(20, 10)}) a JOIN ({donchian_pos(55, 27)}) b USING (symbol, ts)) a
JOIN bars USING (symbol, ts) WHERE abs(tgt - cur) > 0.02""")
def _x13_qty(t):
    plan = q_books._x13(t).join(t.bars.select("symbol", "ts", "close"), ["symbol", "ts"])
    return ledger.with_target_qty(plan, num(10_000), F.col("close"))


@query("x26_funding_leg", _ACC, f"""
SELECT date, gross - coalesce(f, 0) AS gross, cost, turnover, n_held, gross - coalesce(f, 0) - cost AS net FROM ({account_sql('picks_ls')})
LEFT JOIN (SELECT date, sum(weight * cost_rate * 0.1) AS f FROM picks_ls JOIN ranker USING (date, symbol) WHERE ret_next IS NOT NULL GROUP BY 1) USING (date)""")
def _x26_funding(t):
    p = q_books.ranker(t, True)
    funding = p.select("date", "symbol", (F.col("cost_rate") * num(0.1)).alias("funding"))
    return q_books.account(q_books.picks(t, p), p, funding=funding)
