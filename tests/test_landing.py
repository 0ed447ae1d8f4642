"""Stateful streams against plain loops, whatever the cut into micro-batches; the bucketed store's plans."""

import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidebar.operators import windows as win
from tidebar.sources import sinks
from tidebar.streaming import jobs

BASE, HOUR = datetime(2024, 1, 1), timedelta(hours=1)
FLAGS = "asset string, ts timestamp, severity long"


def history(rows, ttl=24):
    """Known flags that the watermark passes, and the silences longer than the limit."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    passed = max(r[1] for r in rows) - HOUR
    out = []
    for asset in {r[0] for r in rows}:
        worst = {}
        for a, ts, s in rows:
            if a == asset and ts <= passed:
                worst[ts] = max(s, worst.get(ts, s))
        times = sorted(worst)
        out += [(asset, ts, worst[ts], "known") for ts in times]
        for ts, nxt in zip(times, [*times[1:], None], strict=True):
            end = ts + ttl * HOUR
            if (nxt > end) if nxt else (end <= passed):
                out.append((asset, end, None, "unknown"))
    return sorted(out, key=str)


def test_flag_history_does_not_depend_on_batches(spark, tmp_path):
    g = random.Random(4)
    times = sorted(BASE + timedelta(minutes=g.randrange(60 * 24 * 20)) for _ in range(60))
    rows = [(g.choice(["a", "b", None]), ts, g.randrange(5)) for ts in times]
    rows += [("a", times[30], 1), ("a", times[30], 9), ("a", times[30], 9), ("c", None, 3), ("b", times[-1], None)]
    rows = [rows[i] for i in sorted(range(len(rows)), key=lambda i: (rows[i][1] or BASE, i))]
    want = history(rows)
    assert {r[3] for r in want} == {"known", "unknown"}
    for files in (1, 7):
        src, out = str(tmp_path / f"src{files}"), str(tmp_path / f"out{files}")
        size = -(-len(rows) // files)
        for i in range(0, len(rows), size):  # rows of a batch come in any order
            part = rows[i:i + size]
            g.shuffle(part)
            spark.createDataFrame(part, FLAGS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(FLAGS).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.append_rows(jobs.flag_history(stream), out, str(tmp_path / f"ck{files}")).awaitTermination(200)
        assert sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str) == want


def test_rows_wait_for_their_clock(spark, tmp_path):
    src, ticks, out, held, ck = (str(tmp_path / n) for n in ("src", "ticks", "out", "held", "ck"))
    schema = "k string, available_at timestamp"
    sink = jobs.admit_when_available(out, held, ["k"], ["available_at"])

    def run(rows, hours):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        spark.createDataFrame([(BASE + hours * HOUR,)], "tick timestamp").coalesce(1).write.mode("append").parquet(ticks)
        stream = jobs.with_clock(spark.readStream.schema(schema).parquet(src), spark.readStream.schema("tick timestamp").parquet(ticks))
        jobs.run_batches(stream, sink, ck).awaitTermination(120)
        return {r["k"]: r["batch"] for r in spark.read.parquet(out).collect()}

    at = lambda h: BASE + h * HOUR
    assert run([("a", at(1)), ("b", at(5)), ("never", None), ("c", at(9))], 2) == {"a": 0}
    assert run([], 6) == {"a": 0, "b": 1}  # no new rows: the clock alone admits
    last = {"a": 0, "b": 1, "c": 2, "d": 2}
    assert run([("a", at(1)), ("d", at(7))], 9) == last
    # a replay of the last batch, with its rows and its clock, changes nothing
    again = spark.createDataFrame([("a", at(1), None), ("d", at(7), None), (None, None, at(9))], f"{schema}, tick timestamp")
    sink(again, 2)
    assert {r["k"]: r["batch"] for r in spark.read.parquet(out).collect()} == last
    assert [r["k"] for r in spark.read.parquet(f"{held}/batch=2").collect()] == ["never"]


def test_bucketed_bars_need_no_shuffle(spark, tmp_path):
    def store(n):
        rows = spark.range(n).select((F.col("id") % 5).cast("string").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("close"))
        return rows, sinks.bucket_bars(rows, f"bars_{uuid.uuid4().hex}", str(tmp_path / str(n)), 4)

    rows, bars = store(500)
    _, other = store(300)
    mean = win.rolling_mean("close", win.series("symbol"), 3)
    rolled = bars.withColumn("m", mean)
    joined = rolled.join(other.hint("merge").select("symbol", "ts", F.col("close").alias("c2")), ["symbol", "ts"], "left")
    total = bars.groupBy("symbol").agg(F.sum("close").alias("s"))
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(setting, "false")
    try:
        for df in (rolled, joined, total):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(setting)
    key = lambda r: (r["symbol"], r["ts"])
    assert sorted(rolled.collect(), key=key) == sorted(rows.withColumn("m", mean).collect(), key=key)
    assert joined.count() == 500 and joined.where("c2 is not null").count() == 300
