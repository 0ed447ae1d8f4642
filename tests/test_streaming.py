"""Streaming forms give what the batch forms give on the same input."""

import pandas as pd
from pyspark.sql import functions as F

from tidebar.operators.sets import pick
from tidebar.streaming import jobs


def _files(spark, tmp_path, name, frames, schema):
    src = str(tmp_path / name)
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), spark.read.schema(schema).parquet(src)


def test_first_write_wins(spark, tmp_path):
    schema = "k string, seq long, v int"
    stream, batch = _files(spark, tmp_path, "a", [[("x", 1, 1), ("y", 2, 2)], [("x", 3, 9), ("z", 4, 4)]], schema)
    out = str(tmp_path / "out")
    q = jobs.run_batches(stream, jobs.append_first(out, ["k"], ["seq"]), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect())
    assert got == sorted((r["k"], r["v"]) for r in pick(batch, ["k"], ["seq"]).collect())
    # a replayed batch changes nothing
    sink = jobs.append_first(out, ["k"], ["seq"])
    sink(spark.createDataFrame([("x", 3, 9), ("z", 4, 4)], schema), 1)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == got


def test_last_write_wins_touched_partitions(spark, tmp_path):
    schema = "day string, k string, seq long, v int"
    frames = [[("d1", "x", 1, 1), ("d2", "y", 2, 2)], [("d1", "x", 3, 9), ("d3", "z", 4, 4)]]
    stream, batch = _files(spark, tmp_path, "b", frames, schema)
    out = str(tmp_path / "out2")
    q = jobs.run_batches(stream, jobs.upsert_partitions(out, ["k"], ["seq"], "day"), str(tmp_path / "ck2"))
    q.awaitTermination(120)
    got = sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect())
    assert got == sorted((r["k"], r["v"]) for r in pick(batch, ["k"], ["seq"], last=True).collect())


def test_dedup_recent(spark, tmp_path):
    schema = "h string, t timestamp"
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    stream, _ = _files(spark, tmp_path, "c", [[("a", t), ("a", t), ("b", t)], [("a", t), ("c", t)]], schema)
    q = jobs.dedup_recent(stream, "h", "t").writeStream.format("memory").queryName("dd").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["h"] for r in spark.table("dd").collect()) == ["a", "b", "c"]


def test_late_rows_are_admitted_later(spark):
    d = spark.createDataFrame([(1, "2024-01-01 21:30:00"), (2, "2024-01-02 21:30:00")], "i int, a string").withColumn("available_at", F.col("a").cast("timestamp"))
    at = lambda s: sorted(r["i"] for r in jobs.admit_available(d, F.lit(s).cast("timestamp")).collect())
    assert at("2024-01-02 00:00:00") == [1] and at("2024-01-03 00:00:00") == [1, 2]


def test_flag_expires_to_unknown(spark, tmp_path):
    schema = "asset string, ts timestamp, severity long"
    at = lambda s: pd.Timestamp(s).to_pydatetime()
    frames = [[("BTC", at("2024-01-01 00:00"), 4)], [("BTC", at("2024-01-01 05:00"), 5)], [("ETH", at("2024-01-04 00:00"), 2)]]
    stream, _ = _files(spark, tmp_path, "f", frames, schema)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = []

    def take(batch, _):
        rows.extend((r["asset"], r["status"], r["severity"]) for r in batch.collect())

    q = jobs.flag_stream(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert ("BTC", "known", 5) in rows and ("BTC", "unknown", None) in rows and ("ETH", "known", 2) in rows
