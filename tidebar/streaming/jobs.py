"""Structured Streaming forms of landing, logs and flags.

Each job takes a streaming DataFrame and returns a started query or a streaming
DataFrame. Exactly-once comes from checkpointed offsets plus sinks that give the
same table when a micro-batch is replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidebar.operators.sets import append_unseen, pick, upsert_last

# ---------------- dedup ----------------


def dedup_recent(stream: DataFrame, key: str, event_time: str, delay: str = "2 days") -> DataFrame:
    """First sighting per key within the watermark; state is dropped after it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, None before the first batch. Any other fault of the store is raised."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_first(
    path: str, keys: list[str], order: list[str], buckets: int = 32
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: a key is written once, by the earliest row that carries it.

    The store is partitioned by a hash bucket of the keys and by batch. A batch reads only the buckets that its keys
    fall into; their list, at most ``buckets`` rows, prunes the scan. Replay-safe: every batch writes its own
    ``batch`` partitions, so a replay replaces the same rows, judged against all the other batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = pick(batch, keys, order)
        first = first.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        stored = _table_or_none(spark, path)
        fresh = first
        if stored is not None:
            others = stored.where(F.col("batch") != batch_id)
            touched = F.broadcast(first.select("bucket").distinct())
            fresh = append_unseen(others.join(touched, "bucket", "left_semi"), first, keys)
        out = fresh.withColumn("batch", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    return write


def upsert_partitions(
    path: str, keys: list[str], order: list[str], partition: str
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: last write wins, rewriting only the partitions a batch touches.

    The merged rows go to a staging folder first, since a partition cannot be
    read and overwritten in one job; replaying the batch gives the same table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = pick(batch, keys, order, last=True)
        stored = _table_or_none(spark, path)
        merged = new
        if stored is not None:
            touched = new.select(partition).distinct()
            # one row per partition folder, which the driver lists anyway; only so does the scan skip the other folders
            same = stored.join(F.broadcast(touched), partition, "left_semi")
            merged = upsert_last(same, new, keys)
        stage = f"{path}_staging/batch={batch_id}"
        merged.write.mode("overwrite").parquet(stage)
        (
            spark.read.parquet(stage).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        )

    return write


def run_batches(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


# ---------------- flag state with a time limit ----------------

FLAG_OUT = T.StructType(
    [
        T.StructField("asset", T.StringType()), T.StructField("ts", T.TimestampType()),
        T.StructField("severity", T.LongType()), T.StructField("status", T.StringType()),
    ]
)


class FlagState(StatefulProcessor):
    """Latest severity per asset. When no newer flag arrives within the limit, the
    state expires and one 'unknown' row is emitted, which callers treat conservatively."""

    def __init__(self, ttl_hours: float = 24.0):
        self.ttl_ms = int(ttl_hours * 3_600_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.flag = handle.getValueState(
            "flag", T.StructType([T.StructField("ms", T.LongType()), T.StructField("severity", T.LongType())])
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self.flag.get() if self.flag.exists() else None
        best = (latest[0], latest[1]) if latest is not None else None
        for pdf in rows:
            for t, s in zip(pdf["ts"], pdf["severity"], strict=True):
                ms = int(pd.Timestamp(t).timestamp() * 1000)
                if best is None or ms >= best[0]:
                    best = (ms, int(s))
        if best is None:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer if not isinstance(timer, (tuple, list)) else timer[0])
        self.flag.update(best)
        self.handle.registerTimer(best[0] + self.ttl_ms)
        yield self._row(key, best[0], best[1], "known")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.flag.clear()
        yield self._row(key, expiredTimerInfo.getExpiryTimeInMs(), None, "unknown")

    @staticmethod
    def _row(key, ms, severity, status) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "asset": [key[0]], "ts": [pd.Timestamp(ms, unit="ms")],
                "severity": pd.array([severity], dtype="Int64"), "status": [status],
            }
        )

    def close(self) -> None:
        pass


def flag_stream(flags: DataFrame, delay: str = "1 hour", ttl_hours: float = 24.0) -> DataFrame:
    """(asset, ts, severity) events to the current flag per asset, with expiry."""
    return (
        flags.withWatermark("ts", delay).groupBy("asset")
        .transformWithStateInPandas(
            statefulProcessor=FlagState(ttl_hours), outputStructType=FLAG_OUT, outputMode="Update", timeMode="EventTime"
        )
    )


class FlagHistory(StatefulProcessor):
    """Flags of an asset in event order, and one 'unknown' row for each time they fell silent for longer than the limit.

    A flag waits until the watermark passes it; then no earlier one can come, and what is emitted does not depend on how
    the input was cut into micro-batches. Of flags of one instant the severest counts. The state of an asset is its
    latest flag and those that the watermark has not passed.
    """

    def __init__(self, ttl_hours: float = 24.0):
        self.ttl_ms = int(ttl_hours * 3_600_000)

    def init(self, handle) -> None:
        self.handle = handle
        ms, severity = T.StructField("ms", T.LongType()), T.StructField("severity", T.LongType())
        self.latest = handle.getValueState("latest", T.StructType([ms]))
        self.waiting = handle.getListState("waiting", T.StructType([ms, severity]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Every row waits; one timer a batch, at its earliest row."""
        new = []
        for pdf in rows:
            new += zip(pdf["ts"].astype("datetime64[ms]").astype("int64").tolist(), pdf["severity"].astype("int64").tolist(), strict=True)
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed, in order; later timers of the same watermark then find nothing to do."""
        now = timerValues.getCurrentWatermarkInMs()
        flags = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [*dict(f for f in flags if f[0] <= now).items()]  # of one instant the severest, which sorts last
        rest = [tuple(f) for f in flags if f[0] > now]
        if due and rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        elif due:
            self.waiting.clear()
        last = self.latest.get()[0] if self.latest.exists() else None
        out = []
        for ms, severity in due:
            if last is not None and ms > last + self.ttl_ms:
                out.append((last + self.ttl_ms, None, "unknown"))
            out.append((ms, severity, "known"))
            last = ms
        if last is not None and last + self.ttl_ms <= now:
            out.append((last + self.ttl_ms, None, "unknown"))
            self.latest.clear()
        elif due:
            self.latest.update((last,))
            self.handle.registerTimer(last + self.ttl_ms)
        if out:
            yield pd.DataFrame({
                "asset": [key[0]] * len(out), "ts": pd.to_datetime([o[0] for o in out], unit="ms"),
                "severity": pd.array([o[1] for o in out], dtype="Int64"), "status": [o[2] for o in out]})

    def close(self) -> None:
        pass


def flag_history(flags: DataFrame, delay: str = "1 hour", ttl_hours: float = 24.0) -> DataFrame:
    """(asset, ts, severity) events to the history of flags and of their expiries. Rows without a time or severity do not count."""
    return (
        flags.where("ts is not null and severity is not null").withWatermark("ts", delay).groupBy("asset")
        .transformWithStateInPandas(
            statefulProcessor=FlagHistory(ttl_hours), outputStructType=FLAG_OUT, outputMode="Append", timeMode="EventTime"
        )
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stateful stream's rows to a file table, exactly once, until nothing is left to read.

    The processors above need the RocksDB state store, a setting that a stream takes from its session when it starts.
    """
    spark, setting = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return w.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


# ---------------- late data ----------------


def admit_available(landing: DataFrame, now) -> DataFrame:
    """Rows whose availability floor has passed; the others stay in the landing zone
    and a later run admits them."""
    return landing.where(F.col("available_at") <= now)


def with_clock(landing: DataFrame, ticks: DataFrame) -> DataFrame:
    """One stream of landing rows and of clock ticks (``tick``, one row per run), so that a run without new rows has a batch
    too, and a replayed batch sees the clock that it saw at first."""
    return landing.unionByName(ticks.select("tick"), allowMissingColumns=True)


def admit_when_available(path: str, held: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink over ``with_clock``: rows whose availability floor has passed go to a first-write store, others wait.

    The held zone has one folder per batch. A batch reads its predecessor's and writes its own, so a replay gives the
    same; only rows not yet available are ever read again. A batch without a tick admits nothing. Rows without a floor wait
    for ever. Folders before the predecessor's are read no more; they are left for the cluster to clear by age.
    """
    store = append_first(path, keys, order)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("_new", F.col("tick").isNull())
        clock = batch.agg(F.max("tick").alias("_now"))  # one row
        rows = batch.where("_new").drop("tick", "_new")
        waiting = _table_or_none(spark, f"{held}/batch={batch_id - 1}")
        if waiting is not None:
            rows = rows.unionByName(waiting)
        timed = rows.crossJoin(F.broadcast(clock))
        ready = F.coalesce(F.col("available_at") <= F.col("_now"), F.lit(False))
        store(timed.where(ready).drop("_now"), batch_id)
        timed.where(~ready).drop("_now").write.mode("overwrite").parquet(f"{held}/batch={batch_id}")

    return write
