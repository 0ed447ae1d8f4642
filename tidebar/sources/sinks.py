"""Table sinks. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.plans.features import ALL_FEATURES, LABELS, MASKS, META, manifest
from tidebar.plans.registry import latest_signal


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a table; with partitions only those present in ``df`` are replaced."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def append_history(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append-only history: no read, no rewrite."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def bucket_bars(bars: DataFrame, table: str, path: str, buckets: int, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """Store bars as a table bucketed by series and sorted in time within a bucket, and return its scan.

    Rows are dealt to their buckets by one shuffle at writing, so each bucket is one file. From then on a window over a
    series or an aggregate by series reads bucket by bucket, without a shuffle. So does a join with a table of as many buckets
    on ``keys``; one on more columns, such as series and time, only in a session that sets
    ``spark.sql.requireAllClusterKeysForCoPartition`` to false.
    Choose ``buckets`` so that one holds some hundred megabytes; a series lies in one bucket, and is bounded by the calendar.
    """
    spark = bars.sparkSession
    rows = bars.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys, order).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def write_signals(weights: DataFrame, path: str, strategy: str) -> None:
    """Full weight table plus a one-row JSON of the latest decision."""
    replace_table(weights, f"{path}/{strategy}")
    latest = latest_signal(weights).withColumn("strategy", F.lit(strategy))
    latest.write.mode("overwrite").json(f"{path}/{strategy}.latest")


def write_features(table: DataFrame, path: str) -> None:
    """Feature table plus manifest; a table with other columns is refused."""
    want = [*META, *ALL_FEATURES, *MASKS, *LABELS]
    if table.columns != want:
        odd = sorted(set(table.columns) ^ set(want))
        raise ValueError(f"feature table columns differ from the schema: {odd or 'order'}")
    replace_table(table, f"{path}/table")
    stored = table.sparkSession.read.parquet(f"{path}/table")
    manifest(stored).write.mode("overwrite").json(f"{path}/manifest")


def write_summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
