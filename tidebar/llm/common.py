"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.session import scratch_path

# A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return:
# the very bytes that bytes.split() splits at, so Python tasks split the UTF-8 text directly.
WORD = r"[^\x20\x09-\x0D]+"


TEXT_ROWS = 1000  # whole texts that go to a Python task at once
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: what stands above is never computed again, also if executors are lost later. ``batch``: rows that go to
    a Python task at once while it is written, for long rows; the session's own setting stands again afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    own = spark.conf.get(BATCH)
    if batch is not None:
        spark.conf.set(BATCH, str(min(batch, int(own)) if int(own) > 0 else batch))
    try:
        df.write.parquet(path)
    finally:
        if batch is not None:
            spark.conf.set(BATCH, own)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables, by the very paths just made. Only for tables whose every reader has been written."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` for mapInArrow, with what its batches took given back to the system at the end of the task.

    Spark keeps a worker for a minute for tasks to come, and what it has freed but not given back stands there beside the
    executor's own memory in stages that need no Python at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give the memory that Arrow and the C library have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


SIEVE_WORDS = 1 << 18  # most words of 64 bits of a sieve: 16 bits a key up to a million keys, fewer beyond


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): a bit map of the keys (bigint), of bounded size, staged. It says which rows may have one of them, so
    that the others need not be shuffled to a join; what passes is joined, so a full map costs time and no result."""
    words = min(SIEVE_WORDS, 1 << max(6, (keys.count() // 4).bit_length()))
    at = F.pmod(F.col(key), F.lit(64 * words))
    bits = F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod({key}, 64) AS INT))")).alias("bits")
    return staged(keys.groupBy(F.floor(at / 64).alias("word"), F.lit(words).alias("words")).agg(bits), "sieve")


def sieved(rows: DataFrame, key: str, through: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of the sieve, rows that have none); ``key`` names a column or field, never null."""
    first = through.select("words").first()
    if first is None:
        return rows.where(F.lit(False)), rows
    cols = [F.col(f"`{c}`") for c in rows.columns]
    own = free_name(rows, "sieve")
    small = F.broadcast(through.select(F.struct("word", "bits").alias(own)))
    at = F.floor(F.pmod(F.expr(key), F.lit(64 * first.words)) / 64)
    met = rows.join(small, at == F.col(f"{own}.word"), "left")
    hit = F.expr(f"shiftright(coalesce({own}.bits, 0L), CAST(pmod({key}, 64) AS INT)) & 1L") == 1
    return met.where(hit).select(*cols), met.where(~hit).select(*cols)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind until the table has no such column in any case: for own values that travel along."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) fixed by the parts: 52 bits of their MD5, so that every engine draws the same."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))
