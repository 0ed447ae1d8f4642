"""Token counts kept by deltas.

A rollup holds additive totals (documents, tokens) by source, language and tokenizer version. It is never recomputed:
inserts add, deletes subtract, and a revised count subtracts the old and adds the new. A batch of changes is summed to
one row per key and written to a folder of its own; a marker in the commit log makes it count. A batch that is sent
again under its number finds its marker and changes nothing; one that failed before its marker is simply written
again. A number names one content: other changes sent under a committed number are ignored. ``compact`` folds committed
batches into one base, itself a commit that names them. One writer at a time: two that commit one number at once could
both pass the look for its marker.

Sums combine before the shuffle, so a source with a third of all rows is one row per task. The folder has to be shared
by all executors.

Edge cases: null sources and languages are keys of their own. Null or empty texts count 0 tokens and one document.
Repeated rows are counted each. A change without old or without new is an insert or a delete; with neither it is
nothing. An empty batch commits and adds nothing; totals of an empty rollup are empty. Keys whose documents and tokens
are both 0 are left out. Other columns are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
MARKS = string.punctuation.encode()
# UTF-8 bytes: what is no letter, digit or beyond ASCII parts runs.
RUNS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def count_words(text: bytes) -> int:
    """Runs between ASCII white space."""
    return len(text.split())


def count_marks(text: bytes) -> int:
    """Runs without ASCII marks and control characters, and every mark on its own."""
    return len(text.translate(RUNS).split()) + len(text) - len(text.translate(None, MARKS))


# Versions of a countable tokenizer, and patterns whose matches, none inside another's, are their tokens.
VERSIONS: dict[str, Callable[[bytes], int]] = {"words-1": count_words, "marks-2": count_marks}
PATTERNS = {
    "words-1": (r"[^\x20\x09-\x0D]+",),
    "marks-2": (r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[!-/:-@\x5B-\x60{-~]"),
}


def counted(
    docs: DataFrame, versions: dict[str, Callable[[bytes], int]] = VERSIONS, revise: Callable[[bytes], bytes] | None = None,
) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): one row per document and version, from one pass over the texts; with
    ``revise``, which makes another text of a text, also its count (revised). In Arrow batches, over UTF-8 bytes."""
    rows = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    names = ["doc_id", "source", "lang", "tokenizer", "tokens", *(["revised"] if revise else [])]
    kept = T.StructType(rows.schema.fields[:3])
    kind = T.StructType([*kept.fields, T.StructField("tokenizer", T.StringType()), *[T.StructField(n, T.LongType()) for n in names[4:]]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column("text").cast(pa.binary())]
            others = [list(map(revise, texts))] if revise else []
            for name, count in versions.items():
                numbers = [pa.array(map(count, x), pa.int64(), size=b.num_rows) for x in (texts, *others)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([name] * b.num_rows, pa.string()), *numbers], names=names)

    return rows.mapInArrow(each, kind)


def signed(rows: DataFrame, new: Column | None = None, old: Column | None = None) -> DataFrame:
    """Changes to the totals: +1 document and ``new`` tokens, -1 document and ``old`` tokens, or both (revised)."""
    docs = (F.lit(0) if new is None else F.when(new.isNotNull(), 1).otherwise(0)) - (F.lit(0) if old is None else F.when(old.isNotNull(), 1).otherwise(0))
    tokens = F.coalesce(F.lit(None) if new is None else new, F.lit(0)) - F.coalesce(F.lit(None) if old is None else old, F.lit(0))
    return rows.select(*KEYS, docs.cast("bigint").alias("n_docs"), tokens.cast("bigint").alias("n_tokens"))


class Rollup:
    """Totals in a folder: ``batches/<id>`` with deltas, ``log/<id>`` with markers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self.fs(path)
        return fs.exists(p)

    def committed(self) -> list[str]:
        """Batches that count: those in the log, less those folded into a base that is in the log."""
        if not self.exists(f"{self.root}/log"):
            return []
        log = self.spark.read.schema("batch string, folds array<string>").json(f"{self.root}/log/*").collect()
        gone = {b for x in log for b in x.folds or []}
        return sorted({x.batch for x in log} - gone)

    def commit(self, batch: str, changes: DataFrame, folds: list[str] | None = None) -> bool:
        """Add a batch of signed changes; False if it was committed before."""
        if self.exists(f"{self.root}/log/{batch}/_SUCCESS"):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs <> 0 OR n_tokens <> 0").write.mode("overwrite").parquet(f"{self.root}/batches/{batch}")
        mark = self.spark.range(1).select(F.lit(batch).alias("batch"), F.array(*map(F.lit, folds or [])).cast("array<string>").alias("folds"))
        mark.coalesce(1).write.mode("overwrite").json(f"{self.root}/log/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        paths = [f"{self.root}/batches/{b}" for b in self.committed()]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, base: str) -> bool:
        """Fold all committed batches into the batch ``base``."""
        return self.commit(base, self.totals(), self.committed())
