"""Ranked lexical search by dense blocked multiplication.

Every document is scored for every item by integer term weights and impacts. Items are dealt into groups of bounded
vocabulary; a group's terms are numbered, and one pass over the texts keeps of each document its length and the
numbers and counts of these terms. Then tiles of items, with the compact vocabulary that they use, are multiplied with
tiles of documents: a float64 matrix of impacts times one of weights, in BLAS. Columns are cut so that a partial sum stays
below 2^53, so every product and sum is exact, and partial sums are added as integers.

Each task keeps the best ``k`` of an item from tile to tile: a document enters if its score is not below the k-th, and
ties are settled by doc_id, so no tie is lost at an edge of tiles. The tasks' results are merged by a ranked window, of
which Spark keeps k rows per item before the shuffle.

What is gathered at the driver is one group of items: its terms, bounded by ``TERMS`` in the mean (items are dealt by
hash, items of one text are one), and one count per term. The corpus itself never passes there.

Edge cases: null and empty texts have no terms; they do not count as documents and no item finds them. Items without
terms give no rows. Repeated rows are documents, or items, of their own. A null doc_id comes after all others at equal
scores. Empty tables give an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import staged

K = 50
TERMS = 1 << 18  # terms of a group of items
ITEMS, DOCS, COLUMNS = 256, 1024, 4096  # items, documents and columns of a tile
LAST = 2**63 - 1
TOP = 10**6  # no impact reaches it
# Bytes of UTF-8: digits, letters and all beyond ASCII stay, A-Z are lower-cased, all else parts terms.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """(key, terms): the distinct terms of every distinct text of ``items``; key names the text."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t.as_py()))) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(found, pa.list_(pa.binary()))], names=["key", "terms"])

    texts = items.where("text IS NOT NULL").select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    return texts.mapInArrow(each, "key string, terms array<binary>").where(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, ids, tfs): per row with a term, its length and what it has of the vocabulary."""
    number = {t: i for i, t in enumerate(vocabulary)}
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                found = terms(t.as_py() or b"")
                if found:
                    has = [(number[w], c) for w, c in Counter(found).items() if w in number]
                    rows.append((i, len(found), [x for x, _ in has], [c for _, c in has]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(each, "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents of each term; every task adds up its own before they are summed."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column("ids").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "df"])

    sums = found.select("ids").mapInArrow(each, "id bigint, df bigint").groupBy("id").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(size, np.int64)
    for r in sums:
        out[r.id] = r.df
    return out


def tiles(items: list[list[int]], weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first item, vocabulary numbers of its columns, weights by column and item) of each tile; a tile whose columns
    would be too many, or whose sums could reach 2^53, is cut by columns."""
    most = min(COLUMNS, max(1, (2**53 - 1) // (TOP * max(1, int(weights.max(initial=1))))))
    out = []
    for at in range(0, len(items), ITEMS):
        part = items[at : at + ITEMS]
        used = np.unique(np.concatenate([np.array(x, np.int64) for x in part]))
        for lo in range(0, len(used), most):
            cols = used[lo : lo + most]
            w = np.zeros((len(cols), len(part)))
            for k, x in enumerate(part):
                mine = np.intersect1d(x, cols, assume_unique=True)
                w[np.searchsorted(cols, mine), k] = weights[mine]
            out.append((at, cols, w))
    return out


def scores(rows: np.ndarray, ids: np.ndarray, impacts: np.ndarray, docs: int, cut: list, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first item, documents x items) as exact integers, for one tile of documents and every tile of items."""
    total, column = {}, np.full(size, -1, np.int64)
    for at, cols, w in cut:
        column[cols] = np.arange(len(cols))
        c = column[ids]
        there = c >= 0
        column[cols] = -1
        tile = np.zeros((docs, len(cols)))
        tile[rows[there], c[there]] = impacts[there]
        part = (tile @ w).astype(np.int64)
        total[at] = total[at] + part if at in total else part
    yield from total.items()


class Best:
    """The best k (score, document) of each of some items so far; ties go to the smaller document."""

    def __init__(self, items: int, k: int):
        self.k, self.item, self.score, self.doc = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        if len(row):
            item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[row, item]), (self.doc, docs[row])))
            order = np.lexsort((doc, -score, item))
            item, score, doc = item[order], score[order], doc[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            full = rank == self.k - 1
            self.floor[item[full]] = score[full]
            self.item, self.score, self.doc = (x[rank < self.k] for x in (item, score, doc))


def group_best(found: DataFrame, items: list[tuple[str, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(key, doc_id, score): the best k of each item of a group among the rows of each task."""
    keys, cut, size = [key for key, _ in items], tiles([x for _, x in items], weights), len(weights)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {at: Best(w.shape[1], k) for at, _, w in cut}
        for whole in batches:
            for lo in range(0, whole.num_rows, DOCS):
                b = whole.slice(lo, DOCS)
                m = np.array([50 + (50 * n * n_docs) // n_terms for n in b.column("n").to_pylist()], np.int64)
                has = np.diff(b.column("ids").offsets.to_numpy())
                rows = np.repeat(np.arange(b.num_rows), has)
                ids, tf = (b.column(c).flatten().to_numpy() for c in ("ids", "tfs"))
                impacts = (10**9 * tf) // (1000 * tf + 20 * m[rows])
                docs = b.column("doc_id").fill_null(LAST).to_numpy()
                for at, got in scores(rows, ids, impacts, b.num_rows, cut, size):
                    best[at].add(got, docs)
        for at, x in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([keys[at + i] for i in x.item], pa.string()), pa.array(x.doc), pa.array(x.score)], names=["key", "doc_id", "score"])

    return found.where(F.size("ids") > 0).mapInArrow(each, "key string, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, group_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text) the k documents of ``docs`` (doc_id,
    text) of highest score above 0."""
    wanted = staged(item_terms(items), "rank-items")
    groups = -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // group_terms)
    found = []
    for g in range(groups):
        group = wanted.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).orderBy("key").collect()
        vocabulary = sorted({bytes(t) for r in group for t in r.terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        rows = staged(postings(docs, vocabulary), "rank-postings")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if n_docs:
            weights = np.array([weight(n_docs, int(x)) for x in frequencies(rows, len(vocabulary))], np.int64)
            found.append(group_best(rows, [(r.key, [number[bytes(t)] for t in r.terms]) for r in group], weights, n_docs, n_terms, k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    every = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "doc_id")
    top = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = items.where("text IS NOT NULL").select("item_id", F.sha2("text", 256).alias("key"))
    doc = F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id")
    return names.join(top, "key").select("item_id", "rank", doc, "score")
