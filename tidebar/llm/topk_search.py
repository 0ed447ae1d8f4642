"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments; of each only mean and deviation are kept, at a coarse and a finer resolution. The
distance of two vectors is at least the distance of these statistics (a segment of length L adds
L * ((difference of means)^2 + (difference of deviations)^2)), so the inner product, half of both squared norms less
the squared distance, has an upper bound. A query first scores the candidates with the best coarse bounds exactly;
the k-th of these scores is beaten by every result. Candidates whose coarse bound is below it are gone, of the others
those whose fine bound is below it, and the exact score is computed for the survivors.

Queries and candidates are dealt into blocks of bounded size by a hash of vec_id, and each pair of blocks is one task
that returns k rows per query; a query's k best of all blocks follow. Memory of a task is a pair of blocks. An exact
search without an index reads every candidate block once per query block; both block sizes are parameters.

Edge cases: vectors that are null or empty, or hold a null or non-finite component, and rows without vec_id, take no
part. A shorter vector counts as ended by zeros. Rows that repeat a vec_id are candidates each, but of no query with
that vec_id; queries that repeat one share its k ranks. Fewer than k candidates give all. Ties go to the smaller
vec_id. Empty tables give an empty result. Other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
OUT_SQL = "query_id bigint, vec_id bigint, score bigint"
COARSE, FINE = 4, 16  # segments


def quantised(x: Column, scale: int = 64) -> Column:
    return F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    x = F.col("embedding")
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    out = vectors.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fits)
    return out.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(x, scale).alias("v"))


def block_table(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, one padded row of integers for each); ids can repeat."""
    ids = t.column("vec_id").to_numpy()
    lists = t.column("v").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.zeros((len(ids), width), np.int64)
    at = np.arange(len(lists.flatten())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows[np.repeat(np.arange(len(ids)), sizes), at] = lists.flatten().to_numpy()
    return ids, rows


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments times the root of their length: the product of two such rows bounds the
    inner product of the vectors from above."""
    parts = [p for p in np.array_split(np.arange(x.shape[1]), segments) if len(p)]
    root = np.sqrt([len(p) for p in parts])
    means = np.stack([x[:, p].mean(axis=1) for p in parts], axis=1)
    devs = np.stack([x[:, p].std(axis=1) for p in parts], axis=1)
    return np.concatenate([means * root, devs * root], axis=1)


def best_of_block(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> list[list[np.ndarray]]:
    """Each query's k best rows: [query ids, row ids, scores]."""
    (qid, q), (vid, v) = queries, rows
    order = np.argsort(vid)
    vid, v = vid[order], v[order]
    big = float(np.abs(q).max(initial=1)) * float(np.abs(v).max(initial=1)) * q.shape[1] >= 2.0**53
    exact = v if big else v.astype(float)  # doubles hold sums below 2^53 exactly
    qf, vf = q.astype(float), v.astype(float)
    slack = 1e-9 * (np.linalg.norm(qf, axis=1)[:, None] * np.linalg.norm(vf, axis=1).max(initial=0)) + 1e-6
    q1, q2, v1, v2 = statistics(qf, COARSE), statistics(qf, FINE), statistics(vf, COARSE), statistics(vf, FINE)
    out: list[list[np.ndarray]] = [[], [], []]
    for lo in range(0, len(qid), 256):
        bound = q1[lo : lo + 256] @ v1.T + slack[lo : lo + 256]
        for i, near in enumerate(bound, lo):
            one = q[i] if big else qf[i]
            own = vid == qid[i] if len(vid) and vid[min(np.searchsorted(vid, qid[i]), len(vid) - 1)] == qid[i] else None
            if own is not None:
                near = np.where(own, -np.inf, near)
            live = len(vid) - (0 if own is None else int(own.sum()))
            if live <= 0:
                continue
            if live > k:
                seeds = np.argpartition(-near, k - 1)[:k]
                floor = np.sort(exact[seeds] @ one)[0]
                left = np.flatnonzero(near >= floor)
                left = left[v2[left] @ q2[i] + slack[i] >= floor]
            else:
                left = np.flatnonzero(near > -np.inf)
            scores = exact[left] @ one
            if len(left) > k:
                worst = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= worst
                left, scores = left[keep], scores[keep]
            top = np.lexsort((vid[left], -scores))[:k]
            out[0].append(np.full(len(top), qid[i]))
            out[1].append(vid[left[top]])
            out[2].append(scores[top].astype(np.int64))
    return out


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, query_block: int = 4096, row_block: int = 8192,
) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank (from 1), vec_id, score.

    ``vectors`` and ``queries`` have (vec_id, embedding); components are floor(scale * x). A vector is no candidate of
    the query with its vec_id.
    """
    rows, asked = usable(vectors, scale), usable(queries, scale)
    n, m, width = (rows.count(), asked.count(), rows.agg(F.max(F.size("v"))).first()[0] or 1)
    width = max(width, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    row_blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-m // query_block))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks))
    mine = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks))
    rows = rows.withColumn("rb", own).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("qb", mine).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return OUT.empty_table()
        got = best_of_block(block_table(left, width), block_table(right, width), k)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in got], schema=OUT)

    keys = [F.col("qb").cast("bigint"), F.col("rb").cast("bigint")]
    asked = asked.select("vec_id", "v", keys[0].alias("qb"), keys[1].alias("rb"))
    rows = rows.select("vec_id", "v", keys[0].alias("qb"), keys[1].alias("rb"))
    found = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInArrow(search, OUT_SQL)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
