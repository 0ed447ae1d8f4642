"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has the 64 majority bits of its shingles' hashes. Documents of one fingerprint become one
node before anything is compared, so a group of exact copies is one row. The fingerprint is cut into segments; of two
fingerprints that differ in at most ``radius`` bits, some segment differs in few (pigeonhole), so each node is entered
in one table per segment and probes the small Hamming ball around its own value there. Of two values near each other
only the smaller probes the larger. Matches are verified on all 64 bits.

Nothing emits all pairs of a group. Verified matches become spanning forests inside the task that found them: small
buckets by direct comparison, large ones by a search that takes every fingerprint out as it is reached, so a dense
group of G costs near G rather than G squared, and every task returns at most one link per row it read. The links are
joined to components by alternating large-star and small-star steps, each staged in the shared folder, until nothing
changes; no number of rounds is fixed.

Edge cases: a null text or one without words has fingerprint zero and is linked like any other. Rows that repeat, and
rows of one doc_id, are rows of their own with the same component. A null doc_id is no name for a component: the
smallest other one is taken, null if there is none. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import staged, trimmed

SEED = 42
BITS = 64
DIRECT = 32  # members of a bucket that are compared with all its rows; above, the search is used


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bit i is 1 if bit i is set in over half of the shingle hashes (XXH64, repeats counted)."""
    from xxhash import xxh64_intdigest as digest

    parts = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], schema=out)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(each), "doc_id bigint, fp bigint")


def segments(nodes: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment. Three segments, or two for very many nodes, keep buckets small.

    Of m segments, with radius = m * r + a, one of the first a + 1 differs in at most r bits or one of the others in
    at most r - 1; a radius below 0 leaves a segment out.
    """
    m = 3 if nodes < 1 << 26 else 2
    r, a = divmod(radius, m)
    edges = [BITS * k // m for k in range(m + 1)]
    cut = [(lo, hi - lo, r if k <= a else r - 1) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return [s for s in cut if s[2] >= 0]


def table_rows(fps: np.ndarray, cut: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, fp, probe): the entry of each fingerprint and the probes to larger values of its Hamming balls."""
    keys, whose, probes = [], [], []
    for k, (shift, width, radius) in enumerate(cut):
        value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(k << 60)
        keys.append(value | tag)
        whose.append(fps)
        probes.append(np.zeros(len(fps), bool))
        for d in range(1, radius + 1):
            for bits in combinations(range(width), d):
                near = value ^ np.uint64(sum(1 << b for b in bits))
                up = near > value
                keys.append(near[up] | tag)
                whose.append(fps[up])
                probes.append(np.ones(int(up.sum()), bool))
    return np.concatenate(keys), np.concatenate(whose), np.concatenate(probes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links a-b connect; root is the smallest node."""
    nodes, ab = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ab[: len(a)], ab[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def searched(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning links of one large bucket; a fingerprint is compared no more once it is reached."""
    left, a, b = np.unique(fps), [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                got = left[near]
                left = left[~near]
                a.append(got)
                b.append(np.full(len(got), x))
                frontier.extend(got)
    return a, b


def bucket_links(keys: np.ndarray, fps: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between the entries of each bucket, and from its probes to its entries, as a forest."""
    order = np.lexsort((probes, keys))
    keys, fps, probes = keys[order], fps[order], probes[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(keys)]]))
    members = np.add.reduceat(~probes, first) if len(first) else size
    a, b = [], []
    for k in np.flatnonzero((members > DIRECT) & (size > 1)):
        x, y = searched(fps[first[k] : first[k] + size[k]], radius)
        a += x
        b += y
    small = (members > 0) & (members <= DIRECT) & (size > 1)
    start, member, height = (np.repeat(v[small], size[small]) for v in (first, members, size))
    row = start + (np.arange(len(start)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]))
    for j in range(int(member.max(initial=0))):  # each row against the j-th entry of its bucket, once per pair
        ok = (j < member) & (row > start + j)
        x, y = fps[row[ok]], fps[start[ok] + j]
        near = np.bitwise_count(x ^ y) <= radius
        a.append(x[near])
        b.append(y[near])
    none = np.zeros(0, fps.dtype)
    return forest(np.concatenate([none, *a]), np.concatenate([none, *b]))


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between fingerprints at ``radius`` or fewer differing bits; a forest from each task."""
    cut = segments(nodes.count(), radius)
    spread = pa.schema([("bucket", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_())])
    link = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            if len(fps):
                keys, whose, probes = table_rows(fps, cut)
                for k in range(0, len(keys), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(whose[part].view(np.int64)), pa.array(probes[part])], schema=spread)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            keys, fps, probes = (np.concatenate(x) for x in zip(*got, strict=True))
            a, b = bucket_links(keys, fps.view(np.uint64), probes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=link)

    rows = nodes.select("fp").mapInArrow(trimmed(enter), "bucket bigint, fp bigint, probe boolean")
    return rows.repartition("bucket").mapInArrow(trimmed(verify), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable. Star contraction."""
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex), component_id, the smallest doc_id reachable."""
    fps = staged(fingerprints(docs, words), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    linked = staged(components(links(nodes, radius)), "simhash-components")
    nodes = nodes.join(linked, nodes.fp == linked.node, "left").drop("node")
    alone = nodes.where("root IS NULL").select("fp", F.col("first_id").alias("component_id"))
    grouped = nodes.where("root IS NOT NULL")
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = alone.unionByName(grouped.join(smallest, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component, once each; rows without doc_id stay. Same columns."""
    kept = near_duplicates(docs, words, radius).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])
