"""Near-duplicates by SimHash, verified by exact Jaccard similarity of word shingles; a prefix filter that loses no pair
finds those that the fingerprints miss.

A document is the set of its shingles' hashes (XXH64). Documents of one set become one node before anything is
compared, so a group of exact copies is one row. First the SimHash fingerprints of these nodes are linked at ``RADIUS`` or
fewer bits by multi-index hashing (``simhash.links``), and links that hold on the whole sets make components. Sets of
similarity 0.8 may differ in more bits, so the nodes then meet once more, and pairs within a component are left out. All sets are sorted in one order; two sets of Jaccard p/q or more
share a shingle among the first n - ceil(p/q n) + 1 of each, so nodes meet at these shingles only. At the first one
they share enough must follow in both (positional bound), and their sizes must be near. The order is by hash, with
shingles that stand in many texts of a sample behind all others; it decides what is cheap, never what is found.

Pairs that met are tested on parity bitmaps, about one bit per shingle: a shingle toggles one bit, so the bits in which
two maps differ are no more than the shingles in which the sets do, which bounds the overlap from above. Only what
passes is verified on the whole sets; nothing else causes a set to be shuffled, and nothing is capped.

The members of a shingle are compared in order of size: first each with its next ``NEAR``, which is all pairs of
most shingles; verified matches become components; then all pairs of the larger ones that lie in different components,
since the others change nothing. So a dense group of G costs near G. A shingle of more than ``TILE`` such members is
cut into blocks that meet pairwise in tasks of their own.

Texts are read twice and never shuffled but for those that a sieve of the wanted hashes lets through; likewise only rows
that may have a copy pass the last join. Intermediate tables are deleted once those built from them are written.

Edge cases: texts shorter than a shingle are one shingle; those without words, and null ones, have one empty set and
are alike. Rows alike in doc_id and text are one. Rows without doc_id stay, but link others. Equal hashes count as equal.
Own values travel in one struct column under a name that the table does not have, so no column clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import TEXT_ROWS, discard, free_name, sieve, sieved, staged, trimmed
from tidebar.llm.simhash import SEED, components, fingerprint
from tidebar.llm.simhash import links as fingerprint_links

SHARE = (4, 5)  # Jaccard similarity of near copies as a fraction
RADIUS = 5  # bits in which linked fingerprints differ at most; each of their three segments is probed at one bit
NEAR = 4
TILE = 2048  # members of a shingle that one task compares; more are cut into blocks of half as many
SAMPLE, OFTEN, MOST = 10_000, 8, 100_000  # texts sampled; shingles in OFTEN of them or more go last, MOST of them at most


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words."""
    from xxhash import xxh64_intdigest as digest

    parts = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(parts) - words + 1, 1)
    spans = zip(starts[:n].tolist(), ends[len(parts) - n :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def prefix(found: np.ndarray, often: np.ndarray, share: tuple[int, int] = SHARE) -> np.ndarray:
    """The shingles of a set at which it can meet others first; those of ``often`` (sorted) are last in the order."""
    p, q = share
    keep = len(found) + p * len(found) // -q + 1 if len(found) else 0
    if len(often):
        late = np.isin(found, often, assume_unique=True)
        found = np.concatenate([found[~late], found[late]])
    return found[:keep]


def alike(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return share[1] * both >= share[0] * (len(a) + len(b) - both)


def parity(found: np.ndarray) -> bytes:
    """A bitmap of 64 bits or more, a power of two near the size of the set; every hash toggles one bit."""
    bits = 1 << max(6, (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, n: int, share: tuple[int, int] = SHARE) -> bool:
    """Whether sets of together ``n`` shingles with these bitmaps can be alike; the longer map is folded onto the shorter."""
    x, y, width = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * max(len(a), len(b))
    if len(a) < len(b):
        x, y = y, x
    while width > 8 * min(len(a), len(b)):
        width //= 2
        x = (x >> width) ^ (x & ((1 << width) - 1))
    p, q = share
    return (x ^ y).bit_count() <= n - 2 * -(p * n // -(p + q))


def meetings(
    keys: np.ndarray, nodes: np.ndarray, n: np.ndarray, at: np.ndarray, comps: np.ndarray, half: np.ndarray, most: int | None, share: tuple[int, int] = SHARE,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of nodes that can be alike, of members of one key that stand up to ``most`` places apart. Rows are in order of
    (key, n, node); rows of one half other than 0 do not meet."""
    p, q = share
    row, gap = np.arange(len(keys) - 1), 1
    while len(row) and (most is None or gap <= most):
        row = row[row + gap < len(keys)]
        row = row[keys[row] == keys[row + gap]]
        row = row[q * n[row] >= p * n[row + gap]]  # later members are larger still
        x, y = row, row + gap
        left = np.minimum(n[x] - at[x], n[y] - at[y])
        ok = (comps[x] != comps[y]) & ((p + q) * left >= p * (n[x] + n[y])) & ((half[x] == 0) | (half[x] != half[y]))
        yield x[ok], y[ok]
        gap += 1


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that stand in many different texts of a sample."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(docs.count() // SAMPLE, 1))) == 0).select("text").distinct()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py() or b"", words).view(np.int64))], names=["tok"])

    counts = part.mapInArrow(trimmed(each), "tok bigint").groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "tok").limit(MOST).select("tok").collect()
    return np.sort(np.array([r.tok for r in top], np.int64).view(np.uint64))


def sets(docs: DataFrame, words: int, often: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, node, n, prefix, map, fp) of every row: the name of its set, its size, where it meets, its bitmap,
    its SimHash fingerprint."""
    out = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("map", pa.binary()), ("fp", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for b in batches:
            texts = [t.as_py() or b"" for t in b.column("text").cast(pa.binary())]
            found = [shingles(t, words) for t in texts]
            fps = pa.array(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))
            node = np.fromiter((digest(s.tobytes(), SEED) for s in found), np.uint64, len(found)).view(np.int64)
            firsts = pa.array([prefix(s, often).view(np.int64) for s in found], pa.list_(pa.int64()))
            n, maps = pa.array([len(s) for s in found], pa.int64()), pa.array([parity(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(node), n, firsts, maps, fps], schema=out)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(trimmed(each), "doc_id bigint, text_hash bigint, node bigint, n bigint, prefix array<bigint>, map binary, fp bigint")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(node, n, prefix, map, fp, text_hash, first, copies): one row per distinct set; first is its smallest (doc_id,
    text_hash), text_hash the hash of a text that has it, copies says whether it stands in several rows."""
    name = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    return rows.groupBy("node").agg(
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("map").alias("map"), F.first("fp").alias("fp"), F.min("text_hash").alias("text_hash"),
        F.min(name).alias("first"), (F.count("*") > 1).alias("copies"),
    )


def in_order(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> list[np.ndarray]:
    """The number columns of a task's rows, which begin with tok, node and n, in order of (tok, n, node), and that order."""
    got = [[b.column(c).to_numpy() for c in columns] for b in batches]
    cols = [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64) for _ in columns]
    order = np.lexsort((cols[1], cols[2], cols[0]))
    return [*(c[order] for c in cols), order]


def linked(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that SimHash links: of one fingerprint each node with the first, of near ones the first nodes. Staged."""
    heads = staged(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-heads")
    x, y = (heads.select(F.col("fp").alias(c), F.col("head").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    near = fingerprint_links(heads, RADIUS).join(x, "a").join(y, "b").select("x", "y")
    same = nodes.select("fp", "node").join(heads, "fp").where("node <> head").select(F.col("head").alias("x"), F.col("node").alias("y"))
    pairs = staged(near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "near-linked")
    discard(heads)
    return pairs


def apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are not in one component."""
    for c in ("a", "b"):
        pairs = pairs.join(named.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}")), c, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of near members; and the members (tok, a, n, at) of every shingle that has more than these pairs."""
    out = pa.schema([(c, pa.int64()) for c in ("tok", "a", "b", "n", "at")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, node, n, at, _ = in_order(batches, ("tok", "node", "n", "at"))
        rows = [np.sort(node[np.stack(x)], axis=0).T for x in meetings(keys, node, n, at, node, 0 * keys, NEAR)]
        pairs = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], schema=out)
        _, whose, size = np.unique(keys, return_inverse=True, return_counts=True)
        big = size[whose] > NEAR + 1 if len(keys) else np.zeros(0, bool)
        none = pa.nulls(int(big.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys[big]), pa.array(node[big]), none, pa.array(n[big]), pa.array(at[big])], schema=out)

    rows = nodes.select("node", "n", F.posexplode("prefix").alias("at", "tok"))
    rows = rows.select("tok", "node", "n", F.col("at").cast("bigint").alias("at")).repartition("tok")
    return rows.mapInArrow(trimmed(each), "tok bigint, a bigint, b bigint, n bigint, at bigint")


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not exclude."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("x", "y", "n"))
            yield b.select(["a", "b"]).filter(pa.array(list(map(may_be_alike, *cols)), pa.bool_()))

    maps = nodes.select("node", "n", "map")
    x = maps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("map").alias("x"))
    y = maps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("map").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("na") + F.col("nb")).alias("n"))
    return both.mapInArrow(trimmed(each), "a bigint, b bigint")


def far_candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members (tok, node, n, at, comp, map) of each shingle, of two components, that their bitmaps
    do not exclude."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        keys, node, n, at, comp, half, order = in_order(iter(got), ("tile", "node", "n", "at", "comp", "half"))
        maps = [m.as_py() for b in got for m in b.column("map")]
        for x, y in meetings(keys, node, n, at, comp, half, None):
            ok = [may_be_alike(maps[i], maps[j], k) for i, j, k in zip(order[x], order[y], (n[x] + n[y]).tolist(), strict=True)]
            pairs = np.sort(node[np.stack([x[ok], y[ok]])], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    # Shingles of one component have nothing to say. Large ones are staged: few rows, so that Spark can split the join.
    sizes = members.groupBy("tok").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    several = staged(sizes.where("lo <> hi").select("tok", F.ceil(F.col("size") / (TILE // 2)).cast("int").alias("blocks")), "near-shingles")
    rows = members.join(several, "tok")
    blocks = F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    half = F.when(lo == hi, 0).when(F.col("mine") == lo, 1).otherwise(2).cast("bigint")
    rows = rows.select(F.xxhash64("tok", lo, hi).alias("tile"), "node", "n", "at", "comp", half.alias("half"), "map").repartition("tile")
    return rows.mapInArrow(trimmed(each), "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike, of staged pairs. Deletes the pairs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py() or b"", words).tobytes() for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.binary())], names=["node", "found"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(s.as_buffer(), np.uint64) for s in b.column(c)] for c in ("x", "y"))
            yield b.select(["a", "b"]).filter(pa.array(list(map(alike, x, y)), pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = staged(nodes.select("node", "text_hash").join(ends, "node"), "near-wanted")
    through = sieve(wanted, "text_hash")
    texts = sieved(docs.select(F.xxhash64("text").alias("text_hash"), "text"), "text_hash", through)[0]
    texts = texts.dropDuplicates(["text_hash"]).join(wanted, "text_hash")
    found = staged(texts.select("node", "text").mapInArrow(trimmed(read), "node bigint, found binary"), "near-sets", TEXT_ROWS)
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
    both = both.join(found.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    links = staged(both.select("a", "b", "x", "y").mapInArrow(trimmed(each), "a bigint, b bigint"), "near-links")
    discard(pairs, wanted, through, found)
    return links


def near_components(rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, root, first, copies) of every distinct set of the staged ``rows`` of ``docs``, staged."""
    nodes = staged(distinct_sets(rows), "near-nodes")
    met = linked(nodes)
    pairs = staged(bounded(met, nodes), "near-pairs")
    discard(met)
    first = verified(pairs, nodes, docs, words)
    old = staged(components(first), "near-components")
    met = staged(candidates(nodes), "near-candidates")
    pairs = staged(bounded(apart(met.where("tok IS NULL").select("a", "b").distinct(), old), nodes), "near-pairs")
    more = verified(pairs, nodes, docs, words)
    links = staged(first.unionByName(more), "near-linked")
    named = staged(components(links), "near-components")
    discard(first, more, old)
    members = met.where("tok IS NOT NULL").select("tok", F.col("a").alias("node"), "n", "at")
    if not members.isEmpty():
        members = members.join(named, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        pairs = staged(far_candidates(members.join(nodes.select("node", "map"), "node")), "near-pairs")
        more = verified(pairs, nodes, docs, words)
        old, named = named, staged(components(links.unionByName(more)), "near-components")
        discard(old, more)
    out = staged(nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "copies"), "near-roots")
    discard(met, links, named, nodes)
    return out


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """Of each component of near copies the row with the smallest (doc_id, hash of text); rows without doc_id stay."""
    rows = staged(sets(docs, words, frequent(docs, words)), "near-rows", TEXT_ROWS)
    nodes = near_components(rows, docs, words)
    best = nodes.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("sets"), F.max("copies").alias("copies"))
    several = nodes.join(best.where("sets > 1 OR copies"), "root").select("node", "best")
    key = F.struct("doc_id", "text_hash")
    fates = rows.where("doc_id IS NOT NULL").select("node", key.alias("key")).join(several, "node").groupBy("key").agg(F.max(F.col("key") == F.col("best")).alias("stays"))
    fates = staged(fates, "near-fates")
    discard(rows, nodes)
    own = free_name(docs, "near")
    named = docs.where("doc_id IS NOT NULL").withColumn(own, F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash")))
    maybe, alone = sieved(named, f"{own}.text_hash", sieve(fates.select("key.text_hash"), "text_hash"))
    fate = free_name(docs, "fate")
    judged = maybe.join(fates.select(F.col("key").alias(own), F.col("stays").alias(fate)), own, "left")
    one = judged.where(F.col(fate)).dropDuplicates([own])
    cols = [F.col(f"`{c}`") for c in docs.columns]
    kept = [x.select(*cols) for x in (alone, judged.where(F.col(fate).isNull()), one, docs.where("doc_id IS NULL"))]
    return reduce(DataFrame.unionByName, kept)
