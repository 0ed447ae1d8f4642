"""Substring dedup with fixed-block anchors.

A repeat of ``window`` words holds, wherever it lies in the reference, one whole block of ``(window + 1) // 2`` words
cut at multiples of that length. So the non-overlapping blocks of each document are the index, and every rolling
window of the same length is a probe. Where a probe meets a block of another document the surroundings may repeat;
only there are windows of full length compared, and runs of them are the maximal exact repeats.

Work goes by chunks: documents dealt by a hash of doc_id, each chunk of bounded size. A chunk sends every hash once
however often its documents hold it, packed as sorted differences (about 4 bytes a word), so a passage in a third of
all documents is no hot key: it makes one entry per chunk. Nothing is emitted per pair of documents:
1. chunks send block and rolling hashes; by hash range, those that a block holds and two chunks have come back;
2. chunks send the full-length windows around what came back, or around what two of their own documents share, with
   the smallest and largest doc_id; by hash range, the smallest doc_id of all comes back where it is smaller;
3. chunks take out the words of windows that also start in a document with a smaller doc_id.
The texts are shuffled once: the three steps read the same exchange. Blocks are compared on 48 bits, which only
widens what is looked at; windows on 64 bits.

Edge cases: a null or empty text has no words and the digest of the empty string. A text shorter than the window loses
nothing. Rows of one doc_id are not smaller than each other, so they take nothing from one another. A null doc_id
comes after all others. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAST = 2**63 - 1
FACTOR = 0x9E3779B97F4A7C15  # odd, for the rolling hash
KEY_BITS = 48

SENT = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
SENT_SQL = "part bigint, chunk bigint, a binary, b binary, c binary"
BACK = pa.schema([("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
BACK_SQL = "chunk bigint, a binary, b binary"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
KEPT_SQL = "doc_id bigint, n_words bigint, n_removed bigint, text string"


class Words:
    """The words of a chunk's documents, one after another, with their hashes."""

    def __init__(self, t: pa.Table):
        order = t.column("doc_id").fill_null(LAST).to_numpy()
        self.nulls = t.column("doc_id").is_null().to_pylist()
        texts = t.column("text").cast(pa.binary()).to_pylist()
        self.split = [(x or b"").split() for x in texts]
        self.counts = np.fromiter(map(len, self.split), np.int64, len(texts))
        self.starts = np.cumsum(self.counts) - self.counts
        self.ids = order.astype(np.int64)
        flat = np.empty(int(self.counts.sum()), object)
        for s, n, w in zip(self.starts, self.counts, self.split, strict=True):
            flat[s : s + n] = w
        self.hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
        self.row = np.repeat(np.arange(len(texts)), self.counts)

    def rolling(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of all windows of ``k`` words that lie in one document."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out *= np.uint64(FACTOR)
            out += self.hashes[j : j + n]
        out = out[at]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return at, out


def packed(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, of 4 bytes if they fit."""
    d = np.diff(x, prepend=np.uint64(0))
    return b"4" + d.astype("<u4").tobytes() if not len(d) or d.max() < 1 << 32 else b"8" + d.astype("<u8").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, "<u4" if b[:1] == b"4" else "<u8", offset=1), dtype=np.uint64)


def within(x: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``pool``."""
    if not len(pool):
        return np.zeros(len(x), bool)
    return pool[np.minimum(np.searchsorted(pool, x), len(pool) - 1)] == x


def repeated(x: np.ndarray) -> np.ndarray:
    """The numbers that occur more than once, sorted."""
    x = np.sort(x)
    return np.unique(x[1:][x[1:] == x[:-1]])


def rows(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def send_blocks(t: pa.Table, block: int, bits: int) -> pa.Table:
    w = Words(t)
    at, h = w.rolling(block)
    key = h >> np.uint64(64 - KEY_BITS)
    rolls = np.unique(key)
    blocks = np.unique(key[(at - w.starts[w.row[at]]) % block == 0]) if len(at) else key
    chunk, out = t.column("chunk")[0].as_py(), [[], [], [], [], []]
    shift = np.uint64(KEY_BITS - bits)
    edges = np.arange((1 << bits) + 1, dtype=np.uint64) << shift
    r, b = np.searchsorted(rolls, edges), np.searchsorted(blocks, edges)
    for p in np.flatnonzero(np.diff(r)).tolist():
        for c, x in zip(out, (p, chunk, packed(rolls[r[p] : r[p + 1]] - edges[p]), packed(blocks[b[p] : b[p + 1]] - edges[p]), b""), strict=True):
            c.append(x)
    return rows(SENT, out)


def meet_blocks(t: pa.Table, bits: int) -> pa.Table:
    """For each chunk, its rolling hashes that another chunk has too and that are a block somewhere."""
    part = np.uint64(t.column("part")[0].as_py()) << np.uint64(KEY_BITS - bits)
    rolls = [unpacked(x) for x in t.column("a").to_pylist()]
    blocks = np.unique(np.concatenate([unpacked(x) for x in t.column("b").to_pylist()]))
    shared = repeated(np.concatenate([x[within(x, blocks)] for x in rolls]))
    out = [[], [], []]
    for chunk, x in zip(t.column("chunk").to_pylist(), rolls, strict=True):
        hit = x[within(x, shared)]
        if len(hit):
            for c, v in zip(out, (chunk, (hit + part).astype("<u8").tobytes(), b""), strict=True):
                c.append(v)
    return rows(BACK, out)


def candidates(w: Words, back: pa.Table, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the full-length windows that hold a block another document has too."""
    at, h = w.rolling(block)
    key = h >> np.uint64(64 - KEY_BITS)
    if not len(at):
        return at, h
    order = np.lexsort((w.row[at], key))
    k, r = key[order], w.row[at][order]
    own = np.unique(k[1:][(k[1:] == k[:-1]) & (r[1:] != r[:-1])])
    came = [np.frombuffer(x, "<u8") for x in back.column("a").to_pylist()]
    pool = np.unique(np.concatenate([own, *came]))
    mark = np.zeros(len(w.hashes) + 1, np.int64)
    mark[at + 1] = within(key, pool)
    upto = np.cumsum(mark)
    start, full = w.rolling(window)
    near = upto[start + window - block + 1] > upto[start]
    return start[near], full[near]


def send_windows(t: pa.Table, back: pa.Table, block: int, window: int, bits: int) -> pa.Table:
    out: list[list] = [[], [], [], [], []]
    if t.num_rows and len((w := Words(t)).hashes):
        at, h = candidates(w, back, block, window)
        ids = w.ids[w.row[at]]
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(h)]]) - 1 if len(h) else first
        hashes, low, high = h[first], ids[first], ids[last]
        chunk = t.column("chunk")[0].as_py()
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(part, np.arange((1 << bits) + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[p], edges[p + 1])
            for c, x in zip(out, (p, chunk, hashes[s].astype("<u8").tobytes(), low[s].astype("<i8").tobytes(), high[s].astype("<i8").tobytes()), strict=True):
                c.append(x)
    return rows(SENT, out)


def meet_windows(t: pa.Table) -> pa.Table:
    """For each chunk, its windows that start in a document smaller than one of its own that has them."""
    hashes = [np.frombuffer(x, "<u8") for x in t.column("a").to_pylist()]
    lows = np.concatenate([np.frombuffer(x, "<i8") for x in t.column("b").to_pylist()])
    highs = [np.frombuffer(x, "<i8") for x in t.column("c").to_pylist()]
    every = np.concatenate(hashes)
    order = np.lexsort((lows, every))
    first = order[np.concatenate([[True], np.diff(every[order]) != 0])]
    pool, least = every[first], lows[first]
    out = [[], [], []]
    for chunk, h, high in zip(t.column("chunk").to_pylist(), hashes, highs, strict=True):
        low = least[np.searchsorted(pool, h)]
        hit = low < high
        if hit.any():
            for c, v in zip(out, (chunk, h[hit].tobytes(), low[hit].tobytes()), strict=True):
                c.append(v)
    return rows(BACK, out)


def take_out(t: pa.Table, back: pa.Table, window: int) -> pa.Table:
    if not t.num_rows:
        return rows(KEPT, [[], [], [], []])
    w = Words(t)
    gone = np.zeros(len(w.hashes) + 1, np.int64)
    came = [np.frombuffer(x, "<u8") for x in back.column("a").to_pylist()]
    if came and len(w.hashes):
        pool, least = np.concatenate(came), np.concatenate([np.frombuffer(x, "<i8") for x in back.column("b").to_pylist()])
        order = np.argsort(pool)
        pool, least = pool[order], least[order]
        at, h = w.rolling(window)
        at, h = at[hit := within(h, pool)], h[hit]
        at = at[least[np.searchsorted(pool, h)] < w.ids[w.row[at]]]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
    gone = np.cumsum(gone)[:-1] > 0
    out: list[list] = [[], [], [], []]
    for i, (words, s, n) in enumerate(zip(w.split, w.starts, w.counts, strict=True)):
        drop = gone[s : s + n]
        lost = int(drop.sum())
        left = words if not lost else [x for x, d in zip(words, drop.tolist(), strict=True) if not d]
        for c, v in zip(out, (None if w.nulls[i] else int(w.ids[i]), int(n), lost, b" ".join(left).decode()), strict=True):
            c.append(v)
    return rows(KEPT, out)


def remove_repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = 6_000_000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed and the text of the words left, joined by spaces.

    ``chunk_bytes``: text in a chunk, so about the memory of a step; a longer document is a chunk of its own at worst.
    """
    block = (window + 1) // 2
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    bits = max(4, (total // 4_000_000).bit_length())
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("bigint"))
    dealt = base.groupBy("chunk")
    none = rows(BACK, [[], [], []])

    def second(t: pa.Table, back: pa.Table) -> pa.Table:
        return send_windows(t, back if back.num_columns else none, block, window, bits)

    def third(t: pa.Table, back: pa.Table) -> pa.Table:
        return take_out(t, back if back.num_columns else none, window)

    sent = dealt.applyInArrow(lambda t: send_blocks(t, block, bits), SENT_SQL)
    back = sent.groupBy("part").applyInArrow(lambda t: meet_blocks(t, bits), BACK_SQL)
    sent = dealt.cogroup(back.groupBy("chunk")).applyInArrow(second, SENT_SQL)
    back = sent.groupBy("part").applyInArrow(meet_windows, BACK_SQL)
    return dealt.cogroup(back.groupBy("chunk")).applyInArrow(third, KEPT_SQL)
