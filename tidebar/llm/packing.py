"""Packing documents into training sequences with bounded space.

Every partition keeps a fixed number of open windows. A document's tokens that fill whole windows are emitted at once;
the rest goes into the open window that it fits best. If it fits none and no further window may be opened, the fullest
one is topped up with the head of the piece, emitted, and the tail is placed anew. Windows that are still open at the
end of a partition are merged across partitions, 64 partitions to a group, and what is left of a group is dealt into
sequences whose lengths are powers of two, which need no padding.

Memory of a task: the open windows and a word cache of bounded size, which ends with the task. Only leftovers are
shuffled, at most ``open_windows`` windows per partition, whatever the size of the table. The packed pieces are staged,
so the two branches (done, left over) never tokenise twice, and a lost executor repeats single tasks only.

Edge cases: a null or empty text is its end token alone. Documents without id keep a null id. Repeated rows are packed
one by one. An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import TEXT_ROWS, staged, trimmed

WIDTH = 4  # bytes of an id
MARKS = "!#$%&*+,-./:;<=>?@|~"
PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("task", pa.int64()), ("seq", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
PIECE_SQL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task bigint, seq bigint, offset bigint, ids binary"


class WordEncoder:
    """Token ids of texts as little-endian 32-bit bytes, by words.

    The tokenizer drops white space, never joins text across it and normalises each word on its own, so the ids of a
    text are those of its words in order; words are encoded once and kept in a cache of bounded size, until the task
    ends. A new word of letters with ASCII marks behind them is put together from the two. Lower-case ASCII letters are
    what the tokenizer itself hands to its model, so they go there directly; other words of letters are encoded many at
    a time, since each ends in the one token that bears the end-of-word sign. If a lot does not come apart in as many
    words, and for all other words, each word is encoded by itself.
    """

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}

    def singly(self, words: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def letters(self, words: list[str]) -> Iterator[bytes]:
        for k in range(0, len(words), 2000):
            lot = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(lot), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * WIDTH
            if len(ends) == len(lot):
                raw, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
                yield from [raw[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]
            else:
                yield from self.singly(lot)

    def learn(self, missing: list[bytes]) -> None:
        if len(self.words) + len(missing) > self.most:
            self.words.clear()
        split, odd = [], []
        for raw in missing:
            word = raw.decode()
            core = word.rstrip(MARKS)
            if core.isalpha():
                split.append((raw, core.lower() if core.isascii() else core, word[len(core) :]))
            else:
                odd.append((raw, word))
        new, parts = {c for _, c, _ in split}, {}
        tokenize, pack = self.model.tokenize, struct.pack
        for c in filter(str.isascii, new):
            ids = [t.id for t in tokenize(c)]
            parts[c] = pack(f"<{len(ids)}I", *ids)
        cores = [c for c in new if not c.isascii()]
        parts.update(zip(cores, self.letters(cores), strict=True))
        marks = list({m for _, _, m in split}.difference(parts))
        parts.update(zip(marks, self.singly(marks), strict=True))
        self.words.update((raw, parts[c] + parts[m]) for raw, c, m in split)
        self.words.update(zip([raw for raw, _ in odd], self.singly([w for _, w in odd]), strict=True))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [t.split() for t in texts]
        ids = [list(map(self.words.get, words)) for words in split]
        unknown = [k for k, x in enumerate(ids) if None in x]
        if unknown:
            missing = {w for k in unknown for w, x in zip(split[k], ids[k], strict=True) if x is None}
            self.learn(list(missing))
            for k in unknown:
                ids[k] = [self.words[w] if x is None else x for w, x in zip(split[k], ids[k], strict=True)]
        yield from map(b"".join, ids)


@lru_cache(maxsize=1)
def encoder(path: str | None) -> WordEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(path)


def encoded(batch: pa.RecordBatch, path: str | None, end_id: int, most_bytes: int = 2_000_000) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end token) of each row; texts go to the encoder in small lots."""
    end = end_id.to_bytes(WIDTH, "little")
    ids: list[int | None] = []
    lot: list[bytes] = []
    size = 0
    texts = batch.column("text").cast(pa.binary())
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
        ids.append(doc_id)
        lot.append(text.as_py() or b"")
        size += len(lot[-1])
        if size >= most_bytes:
            yield from zip(ids, (x + end for x in encoder(path).encode(lot)), strict=True)
            ids, lot, size = [], [], 0
    yield from zip(ids, (x + end for x in encoder(path).encode(lot)), strict=True)


class Packer:
    """Best-fit packing with a fixed number of open windows."""

    def __init__(self, task: int, length: int, open_windows: int):
        self.task, self.length, self.most = task, length, open_windows
        self.windows: list[list[tuple]] = []  # pieces (doc_id, start, ids, doc_tokens)
        self.used: list[int] = []
        self.seq = 0
        self.done: dict[str, list] = {f.name: [] for f in PIECE}

    def emit(self, pieces: list[tuple], keep_ids: bool = False) -> None:
        offset, d = 0, self.done
        for doc_id, start, ids, total in pieces:
            n = len(ids) // WIDTH
            for name, x in zip(PIECE.names, (doc_id, start, n, zlib.crc32(ids), total, self.task, self.seq, offset, ids if keep_ids else None), strict=True):
                d[name].append(x)
            offset += n
        self.seq += 1

    def close(self, k: int) -> None:
        self.emit(self.windows.pop(k))
        self.used.pop(k)

    def put(self, k: int, piece: tuple) -> None:
        self.windows[k].append(piece)
        self.used[k] += len(piece[2]) // WIDTH
        if self.used[k] == self.length:
            self.close(k)

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> None:
        full = self.length * WIDTH
        while len(ids) >= full:
            self.emit([(doc_id, start, ids[:full], total)])
            start, ids = start + self.length, ids[full:]
        while ids:
            n = len(ids) // WIDTH
            fits = [(self.length - u, k) for k, u in enumerate(self.used) if self.length - u >= n]
            if fits:
                return self.put(min(fits)[1], (doc_id, start, ids, total))
            if len(self.windows) < self.most:
                self.windows.append([(doc_id, start, ids, total)])
                return self.used.append(n)
            k = max(range(len(self.used)), key=self.used.__getitem__)
            free = self.length - self.used[k]
            self.put(k, (doc_id, start, ids[: free * WIDTH], total))
            start, ids = start + free, ids[free * WIDTH :]

    def leave(self) -> None:
        """Hand the open windows on, with their ids."""
        for pieces in self.windows:
            self.emit(pieces, keep_ids=True)
        self.windows, self.used = [], []

    def finish(self) -> None:
        """Deal what is still open into sequences of power-of-two lengths, largest first."""
        rest = [p for w in self.windows for p in w]
        left = sum(self.used)
        self.windows, self.used = [], []
        while left:
            size = min(self.length, 1 << (left.bit_length() - 1))
            left -= size
            took: list[tuple] = []
            while size:
                doc_id, start, ids, total = rest.pop(0)
                n = min(size, len(ids) // WIDTH)
                took.append((doc_id, start, ids[: n * WIDTH], total))
                if ids[n * WIDTH :]:
                    rest.insert(0, (doc_id, start + n, ids[n * WIDTH :], total))
                size -= n
            self.emit(took)

    def drain(self) -> pa.RecordBatch:
        done, self.done = self.done, {f.name: [] for f in PIECE}
        return pa.RecordBatch.from_pydict(done, PIECE)


def pack(
    docs: DataFrame, length: int = 2048, end_id: int = 1, open_windows: int = 16, merge: int = 64, path: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path``: the tokenizer's file, by default the 49k word BPE of ``public_tokenizers``. ``length`` is a power of two.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = Packer(TaskContext.get().partitionId(), length, open_windows)
        try:
            for b in batches:
                for doc_id, ids in encoded(b, path, end_id):
                    p.add(doc_id, 0, ids, len(ids) // WIDTH)
                    if len(p.done["seq"]) >= 20_000:
                        yield p.drain()
            p.leave()
            yield p.drain()
        finally:
            if encoder.cache_info().currsize:  # the worker goes on waiting for tasks of any stage
                encoder(path).words.clear()

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        p = Packer((1 << 30) + key[0].as_py(), length, 1)
        for x in t.sort_by([("task", "ascending"), ("seq", "ascending"), ("offset", "ascending")]).to_pylist():
            p.add(x["doc_id"], x["start"], x["ids"], x["doc_tokens"])
        p.finish()
        return pa.Table.from_batches([p.drain()])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = staged(base.mapInArrow(trimmed(each), PIECE_SQL), "pack-pieces", TEXT_ROWS)
    left = pieces.where(F.col("ids").isNotNull()).withColumn("lot", F.floor(F.col("task") / merge))
    tail = left.groupBy("lot").applyInArrow(merged, PIECE_SQL)
    every = pieces.where(F.col("ids").isNull()).drop("ids").unionByName(tail.drop("ids"))
    return every.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.shiftleft(F.col("task"), 32) + F.col("seq")).alias("sequence_id"), "offset",
    )
