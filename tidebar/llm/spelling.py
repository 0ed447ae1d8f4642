"""Grouping of spelling variants by dense prefix-suffix tiling.

Words are counted over all documents; those that are long and frequent enough are the vocabulary. Two words differ by
one inserted, deleted or replaced code point if and only if their common prefix and common suffix together reach the
longer length less one. Both are read off padded code-point matrices, aligned at the left for prefixes and at the right
for suffixes, block against block.

Which blocks meet: if m is the shorter length, such words share their first m // 2 or their last m - m // 2 code points
(a single edit cannot touch both halves). So a word is entered under both halves, for m its own length and one less, and
blocks are only compared inside such a group; no near pair is lost. A group above ``BLOCK`` words is cut into blocks
that meet pairwise in tasks of their own, so a very common half is spread; rows are dealt to as many partitions as
their number needs. A pair that both halves find is counted under the first half only.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent. Counts grow by this factor along
forms, so chains end after log(total) / log(ratio) steps, and pointer doubling follows them in the logarithm of that.

Edge cases: null and empty texts have no words. Every row counts, repeated ones too; a null doc_id is written as "" in
the hash. Equal counts go to the smaller word in code-point order. An empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import staged

MODULUS = 199  # one of so many words of a document, by hash, loses a code point: the planted misspellings
LEAST, OFTEN, RATIO = 6, 5, 5
BLOCK = 512  # words of a block; a tile compares two blocks
STRIP = 64  # groups of up to so many words are compared row by row, many groups at once
HELD = 200_000  # distinct words that a task counts before it passes them on
ROWS = 200_000  # entries of a partition
# Latin-1 bytes: letters stay, A-Z are lower-cased, all else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a text, in Latin-1, after the planted misspellings; words shorter than LEAST are left out."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
        if len(w) >= LEAST:
            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head)
            if h % MODULUS == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) < LEAST:
                    continue
            yield w, n


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): the vocabulary with its counts over all rows of ``docs`` (doc_id, text)."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                for w, n in words_of(i, t.as_py() or ""):
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(each, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)


def matrix(words: list[str], backwards: bool) -> np.ndarray:
    """One row of code points per word, padded with 0; backwards aligns the last ones."""
    rows = [w[::-1] for w in words] if backwards else words
    width = max(map(len, rows), default=1)
    return np.array(rows, f"<U{width}").view(np.uint32).reshape(len(rows), width)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the rows of a and b, which broadcast; padding counts as equal."""
    alive, n = None, np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.int32)
    for k in range(min(a.shape[-1], b.shape[-1])):
        same = a[..., k] == b[..., k]
        alive = same if alive is None else alive & same
        if not alive.any():
            break
        n += alive
    return n


def is_near(a: tuple, b: tuple, m: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Whether rows of a and b (prefix matrix, suffix matrix, lengths) are one edit apart. In groups of a common suffix,
    those that share the first half as well belong to that one's group."""
    la, lb = a[2], b[2]
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    front = np.minimum(shared(a[0], b[0]), short)
    back = np.minimum(shared(a[1], b[1]), short)
    mine = (short == m) & (long - short <= 1) & ~(suffix & (front >= m // 2))
    return mine & (front + back >= long - 1) & ~((front == long) & (la == lb))


def near_rows(words: list[str], group: np.ndarray, half: np.ndarray, m: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of near words of a task's rows, in order of ``group``. ``half``: side of a tile of two blocks, 0
    for a group or block that is compared with itself."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    view = (matrix(words, False), matrix(words, True), n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(group)]])).astype(np.int64)
    left, right = [], []
    whose = np.repeat(np.arange(len(first)), size)
    strip = np.flatnonzero(size[whose] <= STRIP) if len(first) else np.zeros(0, np.int64)
    for gap in range(1, STRIP):
        strip = strip[strip + gap < len(group)]
        strip = strip[group[strip] == group[strip + gap]]
        if not len(strip):
            break
        for at in range(0, len(strip), 1 << 18):
            i = strip[at : at + (1 << 18)]
            j = i + gap
            near = is_near(tuple(v[i] for v in view), tuple(v[j] for v in view), m[i], suffix[i]) & ((half[i] == 0) | (half[i] != half[j]))
            left.append(i[near])
            right.append(j[near])
    for k in np.flatnonzero(size > STRIP):
        rows = np.arange(first[k], first[k] + size[k])
        sides = (rows, rows) if half[rows[0]] == 0 else (rows[half[rows] == 1], rows[half[rows] == 2])
        for i in (sides[0][s : s + BLOCK] for s in range(0, len(sides[0]), BLOCK)):
            for j in (sides[1][s : s + BLOCK] for s in range(0, len(sides[1]), BLOCK)):
                if sides[0] is sides[1] and i[0] > j[0]:
                    continue
                a = (view[0][i][:, None], view[1][i][:, None], n[i][:, None])
                b = (view[0][j][None], view[1][j][None], n[j][None])
                near = is_near(a, b, m[rows[0]], suffix[rows[0]])
                x, y = np.nonzero(near)
                once = i[x] < j[y] if sides[0] is sides[1] else np.ones(len(x), bool)
                left.append(i[x[once]])
                right.append(j[y[once]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def entries(words: DataFrame) -> DataFrame:
    """(m, suffix, part, word, n): the groups of each word; part is the half that its members share."""
    n = F.length("word")

    def under(m: Column) -> list[Column]:
        front, back = F.floor(m / 2).cast("int"), (m - F.floor(m / 2)).cast("int")
        ok = m >= LEAST
        return [
            F.when(ok, F.struct(m.alias("m"), F.lit(False).alias("suffix"), F.left("word", front).alias("part"))),
            F.when(ok, F.struct(m.alias("m"), F.lit(True).alias("suffix"), F.right("word", back).alias("part"))),
        ]

    return words.select("word", "n", F.explode(F.array_compact(F.array(*under(n), *under(n - 1)))).alias("g")).select("g.*", "word", "n")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all pairs of near words, in both directions, for staged ``words`` (word, n)."""
    key = ["m", "suffix", "part"]
    rows = entries(words)
    # Staged: the large groups are few, and a join of two shuffles can split the rows of one.
    large = staged(rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > block), "spelling-large")
    rows = rows.join(large, key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    half = F.when(lo == hi, 0).when(F.col("mine") == lo, 1).otherwise(2).cast("int")
    rows = rows.select(F.xxhash64(*key, lo, hi).alias("tile"), *key, lo.alias("lo"), hi.alias("hi"), half.alias("half"), "word", "n")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([(c, "ascending") for c in ("tile", "m", "suffix", "part", "lo", "hi", "word")])
        if not len(t):
            return
        words = t.column("word").to_pylist()
        new = np.zeros(len(t), bool)
        for c in ("m", "suffix", "lo", "hi", "part"):
            v = np.array(t.column(c).to_pylist(), object)
            new[1:] |= v[1:] != v[:-1]
        a, b = near_rows(words, np.cumsum(new), *(t.column(c).to_numpy() for c in ("half", "m", "suffix")))
        for x, y in ((a, b), (b, a)):
            yield pa.RecordBatch.from_arrays([pa.array(x_) for x_ in ([words[k] for k in x], [words[k] for k in y])] + [pa.array(t.column("n").to_numpy()[y])], schema=pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())]))

    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // ROWS))
    return rows.repartition(parts, "tile").mapInArrow(each, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of ``forms`` (word, form) the last form, by pointer doubling."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        out = staged(now.join(next_, now.root == next_.via, "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if out.where("moved").isEmpty():
            return out.select("word", "root")
        now = out.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """Per word of the vocabulary of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n."""
    words = staged(counted(docs), "spelling-words")
    best = near_words(words, block).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    takes = F.col("best_n") >= ratio * F.col("n")
    rows = staged(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"),
    ), "spelling-forms")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
