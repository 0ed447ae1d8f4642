"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a document. The cost of each rule and the share it rejects are measured on a sample;
the cascade then runs the rules by rejection per cost, highest first, and a document leaves it at its first
rejection. The order decides the work, never the verdict: a document is kept if no rule rejects it.

The rules see a document through ``View``, which computes a figure when a rule first asks for it.

Edge cases: a null text has no words and is rejected as too short, as an empty one is. Repeated rows are judged one
by one. An empty table gives an empty result, in the order of the rules as listed. Other columns pass unchanged.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import trimmed

SYMBOLS = re.compile(rb"[#*$%&|<>]")
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


class View:
    """Figures of one text, each computed once and only when asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        points = len(self.text.decode("utf-8", "replace"))
        return points - sum(self.text.count(s) for s in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count(b"!")

    @cached_property
    def n_upper(self) -> int:
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that occurs twice or more in the text."""
        w, n = self.words, self.n_words
        if n < 4:
            return 0
        seen = set(zip(w, w[1:], w[2:], strict=False))
        if len(seen) == n - 2:
            return 0
        first: dict[tuple[bytes, bytes, bytes], int] = {}
        hit = bytearray(n)
        for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
            j = first.setdefault(x, i)
            if j != i:
                hit[j : j + 3] = hit[i : i + 3] = b"\x01\x01\x01"
        return sum(hit)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[View], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda v: v.n_words < 50, base=True),
    Rule("repeated_words", lambda v: 100 * v.n_repeat_words > 50 * v.n_words, base=True),
    Rule("symbols", lambda v: 10 * v.n_symbols > v.n_words),
    Rule("exclamations", lambda v: 5 * v.n_shouts > v.n_words),
    Rule("capitals", lambda v: 2 * v.n_upper > v.n_words),
    Rule("word_length", lambda v: not 2 * v.n_words <= v.word_chars <= 15 * v.n_words),
    Rule("repeated_lines", lambda v: 2 * v.n_dup_lines > len(v.lines)),
)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    for x in batch.column(column).cast(pa.binary()).to_pylist():
        yield x or b""


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Seconds per document and share rejected, of each rule on its own over about ``sample_rows`` documents.

    Only one row per rule reaches the driver.
    """
    total = docs.count()
    if not total:
        return {}
    picked = docs.select("text").sample(min(1.0, sample_rows / total), seed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            for t in texts(b):
                seen += 1
                for k, r in enumerate(rules):
                    began = time.perf_counter()
                    rejected[k] += r.rejects(View(t))
                    spent[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict(
            {"k": list(range(len(rules))), "spent": spent, "rejected": rejected, "seen": [seen] * len(rules)},
            pa.schema([("k", pa.int32()), ("spent", pa.float64()), ("rejected", pa.int64()), ("seen", pa.int64())]),
        )

    got = picked.mapInArrow(trimmed(each), "k int, spent double, rejected bigint, seen bigint")
    sums = got.groupBy("k").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"), F.sum("seen").alias("seen"))
    return {rules[x.k].name: (x.spent / x.seen, x.rejected / x.seen) for x in sums.collect() if x.seen}


def ordered(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first; unmeasured ones keep their place at the end."""
    def gain(r: Rule) -> float:
        cost, share = measured.get(r.name, (1.0, -1.0))
        return -share / max(cost, 1e-9)

    return tuple(sorted(rules, key=gain))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Per row: doc_id, n_words and the base figures, base_failed, kept and the rule that rejected it (else null).

    The base figures are reported for every document, so only the rules after them are cut short.
    """
    cascade = ordered(rules, measure(docs, rules, sample_rows))
    base = tuple(r for r in cascade if r.base)
    rest = tuple(r for r in cascade if not r.base)
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = pa.schema([("doc_id", pa.int64()), *[(f, pa.int64()) for f in figures], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in out}
            rows["doc_id"] = b.column("doc_id")
            for t in texts(b):
                v = View(t)
                for f in figures:
                    rows[f].append(getattr(v, f))
                by = next((r.name for r in base if r.rejects(v)), None)
                rows["base_failed"].append(by is not None)
                by = by or next((r.name for r in rest if r.rejects(v)), None)
                rows["kept"].append(by is None)
                rows["rejected_by"].append(by)
            yield pa.RecordBatch.from_pydict(rows, out)

    cols = ", ".join(f"{f} bigint" for f in figures)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(trimmed(each), f"doc_id bigint, {cols}, base_failed boolean, kept boolean, rejected_by string")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns unchanged. The whole cascade is cut short."""
    cascade = ordered(rules, measure(docs, rules, sample_rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not any(r.rejects(v) for r in cascade) for v in map(View, texts(b))], pa.bool_()))

    return docs.mapInArrow(trimmed(each), docs.schema)
