"""Personal data. Regular expressions propose spans, checks confirm them, context words adjust the score.
DataFrame functions only.

The text is cut at a pattern's matches, so the pieces between them and the matches give every position in code points;
nothing is shuffled. All patterns run in time linear in the text: their repetitions are possessive, and a match may
start only where an earlier start could not have matched, which leaves the matches those of the plain patterns.

Score of a proposal: the prior of its kind, 0.5 for a passed checksum (card: Luhn, iban: mod 97), 0.3 for a context
word in the 40 code points before it. Email, ip, card and phone are base kinds and stay whatever their score; iban and
ssn are added at 0.6 or more.

Edge cases: a null text counts as empty. Rows are judged one by one, so repeats and ties do not matter; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512
LOCAL = "[A-Za-z0-9._%+-]"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: luhn_part(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def luhn_part(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))


def mod97(code: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters go to the end, letters count 10 to 35; the rest must be 1."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 65, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def ip_parts(x: Column) -> Column:
    """No part is above 255; leading zeros do not count."""
    def fits(p: Column) -> Column:
        n = F.ltrim(p, F.lit("0"))
        return (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))

    return F.forall(F.split(x, "\\."), fits)


def bounded(m: Column) -> Column:
    """No letter or digit stands next to the match."""
    return ~m["before"].rlike("[A-Za-z0-9]$") & ~m["after"].rlike("^[A-Za-z0-9]")


@dataclass(frozen=True)
class Kind:
    """``pattern``: linear form for Java. ``plain``: what it matches, as any engine reads it. ``hint``: a text without
    a match of it has no match of the pattern. ``valid`` takes the match (hit, before, after)."""

    name: str
    pattern: str
    plain: str
    hint: str
    valid: Callable[[Column], Column]
    prior: float
    checksum: bool
    context: str
    base: bool = True


KINDS = (
    Kind(
        "email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@",
        lambda m: F.lit(True), 0.7, False, "mail|contact|write",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]\.[0-9]",
        lambda m: ip_parts(m["hit"]), 0.6, False, "ip|server|host|address",
    ),
    Kind(
        "card", r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++", r"[0-9]([\x20-]?[0-9])+", "[0-9]",
        lambda m: F.length(digits_of(m["hit"])).between(16, 19) & luhn(digits_of(m["hit"])), 0.3, True, "card|visa|pay|credit",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
        lambda m: F.length(digits_of(m["hit"])).between(8, 15), 0.6, False, "phone|call|tel|mobile|fax",
    ),
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", "[A-Z]{2}[0-9]{2}",
        lambda m: bounded(m) & mod97(F.replace(m["hit"], F.lit(" "), F.lit(""))), 0.2, True, "iban|account|bank", False,
    ),
    Kind(
        "ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]",
        lambda m: bounded(m) & ~m["hit"].rlike("^(?:000|666|9)"), 0.4, False, "ssn|social security|taxpayer", False,
    ),
)
THRESHOLD = 0.6


def matches(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """(pieces between the matches, matches); texts without the hint are not searched."""
    none = F.array().cast("array<string>")
    there = text.rlike(hint)
    return F.when(there, F.split(text, pattern, -1)).otherwise(none), F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def ends_of(lengths: Column) -> Column:
    """Running sums of an array, by blocks, so that very many matches in a text stay cheap."""
    add = lambda a, x: a + x
    zero = F.lit(0)
    blocks = F.sequence(zero, F.floor(F.size(lengths) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), zero, add))
    before = F.transform(blocks, lambda b: F.aggregate(F.slice(sums, F.lit(1), b), zero, add))
    def upto(x: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        return F.get(before, b) + F.aggregate(F.slice(lengths, b * BLOCK + 1, i - b * BLOCK + 1), zero, add)

    return F.transform(lengths, upto)


def with_spans(cut: DataFrame, k: Kind) -> DataFrame:
    """Add s_<kind>, the confirmed spans of one kind, from its pieces p_<kind> and matches h_<kind>."""
    p, h, e = F.col(f"p_{k.name}"), F.col(f"h_{k.name}"), F.col(f"e_{k.name}")

    def length(x: Column, i: Column) -> Column:
        return F.length(F.get(p, i)) + F.length(x)

    def placed(x: Column, i: Column) -> Column:
        end = F.get(e, i)
        return F.struct(
            x.alias("hit"), (end - F.length(x)).alias("start"), end.alias("end"),
            F.right(F.get(p, i), F.lit(40)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after"),
        )

    def scored(m: Column) -> Column:
        near = F.when(F.lower(m["before"]).rlike(k.context), 0.3).otherwise(0.0)
        score = F.round(F.lit(k.prior + 0.5 * k.checksum) + near, 2)
        return F.struct(F.lit(k.name).alias("kind"), m["start"].cast("bigint").alias("start"), m["end"].cast("bigint").alias("end"), score.alias("score"))

    lengths = F.col(f"l_{k.name}")
    out = cut.withColumn(f"l_{k.name}", F.transform(h, length))
    out = out.withColumn(f"e_{k.name}", F.when(F.size(lengths) > 0, ends_of(lengths)))
    out = out.withColumn(f"m_{k.name}", F.filter(F.transform(h, placed), k.valid))
    spans = F.transform(f"m_{k.name}", scored)
    return out.withColumn(f"s_{k.name}", spans if k.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD))


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` (doc_id, text) with spans: array of (kind, start, end, score), by kind as listed, then by start.
    Positions are code points from 0, the end exclusive."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for k in kinds:
        pieces, hits = matches(F.col("text"), k.pattern, k.hint)
        out = out.withColumn(f"p_{k.name}", pieces).withColumn(f"h_{k.name}", hits)
    out = out.drop("text")
    for k in kinds:
        out = with_spans(out, k)
    return out.select("doc_id", *[F.col(f"s_{k.name}").alias(k.name) for k in kinds])


def written(spans: list[Column]) -> Column:
    """kind:start:end of every span, comma-joined."""
    every = reduce(lambda a, b: F.concat(a, b), spans)
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans, their number and top score."""
    found = find(docs, kinds)
    base = [F.col(k.name) for k in kinds if k.base]
    every = [F.col(k.name) for k in kinds]
    counts = [F.size(k.name).cast("bigint").alias(f"n_{k.name}") for k in kinds if k.base]
    added = reduce(lambda a, b: a + b, [F.size(k.name) for k in kinds if not k.base], F.lit(0))
    top = F.array_max(F.transform(reduce(lambda a, b: F.concat(a, b), every), lambda s: s["score"]))
    return found.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(every).alias("spans"),
        added.cast("bigint").alias("n_added"), top.alias("top_score"),
    )
