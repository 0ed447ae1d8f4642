"""Line dedup by a log-template tree. DataFrame functions only.

The tree has a fixed depth: a line goes down by its number of tokens and its first ``lead`` tokens, after runs of
digits have become "0". Lines in a leaf are generalised position by position: the token that most lines have there is
the template's, and a line belongs to the template if it agrees with it in at least ``similar`` of the tokens behind
the leading ones; where it differs stands a variable field. Lines that do not agree go one level down, by the place and
token where they first leave the template, and are generalised there, ``LEVELS`` times in all; so a leaf holds one
template for each of its families. Lines that no template takes stand for themselves.

What recurs is dropped, all but the first (by doc_id, then place), so no content disappears from the corpus:

- a generalised template found in ``min_docs`` documents or more;
- a line of ``min_tokens`` tokens or more found, but for its digits, in two documents or more;
- a shorter line found so in ``short_docs`` documents or more, which marks it as boilerplate ("Share this page").

Shuffles: lines travel as hashes (leaf, masked line). Only one line of each distinct masked line of a leaf with two or
more of them is fetched as text, and counts per template combine before the shuffle, so a line in a third of all
documents is no hot key. Texts are shuffled by document at most twice. Two lines of one 64-bit hash count as equal.
Intermediate tables are deleted once those built from them are written.

Edge cases: lines without tokens are always kept. A null text gives a null text and no lines; an empty text stays empty.
Rows alike in doc_id and text are one document and get the same lines. A null doc_id comes after all others. An empty
table gives an empty result. Other columns pass unchanged, whatever their names: own values travel in one struct under
a name that the table does not have. Only line_count and line_dropped are columns of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import WORD, discard, free_name, staged

LAST = 2**63 - 1
LEVELS = 3


def named(docs: DataFrame) -> Column:
    """(doc, hash), which name a document; rows alike in doc_id and text are one."""
    return F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("hash"))


def masked(line: Column) -> Column:
    return F.regexp_replace(line, "[0-9]+", "0")


def line_keys(docs: DataFrame, lead: int) -> DataFrame:
    """(doc, hash, no, n, leaf, own): one narrow row per line with a token."""
    lines = docs.select(named(docs).alias("d"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    lines = lines.withColumn("line", masked(F.col("line")))
    lines = lines.withColumn("n", F.regexp_count("line", F.lit(WORD))).where(F.col("n") > 0)
    first = F.regexp_extract("line", rf"{WORD}(?:[\x20\x09-\x0D]+{WORD}){{0,{lead - 1}}}+", 0)
    return lines.select("d.doc", "d.hash", "no", "n", F.xxhash64("n", first).alias("leaf"), F.xxhash64("n", "line").alias("own"))


def fetched(docs: DataFrame, kinds: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, own, lines, tokens): the distinct masked lines of leaves that could be generalised, as text."""
    several = kinds.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("lines").alias("all"))
    # Staged, as the templates below, so that the joins deal both sides themselves and can split a large leaf.
    several = staged(several.where((F.col("kinds") > 1) & (F.col("all") >= min_docs)).select("leaf"), "line-leaves")
    wanted = kinds.join(several, "leaf").select("at.doc", "at.hash", F.struct("at.no", "leaf", "own", "lines").alias("x"))
    wanted = wanted.groupBy("doc", "hash").agg(F.collect_list("x").alias("xs"))
    texts = docs.select(named(docs).alias("d"), "text").select("d.*", "text").join(wanted, ["doc", "hash"]).dropDuplicates(["doc", "hash"])
    found = texts.select(F.split("text", "\n").alias("rows"), F.explode("xs").alias("x"))
    tokens = F.regexp_extract_all(masked(F.get("rows", F.col("x.no"))), F.lit(WORD), F.lit(0))
    out = staged(found.select("x.leaf", "x.own", "x.lines", tokens.alias("tokens")), "line-tokens")
    discard(several)
    return out


def generalised(found: DataFrame, lead: int, similar: float, min_docs: int) -> DataFrame:
    """(own, family) of the masked lines that a template takes, staged; ``found`` is staged and deleted."""
    taken = []
    for level in range(LEVELS):
        votes = found.select("leaf", "lines", F.posexplode("tokens").alias("pos", "token"))
        votes = votes.groupBy("leaf", "pos", "token").agg(F.sum("lines").alias("n"))
        votes = votes.groupBy("leaf", "pos").agg(F.max(F.struct("n", "token")).alias("top"))
        template = votes.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "top.token"))).alias("template"))
        template = staged(template.withColumn("template", F.col("template.token")), "line-votes")
        both = found.join(template, "leaf")
        agrees = F.transform(F.arrays_zip("tokens", "template"), lambda x: x["tokens"] == x["template"])
        both = both.withColumn("agrees", agrees).withColumn("same", F.size(F.filter("agrees", lambda x: x)))
        fits = F.col("same") - lead >= (F.size("tokens") - lead) * F.lit(similar)
        away = F.array_position("agrees", F.lit(False))
        both = staged(both.select("leaf", "own", "lines", "tokens", fits.alias("fits"), away.alias("away")), "line-families")
        taken.append(staged(both.where("fits").select("own", F.xxhash64(F.lit(level), "leaf").alias("family")), "line-taken"))
        deeper = F.xxhash64("leaf", "away", F.get("tokens", F.col("away").cast("int") - 1))
        rest = both.where("NOT fits").select(deeper.alias("leaf"), "own", "lines", "tokens")
        several = rest.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("lines").alias("all"))
        several = staged(several.where((F.col("kinds") > 1) & (F.col("all") >= min_docs)).select("leaf"), "line-leaves")
        old, found = found, staged(rest.join(several, "leaf"), "line-tokens")
        discard(old, template, both, several)
    out = staged(reduce(DataFrame.unionByName, taken), "line-generalised")
    discard(found, *taken)
    return out


def recurring(docs: DataFrame, lead: int, similar: float, min_docs: int, min_tokens: int, short_docs: int) -> DataFrame:
    """(doc, hash, drop): the numbers of the lines to drop, for documents that lose any; staged."""
    keys = staged(line_keys(docs, lead), "line-keys")
    place = F.struct("doc", "hash", "no")
    once = keys.groupBy("leaf", "own", "n", "doc", "hash").agg(F.count("*").alias("lines"), F.min("no").alias("no"))
    kinds = once.groupBy("leaf", "own", "n").agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.min(place).alias("at"))
    kinds = staged(kinds, "line-distinct")
    least = F.when(F.col("n") < min_tokens, short_docs).otherwise(2)
    equal = staged(kinds.where(F.col("docs") >= least).select("own", F.col("at").alias("first")), "line-equal")
    families = generalised(fetched(docs, kinds.where(F.col("n") >= min_tokens), min_docs), lead, similar, min_docs)
    members = staged(keys.join(families, "own").select("doc", "hash", "no", "family"), "line-members")
    seen = members.groupBy("family", "doc", "hash").agg(F.min("no").alias("no"))
    often = seen.groupBy("family").agg(F.count("*").alias("docs"), F.min(place).alias("first"))
    often = staged(often.where(F.col("docs") >= min_docs).select("family", "first"), "line-recurring")
    gone = [rows.where(place != F.col("first")).select("doc", "hash", "no") for rows in (keys.join(equal, "own"), members.join(often, "family"))]
    lost = gone[0].unionByName(gone[1]).groupBy("doc", "hash").agg(F.collect_set("no").alias("drop"))
    lost = staged(lost, "line-drops")
    discard(keys, kinds, equal, families, members, often)
    return lost


def drop_recurring(
    docs: DataFrame, lead: int = 3, similar: float = 0.7, min_docs: int = 5, min_tokens: int = 4, short_docs: int = 20,
) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and line_count and line_dropped (lines dropped)."""
    lost = recurring(docs.select("doc_id", "text"), lead, similar, min_docs, min_tokens, short_docs)
    own, gone = free_name(docs, "lines"), free_name(docs, "gone")
    rows = docs.withColumn(own, named(docs))
    out = rows.join(lost.select(F.struct("doc", "hash").alias(own), F.struct("drop").alias(gone)), own, "left")
    drop, lines = F.col(f"{gone}.drop"), F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n")
    text = F.when(drop.isNull(), F.col("text")).otherwise(left)
    cols = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("line_count", "line_dropped")]
    return out.select(
        *cols, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("line_count"),
        F.when(drop.isNull(), 0).otherwise(F.size(drop)).cast("bigint").alias("line_dropped"),
    )


def without_lines(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without recurring lines, same columns. A document of which no word is left goes; n_chars follows."""
    names = [free_name(docs, c) for c in ("line_count", "line_dropped")]
    there = [c for c in docs.columns if c in ("line_count", "line_dropped")]
    kept = {c: free_name(docs, f"own_{c}") for c in there}  # columns of the table that are named like the counts
    out = drop_recurring(docs.withColumnsRenamed(kept), **params).withColumnsRenamed(dict(zip(("line_count", "line_dropped"), names, strict=True)))
    out = out.withColumnsRenamed({v: k for k, v in kept.items()})
    dropped = F.col(names[1])
    out = out.where((dropped == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        changed = F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
