"""Near-duplicate titles: exact similarity pairs and the greedy collapse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.text import fold_tokens
from tidebar.operators.setjoin import candidates, common, dealt, hashes_of, sketch_pairs, sketched, verified
from tidebar.session import cut_lineage

THRESHOLD, MIN_TOKENS = 0.6, 4
SIEVE_WORDS = 1 << 18  # most words of 64 bits of a sieve: 16 bits a key up to a million keys, fewer beyond
Find = Callable[[DataFrame], DataFrame]


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` (bigint, not null) may be one of the wanted: a bit map of bounded size lets through all that are
    and few others, so that only these are shuffled to the join that follows."""
    words = min(SIEVE_WORDS, 1 << max(6, (wanted.count() // 4).bit_length()))
    word = F.floor(F.pmod(F.col(key), F.lit(64 * words)) / 64).alias("_word")
    bit = f"CAST(pmod({key}, 64) AS INT)"
    bits = wanted.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))
    met = rows.select("*", word).join(F.broadcast(bits), "_word")  # a row per word of the map
    return met.where(F.expr(f"shiftright(_bits, {bit}) & 1L") == 1).drop("_word", "_bits")


def token_sets(items: DataFrame, title: str, prefer: list[Column], id_col: str, threshold: float) -> tuple[DataFrame, DataFrame, Find]:
    """(rows (id, name, n) by the name of their set, distinct sets (k, pref, n, s, map, rare), what returns the tokens of sets).
    ``k`` is the smallest id of a set; with a preference it is a number that rises in its order instead.

    Copies share one set, so a group of identical titles, however large, becomes a single row here before any pair is
    formed; sets are told apart by the MD5 of their tokens. Titles are folded once for the sketches, and once more where a
    set is to be verified; neither they nor their tokens are shuffled for the others.
    """
    chosen = [p.alias(f"p{i}") for i, p in enumerate(prefer)]
    own = [F.col(id_col).cast("bigint").alias("id"), F.xxhash64(title).alias("text")]
    toks = items.select(*own, *chosen, fold_tokens(title).alias("toks")).withColumn("name", F.unhex(F.md5(F.array_join("toks", " ").cast("binary"))))
    order = common(items.select(F.col(id_col).alias("id"), F.col(title).alias("title")), "id", fold_tokens("title"))
    rows = cut_lineage(sketched(toks, "toks", threshold, order))
    pref = F.min(F.struct(*[f"p{i}" for i in range(len(prefer))], "id", "text")).alias("pref")
    best = rows.where("n > 0").groupBy("name").agg(pref, F.first("n").alias("n"), F.first("s").alias("s"), F.first("map").alias("map"), F.first("rare").alias("rare"))
    if prefer:
        best = best.orderBy("pref").withColumn("k", F.monotonically_increasing_id())
    else:
        best = best.withColumn("k", F.col("pref.id"))
    sets = cut_lineage(best.select("k", "pref", "n", "s", "map", "rare"))

    def find(wanted: DataFrame) -> DataFrame:
        named = cut_lineage(sets.join(wanted, "k").select("k", "pref.id", "pref.text"))
        texts = sieved(items.select(*own, F.col(title).alias("title")), "text", named).join(named, ["id", "text"])
        return texts.select("k", fold_tokens("title").alias("t"))

    return rows.select("id", "name", "n"), sets, find


def near_duplicate_pairs(items: DataFrame, title: str, id_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Similar pairs between the representatives (smallest id) of distinct token sets."""
    _, sets, find = token_sets(items, title, [], id_col, threshold)
    return sketch_pairs(sets, find, threshold, MIN_TOKENS)


def collapse(
    items: DataFrame,
    title: str,
    id_col: str,
    prefer: list[Column],
    threshold: float = THRESHOLD,
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """Greedy collapse in preference order: a row survives unless it matches an
    earlier *surviving* row (same token set, or Jaccard at or above the threshold).

    Solved as a fixpoint over the pairs of distinct sets that no bound excludes: every round keeps each undecided set
    without an undecided earlier neighbour, verifies its pairs only, and drops what is similar. So of a group of near
    copies one pair per member is verified, not all; the pairs themselves travel as two numbers each. The earliest
    undecided set is always decided, so the loop ends; rounds follow the longest dependency chain, not the data size.
    Rows without any token never match and always survive. Lineage is cut by a reliable checkpoint each round.
    """
    rows, sets, find = token_sets(items, title, prefer, id_col, threshold)
    live = cut_lineage(candidates(dealt(sets.where(F.col("n") >= min_tokens)), threshold))  # a is preferred to b
    found = hashes_of(live, find)
    dropped = sets.select("k").where(F.lit(False))
    while not live.isEmpty():
        later = live.select(F.col("b").alias("a")).distinct()
        kept = cut_lineage(live.select("a").distinct().join(later, "a", "left_anti"))
        stars = cut_lineage(live.join(kept, "a", "left_semi"))
        gone = cut_lineage(verified(stars, found, threshold, stars=True).select(F.col("b").alias("k")).distinct())
        dropped = dropped.unionByName(gone)
        live = live.join(kept, "a", "left_anti")
        for side in ("a", "b"):
            live = live.join(gone.select(F.col("k").alias(side)), side, "left_anti")
        live = cut_lineage(live)
    survivors = sets.join(dropped, "k", "left_anti").select("pref.id")
    blank = rows.where("n = 0").select("id")
    return items.join(survivors.unionByName(blank).withColumnRenamed("id", id_col), id_col, "left_semi")
