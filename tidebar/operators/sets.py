"""Unions and upserts with an explicit survivor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import col


def pick(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) in the given order.

    An aggregate, not a window: each task reduces its own rows first, so a key
    with very many versions never meets in one place. The whole row travels as a
    struct, and the order decides every comparison before the payload does.
    """
    rank = F.struct(*[col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    chosen = F.max_by(row, rank) if last else F.min_by(row, rank)
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def _stack(existing: DataFrame, new: DataFrame) -> DataFrame:
    a = existing.withColumn("_batch", F.lit(0))
    return a.unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)


def upsert_last(
    existing: DataFrame, new: DataFrame, keys: list[str], arrival: list[str] | None = None
) -> DataFrame:
    """Last write wins: new rows replace stored ones; within a batch the latest arrival."""
    order = ["_batch", *(arrival or [])]
    return pick(_stack(existing, new), keys, order, last=True).drop("_batch")


def upsert_first(
    existing: DataFrame, new: DataFrame, keys: list[str], arrival: list[str] | None = None
) -> DataFrame:
    """First write wins: a stored key is never rewritten."""
    order = ["_batch", *(arrival or [])]
    return pick(_stack(existing, new), keys, order).drop("_batch")


def append_unseen(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only the new rows whose key is not stored yet, each key once."""
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    return fresh.dropDuplicates(keys)


def primary_then_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All primary rows, plus fallback rows for keys the primary does not cover at all."""
    uncovered = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(uncovered, allowMissingColumns=True)


def upsert_with_fallback(
    existing: DataFrame, primary: DataFrame, fallback: DataFrame, keys: list[str], cover: str
) -> DataFrame:
    return upsert_last(existing, primary_then_fallback(primary, fallback, cover), keys)


def new_row_count(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    return fresh.agg(F.count(F.lit(1)).alias("n_new"))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shifted_dates(df: DataFrame, ts: str, days: int = -1, out: str = "bar_date") -> DataFrame:
    """Distinct decision dates shifted to the bar dates they decide on."""
    return df.select(F.date_add(F.col(ts).cast("date"), days).alias(out)).distinct()


def intersect_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def subtract_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")
