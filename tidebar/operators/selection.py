"""Top-k and arg-max selections.

``row_number() <= k`` filters are planned with a group limit before the shuffle,
so each task ships at most k rows per group however hot the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import col


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(
        F.col(name) <= k
    )
    return out if rank else out.drop(name)


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return top_k(df, keys, [F.col(o).desc() for o in order], n)


def best_variant(
    df: DataFrame, keys: list[str], score: str, tie: str, payload: list[str], digits: int = 9
) -> DataFrame:
    """Highest score to ``digits`` places, smallest tie on equality; the choice is one partial aggregate.

    Scores are float sums, whose last bits follow the order of addition: rounded, equal variants tie on every cluster.
    """
    order = F.struct(F.coalesce(F.round(F.col(score), digits), F.lit(float("-inf"))), -F.col(tie))
    row = F.struct(F.col(score), F.col(tie), *[F.col(p) for p in payload])
    return df.groupBy(*keys).agg(F.max_by(row, order).alias("_b")).select(*keys, "_b.*")


def widest_first(df: DataFrame, keys: list[str], score: str, width: str, digits: int = 6) -> DataFrame:
    """Parameter choice by rounded score; equal scores take the smaller parameter."""
    order = F.struct(F.round(F.col(score), digits), -F.col(width))
    return df.groupBy(*keys).agg(F.max_by(F.col(width), order).alias(f"best_{width}"))


def quota_top_k(
    items: DataFrame, feed: str, curated: str, t: str, tie: str, total: int, reserve: int
) -> DataFrame:
    """Newest ``total`` items of two feeds with reserved places for the curated one.

    The curated feed is sure of min(reserve, available); the other feed takes the
    rest; whatever one side leaves unused goes to the other. Only the newest
    ``total`` rows of each feed can ever be chosen, so each feed is cut to that
    first (a partial top-k) and the quota is arithmetic on two small counts.
    """
    newest = [F.col(t).desc(), F.col(tie).asc()]
    cut = top_k(items, [feed], newest, total, "_rank")
    is_cur = F.col(feed) == curated
    counts = cut.agg(
        F.count_if(is_cur).alias("_n_cur"), F.count_if(~is_cur).alias("_n_other")
    )
    reserved = F.least(F.lit(max(0, reserve)), F.col("_n_cur"))
    other = F.least(F.col("_n_other"), F.greatest(F.lit(0), F.lit(total) - reserved))
    placed = cut.crossJoin(F.broadcast(counts)).withColumn("_other", other)
    quota = F.when(is_cur, F.lit(total) - F.col("_other")).otherwise(F.col("_other"))
    chosen = placed.where(F.col("_rank") <= quota)
    return chosen.orderBy(*newest).limit(total).drop("_rank", "_n_cur", "_n_other", "_other")


def long_short_picks(
    scores: DataFrame,
    date: str,
    symbol: str,
    score: str,
    shortable: DataFrame | None = None,
    slots: int = 5,
    neutral: float = 0.5,
    weight: float = 0.1,
) -> DataFrame:
    """Stateless daily picks: confident names of the top ``slots`` long, of the bottom short.

    A slot without a confident (or shortable) name stays in cash.
    """
    known = scores.where(F.col(score).isNotNull())
    down = [F.col(score).desc(), F.col(symbol).asc()]
    up = [F.col(score).asc(), F.col(symbol).desc()]
    longs = top_k(known, [date], down, slots, "rank").where(F.col(score) >= neutral)
    longs = longs.select(date, symbol, score, "rank", F.lit(float(weight)).alias("weight"))
    shorts = top_k(known, [date], up, slots, "rank").where(F.col(score) <= neutral)
    if shortable is not None:
        shorts = shorts.join(shortable.select(symbol).distinct(), symbol, "left_semi")
    shorts = shorts.select(date, symbol, score, "rank", F.lit(-float(weight)).alias("weight"))
    # a thin date can put a name in both halves; the long side is decided first
    shorts = shorts.join(longs.select(date, symbol), [date, symbol], "left_anti")
    return longs.unionByName(shorts)


def sells_first(plan: DataFrame, side: str, tie: list[str]) -> DataFrame:
    return plan.orderBy(F.when(col(side) == "sell", 0).otherwise(1), *tie)
