"""Named strategies: bars in, long weights (symbol, ts, weight) out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.operators.aggregates import ensemble_weights
from tidebar.plans import grids
from tidebar.plans.signals import positions

SYMBOL_SHARE = 1.0 / 3.0
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    STRATEGIES[name] = fn


def strategy(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; registered: {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def _ensemble(family: str) -> Callable[[DataFrame], DataFrame]:
    def weights(bars: DataFrame) -> DataFrame:
        return ensemble_weights(positions(bars, [family]), ["symbol", "ts"], SYMBOL_SHARE)

    return weights


for _book, _family, _ in grids.BOOKS:
    register(_book, _ensemble(_family))


def latest_signal(weights: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row: last decision date, first effective day, weights and gross exposure.

    Gross is null when a leg is unknown at that date.
    """
    last = weights.agg(F.max("ts").alias("decision_date"))
    names = (symbols if symbols is not None else weights).select("symbol").distinct()
    now = weights.join(F.broadcast(last), weights["ts"] == last["decision_date"]).select("symbol", "weight")
    legs = names.join(now, "symbol", "left")
    row = legs.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", F.round("weight", 6))))).alias("target_weights"),
        F.when(F.count("weight") == F.count(F.lit(1)), F.round(F.sum("weight"), 6)).alias("gross_exposure"),
    )
    out = last.crossJoin(row)
    return out.select(
        "decision_date", F.date_add(F.col("decision_date").cast("date"), 1).alias("effective_from"),
        "target_weights", "gross_exposure",
    )


def cost_dimension(bars: DataFrame, presets: list[tuple[str, float, float]] | None = None) -> tuple[DataFrame, Column, Column]:
    """Bars crossed with the cost presets, and the fee and floor columns to account with."""
    spark = bars.sparkSession
    dim = spark.createDataFrame(presets or grids.COST_PRESETS, "cost string, fee_bps double, floor_bps double")
    return bars.crossJoin(F.broadcast(dim)), F.col("fee_bps"), F.col("floor_bps")


__all__ = ["STRATEGIES", "cost_dimension", "latest_signal", "num", "register", "strategy"]
