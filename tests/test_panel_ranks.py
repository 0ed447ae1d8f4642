"""Ranks by volume do not hang on the order in which the volumes were summed."""

from __future__ import annotations

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidebar import adapters
from tidebar.catalog import load
from tidebar.functions.columns import exact_sum

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"


def lines(spark, at, orders):
    """Rows of the suppliers of ``orders``, which bring the same prices, each in its own order."""
    rows = [(i, 1, s, i, 1.0, x, at) for s, prices in orders.items() for i, x in enumerate(prices)]
    return spark.createDataFrame(rows, LINES).coalesce(1)


def test_equal_volumes_rank_by_symbol(spark, tmp_path):
    assert 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1
    table = lines(spark, datetime(2024, 1, 1), {1: [0.3, 0.2, 0.1], 2: [0.1, 0.2, 0.3], 3: [0.3, 0.1, 0.2]})
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = load()["w19_cross_rank"].run(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [(r.symbol, r["rank"]) for r in got] == [("S000001", 1), ("S000002", 2), ("S000003", 3)]


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5, 1e10])
def test_exact_sum_rounds_once(spark, scale):
    rng = random.Random(7)
    values = [rng.uniform(-scale, 2 * scale) for _ in range(300)]
    sums = set()
    for cut in (1, 3, 7):
        rng.shuffle(values)
        sums |= {spark.createDataFrame([(v,) for v in values], "x double").repartition(cut).agg(exact_sum("x")).first()[0]}
    assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(values), rel=1e-15, abs=300 * 2**-52)
    cents = [round(abs(v), 2) + 1 for v in values]
    assert spark.createDataFrame([(v,) for v in cents], "x double").agg(exact_sum("x")).first()[0] == math.fsum(cents)


def test_exact_sum_of_odd_values(spark):
    of = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum("x")).first()[0]
    assert of(None) is None and of(None, 1.5) == 1.5 and of(1e300, 1.5) == 1e300 and of(1.5, float("inf")) == float("inf")
    assert math.isnan(of(1.0, float("nan"))) and of(-0.25, -0.5) == -0.75 and of(2.0**36, 0.5) == 2.0**36 + 0.5

def test_panel_ranks_of_copies(spark, tmp_path):
    """Suppliers of equal weeks, each in its own order of rows, stand in the order of their names in the ranker panel, too."""
    from tidebar.plans import universe

    rng = random.Random(3)
    weeks = [(datetime(2024, 1, 1 + 7 * w), [round(rng.uniform(900, 90_000), 2) for _ in range(5)]) for w in range(4)]
    parts = [lines(spark, at, {s: rng.sample(prices, 5) for s in range(6)}) for at, prices in weeks]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    panel = universe.panel(adapters.weekly_panel_bars(table), adv_window=2)
    got = panel.select("symbol", F.col("rank").alias("r")).distinct().orderBy("symbol").collect()
    assert [(r.symbol, r.r) for r in got] == [(f"S{s:06d}", s + 1) for s in range(6)]
