"""Gates, quantile blocks and short series against plain Python."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.operators import blocks, bootstrap, joins, metrics, selection
from tidebar.plans import review, risk
from tidebar.sources import readers

T0 = dt.datetime(2024, 1, 1)


def test_event_gate_equals_all_pairs(spark):
    hours = [0, 36, 37, 38, 500, 501, 501, 744, 5000]
    events = [(f"e{i}", T0 + dt.timedelta(hours=h)) for i, h in enumerate(hours)]
    instants = [T0 + dt.timedelta(minutes=30 * i) for i in range(-200, 11000, 7)]
    got = joins.event_gate(
        spark.createDataFrame([(t,) for t in instants] * 2, "ts timestamp"), spark.createDataFrame(events, "name string, utc timestamp")
    )
    want = {}
    for t in instants:
        near = sorted((u, n) for n, u in events if u - dt.timedelta(hours=36) <= t <= u + dt.timedelta(hours=1))
        want[t] = (bool(near), near[0][1] if near else None, len(near))
    assert {r["ts"]: (r["blocked"], r["event_name"], r["n_events"]) for r in got.collect()} == want


def test_event_gate_without_events(spark):
    points = spark.createDataFrame([(T0,), (None,)], "ts timestamp")
    got = joins.event_gate(points, spark.createDataFrame([], "name string, utc timestamp"))
    assert sorted((r["ts"] is None, r["blocked"], r["n_events"]) for r in got.collect()) == [(False, False, 0), (True, False, 0)]


def test_one_far_outlier_leaves_quantile_blocks_even(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 7.0).alias("x"))
    edges, block = blocks.value_blocks("x", 64)
    placed = rows.join(rows.groupBy("k").agg(edges.alias("_edges")), "k").withColumn("b", block)
    sizes = [r["count"] for r in placed.groupBy("b").count().collect()]
    assert len(sizes) >= 60 and max(sizes) < 3 * 20_000 / 64
    order = placed.groupBy("b").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(order, order[1:]))
    got = blocks.quantiles(rows, ["k"], "x", {"q": 0.5}).first()["q"]
    assert got == pytest.approx(rows.agg(F.percentile("x", 0.5)).first()[0])


def test_block_band_of_a_series_shorter_than_a_block(spark):
    rows = spark.createDataFrame([("a", i, 0.01) for i in range(4)], "k string, ts int, r double")
    got = bootstrap.block_band(rows, ["k"], "ts", "r", 10, n_boot=20, block=10).first()
    assert got["n_paths"] == 20 and got["p50"] == pytest.approx(1.01**10 - 1)


def test_flow_gate_knows_two_assets(spark):
    rows = [(a, T0 + dt.timedelta(days=i), -110.0) for a in ("BTC", "ETH", "SOL") for i in range(5)]
    flows = spark.createDataFrame(rows, "asset string, date timestamp, net_flow_usd_m double")
    days = spark.createDataFrame([(T0 + dt.timedelta(days=6),)], "day timestamp")
    assert {(r["asset"], r["action"]) for r in risk.flow_gate(days, flows).collect()} == {("BTC", "block"), ("ETH", "block")}
    assert risk.flow_gate(days, flows, assets=None).count() == 3


def test_best_variant_ties_in_the_last_bits(spark):
    rows = spark.createDataFrame([("s", 0.1 + 0.2, 2), ("s", 0.3, 1)], "k string, score double, o int")
    assert selection.best_variant(rows, ["k"], "score", "o", []).first()["o"] == 1


def test_pbo_of_returns_far_from_zero(spark):
    """A large common mean must not swallow the deviations: shifting all returns keeps which variants differ."""
    made = spark.range(200).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v"), F.col("id").alias("ts"))
    noise = (F.pmod(F.xxhash64("v", "ts"), F.lit(1000)) - 500) / 1e9
    rows = made.select(F.col("v").cast("string").alias("name"), "v", "ts", (F.lit(1e3) + noise).alias("r"), F.lit("a").alias("k"))
    assert 0 <= metrics.pbo(rows, ["k"], "name", "v", "ts", "r").first()["pbo"] <= 1


def test_overlay_gate_nine_checks_and_ladder(spark):
    good = dict(sharpe=1.2, base_sharpe=1.0, baseline_sharpe=1.1, gain_p=None, dsr=0.96, max_dd_pct=-10.0, base_max_dd_pct=-20.0,
                cagr_pct=8.0, base_cagr_pct=10.0, folds_positive=7, folds_total=10, stress_sharpe=0.1, sharpe_gap_wo_best=0.2)
    rows = [dict(good, variant="E1", gain_p=0.04), dict(good, variant="E3", gain_p=0.06, sharpe=1.3)]
    got = review.overlay_gate(spark.createDataFrame(rows)).collect()
    assert {(r["variant"], r["all_pass"], r["n_known"]) for r in got if r["n_known"]} == {("E1", True, 9), ("E3", False, 9)}
    assert [(r["variant"], r["passed"]) for r in got if r["check"] == "sharpe_above_E1"] == [("E3", True)]


def test_views_skip_only_missing_folders(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    assert readers.register_views(spark, str(tmp_path), {"here": "a", "absent": "b"}) == ["here"]
