"""Timing rules, kernels and statistics on tiny frames."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions.text import fold_tokens, parse_money
from tidebar.operators import blocks, metrics, similarity
from tidebar.operators import windows as win
from tidebar.operators.bootstrap import block_band, paired_test
from tidebar.operators.joins import asof_join
from tidebar.operators.models import isotonic_pools, least_squares
from tidebar.plans import backtest, portfolio, signals
from tidebar.plans.grids import FAMILY_SIZES, TOTAL_TRIALS
from tidebar.plans.registry import strategy


def bars(spark, n=400, seed=3, symbols=("A", "B")):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        px = 100.0
        for i in range(n):
            px *= math.exp(rng.gauss(0, 0.03))
            rows.append((s, pd.Timestamp("2021-01-01") + pd.Timedelta(days=i), px, px * 1.01, px * 0.99, px, 1000.0, 1e6))
    cols = ["symbol", "ts", "open", "high", "low", "close", "volume", "quote_volume"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=cols))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_grid_sizes():
    assert TOTAL_TRIALS == 32 and FAMILY_SIZES == {"sma_cross": 8, "donchian": 4, "tsmom": 12, "rsi_meanrev": 8}


def test_lookahead_cheat_earns_nothing_special(spark):
    """A position equal to the sign of the same bar's return must not earn that return."""
    b = bars(spark, 300, symbols=("A",))
    w = win.series("symbol")
    cheat = b.withColumn("r", win.pct_change("close", w)).select("symbol", "ts", F.coalesce((F.col("r") > 0).cast("double"), F.lit(0.0)).alias("pos"))
    out = backtest.run(b, cheat).toPandas().sort_values("ts")
    assert out["held"].tolist()[1:] == out["pos"].tolist()[:-1]
    assert out["gross"].sum() < out.loc[out["ret"] > 0, "ret"].sum() / 2


def test_costs_on_turnover_only(spark):
    b = bars(spark, 60, symbols=("A",))
    out = backtest.run(b, signals.buy_and_hold(b)).toPandas().sort_values("ts")
    assert (out["cost"] > 0).sum() == 1 and out["turnover"].sum() == 1.0


def test_longs_pay_positive_funding(spark):
    b = bars(spark, 20, symbols=("A",))
    f = b.select("symbol", "ts", F.lit(0.001).alias("funding"))
    out = backtest.run(b, signals.buy_and_hold(b), funding=f).toPandas()
    assert out["funding_pnl"].sum() == pytest.approx(-0.019)


def test_future_mutation_leaves_past_signals(spark):
    b = bars(spark, 350)
    cut = F.lit("2021-10-01").cast("timestamp")
    mutated = b.withColumn("close", F.when(F.col("ts") > cut, F.col("close") * 3).otherwise(F.col("close")))
    keep = lambda d: rows(signals.positions(d).where(F.col("ts") <= cut).select("symbol", "ts", "params", F.round("pos", 9)), "symbol", "params", "ts")
    assert keep(b) == keep(mutated)


def test_ensemble_weight_equals_mean_of_variants(spark):
    b = bars(spark, 200)
    a = rows(strategy("donchian_ensemble")(b).select("symbol", "ts", F.round("weight", 9)), "symbol", "ts")
    parts = [signals.single(b, "donchian", n_entry=n, n_exit=max(5, n // 2)) for n in (20, 40, 55, 100)]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert a == rows(u.groupBy("symbol", "ts").agg(F.round(F.avg("pos") / 3, 9)), "symbol", "ts")
    with pytest.raises(KeyError):
        strategy("nothing")


def test_partitioning_does_not_change_results(spark):
    b = bars(spark, 150)
    f = lambda d: rows(backtest.variant_returns(d, ["donchian"]).select("symbol", "params", "ts", F.round("net", 12)), "symbol", "params", "ts")
    assert f(b) == f(b.orderBy(F.rand(1)).repartition(7))


def test_ewm_and_hysteresis(spark):
    d = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate([1, 3, 2, 5])], "symbol string, ts int, x double")
    e = [r[0] for r in win.ewm(d, ["symbol"], "ts", ["x"], 2).orderBy("ts").select("x_ewm").collect()]
    assert e == [1.0, 2.0, 2.0, 3.5]
    t = spark.createDataFrame([("A", i, v) for i, v in enumerate([0.5, 0.51, 0.53, None, 0.01])], "symbol string, ts int, x double")
    h = [r[0] for r in win.hysteresis(t, ["symbol"], "ts", "x", "h").orderBy("ts").select("h").collect()]
    assert h == [0.5, 0.5, 0.53, 0.0, 0.0]


def test_blocks_equal_plain_windows(spark):
    """One key holds most rows; block-wise results equal the unbounded windows."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.8 else "cold", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * i), i,
             None if rng.random() < 0.6 else float(rng.randint(1, 9))) for i in range(2500)]
    d = spark.createDataFrame(pd.DataFrame(data, columns=["k", "ts", "i", "x"])).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    want = rows(d.select("i", F.sum(F.coalesce("x", F.lit(0.0))).over(w), F.last("x", ignorenulls=True).over(w), F.row_number().over(W.partitionBy("k").orderBy("ts"))), "i")
    got = blocks.running_sum(d, ["k"], ["ts"], {"s": "x"}, "day")
    got = blocks.carry_forward(got, ["k"], ["ts"], {"l": "x"}, "day")
    got = blocks.row_positions(got, ["k"], ["ts"], "p", "day")
    assert rows(got.select("i", "s", "l", "p"), "i") == want
    r = blocks.rolling_blocks(d, ["k"], ["ts"], 30, lambda ww: {"m": win.rolling_mean("x", ww, 30, min_rows=5)}, rows_per_block=50, span="day")
    plain = d.select("i", F.round(win.rolling_mean("x", W.partitionBy("k").orderBy("ts"), 30, min_rows=5), 9))
    assert rows(r.select("i", F.round("m", 9)), "i") == rows(plain, "i")


def test_a_day_with_most_rows_is_cut_by_row_count(spark, monkeypatch):
    """90% of the rows in one day: no block above a fraction of them, and the results of the plain windows."""
    from pyspark.sql import Window as W

    rng = random.Random(9)
    start = datetime(2024, 3, 7)
    data = [(None if rng.random() < 0.3 else "k", start + timedelta(seconds=rng.randrange(86_400) if i % 10 else rng.randrange(-4_000_000, 4_000_000)), i, float(i % 7) if i % 5 == 0 else None) for i in range(4000)]
    d = spark.createDataFrame(data, "k string, ts timestamp, i int, x double")
    most = lambda df: df.groupBy("k", blocks.BLOCK).count().agg(F.max("count")).first()[0]
    assert most(blocks.with_blocks(d, ["k"], "ts", "month")) > 2000
    assert most(blocks.with_blocks(d, ["k"], "ts", "month", rows=100)) <= 100
    w = W.partitionBy("k").orderBy("ts", "i").rowsBetween(W.unboundedPreceding, 0)
    want = rows(d.select("i", F.sum(F.coalesce("x", F.lit(0.0))).over(w), F.last("x", ignorenulls=True).over(w), F.row_number().over(W.partitionBy("k").orderBy("ts", "i"))), "i")
    got = blocks.running_sum(d, ["k"], ["ts", "i"], {"s": "x"}, rows=100)
    got = blocks.carry_forward(got, ["k"], ["ts", "i"], {"l": "x"}, rows=100)
    got = blocks.row_positions(got, ["k"], ["ts", "i"], "p", rows=100)
    assert rows(got.select("i", "s", "l", "p"), "i") == want
    monkeypatch.setattr("tidebar.operators.joins.ROWS", 100)
    marks = d.where("x IS NOT NULL").select("ts", F.col("i").alias("j"))
    met = rows(asof_join(d.select("i", "ts"), marks, "ts", "ts", cols=["j"], tie=["j"], span="year").select("i", "j"), "i")
    line = sorted((r.ts, r.j) for r in marks.collect())
    at = {r.i: r.ts for r in d.collect()}
    assert met == [(i, max((m for m in line if m[0] <= at[i]), default=(None, None))[1]) for i in sorted(at)]


def test_similarity_join_finds_all_pairs_with_a_hot_token(spark):
    """A token in a third of the sets is cut into tiles; every similar pair is found and no group exceeds a tile."""
    from tidebar.operators import setjoin

    rng = random.Random(3)
    sets = [sorted({f"w{rng.randrange(60)}" for _ in range(rng.randint(2, 25))} | ({"hot"} if i % 3 == 0 else set())) for i in range(500)]
    sets += [[x for x in s if rng.random() < 0.9] for s in sets[:200]]
    sets = [list(x) for x in {tuple(s) for s in sets}]
    d = spark.createDataFrame(list(enumerate(sets)), "id bigint, toks array<string>")
    want = {}
    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            both = len(set(x) & set(sets[b]))
            j = both / (len(x) + len(sets[b]) - both) if min(len(x), len(sets[b])) >= 4 else 0
            if j >= 0.6:
                want[a, b] = j
    for tile in (setjoin.TILE, 20):
        got = {(r.a, r.b): r.jaccard for r in setjoin.similar_pairs(d, "id", "toks", 0.6, 4, tile).collect()}
        assert got == want and len(want) > 100
    named = setjoin.entered(d.where("size(toks) >= 4").select(F.col("id").alias("k"), F.col("toks").alias("t")), 0.6)
    largest = lambda tile: setjoin.dealt(named, tile).groupBy("tile").count().agg(F.max("count")).first()[0]
    assert largest(setjoin.TILE) > 60 and largest(20) <= 40


def test_asof_ties_and_age(spark):
    left = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 09:59:59"), (3, "2024-03-05 00:00:00")], "i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([("2024-01-01 10:00:00", 7)], "at string, v int").withColumn("at", F.col("at").cast("timestamp"))
    got = rows(asof_join(left, right, "t", "at", cols=["v"]).select("i", "v"), "i")
    assert got == [(1, 7), (2, None), (3, 7)]
    assert rows(asof_join(left, right, "t", "at", cols=["v"], max_age_hours=24).select("i", "v"), "i")[2] == (3, None)


def test_sharpe_drawdown_dsr(spark):
    rng = random.Random(1)
    data = [("noise", i, rng.gauss(0, 0.01)) for i in range(1500)] + [("edge", i, rng.gauss(0.002, 0.01)) for i in range(1500)]
    d = spark.createDataFrame(data, "k string, ts int, net double")
    m = metrics.moments(d, ["k"]).withColumn("v", F.lit(0.0005))
    dsr = {r["k"]: r["dsr"] for r in metrics.deflated_sharpe(m, 32, "v").collect()}
    assert dsr["edge"] > 0.99 > dsr["noise"]
    pdf = pd.DataFrame(data, columns=["k", "ts", "net"])
    for r in m.collect():
        x = pdf.loc[pdf["k"] == r["k"], "net"]
        assert r["skew"] == pytest.approx(x.skew(), abs=1e-9) and r["ex_kurt"] == pytest.approx(x.kurt(), abs=1e-9)
    up = spark.createDataFrame([("a", 0, 0.1), ("a", 1, -0.5), ("a", 2, 0.2)], "k string, ts int, net double")
    assert metrics.summary(up, ["k"], "ts").collect()[0]["max_dd_pct"] == pytest.approx(-50)


def test_pbo_dominant_column_is_low(spark):
    rng = random.Random(4)
    data = [("a", f"v{v}", v, i, rng.gauss(0.02 if v == 3 else 0, 0.01)) for v in range(6) for i in range(200)]
    d = spark.createDataFrame(data, "k string, params string, o long, ts int, net double")
    assert metrics.pbo(d, ["k"], "params", "o", "ts", "net").collect()[0]["pbo"] == 0.0
    short = d.where("ts < 40")
    assert metrics.pbo(short, ["k"], "params", "o", "ts", "net").collect()[0]["pbo"] is None


def test_bootstraps_are_reproducible(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([("a", i, rng.gauss(0.01, 0.01), rng.gauss(0, 0.01)) for i in range(150)], "k string, ts int, a double, b double")
    one = block_band(d, ["k"], "ts", "a", 20, n_boot=50).collect()
    assert one == block_band(d.repartition(5), ["k"], "ts", "a", 20, n_boot=50).collect()
    p = paired_test(d, ["k"], "ts", "a", "b", n_boot=60).collect()[0]
    assert p["mean_p"] == 0.0 and p["n"] == 150


def test_models(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(scale=0.01, size=200)
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "c": 1.0, "x1": x[:, 0], "x2": x[:, 1], "y": y}))
    r = least_squares(d, ["k"], ["c", "x1", "x2"], "y", ["b0", "b1", "b2"]).collect()[0]
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [r["b0"], r["b1"], r["b2"]] == pytest.approx(list(want), abs=1e-8)
    p = rng.random(300).round(2)
    lab = (rng.random(300) < p).astype(int)
    pools = isotonic_pools(spark.createDataFrame(pd.DataFrame({"k": "a", "p": p, "y": lab})), ["k"], "p", "y", blocks=7).orderBy("lo").toPandas()
    one = isotonic_pools(spark.createDataFrame(pd.DataFrame({"k": "a", "p": p, "y": lab})), ["k"], "p", "y", blocks=1).orderBy("lo").toPandas()
    assert pools["value"].is_monotonic_increasing and pools.equals(one)


def greedy(items):
    kept = []
    for i, toks in items:
        t = set(toks)
        hit = any(t and k and (t == k or (min(len(t), len(k)) >= 4 and len(t & k) / len(t | k) >= 0.6)) for _, k in kept)
        if not hit:
            kept.append((i, t))
    return [i for i, _ in kept]


def test_collapse_equals_greedy(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(18)]
    titles = [" ".join(rng.sample(words, rng.randint(1, 7))) for _ in range(120)] + ["same story again today"] * 40 + ["", "??"]
    d = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    toks = {r["id"]: r["t"] for r in d.select("id", fold_tokens("title").alias("t")).collect()}
    want = greedy([(i, toks[i]) for i in range(len(titles))])
    got = sorted(r["id"] for r in similarity.collapse(d, "title", "id", [F.col("id")]).collect())
    assert got == want


def test_money_and_tokens(spark):
    vals = ["1,234.5", "(45.6)", "-", "", "n/a", "US$7", "x1"]
    d = spark.createDataFrame([(v,) for v in vals], "s string")
    assert [r[0] for r in d.select(parse_money("s")).collect()] == [1234.5, -45.6, 0.0, 0.0, 0.0, 7.0, None]
    e = spark.createDataFrame([("Él ÉTÉ 42 to",)], "s string")
    assert e.select(fold_tokens("s")).collect()[0][0] == ["42", "ete"]


def test_holdings_forced_exit(spark):
    p = spark.createDataFrame([(1, "A", 0.1, 0.001), (1, "B", 0.2, 0.001), (2, "A", None, 0.001), (2, "B", -0.1, 0.001), (3, "B", 0.0, 0.001)], "date int, symbol string, ret_next double, cost_rate double")
    w = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (2, "A", 0.5), (3, "B", 0.5)], "date int, symbol string, weight double")
    out = {r["date"]: r for r in portfolio.holdings_account(w, p).collect()}
    assert out[1]["gross"] == pytest.approx(0.15) and out[1]["turnover"] == pytest.approx(1.0)
    # date 2: A has no next bar (cost, no turnover), B is sold
    assert out[2]["gross"] == 0 and out[2]["turnover"] == pytest.approx(0.5) and out[2]["cost"] == pytest.approx(0.001)
    assert out[3]["turnover"] == pytest.approx(0.5)


def test_block_quantiles_are_exact(spark):
    rng = random.Random(8)
    data = [("hot" if rng.random() < 0.8 else "cold", float(rng.randint(0, 300)) / 7) for _ in range(3000)] + [("one", 5.0)]
    d = spark.createDataFrame(data, "k string, x double")
    got = {r["k"]: r for r in blocks.quantiles(d, ["k"], "x", {"a": 0.05, "b": 0.5, "c": 1.0}, n_blocks=9).collect()}
    pdf = pd.DataFrame(data, columns=["k", "x"]).groupby("k")["x"]
    for k, x in pdf:
        assert [got[k]["a"], got[k]["b"], got[k]["c"]] == pytest.approx([x.quantile(q) for q in (0.05, 0.5, 1.0)])


def test_similarity_join_ships_sketches_not_tokens(spark):
    from tidebar.operators import setjoin

    # Sizes on both sides of bucket edges, so maps of two lengths meet; every set has its near copy two tokens shorter.
    sets = [[f"w{i}x{j}" for j in range(n)] for i, n in enumerate([4, 7, 8, 12, 13, 21, 36, 60, 100, 167, 168, 280, 470, 471])]
    sets += [s[:-2] if len(s) > 6 else s[:-1] + ["other"] for s in sets]
    d = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)] + [(98, None), (99, ""), (100, " ".join(sets[3]))], "id bigint, title string")
    got = {(r.a, r.b): r.jaccard for r in similarity.near_duplicate_pairs(d, "title", "id").collect()}
    half = len(sets) // 2
    assert got == {(i, i + half): (len(sets[i]) - 2) / len(sets[i]) if len(sets[i]) > 6 else 0.6 for i in range(half)}
    named = setjoin.entered(spark.createDataFrame(list(enumerate(sets)), "k bigint, t array<string>"), 0.6)
    assert setjoin.dealt(named).count() <= 3 * len(sets)
    assert named.where("length(map) > n / 4 + 1 and length(map) > n + 32").count() == 0
    left = {r["id"] for r in similarity.collapse(d, "title", "id", [F.col("id")]).collect()}
    assert left == {*range(half), 99}


def test_collapse_verifies_few_pairs_of_a_dense_group(spark, monkeypatch):
    seen, verified = [], similarity.verified

    def counted(pairs, *rest, **more):
        seen.append(pairs.count())
        return verified(pairs, *rest, **more)

    monkeypatch.setattr(similarity, "verified", counted)
    base = [f"word{i}" for i in range(30)]
    titles = [" ".join([*base[:k], f"other{k}", *base[k + 1 :]]) for k in range(30)] + [f"story {i} of{i} alone{i} here{i}" for i in range(9)]
    d = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    # the larger id is preferred, so the last of the group stays
    assert {r["id"] for r in similarity.collapse(d, "title", "id", [-F.col("id")]).collect()} == {29, *range(30, 39)}
    assert sum(seen) <= 2 * len(titles)  # all pairs of the group are 435
