"""The rolling kernel against plain frames, walk-forward moments against whole windows, and no look-ahead in the feature table."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.catalog.base import Tables
from tidebar.catalog.q_research import bar_funding
from tidebar.operators import metrics, rolling
from tidebar.plans import features, walkforward

SMALL = "/root/testdata/sf0.001"


def plain(op, x, y, width, least):
    out = []
    for i in range(len(x)):
        part = [(a, b) for a, b in zip(x[max(0, i - width + 1) : i + 1], y[max(0, i - width + 1) : i + 1], strict=True) if a == a and (op not in ("corr", "beta") or b == b)]
        if len(part) < least:
            out.append(math.nan)
            continue
        a, b = np.array([p[0] for p in part]), np.array([p[1] for p in part])
        with np.errstate(all="ignore"):
            out.append({
                "sum": lambda: a.sum(), "mean": lambda: a.mean(), "std": lambda: a.std(ddof=1) if len(a) > 1 else math.nan, "max": lambda: a.max(), "min": lambda: a.min(),
                "corr": lambda: np.corrcoef(a, b)[0, 1], "beta": lambda: np.cov(a, b)[0, 1] / b.var(ddof=1),
            }[op]())
    return out


@pytest.mark.parametrize("op", ["sum", "mean", "std", "max", "min", "corr", "beta"])
@pytest.mark.parametrize(("width", "least"), [(1, 1), (5, 5), (21, 10), (64, 64), (500, 3)])
def test_measures_equal_plain_frames(op, width, least):
    if op in ("corr", "beta") and least < 3:
        return
    rng = np.random.default_rng(width)
    x, y = rng.normal(1e6, 3, 200), rng.normal(-4, 1, 200)  # a level far from 0 must not cancel
    x[rng.random(200) < 0.1], y[rng.random(200) < 0.1] = np.nan, np.nan
    got = rolling.measured({"x": x, "y": y}, rolling.Roll(op, "x", width, least, "y" if op in ("corr", "beta") else None))
    assert np.allclose(got, plain(op, x, y, width, least), rtol=1e-8, equal_nan=True)


def test_kernel_by_series_with_nulls_and_short_series(spark):
    rows = [("a", i, float(i * i % 7) if i % 4 else None) for i in range(40)] + [("b", 0, 1.0), (None, 0, None)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "k string, t int, x double")
    out = rolling.rolling_many(d, ["k"], "t", {"m": rolling.Roll("mean", "x", 8, 3), "c": rolling.Roll("change", "x", 1), "r": rolling.Roll("rank", "x", 1, 2)})
    got = {(r.k, r.t): (r.m, r.c, r.r) for r in out.collect()}
    xs = [r[2] for r in sorted(r for r in rows if r[0] == "a")]
    for i, x in enumerate(xs):
        part = [v for v in xs[max(0, i - 7) : i + 1] if v is not None]
        seen = [v for v in xs[: i + 1] if v is not None]
        m, c, r = got["a", i]
        assert m == (pytest.approx(sum(part) / len(part)) if len(part) >= 3 else None)
        assert c == (x - xs[i - 1] if i and x is not None and xs[i - 1] is not None else None)
        below, upto = (sum(v < x for v in seen), sum(v <= x for v in seen)) if x is not None else (0, 0)
        assert r == (pytest.approx((below + 1 + upto) / 2 / len(seen)) if x is not None and len(seen) >= 2 else None)
    assert got["b", 0] == (None, None, None) == got[None, 0]
    assert rolling.rolling_many(d.limit(0), ["k"], "t", {"m": rolling.Roll("mean", "x", 8)}).count() == 0


def test_moments_merge_to_those_of_the_whole(spark):
    rng = np.random.default_rng(2)
    parts = [rng.normal(1e3, 1, n) for n in (1, 5, 40, 2)]
    flat = [np.full(n, 0.1) for n in (3, 4, 5)]
    for xs in (parts, flat, [parts[0]], []):
        rows = [(float(len(x)), float(x[0] if np.ptp(x) == 0 else x.mean()), float(len(x) * x.var() if np.ptp(x) else 0.0)) for x in xs]
        made = F.array(*[F.struct(F.lit(int(n)).cast("bigint").alias("n"), F.lit(m).alias("mean"), F.lit(q).alias("m2")) for n, m, q in rows])
        made = made if rows else made.cast("array<struct<n:bigint,mean:double,m2:double>>")
        got = spark.range(1).select(metrics.sharpe_of_moments(made)).first()[0]
        whole = np.concatenate(xs) if xs else np.zeros(0)
        want = 0.0 if len(whole) < 3 or np.ptp(whole) == 0 else whole.mean() / whole.std(ddof=1)
        assert got == pytest.approx(want, rel=1e-9)


def test_walk_forward_equals_whole_windows(spark):
    rng = random.Random(6)
    rows = [("s", p, g, t, rng.gauss(0.001 * g, 0.01) if t % 9 else None) for g, p in enumerate(("a", "b", "c")) for t in range(100)]
    d = spark.createDataFrame(rows, "symbol string, params string, grid_order int, ts int, net double")
    oos, ledger = walkforward.walk_forward(d, ["symbol"], train=30, test=12, min_test=5)
    kept = {(r.fold, r.ts): r.net for r in oos.collect()}
    by = {(p, t): x for _, p, _, t, x in rows}
    want, folds = {}, 0
    for k in range(10):
        lo, hi = 30 + 12 * k, min(42 + 12 * k, 100)
        if lo >= 100 or hi - lo < 5:
            continue
        folds += 1
        sr = {}
        for p in "abc":
            x = np.array([by[p, t] for t in range(lo - 30, lo) if by[p, t] is not None])
            sr[p] = x.mean() / x.std(ddof=1)
        best = max("abc", key=lambda p: sr[p])
        row = ledger.where(f"fold = {k}").first()
        assert row.train_sr == pytest.approx(sr[best]) and row.chosen == (best if sr[best] > 0 else "(flat)") and row.n_test == hi - lo
        want |= {(k, t): by[best, t] if sr[best] > 0 else 0.0 for t in range(lo, hi)}
    assert kept == want and folds == ledger.count() == 6


def test_features_do_not_look_ahead(spark):
    """What is known at a decision does not change when everything after it does; only the labels may."""
    t, cut = Tables(spark, SMALL), "1996-06-01"
    roles = {"spy": "1-URGENT", "qqq": "2-HIGH", "gld": "3-MEDIUM", "vix": "5-LOW"}

    def moved(df, at, cols):
        later = F.col(at) >= F.lit(cut).cast("timestamp")
        return df.withColumns({c: F.when(later, F.col(c) * (2 + F.pmod(F.xxhash64(at), F.lit(5)))).otherwise(F.col(c)) for c in cols})

    prices = ["open", "high", "low", "close", "volume"]
    lead = t.bars.select(F.min("symbol")).first()[0]
    before = features.feature_table(t.bars, t.sessions, bar_funding(t), lead, roles)
    bars, sessions = moved(t.bars, "ts", prices), moved(t.sessions, "session_date", prices)
    after = features.feature_table(bars, sessions, moved(bar_funding(t), "ts", ["funding"]), lead, roles)
    names = [c for c in before.columns if c not in features.LABELS]
    read = lambda df: {(r.symbol, r.decision_ts): r for r in df.where(F.col("decision_ts") <= F.lit(cut).cast("timestamp")).select(*names).collect()}
    x, y = read(before), read(after)
    assert x == y and len(x) > 300
    assert before.exceptAll(after).count() > 0
