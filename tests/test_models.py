"""Logistic regressions of many keys, fitted together, against one-by-one fits."""

import numpy as np

from tidebar.operators import models

REG = 1e-3


def one_fit(x, y, reg=REG):
    """Gradient descent to the optimum of one key: slow, but of another kind than Newton steps."""
    s = x.std(axis=0, ddof=1)
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / np.where(s > 0, s, 1)])
    ridge = np.array([0.0] + [reg] * x.shape[1])
    b, rate = np.zeros(z.shape[1]), 4.0 / np.linalg.eigvalsh(z.T @ z / len(z)).max()
    for _ in range(20_000):
        b += rate * (z.T @ (y - 1 / (1 + np.exp(-z @ b))) / len(y) - ridge * b)
    return b, 1 / (1 + np.exp(-z @ b))


def made(seed, n, shift):
    g = np.random.default_rng(seed)
    x = np.column_stack([g.normal(size=n), g.normal(size=n) * 50 + 1000, np.full(n, 3.0)])
    y = (g.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 2 + (x[:, 1] - 1000) / 50 + shift)))).astype(float)
    return x, y


def test_all_keys_at_once(spark):
    data = {("u", 1): made(1, 300, 0.0), ("u", 2): made(2, 90, -2.0), ("v", 1): made(3, 500, 3.0)}
    rows = [(a, k, *map(float, xi), float(yi)) for (a, k), (x, y) in data.items() for xi, yi in zip(x, y, strict=True)]
    rows += [("u", 1, None, 1.0, 3.0, 1.0), ("u", 1, float("nan"), 1.0, 3.0, 0.0), ("u", 1, 1.0, 1.0, 3.0, None)]
    rows += [("w", 9, float(i), 1.0, 1.0, 0.0) for i in range(5)]  # one label only
    rows += [("s", 9, float(i), float(-i), 1.0, float(i > 4)) for i in range(10)]  # separable: the ridge bounds it
    df = spark.createDataFrame(rows, "a string, k int, x0 double, x1 double, x2 double, y double")
    feats, keys = ["x0", "x1", "x2"], ["a", "k"]
    fits = models.logistic_fits(df, keys, feats, "y", REG)
    got = {(r["a"], r["k"]): r for r in fits.collect()}
    assert len(got) == 5 and all(r["converged"] and r["steps"] < 40 for r in got.values())
    for key, (x, y) in data.items():
        want, _ = one_fit(x, y)
        assert got[key]["n_fit"] == len(y)
        assert np.allclose(got[key]["_beta"], want, atol=1e-6) and got[key]["_beta"][3] == 0
    scored = models.logistic_scores(df, fits, keys, feats, "p")
    assert scored.columns == [*df.columns, "p"]
    out = scored.toPandas()
    assert len(out) == df.count() - 2 and (out[out.a == "w"].p == 0).all()
    x, y = data["v", 1]
    assert np.allclose(sorted(out[(out.a == "v")].p), sorted(one_fit(x, y)[1]), atol=1e-6)
    for r in models.score_equations(df, fits, keys, feats, "y", REG).collect():
        rows = out[(out.a == r["a"]) & (out.k == r["k"]) & out.y.notna()]
        s = rows.x0.std(ddof=1)
        assert abs(r["eq_0"] - rows.y.mean()) < 1e-9
        assert abs(r["eq_x0"] - (rows.y * (rows.x0 - rows.x0.mean()) / s).mean()) < 1e-9


def test_no_rows(spark):
    df = spark.createDataFrame([], "k int, x double, y double")
    fits = models.logistic_fits(df, ["k"], ["x"], "y")
    assert fits.count() == 0 and models.logistic_scores(df, fits, ["k"], ["x"], "p").count() == 0


def test_steps_do_not_grow_with_keys(spark):
    x, y = made(5, 60, 0.5)
    rows = [(k, float(a[0]), float(b)) for k in range(40) for a, b in zip(x, y, strict=True)]
    fits = models.logistic_fits(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], ["x"], "y").collect()
    assert len(fits) == 40 and len({tuple(np.round(r["_beta"], 9)) for r in fits}) == 1 and max(r["steps"] for r in fits) < 12
