"""Statistical models as distributed fits.

Linear models reduce to sums of cross products, so the fit is one aggregate and
a tiny solve on its (few) rows. Isotonic calibration pools within score blocks
first, then merges the pools.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.columns import har_design, num
from tidebar.operators.blocks import with_value_blocks
from tidebar.session import scratch_path

HAR_COLUMNS = ["har_0", "har_1", "har_2", "har_3"]


def _har_terms():
    design = har_design(F.col("c_ret1_n"), F.col("c_sigma20d"), F.col("c_vol5"), F.col("c_vol22"))
    return [num(1), *design]


def least_squares(rows: DataFrame, keys: list[str], xs: list[str], y: str, out: list[str]) -> DataFrame:
    """OLS coefficients per key by normal equations: one partial aggregate, then a
    small solve on the aggregated rows where they already are (no further shuffle)."""
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"_a{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(x) * F.col(y)).alias(f"_b{i}") for i, x in enumerate(xs)]
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    agg = grouped.agg(*sums, F.count(F.lit(1)).alias("n_fit"))
    fields = [agg.schema[c] for c in keys]
    schema = T.StructType(
        [*fields, T.StructField("n_fit", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in out]]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            res = {c: [] for c in out}
            for _, r in pdf.iterrows():
                a = np.zeros((k, k))
                for i, j in pairs:
                    a[i, j] = a[j, i] = r[f"_a{i}_{j}"]
                b = np.array([r[f"_b{i}"] for i in range(k)], dtype=float)
                ok = np.isfinite(a).all() and np.isfinite(b).all()
                beta = np.linalg.lstsq(a, b, rcond=None)[0] if ok else np.full(k, np.nan)
                for c, v in zip(out, beta, strict=True):
                    res[c].append(v)
            made = pdf[[*keys, "n_fit"]].copy()
            for c in out:
                made[c] = res[c]
            yield made

    return agg.mapInPandas(solve, schema)


def har_fit(train: DataFrame, keys: list[str]) -> DataFrame:
    """Pooled log-HAR regression of the forward log volatility, per key."""
    terms = _har_terms()
    rows = train.select(*keys, *[t.alias(f"_x{i}") for i, t in enumerate(terms)], F.col("label_logvol5").alias("_y"))
    rows = rows.dropna()
    return least_squares(rows, keys, [f"_x{i}" for i in range(4)], "_y", HAR_COLUMNS)


def har_predict(rows: DataFrame, fitted: DataFrame | None, keys: list[str]) -> DataFrame:
    """Add har_sigma in daily units; coefficients join per key or are already present."""
    if fitted is not None:
        rows = rows.join(F.broadcast(fitted.select(*keys, *HAR_COLUMNS)), keys)
    terms = _har_terms()
    total = F.col(HAR_COLUMNS[0]) * terms[0]
    for c, t in zip(HAR_COLUMNS[1:], terms[1:], strict=True):
        total = total + F.col(c) * t
    return rows.withColumn("har_sigma", F.exp(total)).drop(*HAR_COLUMNS)


MIN_POSITIVES = 10


def _pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> list[tuple]:
    """Pool adjacent violators of weighted means given in ascending score order."""
    pools: list[list[float]] = []
    for a, b, n, t in zip(lo, hi, w, s, strict=True):
        pools.append([a, b, n, t])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            top = pools.pop()
            pools[-1][1] = top[1]
            pools[-1][2] += top[2]
            pools[-1][3] += top[3]
    return [tuple(p) for p in pools]


def isotonic_pools(
    df: DataFrame, keys: list[str], score: str, label: str, blocks: int = 64
) -> DataFrame:
    """Isotonic regression of a 0/1 label on a score in [0, 1], per key.

    Rows are summed per distinct score, pooled in parallel inside blocks of about equally many scores,
    and the surviving pools (non-decreasing, hence few) merged per key. Pooling is
    order-free, so the result equals the one-pass fit. Keys with fewer than ten
    positives yield no rows: the caller's gate then stays open.
    """
    ok = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    levels = ok.groupBy(*keys, F.col(score).alias("lo")).agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.sum(label).cast("double").alias("s")
    )
    levels = with_value_blocks(levels, keys, "lo", blocks).withColumn("hi", F.col("lo"))
    key_fields = [levels.schema[k] for k in keys]
    d = T.DoubleType()
    pool_fields = [T.StructField(c, d) for c in ("lo", "hi", "w", "s")]
    schema = T.StructType([*key_fields, *pool_fields])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("lo")
        pools = _pool(p["lo"].to_numpy(), p["hi"].to_numpy(), p["w"].to_numpy(), p["s"].to_numpy())
        out = pd.DataFrame(pools, columns=["lo", "hi", "w", "s"])
        for k in reversed(keys):
            out.insert(0, k, p[k].iloc[0])
        return out

    inside = levels.groupBy(*keys, "_block").applyInPandas(merge, schema)
    whole = inside.groupBy(*keys).applyInPandas(merge, schema)
    enough = ok.groupBy(*keys).agg(F.sum(label).alias("_p")).where(F.col("_p") >= MIN_POSITIVES)
    return whole.join(enough.select(*keys), keys, "left_semi").select(
        *keys, "lo", "hi", "w", (F.col("s") / F.col("w")).alias("value")
    )


def isotonic_breakpoints(pools: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the (xs, ys) arrays that piecewise-linear interpolation reproduces the fit with."""
    ends = F.array_distinct(F.array(F.struct(F.col("lo").alias("x"), "value"), F.struct(F.col("hi").alias("x"), "value")))
    points = pools.select(*keys, F.explode(ends).alias("_p"))
    arr = points.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    return arr.select(
        *keys, F.transform("_ps", lambda p: p["x"]).alias("xs"), F.transform("_ps", lambda p: p["value"]).alias("ys")
    )


def linear_vol_forecast(
    train: DataFrame, rows: DataFrame, keys: list[str], features: list[str], label: str = "label_logvol5"
) -> DataFrame:
    """Ridge-free linear forecast of log volatility per key: adds sigma_hat."""
    t = train.where(F.col(label).isNotNull()).withColumn("_x0", num(1))
    xs = ["_x0", *features]
    names = [f"_beta{i}" for i in range(len(xs))]
    fitted = least_squares(t.select(*keys, *xs, label).dropna(), keys, xs, label, names)
    scored = rows.withColumn("_x0", num(1)).join(F.broadcast(fitted.drop("n_fit")), keys)
    total = num(0)
    for n, x in zip(names, xs, strict=True):
        total = total + F.col(n) * F.coalesce(F.col(x), num(0))
    return scored.withColumn("sigma_hat", F.exp(total)).drop("_x0", *names)


def _usable(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows with a number in every feature."""
    for c in features:
        x = F.col(c).cast("double")
        rows = rows.where(x.isNotNull() & ~F.isnan(x))
    return rows


def _score(features: list[str]) -> tuple[list[Column], Column]:
    """Standardised terms (the first is the constant) and the log odds, from the columns of a fit."""
    z = [num(1), *[(F.col(c).cast("double") - F.col("_mean")[j]) / F.col("_std")[j] for j, c in enumerate(features)]]
    odds = F.col("_beta")[0]
    for j, x in enumerate(z[1:], 1):
        odds = odds + F.col("_beta")[j] * x
    return z, odds


def _solve(state: dict, n: float, loss: float, grad: np.ndarray, hess: np.ndarray, reg: float, tol: float) -> None:
    """Next trial of one fit from the sums at its present one. A trial that raised the loss is halved."""
    beta = state["beta"]
    ridge = np.full(len(beta), reg)
    ridge[0] = 0.0
    value = loss / n + 0.5 * float(ridge @ (beta * beta))
    if state["from"] is not None and not value <= state["value"] + 1e-14 * abs(state["value"]) and state["halved"] < 40:
        state["step"] = state["step"] / 2
        state["halved"] += 1
        state["beta"] = state["from"] + state["step"]
        return
    slope = grad / n - ridge * beta
    state.update(value=value, halved=0, converged=bool(np.abs(slope).max() <= tol))
    if not state["converged"]:
        step = np.linalg.lstsq(hess / n + np.diag(ridge), slope, rcond=None)[0]
        state.update({"from": beta, "step": step, "beta": beta + step})


def logistic_fits(
    train: DataFrame, keys: list[str], features: list[str], label: str, reg: float = 1e-3, tol: float = 1e-12,
    max_steps: int = 60,
) -> DataFrame:
    """Ridge logistic regressions of a 0/1 label, one per key, all fitted together.

    Each Newton step is one job, whatever the number of keys: gradient, Hessian and loss are sums by key that combine
    before the shuffle, so what reaches the driver is one row of (features + 1)^2 numbers per key. Keys are folds and
    variants, not data. Features are standardised by the key's own rows; the ridge, on the standardised slopes, leaves
    the constant free. Keys that have converged take no further part. Rows without a label or a feature do not count; a
    constant feature gets slope 0; a key with one label only predicts that label.

    Returns per key (n_fit, steps, converged, _mean, _std, _beta), the constant first in ``_beta``.
    """
    spark = train.sparkSession
    rows = _usable(train.where(F.col(label).isNotNull()), features)
    path = scratch_path(spark, "logistic")
    rows.select(*keys, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]).write.parquet(path)
    rows = spark.read.parquet(path)
    spread = [f(F.col(c)) for c in features for f in (F.avg, F.stddev_samp)]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"), F.array(*spread).alias("spread"))
    fits: dict[tuple, dict] = {}
    for r in sizes.collect():  # one row per key
        mean, std = r["spread"][0::2], [s if s else 1.0 for s in r["spread"][1::2]]
        beta, rate = np.zeros(len(features) + 1), r["pos"] / r["n"]
        sure = rate in (0.0, 1.0)
        beta[0] = np.inf if rate == 1.0 else -np.inf if rate == 0.0 else np.log(rate / (1 - rate))
        fits[tuple(r[k] for k in keys)] = {
            "n": r["n"], "mean": mean, "std": std, "beta": beta, "converged": sure, "steps": 0,
            "from": None, "step": None, "value": None, "halved": 0}
    fields = T.StructType([rows.schema[k] for k in keys])
    for name in ("_mean", "_std", "_beta"):
        fields.add(name, T.ArrayType(T.DoubleType()))
    k = len(features) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    z, odds = _score(features)
    for _ in range(max_steps):
        open_fits = {key: f for key, f in fits.items() if not f["converged"]}
        if not open_fits:
            break
        trial = [(*key, f["mean"], f["std"], [float(b) for b in f["beta"]]) for key, f in open_fits.items()]
        at = rows.join(F.broadcast(spark.createDataFrame(trial, fields)), keys)  # one row per key
        at = at.select(*keys, "_y", odds.alias("_odds"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
        at = at.withColumn("_p", num(1) / (num(1) + F.exp(-F.col("_odds"))))
        loss = F.greatest(F.col("_odds"), num(0)) - F.col("_y") * F.col("_odds") + F.log1p(F.exp(-F.abs("_odds")))
        sums = at.groupBy(*keys).agg(
            F.sum(loss).alias("loss"),
            F.array(*[F.sum((F.col("_y") - F.col("_p")) * F.col(f"_z{i}")) for i in range(k)]).alias("grad"),
            F.array(*[F.sum(F.col("_p") * (num(1) - F.col("_p")) * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs]).alias("hess"))
        for r in sums.collect():  # one row per key
            f = fits[tuple(r[c] for c in keys)]
            hess = np.zeros((k, k))
            for (i, j), v in zip(pairs, r["hess"], strict=True):
                hess[i, j] = hess[j, i] = v
            f["steps"] += 1
            _solve(f, f["n"], r["loss"], np.array(r["grad"]), hess, reg, tol)
    out = T.StructType([*fields.fields[:len(keys)], T.StructField("n_fit", T.LongType()), T.StructField("steps", T.LongType()),
                        T.StructField("converged", T.BooleanType()), *fields.fields[len(keys):]])
    made = [(*key, f["n"], f["steps"], f["converged"], f["mean"], f["std"], [float(b) for b in f["beta"]]) for key, f in fits.items()]
    return spark.createDataFrame(made, out)


def logistic_scores(rows: DataFrame, fits: DataFrame, keys: list[str], features: list[str], out: str) -> DataFrame:
    """Rows of the fitted keys with their probability; rows without a feature are left out, as in the fit."""
    _, odds = _score(features)
    models = F.broadcast(fits.select(*keys, "_mean", "_std", "_beta"))  # one row per key
    scored = _usable(rows, features).join(models, keys)
    return scored.withColumn(out, num(1) / (num(1) + F.exp(-odds))).drop("_mean", "_std", "_beta")


def score_equations(
    train: DataFrame, fits: DataFrame, keys: list[str], features: list[str], label: str, reg: float = 1e-3
) -> DataFrame:
    """Left sides of the fit's score equations: per key ``eq_0`` and ``eq_<feature>``.

    At the optimum the mean of p times a standardised term, plus the ridge's share, equals the mean of the label times
    that term. The problem is strictly convex, so the equations hold for no other coefficients.
    """
    z, odds = _score(features)
    models = F.broadcast(fits.select(*keys, "_mean", "_std", "_beta"))  # one row per key
    rows = _usable(train.where(F.col(label).isNotNull()), features).join(models, keys)
    p = num(1) / (num(1) + F.exp(-odds))
    eqs = [F.avg(p).alias("eq_0")]
    eqs += [(F.avg(p * z[j]) + num(reg) * F.first("_beta")[j]).alias(f"eq_{c}") for j, c in enumerate(features, 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fit"), *eqs)
