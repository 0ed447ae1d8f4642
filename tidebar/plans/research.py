"""The research suite: one job over all symbols and families of a market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.operators import metrics
from tidebar.plans import grids
from tidebar.plans.backtest import run
from tidebar.plans.signals import buy_and_hold
from tidebar.plans.walkforward import MIN_TEST_BARS, TEST_BARS, TRAIN_BARS, walk_forward

GATE_DSR = 0.95


def trial_sharpes(returns: DataFrame, keys: list[str]) -> DataFrame:
    return returns.groupBy(*keys, "params", "grid_order").agg(metrics.sharpe_pp("net").alias("sr"))


def _dsr_by_family(m: DataFrame, variance: str, out: str) -> DataFrame:
    """Deflated Sharpe where the trial count is the family's grid size."""
    from tidebar.functions.normal import expected_max_factor, normal_cdf

    factor = num(0)
    for fam, n in grids.FAMILY_SIZES.items():
        factor = F.when(F.col("family") == fam, num(expected_max_factor(n))).otherwise(factor)
    sr, n = F.col("sr"), F.col("n")
    sr0 = F.sqrt(F.greatest(F.col(variance), num(0))) * factor
    inner = num(1) - F.col("skew") * sr + (F.col("ex_kurt") + num(2)) / num(4) * sr * sr
    z = (sr - sr0) * F.sqrt((n - 1).cast("double")) / F.sqrt(F.greatest(inner, num(1e-12)))
    return m.withColumn(out, F.when(n < 20, num(0)).otherwise(normal_cdf(z)))


def market_table(
    bars: DataFrame,
    returns: DataFrame,
    fee_bps: float = 10.0,
    train: int = TRAIN_BARS,
    test: int = TEST_BARS,
    min_test: int = MIN_TEST_BARS,
) -> DataFrame:
    """Per (symbol, family): full-sample best, out-of-sample statistics, DSR, PBO,
    parameter ensemble, buy and hold, DSR over all trials, and the family gate.

    ``returns`` is the long trials table, read by several branches: persist or
    write it before calling on a large universe.
    """
    k = ["symbol", "family"]
    oos, ledger = walk_forward(returns, k, train=train, test=test, min_test=min_test)
    trials = trial_sharpes(returns, k)
    root = F.sqrt(num(365))
    best = trials.groupBy(*k).agg((F.max("sr") * root).alias("full_best_sharpe"))
    var_family = metrics.trial_variance(trials, k).select(*k, F.col("sr_variance").alias("_vf"))
    var_all = metrics.trial_variance(trials, ["symbol"]).select("symbol", F.col("sr_variance").alias("_va"))
    stats = metrics.summary(oos, k, "ts").select(
        *k, F.col("sharpe").alias("oos_sharpe"), F.col("cagr_pct").alias("oos_cagr_pct"),
        F.col("max_dd_pct").alias("oos_max_dd_pct"), F.col("n_bars").alias("n_oos"),
    )
    m = metrics.moments(oos, k).join(var_family, k).join(var_all, "symbol")
    m = _dsr_by_family(m, "_vf", "dsr")
    m = metrics.deflated_sharpe(m, grids.TOTAL_TRIALS, "_va", "dsr_all").select(*k, "dsr", "dsr_all")
    pbo = metrics.pbo(returns, k, "params", "grid_order", "ts", "net").select(*k, "pbo")
    deployed = ledger.groupBy(*k).agg(F.avg(F.col("deployed").cast("double")).alias("deployed_frac"))
    days = oos.select(*k, "ts")
    ens = returns.groupBy(*k, "ts").agg(F.avg("net").alias("net")).join(days, [*k, "ts"], "left_semi")
    ens_stats = metrics.summary(ens, k, "ts").select(
        *k, F.col("sharpe").alias("ens_oos_sharpe"), F.col("max_dd_pct").alias("ens_oos_max_dd_pct")
    )
    hold = run(bars, buy_and_hold(bars), fee_bps=fee_bps).select("symbol", "ts", F.col("net").alias("_bh"))
    bh = days.join(hold, ["symbol", "ts"]).groupBy(*k).agg(metrics.sharpe("_bh").alias("bh_oos_sharpe"))
    out = best
    for part in (stats, m, pbo, deployed, ens_stats, bh):
        out = out.join(part, k)
    gate = (F.col("oos_sharpe") > 0) & (F.col("dsr") >= GATE_DSR)
    return out.withColumn("family_gate", gate)


def family_portfolios(returns: DataFrame, warm_up: int = TRAIN_BARS, oos: DataFrame | None = None) -> DataFrame:
    """Daily equal-weight portfolio of each family's parameter ensemble, complete dates only.

    With ``oos`` the dates of each (symbol, family) are its walk-forward test
    dates; otherwise each series drops its first ``warm_up`` bars.
    """
    ens = returns.groupBy("symbol", "family", "ts").agg(F.avg("net").alias("net"))
    if oos is not None:
        ens = ens.join(oos.select("symbol", "family", "ts"), ["symbol", "family", "ts"], "left_semi")
    else:
        w = W.partitionBy("symbol", "family").orderBy("ts")
        ens = ens.withColumn("_i", F.row_number().over(w)).where(F.col("_i") > warm_up).drop("_i")
    return _complete(ens, ["family"])


def _complete(legs: DataFrame, keys: list[str]) -> DataFrame:
    n = legs.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_n"))
    per = legs.groupBy(*keys, "ts").agg(F.avg("net").alias("net"), F.count("net").alias("_c"))
    return per.crossJoin(F.broadcast(n)).where("_c = _n").drop("_c", "_n")


def trial_portfolios(returns: DataFrame, warm_up: int = TRAIN_BARS) -> DataFrame:
    """Equal-weight portfolio of every (family, params) after the warm-up."""
    w = W.partitionBy("symbol", "family", "params").orderBy("ts")
    cut = returns.withColumn("_i", F.row_number().over(w)).where(F.col("_i") > warm_up)
    return _complete(cut, ["family", "params", "grid_order"])


def portfolio_table(returns: DataFrame, warm_up: int = TRAIN_BARS, oos: DataFrame | None = None) -> DataFrame:
    """Family portfolios with the two-tier Deflated Sharpe correction (4 and 32 trials)."""
    fam = family_portfolios(returns, warm_up, oos)
    m = metrics.moments(fam, ["family"])
    v4 = metrics.trial_variance(m, []).select(F.col("sr_variance").alias("_v4"))
    trials = trial_portfolios(returns, warm_up).groupBy("family", "params").agg(metrics.sharpe_pp("net").alias("sr"))
    v32 = metrics.trial_variance(trials, []).select(F.col("sr_variance").alias("_v32"))
    j = m.crossJoin(F.broadcast(v4)).crossJoin(F.broadcast(v32))
    j = metrics.deflated_sharpe(j, len(grids.FAMILY_SIZES), "_v4", "dsr_n4")
    j = metrics.deflated_sharpe(j, grids.TOTAL_TRIALS, "_v32", "dsr_n32").select("family", "dsr_n4", "dsr_n32")
    return metrics.summary(fam, ["family"], "ts").join(j, "family")
