"""Risk overlay: forecasts to multipliers to held weights to net returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import clip, num, risk_multiplier
from tidebar.functions.times import plus_days
from tidebar.operators import metrics, models
from tidebar.operators import windows as win
from tidebar.operators.aggregates import sigma_floor, sigma_reference
from tidebar.operators.blocks import quantiles
from tidebar.operators.bootstrap import paired_test
from tidebar.operators.selection import last_n
from tidebar.operators.sets import upsert_first
from tidebar.plans.backtest import account, bar_inputs
from tidebar.plans.features import schema_hash
from tidebar.plans.signals import positions

REBALANCE_THRESHOLD = 0.02
VIX_QUANTILE, VIX_MIN_ROWS = 0.90, 100


def fold_constants(tagged: DataFrame) -> DataFrame:
    """Per fold, from training rows with a label: sigma_ref, sigma_floor and the VIX threshold."""
    train = tagged.where((F.col("split") == "train") & F.col("label_logvol5").isNotNull())
    vix = F.when(F.col("m_vix") == 1, F.col("x_vix_log"))
    gate = quantiles(train, ["fold"], vix, {"_q": VIX_QUANTILE}).select(
        "fold", F.when(F.col("n_values") >= VIX_MIN_ROWS, F.col("_q")).alias("vix_limit")
    )
    base = sigma_reference(train, ["fold"]).join(sigma_floor(train, ["fold"]), "fold")
    return base.join(gate, "fold", "left")


def baseline_forecasts(tagged: DataFrame, with_har: bool = True) -> DataFrame:
    """B1 (trailing sigma), B2 (HAR regression) and B3 (trailing sigma with stress gate).

    ``tagged`` is the feature table with (fold, split). All folds and variants
    come from one test scan crossed with three variant rows.
    """
    const = fold_constants(tagged)
    test = tagged.where((F.col("split") == "test") & F.col("c_ret252_n").isNotNull())
    rows = test.join(F.broadcast(const), "fold")
    none = F.lit(None).cast("double")
    hot = (F.col("m_vix") == 1) & (F.col("x_vix_log") > F.col("vix_limit"))
    gate = F.when(hot, num(0.5)).otherwise(num(1))
    base = risk_multiplier("c_sigma20d", "sigma_ref", none)

    def entry(variant: str, sigma: Column, mult: Column) -> Column:
        return F.struct(F.lit(variant).alias("variant"), sigma.alias("sigma_hat"), mult.alias("multiplier"))

    entries = [entry("B1", F.col("c_sigma20d"), base), entry("B3", F.col("c_sigma20d"), base * gate)]
    if with_har:
        train = tagged.where((F.col("split") == "train") & F.col("label_logvol5").isNotNull())
        rows = models.har_predict(rows, models.har_fit(train, ["fold"]), ["fold"])
        entries.insert(1, entry("B2", F.col("har_sigma"), risk_multiplier("har_sigma", "sigma_ref", none)))
    out = rows.select("fold", "decision_ts", "symbol", "sigma_floor", F.explode(F.array(*entries)).alias("_e"))
    return out.select(
        "_e.variant", "fold", "decision_ts", "symbol", "_e.sigma_hat",
        none.alias("p_tail_cal"), "_e.multiplier", "sigma_floor",
    )


def base_weights(bars: DataFrame) -> DataFrame:
    """Donchian parameter-ensemble weight in [0, 1] per (symbol, ts)."""
    pos = positions(bars, ["donchian"])
    return pos.groupBy("symbol", "ts").agg(F.avg("pos").alias("weight"))


def overlay_targets(weights: DataFrame, preds: DataFrame, with_base: bool = True) -> DataFrame:
    """Weight times multiplier for every variant; rows without a forecast keep weight.

    Variant 'B0' is the weight without overlay.
    """
    variants = preds.select("variant").distinct()
    if with_base:
        variants = variants.unionByName(
            variants.sparkSession.createDataFrame([("B0",)], "variant string")
        )
    spread = weights.crossJoin(F.broadcast(variants))
    mult = preds.select("variant", "symbol", plus_days("decision_ts", -1).alias("ts"), "multiplier")
    j = spread.join(mult, ["variant", "symbol", "ts"], "left")
    target = clip(F.col("weight") * F.coalesce("multiplier", num(1)), 0, 1)
    return j.select("variant", "symbol", "ts", "weight", target.alias("target"))


def overlay_legs(
    bars: DataFrame, preds: DataFrame, fee_bps: float = 10.0, floor_bps: float = 1.0, fill_ahead: bool = False
) -> DataFrame:
    """Net return per (variant, symbol, ts) after threshold and costs."""
    targets = overlay_targets(base_weights(bars), preds)
    held = win.hysteresis(
        targets.select("variant", "symbol", "ts", "target"), ["variant", "symbol"], "ts", "target", "pos",
        REBALANCE_THRESHOLD,
    )
    inputs = bar_inputs(bars, fill_ahead=fill_ahead).select("symbol", "ts", "ret", "daily_vol", "dollar_volume")
    return account(held.join(inputs, ["symbol", "ts"]), ["variant", "symbol"], fee_bps, floor_bps)


def oos_dates(preds: DataFrame) -> DataFrame:
    return preds.select(plus_days("decision_ts", -1).alias("ts")).distinct()


def overlay_portfolio(legs: DataFrame, preds: DataFrame) -> DataFrame:
    """Equal-weight net per (variant, ts) on the out-of-sample dates, skipping absent legs."""
    inside = legs.join(F.broadcast(oos_dates(preds)), "ts", "left_semi")
    return inside.groupBy("variant", "ts").agg(F.avg("net").alias("net"))


def per_symbol_gain(legs: DataFrame, preds: DataFrame, base: str = "B0") -> DataFrame:
    """Sharpe of each variant's leg minus the base variant's leg, per symbol."""
    inside = legs.join(F.broadcast(oos_dates(preds)), "ts", "left_semi")
    sr = inside.groupBy("variant", "symbol").agg(metrics.sharpe("net").alias("sharpe"))
    ref = sr.where(F.col("variant") == base).select("symbol", F.col("sharpe").alias("_base"))
    out = sr.where(F.col("variant") != base).join(ref, "symbol")
    return out.select("variant", "symbol", (F.col("sharpe") - F.col("_base")).alias("sharpe_diff"))


def fold_increments(port: DataFrame, preds: DataFrame, base: str = "B0") -> DataFrame:
    """Mean daily gain over the base by (variant, fold)."""
    ref = port.where(F.col("variant") == base).select("ts", F.col("net").alias("_base"))
    diff = port.where(F.col("variant") != base).join(ref, "ts")
    days = preds.select("variant", "fold", plus_days("decision_ts", -1).alias("ts")).distinct()
    return (
        diff.join(days, ["variant", "ts"])
        .groupBy("variant", "fold").agg(F.avg(F.col("net") - F.col("_base")).alias("increment"))
    )


def increment_summary(port: DataFrame, preds: DataFrame, base: str = "B0") -> DataFrame:
    """Positive folds, folds, best fold, and the Sharpe gap with the best fold removed."""
    inc = fold_increments(port, preds, base)
    top = inc.groupBy("variant").agg(
        F.count_if(F.col("increment") > 0).alias("folds_positive"),
        F.count(F.lit(1)).alias("folds_total"),
        F.max_by("fold", F.struct("increment", -F.col("fold"))).alias("best_fold"),
    )
    days = preds.select("variant", "fold", plus_days("decision_ts", -1).alias("ts")).distinct()
    drop = days.join(top.select("variant", F.col("best_fold").alias("fold")), ["variant", "fold"])
    ref = port.where(F.col("variant") == base).select("ts", F.col("net").alias("_base"))
    kept = (
        port.where(F.col("variant") != base).join(ref, "ts", "full")
        .join(drop.select("variant", "ts"), ["variant", "ts"], "left_anti")
    )
    gap = kept.groupBy("variant").agg(
        (metrics.sharpe("net") - metrics.sharpe("_base")).alias("sharpe_gap_wo_best")
    )
    return top.join(gap, "variant")


def gate_stats(legs: DataFrame, preds: DataFrame, n_trials: int, base: str = "B0", baselines: str = "B") -> DataFrame:
    """What the overlay gate compares, one row per variant but the base.

    ``n_trials`` deflates the Sharpe ratio with the variance over the variants; the best of the variants whose name
    starts with ``baselines``, the base aside, is the baseline. Under stress every cost is paid twice. gain_p is the
    share of paired bootstrap draws in which a variant's Sharpe ratio is not above the base's.
    """
    port = overlay_portfolio(legs, preds)
    s = metrics.summary(port, ["variant"], "ts")
    var = metrics.trial_variance(port.groupBy("variant").agg(metrics.sharpe_pp("net").alias("sr")), [])
    deflated = metrics.deflated_sharpe(metrics.moments(port, ["variant"]).crossJoin(F.broadcast(var)), n_trials, "sr_variance")
    paid_twice = overlay_portfolio(legs.withColumn("net", F.col("net") - F.col("cost")), preds)
    stress = paid_twice.groupBy("variant").agg(metrics.sharpe("net").alias("stress_sharpe"))
    mine = s.select("variant", "sharpe", "cagr_pct", "max_dd_pct").join(deflated.select("variant", "dsr"), "variant")
    mine = mine.join(stress, "variant").join(increment_summary(port, preds, base), "variant")
    is_base = F.col("variant") == base
    refs = s.agg(  # one row
        *[F.max(F.when(is_base, F.col(c))).alias(f"base_{c}") for c in ("sharpe", "cagr_pct", "max_dd_pct")],
        F.max(F.when(~is_base & F.startswith("variant", F.lit(baselines)), F.col("sharpe"))).alias("baseline_sharpe"),
    )
    base_net = port.where(is_base).select("ts", F.col("net").alias("b"))
    pairs = port.where(~is_base).select("variant", "ts", F.col("net").alias("a")).join(base_net, "ts")
    gain = paired_test(pairs, ["variant"], "ts", "a", "b").select("variant", F.col("sharpe_p").alias("gain_p"))
    return mine.crossJoin(F.broadcast(refs)).join(gain, "variant", "left")


def decision_log(
    table: DataFrame,
    weights: DataFrame,
    har: DataFrame,
    sigma_ref: float,
    logged: DataFrame | None = None,
) -> DataFrame:
    """Latest B1/B2 multipliers with the base weight of the same decision, first write wins."""
    latest = last_n(table, ["symbol"], ["decision_ts"], 1)
    fitted = models.har_predict(latest.crossJoin(F.broadcast(har)), None, [])
    none = F.lit(None).cast("double")
    entries = F.array(
        *[
            F.struct(
                F.lit(v).alias("variant"), F.col(c).alias("sigma_hat"),
                risk_multiplier(c, num(sigma_ref), none).alias("multiplier"),
            )
            for v, c in (("B1", "c_sigma20d"), ("B2", "har_sigma"))
        ]
    )
    rows = fitted.select("decision_ts", "symbol", F.explode(entries).alias("_e"))
    rows = rows.select("decision_ts", "symbol", "_e.*")
    base = weights.select("symbol", plus_days("ts", 1).alias("decision_ts"), F.col("weight").alias("base_weight"))
    out = rows.join(base, ["symbol", "decision_ts"], "left")
    out = out.withColumn("shadow_weight", clip(F.col("base_weight") * F.col("multiplier"), 0, 1))
    out = out.withColumn("schema_hash", F.lit(schema_hash()))
    keys = ["decision_ts", "symbol", "variant"]
    return out if logged is None else upsert_first(logged, out, keys)
