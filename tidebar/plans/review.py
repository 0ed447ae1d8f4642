"""Reviews of running books: status, model comparison, baselines, verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import num
from tidebar.operators import metrics
from tidebar.operators import windows as win
from tidebar.operators.selection import last_n


def book_status(equity: DataFrame, cash: DataFrame, positions: DataFrame, keys: list[str], capital: float) -> DataFrame:
    """Latest equity, return since start, cash and open positions per book."""
    last = equity.groupBy(*keys).agg(
        F.max("day").alias("as_of"), F.max_by("equity", "day").alias("equity")
    )
    # positions per book are bounded by the symbols traded, already netted
    held = positions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.array_sort(F.collect_list(F.struct("symbol", "qty"))).alias("positions"),
    )
    out = last.join(cash, keys).join(held, keys, "left")
    ret = num(100) * (F.col("equity") / num(capital) - num(1))
    return out.select(
        *keys, "as_of", "equity", ret.alias("return_pct"), "cash",
        F.coalesce("n_positions", F.lit(0)).alias("n_positions"), "positions",
    )


def last_trades(trades: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return last_n(trades, keys, order, n)


def paper_returns(settled: DataFrame, keys: list[str], capital: float, start: Column | None = None) -> DataFrame:
    """Daily returns of settled equity, the first one against the start capital."""
    w = win.series(*keys, order="day")
    prev = F.coalesce(F.lag("equity").over(w), num(capital))
    return settled.select(*keys, "day", (F.try_divide(F.col("equity"), prev) - num(1)).alias("ret"))


def compare_to_model(paper: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative returns, tracking error and Sharpe ratios; absent model days count as 0."""
    on = [*keys, "day"]
    j = paper.join(model.select(*on, F.col("net").alias("_m")), on, "left")
    j = j.withColumn("model", F.coalesce("_m", num(0)))
    diff = F.col("ret") - F.col("model")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.product(num(1) + F.col("ret")) - num(1)).alias("cum_paper"),
        (F.product(num(1) + F.col("model")) - num(1)).alias("cum_model"),
        F.when(F.count(F.lit(1)) > 2, F.stddev_samp(diff) * F.sqrt(num(365))).alias("te_ann"),
        metrics.sharpe("ret").alias("sharpe_paper"),
        metrics.sharpe("model").alias("sharpe_model"),
    )


def band_flags(review: DataFrame, band: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the cumulative paper return lies inside the 80% and 95% bands."""
    j = review.join(band, keys) if keys else review.crossJoin(band)
    return j.withColumns(
        {
            "in_band80": F.col("cum_paper").between(F.col("p10"), F.col("p90")),
            "in_band95": F.col("cum_paper").between(F.col("p2_5"), F.col("p97_5")),
        }
    )


def baseline_meta(returns: DataFrame, keys: list[str], value: str = "net", ts: str = "ts") -> DataFrame:
    g = returns.groupBy(*keys) if keys else returns.groupBy()
    return g.agg(
        F.count(value).alias("n_days"), F.min(ts).alias("first_day"), F.max(ts).alias("last_day"),
        F.avg(value).alias("mu_d"), F.stddev_samp(value).alias("sd_d"),
    )


def freeze_baseline(returns: DataFrame, path: str, force: bool = False) -> None:
    """Write the baseline once. A second freeze fails unless forced."""
    returns.write.mode("overwrite" if force else "errorifexists").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def verdict(checks: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Named boolean columns to one row per check, and whether all known ones pass."""
    long = checks.select(*keys, *names).unpivot(keys, names, "check", "passed")
    alls = long.groupBy(*keys).agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_pass"),
        F.count("passed").alias("n_known"), F.count_if("passed").alias("n_passed"),
    )
    return long.join(alls, keys)


# Fixed values of the overlay gate: metric, comparison, factor, and what the factor multiplies (None: 1). Sizes of
# drawdowns count, not signs. A condition without both sides is unknown; one with a guard holds where the guard fails.
OVERLAY_GATE = {
    "sharpe_above_base": ("sharpe", ">", 1.0, "base_sharpe", None),
    "sharpe_above_best_baseline": ("sharpe", ">", 1.0, "baseline_sharpe", None),
    "gain_significant": ("gain_p", "<", 0.05, None, None),
    "deflated_sharpe": ("dsr", ">=", 0.95, None, None),
    "drawdown": ("abs(max_dd_pct)", "<=", 0.85, "abs(base_max_dd_pct)", None),
    "growth": ("cagr_pct", ">=", 0.8, "base_cagr_pct", "base_cagr_pct > 0"),
    "folds": ("folds_positive", ">=", 0.7, "greatest(folds_total, 1)", None),
    "double_costs": ("stress_sharpe", ">", 0.0, None, None),
    "without_best_fold": ("sharpe_gap_wo_best", ">", 0.0, None, None),
}
# A variant that has to beat a simpler one of its kind.
OVERLAY_LADDER = {"E3": "E1", "E4": "E3"}


def gate_condition(metric: str, cmp: str, factor: float, of: str | None, guard: str | None) -> Column:
    """One line of the gate table as a boolean column."""
    bound = f"{factor}D * {of}" if of else f"{factor}D"
    held = F.expr(f"{metric} {cmp} {bound}")
    return held if guard is None else F.when(F.expr(guard), held).otherwise(F.lit(True))


def overlay_gate(stats: DataFrame, ladder: dict[str, str] = OVERLAY_LADDER) -> DataFrame:
    """Overlay gate in long form: variant, check, passed, and per variant all_pass, n_known, n_passed.

    ``stats`` has one row per variant with the columns of ``OVERLAY_GATE``; a null metric leaves its check unknown.
    ``ladder`` maps a variant to the simpler one it has to beat: those checks, where both are there, are listed with
    null counts, since they do not decide whether a variant passes.
    """
    made = stats.select("variant", *[gate_condition(*line).alias(name) for name, line in OVERLAY_GATE.items()])
    out = verdict(made, ["variant"], list(OVERLAY_GATE))
    if not ladder:
        return out
    pairs = F.map_from_arrays(F.array(*map(F.lit, ladder)), F.array(*map(F.lit, ladder.values())))
    mine = stats.select("variant", "sharpe", F.try_element_at(pairs, F.col("variant")).alias("_rival"))
    rival = stats.select(F.col("variant").alias("_rival"), F.col("sharpe").alias("_s"))
    steps = mine.join(rival, "_rival").select(
        "variant", F.concat(F.lit("sharpe_above_"), "_rival").alias("check"), (F.col("sharpe") > F.col("_s")).alias("passed")
    )
    return out.unionByName(steps, allowMissingColumns=True)
