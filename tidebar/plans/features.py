"""Cross-asset feature table: one row per (decision time, symbol).

Session features are computed on the session grid first and joined as-of by
availability afterwards, so a closed market never creates a new observation.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import div, num
from tidebar.functions.times import plus_days, staleness_days
from tidebar.operators import windows as win
from tidebar.operators.joins import asof_many
from tidebar.operators.rolling import Roll, rolling_many
from tidebar.session import cut_lineage

SCHEMA_VERSION = "xa-dl-v1"

# Column names of the table, in order.
CRYPTO = [
    "c_ret1_n", "c_ret5_n", "c_ret21_n", "c_ret63_n", "c_ret126_n", "c_ret252_n",
    "c_vol5", "c_vol20", "c_vol22", "c_vol60",
    "c_range", "c_volz20", "c_dch_high55", "c_dch_low20", "c_ma20", "c_ma100",
    "c_fund_d", "c_fund_m21",
]
EQUITY = [
    "x_spy_ret1", "x_spy_ret5", "x_spy_ret20", "x_spy_vol20", "x_spy_dd20", "x_spy_dd60",
    "x_spy_ma20", "x_spy_ma100", "x_qqq_spy_spread20",
    "x_corr20_btc_spy", "x_corr60_btc_spy", "x_beta60_btc_spy", "x_spy_closed", "x_spy_days_since",
]
VIX = [
    "x_vix_log", "x_vix_chg1", "x_vix_chg5", "x_vix_pctile", "x_vix_ma20", "x_stress", "x_vix_days_since",
]
GLD = [
    "x_gld_ret1", "x_gld_ret5", "x_gld_ret20", "x_gld_vol20", "x_gld_dd20", "x_gld_dd60",
    "x_gld_ma20", "x_gld_ma100", "x_gld_closed", "x_gld_days_since",
]
MASKS = ["m_fund", "m_equity", "m_vix", "m_gld"]
LABELS = ["label_logvol5", "label_minz5"]
META = [
    "decision_ts", "bar_date", "symbol", "c_sigma20d",
    "prov_spy_session", "prov_vix_session", "prov_gld_session",
]
ALL_FEATURES = CRYPTO + EQUITY + VIX + GLD
GROUPS = {"equity": (EQUITY, "m_equity"), "vix": (VIX, "m_vix"), "gld": (GLD, "m_gld")}
STALE_LIMIT_DAYS = 5.5

# Groups kept by each ablation variant.
VARIANTS = [
    ("E1", False, False, False), ("E2", True, False, False), ("E3", True, True, False), ("E4", True, True, True),
]


def schema_hash() -> str:
    payload = {"version": SCHEMA_VERSION, "features": ALL_FEATURES, "masks": MASKS, "labels": LABELS}
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:16]


def crypto_features(bars: DataFrame, funding: DataFrame | None = None) -> DataFrame:
    """Per-symbol bar features and forward labels, keyed by (symbol, ts)."""
    w = win.series("symbol")
    base = bars.select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")])
    if funding is not None:
        base = base.join(funding.select("symbol", "ts", F.col("funding").cast("double").alias("_f")), ["symbol", "ts"], "left")
    else:
        base = base.withColumn("_f", F.lit(None).cast("double"))
    base = base.withColumns({"_p": F.ln("close"), "lr": win.log_diff("close", w)})
    horizons, vols = (1, 5, 21, 63, 126, 252), (5, 20, 22, 60)
    made = rolling_many(base, ["symbol"], "ts", {
        "c_sigma20d": Roll("std", "lr", 20), **{f"_sum{h}": Roll("sum", "lr", h) for h in horizons},
        **{f"_std{n}": Roll("std", "lr", n) for n in vols}, **{f"_move{h}": Roll("change", "_p", h) for h in horizons},
        "_v20": Roll("mean", "volume", 20), "_vs20": Roll("std", "volume", 20), "_hi55": Roll("max", "close", 55),
        "_lo20": Roll("min", "close", 20), "_ma20": Roll("mean", "close", 20), "_ma100": Roll("mean", "close", 100),
        "_f21": Roll("mean", "_f", 21, 10),
    })
    c, sigma = F.col("close"), F.col("c_sigma20d")
    out = {}
    for h in horizons:
        # the sum says whether all returns are known; its value is one difference of log prices
        total = F.when(F.col(f"_sum{h}").isNotNull(), F.col(f"_move{h}"))
        out[f"c_ret{h}_n"] = div(total, F.nullif(sigma * F.sqrt(num(h)), num(0)))
    for n in vols:
        out[f"c_vol{n}"] = F.col(f"_std{n}") * F.sqrt(num(365))
    out["c_range"] = div(F.col("high") - F.col("low"), c)
    out["c_volz20"] = div(F.col("volume") - F.col("_v20"), F.nullif(F.col("_vs20"), num(0)))
    out["c_dch_high55"], out["c_dch_low20"] = div(c, F.col("_hi55")) - 1, div(c, F.col("_lo20")) - 1
    out["c_ma20"], out["c_ma100"] = div(c, F.col("_ma20")) - 1, div(c, F.col("_ma100")) - 1
    out["c_fund_d"], out["c_fund_m21"] = F.coalesce("_f", num(0)), F.coalesce("_f21", num(0))
    out["m_fund"] = F.col("_f").isNotNull().cast("double")
    out["label_logvol5"] = win.forward_log_vol("lr", w)
    out["label_minz5"] = win.forward_min_z(F.col("_p"), "c_sigma20d", w)
    return made.select(
        plus_days("ts", 1).alias("decision_ts"), F.col("ts").alias("bar_date"), "symbol", "c_sigma20d",
        *[x.alias(n) for n, x in out.items()],
    )


def session_features(sessions: DataFrame, roles: dict[str, str], lead_bars: DataFrame) -> DataFrame:
    """Measures of the sessions of all roles in one pass, staged: (role, session_date, available_at, bar_end, lr, ...).

    The lead asset's return of the session's date rides along, for correlations with it.
    """
    lead = lead_bars.select(F.col("ts").cast("date").alias("session_date"), win.log_diff("close", win.series("symbol")).alias("lead"), F.lit(True).alias("lead_there"))
    role = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s).alias("symbol")) for r, s in roles.items()])
    dim = F.explode(F.filter(role, lambda x: x["symbol"] == F.col("symbol")))
    rows = sessions.select(dim.alias("_r"), "session_date", "available_at", "bar_end", F.col("close").cast("double").alias("close"))
    rows = rows.select("_r.role", "session_date", "available_at", "bar_end", "close", F.ln("close").alias("p"))
    rows = rows.withColumn("lr", win.log_diff("close", win.series("role", order="session_date")))
    rows = rows.join(lead, "session_date", "left")
    return cut_lineage(rolling_many(rows, ["role"], "session_date", {
        "ret5": Roll("sum", "lr", 5), "ret20": Roll("sum", "lr", 20), "std20": Roll("std", "lr", 20), "hi20": Roll("max", "close", 20),
        "hi60": Roll("max", "close", 60), "m20": Roll("mean", "close", 20), "m100": Roll("mean", "close", 100), "chg5": Roll("change", "p", 5),
        "pctile": Roll("rank", "close", 1, 60),
    }))


def etf_features(rows: DataFrame, prefix: str) -> DataFrame:
    c = F.col("close")
    return rows.select(
        "session_date", "available_at", "bar_end", "lead", F.col("lr").alias(f"{prefix}_ret1"),
        F.col("ret5").alias(f"{prefix}_ret5"), F.col("ret20").alias(f"{prefix}_ret20"),
        (F.col("std20") * F.sqrt(num(252))).alias(f"{prefix}_vol20"),
        (div(c, F.col("hi20")) - 1).alias(f"{prefix}_dd20"), (div(c, F.col("hi60")) - 1).alias(f"{prefix}_dd60"),
        (div(c, F.col("m20")) - 1).alias(f"{prefix}_ma20"), (div(c, F.col("m100")) - 1).alias(f"{prefix}_ma100"),
    )


def vix_features(rows: DataFrame) -> DataFrame:
    return rows.select(
        "session_date", "available_at", "bar_end", F.col("p").alias("x_vix_log"), F.col("lr").alias("x_vix_chg1"),
        F.col("chg5").alias("x_vix_chg5"), F.col("pctile").alias("x_vix_pctile"),
        (div(F.col("close"), F.col("m20")) - 1).alias("x_vix_ma20"),
    )


def correlation_features(spy: DataFrame) -> DataFrame:
    """Rolling correlation and beta of the lead asset with the equity index, over the sessions that the lead asset has.

    The lead asset's same-date close is final only at the next midnight, so these
    values become available then.
    """
    j = spy.select(F.lit(1).alias("one"), "session_date", "x_spy_ret1", "lead")
    made = rolling_many(j, ["one"], "session_date", {
        "x_corr20_btc_spy": Roll("corr", "lead", 20, y="x_spy_ret1"), "x_corr60_btc_spy": Roll("corr", "lead", 60, y="x_spy_ret1"),
        "x_beta60_btc_spy": Roll("beta", "lead", 60, y="x_spy_ret1"),
    })
    return made.withColumn("available_at", plus_days(F.col("session_date").cast("timestamp"), 1))


def feature_table(
    bars: DataFrame,
    sessions: DataFrame,
    funding: DataFrame | None,
    lead_symbol: str,
    roles: dict[str, str],
) -> DataFrame:
    """The full table. ``roles`` maps spy/qqq/gld/vix to session symbols; a missing
    role leaves its group empty and masked, never invented."""
    base = crypto_features(bars, funding)

    done = session_features(sessions, roles, bars.where(F.col("symbol") == lead_symbol))
    spy, qqq, gld = (etf_features(done.where(F.col("role") == r), f"x_{r}") for r in ("spy", "qqq", "gld"))
    vix = vix_features(done.where(F.col("role") == "vix"))
    spread = (
        spy.select("session_date", "available_at", "x_spy_ret20")
        .join(qqq.select("session_date", "x_qqq_ret20"), "session_date")
        .withColumn("x_qqq_spy_spread20", F.col("x_qqq_ret20") - F.col("x_spy_ret20"))
    )
    stress = (
        spy.select("session_date", "x_spy_ret1")
        .join(vix.select("session_date", "available_at", "x_vix_pctile"), "session_date")
        .withColumn("x_stress", F.greatest(-F.col("x_spy_ret1"), num(0)) * F.col("x_vix_pctile"))
    )
    stress = stress.withColumn("x_stress", F.when(F.col("x_spy_ret1").isNotNull(), F.col("x_stress")))
    corr = correlation_features(etf_features(done.where((F.col("role") == "spy") & F.col("lead_there")), "x_spy"))

    etf = lambda p: [f"x_{p}_{s}" for s in ("ret1", "ret5", "ret20", "vol20", "dd20", "dd60", "ma20", "ma100")]
    vix_cols = ["x_vix_log", "x_vix_chg1", "x_vix_chg5", "x_vix_pctile", "x_vix_ma20"]
    # decisions follow the calendar: one row per bar date, whatever the number of symbols
    decisions = bars.select(plus_days("ts", 1).alias("decision_ts")).distinct()
    same = lambda cols: {c: c for c in cols}
    sided = lambda r: {f"prov_{r}_session": "session_date", f"_{r}_end": "bar_end"}
    joined = asof_many(
        decisions,
        [
            (spy, "available_at", {**sided("spy"), **same(etf("spy"))}),
            (gld, "available_at", {**sided("gld"), **same(etf("gld"))}),
            (vix, "available_at", {**sided("vix"), **same(vix_cols)}),
            (spread, "available_at", same(["x_qqq_spy_spread20"])),
            (stress, "available_at", same(["x_stress"])),
            (corr, "available_at", same(["x_corr20_btc_spy", "x_corr60_btc_spy", "x_beta60_btc_spy"])),
        ],
        "decision_ts", bounded=True,
    )
    for r in ("spy", "gld", "vix"):
        joined = joined.withColumn(f"x_{r}_days_since", staleness_days("decision_ts", f"_{r}_end")).drop(f"_{r}_end")

    def fresh(role: str, value: str):
        ok = (F.col(f"x_{role}_days_since") <= STALE_LIMIT_DAYS) & F.col(value).isNotNull()
        return F.coalesce(ok, F.lit(False)).cast("double")

    closed = lambda r: F.coalesce(F.col(f"x_{r}_days_since") > 1.0, F.lit(False)).cast("double")
    joined = joined.withColumns(
        {
            "x_spy_closed": closed("spy"), "x_gld_closed": closed("gld"),
            "m_equity": fresh("spy", "x_spy_ret1"), "m_vix": fresh("vix", "x_vix_log"),
            "m_gld": fresh("gld", "x_gld_ret1"),
        }
    )
    joined = joined.withColumn("m_equity", F.when(F.col("x_corr60_btc_spy").isNull(), num(0)).otherwise(F.col("m_equity")))
    table = base.join(joined, "decision_ts", "left")
    return mask_groups(table).select(*META, *ALL_FEATURES, *MASKS, *LABELS)


def mask_groups(table: DataFrame) -> DataFrame:
    """Invalid groups contribute exact zeros; staleness columns keep their values."""
    made = {}
    for cols, mask in GROUPS.values():
        for c in cols:
            if not c.endswith(("_closed", "_days_since")):
                made[c] = F.when(F.col(mask) == 0, num(0)).otherwise(F.coalesce(F.col(c), num(0)))
    return table.withColumns(made)


def ablate(table: DataFrame) -> DataFrame:
    """Every row once per variant, with the variant's removed groups and masks at 0."""
    spark = table.sparkSession
    dim = spark.createDataFrame(VARIANTS, "variant string, _equity boolean, _vix boolean, _gld boolean")
    out = table.crossJoin(F.broadcast(dim))
    made = {}
    for group, (cols, mask) in GROUPS.items():
        for c in [*cols, mask]:
            made[c] = F.when(F.col(f"_{group}"), F.col(c)).otherwise(num(0))
    return out.withColumns(made).drop("_equity", "_vix", "_gld")


def fit_scaler(train: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, mean, std) from training rows where the feature's group is valid.

    One aggregate over all features; identity scaling below 21 values, unit
    deviation for a constant feature.
    """
    owner = {c: m for cols, m in GROUPS.values() for c in cols}
    aggs = []
    for c in features:
        v = F.when(F.col(owner[c]) == 1, F.col(c)) if c in owner else F.col(c)
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"), F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s")
            ).alias(c)
        )
    wide = train.groupBy(*keys).agg(*aggs)
    long = wide.select(*keys, F.explode(F.array(*features)).alias("_e")).select(*keys, "_e.*")
    enough = F.col("n") > 20
    return long.select(
        *keys, "feature",
        F.when(enough, F.col("m")).otherwise(num(0)).alias("mean"),
        F.when(enough & (F.col("s") > 1e-9), F.col("s")).otherwise(num(1)).alias("std"),
    )


def scale(df: DataFrame, scaler: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(x - mean)/std clipped to ±8, null as 0, masked groups back to exactly 0."""
    owner = {c: m for cols, m in GROUPS.values() for c in cols}
    # one row per key with the statistics in the order of the features, so that a row finds them by place
    entry = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std"))))
    stats = scaler.groupBy(*keys).agg(entry.alias("_by_name"))
    names = F.array(*[F.lit(c) for c in features])
    stats = stats.select(*keys, F.transform(names, lambda c: F.element_at("_by_name", c)).alias("_stats"))
    out = df.join(F.broadcast(stats), keys)
    made = {}
    for i, c in enumerate(features):
        s = F.get("_stats", F.lit(i))
        z = (F.col(c) - s["mean"]) / s["std"]
        z = F.coalesce(F.when(z.isNotNull(), F.greatest(F.least(z, num(8)), num(-8))), num(0))
        made[c] = F.when(F.col(owner[c]) == 0, num(0)).otherwise(z) if c in owner else z
    return out.withColumns(made).drop("_stats")


def manifest(table: DataFrame) -> DataFrame:
    """One row describing a stored feature table."""
    return table.agg(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(schema_hash()).alias("schema_hash"),
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"),
        F.min("decision_ts").alias("first_decision"), F.max("decision_ts").alias("last_decision"),
    )
