"""Feature table, folds, forecasts and the risk overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import cte, query
from tidebar.catalog.q_research import bar_funding
from tidebar.catalog.tables_sql import backtest, paired_sql, roll, sharpe, win as sqlwin
from tidebar.functions.columns import TAIL_Z, num, tail_label
from tidebar.operators import aggregates, metrics, models
from tidebar.operators import windows as win
from tidebar.plans import features as X
from tidebar.plans import overlay, review, walkforward
from tidebar.session import scratch_path
from tidebar.sources import sinks

ROLES = {"spy": "1-URGENT", "qqq": "2-HIGH", "gld": "3-MEDIUM", "vix": "5-LOW"}
LEAD = "NO"


def w():
    """Window of one series; built on use, so the catalog loads without a session."""
    return win.series("symbol")

_LRB = f"(SELECT b.*, ln(close) - lag(ln(close)) {sqlwin()} AS lr, ln(close) AS lc, f.funding AS f FROM bars b LEFT JOIN bar_funding f USING (symbol, ts))"
_S20 = roll("stddev_samp({})", "lr", 20)
_ret = lambda h: f"{roll('sum({})', 'lr', h)} / nullif(s20 * sqrt({h}.0), 0) AS c_ret{h}_n"
_vol = lambda n: f"{roll('stddev_samp({})', 'lr', n)} * sqrt(365.0) AS c_vol{n}"
_lead = " AND ".join(f"lead(lr, {h}) {sqlwin()} IS NOT NULL" for h in range(1, 6))
_sq = " + ".join(f"power(lead(lr, {h}) {sqlwin()}, 2)" for h in range(1, 6))
_mz = ", ".join(f"(lead(lc, {h}) {sqlwin()} - lc) / nullif(s20 * sqrt({h}.0), 0)" for h in range(1, 6))
cte("crypto_f", f"""
SELECT symbol, ts AS bar_date, ts + INTERVAL 1 DAY AS decision_ts, s20 AS c_sigma20d, {', '.join(_ret(h) for h in (1, 5, 21, 63, 126, 252))},
 {', '.join(_vol(n) for n in (5, 20, 22, 60))}, (high - low) / close AS c_range,
 (volume - {roll('avg({})', 'volume', 20)}) / nullif({roll('stddev_samp({})', 'volume', 20)}, 0) AS c_volz20,
 close / {roll('max({})', 'close', 55)} - 1 AS c_dch_high55, close / {roll('min({})', 'close', 20)} - 1 AS c_dch_low20,
 close / {roll('avg({})', 'close', 20)} - 1 AS c_ma20, close / {roll('avg({})', 'close', 100)} - 1 AS c_ma100,
 coalesce(f, 0) AS c_fund_d, coalesce({roll('avg({})', 'f', 21, need=10)}, 0) AS c_fund_m21, CAST(f IS NOT NULL AS DOUBLE) AS m_fund,
 CASE WHEN {_lead} THEN ln(sqrt(({_sq}) / 5)) END AS label_logvol5, CASE WHEN {_lead} AND s20 IS NOT NULL THEN least({_mz}) END AS label_minz5
FROM (SELECT *, {_S20} AS s20 FROM {_LRB})""")


def _etf(role: str) -> str:
    p = f"x_{role}"
    r = lambda fn, x, n: roll(fn, x, n, order="session_date")
    return f"""SELECT session_date, available_at, bar_end, lr AS {p}_ret1, {r('sum({})', 'lr', 5)} AS {p}_ret5, {r('sum({})', 'lr', 20)} AS {p}_ret20,
 {r('stddev_samp({})', 'lr', 20)} * sqrt(252.0) AS {p}_vol20, close / {r('max({})', 'close', 20)} - 1 AS {p}_dd20, close / {r('max({})', 'close', 60)} - 1 AS {p}_dd60,
 close / {r('avg({})', 'close', 20)} - 1 AS {p}_ma20, close / {r('avg({})', 'close', 100)} - 1 AS {p}_ma100
FROM (SELECT *, ln(close) - lag(ln(close)) {sqlwin('session_date')} AS lr FROM sessions WHERE symbol = '{ROLES[role]}')"""


for _r in ("spy", "qqq", "gld"):
    cte(f"{_r}_f", _etf(_r))
cte("vix_f", f"""
SELECT s.session_date, available_at, bar_end, ln(close) AS x_vix_log, ln(close) - lag(ln(close)) {sqlwin('s.session_date', 's.symbol')} AS x_vix_chg1,
 ln(close) - lag(ln(close), 5) {sqlwin('s.session_date', 's.symbol')} AS x_vix_chg5, pct AS x_vix_pctile,
 close / {roll('avg({})', 'close', 20, order='s.session_date', part='s.symbol')} - 1 AS x_vix_ma20
FROM (SELECT * FROM sessions WHERE symbol = '{ROLES['vix']}') s JOIN (SELECT a.session_date, CASE WHEN count(*) >= 60 THEN
 (count(CASE WHEN b.close < a.close THEN 1 END) + (count(CASE WHEN b.close = a.close THEN 1 END) + 1) / 2.0) / count(*) END AS pct
 FROM sessions a JOIN sessions b ON a.symbol = b.symbol AND b.session_date <= a.session_date WHERE a.symbol = '{ROLES['vix']}' GROUP BY 1) p USING (session_date)""")
cte("spread_f", "SELECT a.session_date AS sd, a.available_at, b.x_qqq_ret20 - a.x_spy_ret20 AS x_qqq_spy_spread20 FROM spy_f a JOIN qqq_f b USING (session_date)")
cte("stress_f", "SELECT a.session_date AS sd, b.available_at, CASE WHEN x_spy_ret1 IS NOT NULL THEN greatest(-x_spy_ret1, 0) * x_vix_pctile END AS x_stress FROM spy_f a JOIN vix_f b USING (session_date)")


def _pair(fn: str, n: int) -> str:
    f = f"OVER (ORDER BY session_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) {f} = {n} THEN {fn} {f} END)"


_YV = "(CASE WHEN count(x) OVER (ORDER BY session_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) >= 60 THEN var_samp(x) OVER (ORDER BY session_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END)"
cte("corr_f", f"""
SELECT CAST(session_date AS TIMESTAMP) + INTERVAL 1 DAY AS available_at, {_pair('corr(y, x)', 20)} AS x_corr20_btc_spy, {_pair('corr(y, x)', 60)} AS x_corr60_btc_spy,
 {_pair('covar_samp(y, x)', 60)} / {_YV} AS x_beta60_btc_spy
FROM (SELECT s.session_date, s.x_spy_ret1 AS x, b.lr AS y FROM spy_f s JOIN (SELECT CAST(ts AS DATE) AS session_date, ln(close) - lag(ln(close)) {sqlwin()} AS lr FROM bars WHERE symbol = '{LEAD}') b USING (session_date))""")
_etf_cols = lambda r: [f"x_{r}_{s}" for s in ("ret1", "ret5", "ret20", "vol20", "dd20", "dd60", "ma20", "ma100")]
_vix_cols = ["x_vix_log", "x_vix_chg1", "x_vix_chg5", "x_vix_pctile", "x_vix_ma20"]


def _join(prev: str, right: str, cols: list[str], role: str | None) -> str:
    extra = f", r.session_date AS prov_{role}_session, (epoch_us(l.decision_ts) - epoch_us(r.bar_end)) / 86400e6 AS x_{role}_days_since" if role else ""
    return f"SELECT l.*{extra}, {', '.join('r.' + c for c in cols)} FROM {prev} l ASOF LEFT JOIN {right} r ON l.decision_ts >= r.available_at"


_chain = "(SELECT DISTINCT decision_ts FROM crypto_f)"
for _right, _cols, _role in [
    ("spy_f", _etf_cols("spy"), "spy"), ("gld_f", _etf_cols("gld"), "gld"), ("vix_f", _vix_cols, "vix"),
    ("spread_f", ["x_qqq_spy_spread20"], None), ("stress_f", ["x_stress"], None),
    ("corr_f", ["x_corr20_btc_spy", "x_corr60_btc_spy", "x_beta60_btc_spy"], None),
]:
    _chain = f"({_join(_chain, _right, _cols, _role)})"
_fresh = lambda r, c: f"CAST(coalesce(x_{r}_days_since <= 5.5 AND {c} IS NOT NULL, FALSE) AS DOUBLE)"
_raw = {c for g, _ in X.GROUPS.values() for c in g if not c.endswith(("_closed", "_days_since"))}
_masked = []
for _cols, _m in X.GROUPS.values():
    for _c in _cols:
        _masked.append(f"CASE WHEN {_m} = 0 THEN 0 ELSE coalesce({_c}, 0) END AS {_c}" if _c in _raw else _c)
cte("feat", f"""
SELECT {', '.join(X.META)}, {', '.join(X.CRYPTO)}, {', '.join(_masked)}, m_fund, m_equity, m_vix, m_gld, label_logvol5, label_minz5 FROM (
 SELECT c.*, j.* EXCLUDE (decision_ts), CAST(coalesce(x_spy_days_since > 1, FALSE) AS DOUBLE) AS x_spy_closed, CAST(coalesce(x_gld_days_since > 1, FALSE) AS DOUBLE) AS x_gld_closed,
  CASE WHEN x_corr60_btc_spy IS NULL THEN 0 ELSE {_fresh('spy', 'x_spy_ret1')} END AS m_equity, {_fresh('vix', 'x_vix_log')} AS m_vix, {_fresh('gld', 'x_gld_ret1')} AS m_gld
 FROM crypto_f c JOIN {_chain} j ON j.decision_ts = c.decision_ts)""")


def table(t):
    return X.feature_table(t.bars, t.sessions, bar_funding(t), LEAD, ROLES)


_FC = " ".join(f"{c}:6" for c in [*X.ALL_FEATURES, *X.MASKS, *X.LABELS])
_META = "decision_ts:t bar_date:t symbol c_sigma20d:7 prov_spy_session:d prov_vix_session:d prov_gld_session:d"


@query("x16_feature_table", f"{_META} {_FC}", "SELECT * FROM feat")
def _x16(t):
    return table(t)


@query("p6_masked_groups", "m_equity:1 m_vix:1 m_gld:1 n:i nonzero:i", """
SELECT m_equity, m_vix, m_gld, count(*) AS n, count(CASE WHEN x_spy_ma20 <> 0 THEN 1 END) AS nonzero FROM feat GROUP BY 1, 2, 3""")
def _p6(t):
    return table(t).groupBy("m_equity", "m_vix", "m_gld").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x_spy_ma20") != 0).alias("nonzero"))


@query("p5_ablation", "variant n:i spy:6 vix:6 gld:6 masks:1", """
SELECT v.variant, count(*) AS n, sum(CASE WHEN e THEN x_spy_ret20 ELSE 0 END) AS spy, sum(CASE WHEN x THEN x_vix_log ELSE 0 END) / 1000 AS vix,
 sum(CASE WHEN g THEN x_gld_ret20 ELSE 0 END) AS gld, sum(CASE WHEN e THEN m_equity ELSE 0 END + CASE WHEN x THEN m_vix ELSE 0 END + CASE WHEN g THEN m_gld ELSE 0 END) AS masks
FROM feat CROSS JOIN (VALUES ('E1', FALSE, FALSE, FALSE), ('E2', TRUE, FALSE, FALSE), ('E3', TRUE, TRUE, FALSE), ('E4', TRUE, TRUE, TRUE)) AS v(variant, e, x, g) GROUP BY 1""")
def _p5(t):
    a = X.ablate(table(t))
    return a.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x_spy_ret20").alias("spy"), (F.sum("x_vix_log") / 1000).alias("vix"), F.sum("x_gld_ret20").alias("gld"),
        F.sum(F.col("m_equity") + F.col("m_vix") + F.col("m_gld")).alias("masks"))


@query("s17_feature_sink", "schema_version schema_hash n_rows:i n_symbols:i first_decision:t last_decision:t", f"""
SELECT 'xa-dl-v1' AS schema_version, '{X.schema_hash()}' AS schema_hash, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols,
 min(decision_ts) AS first_decision, max(decision_ts) AS last_decision FROM feat""")
def _s17(t):
    path = scratch_path(t.spark, "s17")
    sinks.write_features(table(t), path)
    return t.spark.read.schema(
        "schema_version string, schema_hash string, n_rows long, n_symbols long, first_decision timestamp, last_decision timestamp").json(f"{path}/manifest")


# ---------------- folds on the feature table ----------------

cte("feat_span", "SELECT min(CASE WHEN c_ret252_n IS NOT NULL AND label_logvol5 IS NOT NULL THEN decision_ts END) AS t0, max(decision_ts) AS t_end FROM feat")
cte("feat_folds", """
SELECT k AS fold, t0 + to_days(CAST(730 + 182 * k AS INTEGER)) AS train_end, t0 + to_days(CAST(912 + 182 * k AS INTEGER)) AS val_end,
  least(t0 + to_days(CAST(1094 + 182 * k AS INTEGER)), t_end) AS test_end FROM feat_span, (SELECT unnest(range(60)) AS k)
WHERE t0 + to_days(CAST(912 + 182 * k AS INTEGER)) < t_end - INTERVAL 30 DAY""")
cte("feat_split", """
SELECT feat.*, fold, CASE WHEN decision_ts <= train_end - INTERVAL 5 DAY THEN 'train' WHEN decision_ts > train_end AND decision_ts <= val_end - INTERVAL 5 DAY THEN 'val'
 WHEN decision_ts > val_end AND decision_ts <= test_end THEN 'test' END AS split FROM feat JOIN feat_folds ON decision_ts <= test_end""")
cte("fold_c", """
SELECT fold, quantile_cont(exp(label_logvol5), 0.5) AS sigma_ref, coalesce(quantile_cont(CASE WHEN c_sigma20d > 0 THEN c_sigma20d END, 0.05), 1e-4) AS sigma_floor,
 CASE WHEN count(CASE WHEN m_vix = 1 THEN x_vix_log END) >= 100 THEN quantile_cont(CASE WHEN m_vix = 1 THEN x_vix_log END, 0.9) END AS vix_limit
FROM feat_split WHERE split = 'train' AND label_logvol5 IS NOT NULL GROUP BY fold""")
cte("preds", """
SELECT v.variant, s.fold, decision_ts, symbol, c_sigma20d AS sigma_hat, sigma_floor, greatest(least(sigma_ref / greatest(c_sigma20d, 1e-8), 1), 0)
 * CASE WHEN v.variant = 'B3' AND m_vix = 1 AND x_vix_log > vix_limit THEN 0.5 ELSE 1 END AS multiplier
FROM feat_split s JOIN fold_c USING (fold) CROSS JOIN (VALUES ('B1'), ('B3')) AS v(variant) WHERE split = 'test' AND c_ret252_n IS NOT NULL""")


def tagged(t, written: bool = True):
    """Feature table with folds. Several branches read it, so it is written once."""
    f = table(t)
    if written:
        path = scratch_path(t.spark, "features")
        sinks.replace_table(f, path)
        f = t.spark.read.parquet(path)
    valid = F.when(F.col("c_ret252_n").isNotNull() & F.col("label_logvol5").isNotNull(), F.col("decision_ts"))
    bounds = f.agg(F.min(valid).alias("t0"), F.max("decision_ts").alias("t_end"))
    return walkforward.split_rows(f, walkforward.fold_schedule(bounds, 730), "decision_ts")


@query("a10_sigma_floor", "fold:i sigma_floor:8", "SELECT fold, sigma_floor FROM fold_c")
def _a10(t):
    tr = tagged(t).where("split = 'train' and label_logvol5 is not null")
    return aggregates.sigma_floor(tr, ["fold"])


@query("a11_sigma_reference", "fold:i sigma_ref:7", "SELECT fold, sigma_ref FROM fold_c")
def _a11(t):
    return aggregates.sigma_reference(tagged(t).where("split = 'train'"), ["fold"])


@query("x23_baseline_forecasts", "variant fold:i decision_ts:t symbol sigma_hat:7 multiplier:7 sigma_floor:8", "SELECT * FROM preds")
def _x23(t):
    return overlay.baseline_forecasts(tagged(t), with_har=False)


def har_x(eps: str = "1e-6") -> str:
    return (f"ln(abs(c_ret1_n * c_sigma20d) + {eps}) AS x1, ln(c_vol5 / sqrt(365.0::DOUBLE) + {eps}) AS x2, ln(c_vol22 / sqrt(365.0::DOUBLE) + {eps}) AS x3")


# Least squares by elimination on the 3 x 3 covariances.
cte("har_b", f"""
WITH x AS (SELECT * FROM (SELECT fold, {har_x()}, label_logvol5 AS y FROM feat_split WHERE split = 'train')
 WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND y IS NOT NULL),
s AS (SELECT fold, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12,
 covar_pop(x1, x3) AS s13, covar_pop(x2, x2) AS s22, covar_pop(x2, x3) AS s23, covar_pop(x3, x3) AS s33, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x3, y) AS c3 FROM x GROUP BY fold),
e AS (SELECT *, s22 - s12 / s11 * s12 AS t22, s23 - s12 / s11 * s13 AS t23, s33 - s13 / s11 * s13 AS t33, c2 - s12 / s11 * c1 AS d2, c3 - s13 / s11 * c1 AS d3 FROM s),
b3 AS (SELECT *, (d3 - t23 / t22 * d2) / (t33 - t23 / t22 * t23) AS h3 FROM e), b2 AS (SELECT *, (d2 - t23 * h3) / t22 AS h2 FROM b3),
b1 AS (SELECT *, (c1 - s12 * h2 - s13 * h3) / s11 AS h1 FROM b2)
SELECT fold, n AS n_fit, my - h1 * m1 - h2 * m2 - h3 * m3 AS har_0, h1 AS har_1, h2 AS har_2, h3 AS har_3 FROM b1""")
HAR_SIGMA = "exp(har_0 + har_1 * x1 + har_2 * x2 + har_3 * x3)"


@query("m8_har_regression", "fold:i n_fit:i har_0:5 har_1:5 har_2:5 har_3:5", "SELECT * FROM har_b")
def _m8(t):
    return models.har_fit(tagged(t).where("split = 'train' and label_logvol5 is not null"), ["fold"])


@query("x23_har_forecasts", "variant fold:i n:i mean_sigma:5 mean_mult:5", f"""
WITH h AS (SELECT fold, sigma_ref, {HAR_SIGMA} AS sigma_hat FROM (SELECT fold, {har_x()} FROM feat_split WHERE split = 'test' AND c_ret252_n IS NOT NULL) JOIN har_b USING (fold) JOIN fold_c USING (fold)),
p AS (SELECT variant, fold, sigma_hat, multiplier FROM preds UNION ALL SELECT 'B2', fold, sigma_hat, greatest(least(sigma_ref / greatest(sigma_hat, 1e-8), 1), 0) FROM h)
SELECT variant, fold, count(*) AS n, avg(sigma_hat) AS mean_sigma, avg(multiplier) AS mean_mult FROM p GROUP BY 1, 2""")
def _x23b(t):
    p = overlay.baseline_forecasts(tagged(t))
    return p.groupBy("variant", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("sigma_hat").alias("mean_sigma"), F.avg("multiplier").alias("mean_mult"))


cte("pscores", """
SELECT variant, fold, count(*) AS n, avg(abs(ln(sigma_hat) - label_logvol5)) AS vol_mae_log,
 avg(ln(greatest(sigma_hat * sigma_hat, 1e-12)) + exp(2 * label_logvol5) / greatest(sigma_hat * sigma_hat, 1e-12)) AS qlike,
 count(CASE WHEN label_minz5 * c_sigma20d / greatest(c_sigma20d, sigma_floor) <= -2 THEN 1 END) AS tail_positives
FROM preds JOIN (SELECT decision_ts, symbol, label_logvol5, label_minz5, c_sigma20d FROM feat) USING (decision_ts, symbol) WHERE label_logvol5 IS NOT NULL GROUP BY 1, 2""")


@query("a8_predictive_scores", "variant fold:i n:i vol_mae_log:6 qlike:4 tail_positives:i", "SELECT * FROM pscores")
def _a8(t):
    g = tagged(t)
    return aggregates.predictive_scores(overlay.baseline_forecasts(g, with_har=False), _labels(g))


def _labels(g):
    return g.select("decision_ts", "symbol", "label_logvol5", "label_minz5", "c_sigma20d").dropDuplicates(["decision_ts", "symbol"])


@query("a9_pooled_scores", "variant n:i vol_mae_log:6 qlike:4 tail_positives:i", """
SELECT variant, sum(n) AS n, avg(vol_mae_log) AS vol_mae_log, avg(qlike) AS qlike, sum(tail_positives) AS tail_positives FROM pscores GROUP BY 1""")
def _a9(t):
    g = tagged(t)
    return aggregates.pooled_scores(aggregates.predictive_scores(overlay.baseline_forecasts(g, with_har=False), _labels(g)))


@query("a17_multiplier_stats", "variant mult_mean:6 mult_below_1:6", """
SELECT variant, avg(multiplier) AS mult_mean, avg(CAST(multiplier < 0.999 AS DOUBLE)) AS mult_below_1 FROM preds GROUP BY 1""")
def _a17(t):
    return aggregates.multiplier_stats(overlay.baseline_forecasts(tagged(t), with_har=False))


_SC = X.ALL_FEATURES
_OWN = {c: m for cols, m in X.GROUPS.values() for c in cols}
_fit = " UNION ALL ".join(
    f"SELECT fold, '{c}' AS feature, CASE WHEN count(v) > 20 THEN avg(v) ELSE 0 END AS mean, CASE WHEN count(v) > 20 AND stddev_samp(v) > 1e-9 THEN stddev_samp(v) ELSE 1 END AS std "
    f"FROM (SELECT fold, {f'CASE WHEN {_OWN[c]} = 1 THEN {c} END' if c in _OWN else c} AS v FROM feat_split WHERE split = 'train') GROUP BY fold" for c in _SC)
cte("scaler", _fit)


@query("p15_train_scaler", "fold:i feature mean:6 std:6", "SELECT * FROM scaler")
def _p15(t):
    return X.fit_scaler(tagged(t).where("split = 'train'"), ["fold"], _SC)


_z = ", ".join(
    f"avg({f'CASE WHEN {_OWN[c]} = 0 THEN 0 ELSE' if c in _OWN else 'CASE WHEN FALSE THEN 0 ELSE'} coalesce(CASE WHEN {c} IS NOT NULL THEN greatest(least(({c} - m['{c}'].mean) / m['{c}'].std, 8), -8) END, 0) END) AS {c}" for c in _SC)


@query("p15_scaled_features", "fold:i split " + " ".join(f"{c}:5" for c in _SC), f"""
WITH m AS (SELECT fold, map_from_entries(list((feature, {{'mean': mean, 'std': std}}))) AS m FROM scaler GROUP BY fold)
SELECT fold, split, {_z} FROM feat_split JOIN m USING (fold) WHERE split IS NOT NULL GROUP BY fold, split""")
def _p15b(t):
    g = tagged(t)
    sc = X.fit_scaler(g.where("split = 'train'"), ["fold"], _SC)
    z = X.scale(g, sc, ["fold"], _SC)
    return z.groupBy("fold", "split").agg(*[F.avg(c).alias(c) for c in _SC])


# ---------------- overlay ----------------

cte("base_w", "SELECT symbol, ts, avg(pos) AS weight FROM donchian_variants GROUP BY 1, 2")
cte("overlay_t", """
SELECT v.variant, b.symbol, b.ts, weight, greatest(least(weight * coalesce(p.multiplier, 1), 1), 0) AS target FROM base_w b CROSS JOIN (VALUES ('B0'), ('B1'), ('B3')) AS v(variant)
LEFT JOIN preds p ON p.variant = v.variant AND p.symbol = b.symbol AND p.decision_ts = b.ts + INTERVAL 1 DAY""")
# the held weight is a true recursion: one recursive step per bar number, all series at once
cte("overlay_held", """
SELECT variant, symbol, ts, h AS pos FROM (WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY variant, symbol ORDER BY ts) AS i FROM overlay_t),
r AS (SELECT variant, symbol, ts, i, CASE WHEN abs(target) > 0.02 THEN target ELSE 0.0::DOUBLE END AS h FROM n WHERE i = 1
 UNION ALL SELECT n.variant, n.symbol, n.ts, n.i, CASE WHEN abs(n.target - r.h) > 0.02 THEN n.target ELSE r.h END FROM r JOIN n ON n.variant = r.variant AND n.symbol = r.symbol AND n.i = r.i + 1)
SELECT * FROM r)""")


def forecasts(t):
    path = scratch_path(t.spark, "forecasts")
    sinks.replace_table(overlay.baseline_forecasts(tagged(t), with_har=False), path)
    return t.spark.read.parquet(path)


@query("j16_shifted_multiplier", "variant symbol ts:t target:6", "SELECT variant, symbol, ts, target FROM overlay_t")
def _j16(t):
    return overlay.overlay_targets(overlay.base_weights(t.bars), forecasts(t))


@query("x20_hysteresis", "variant symbol ts:t pos:6", "SELECT * FROM overlay_held")
def _x20(t):
    g = overlay.overlay_targets(overlay.base_weights(t.bars), forecasts(t))
    return win.hysteresis(g.select("variant", "symbol", "ts", "target"), ["variant", "symbol"], "ts", "target", "pos")


cte("overlay_net", backtest("overlay_held", "variant, symbol"))
cte("oos_days", "SELECT DISTINCT decision_ts - INTERVAL 1 DAY AS ts FROM preds")
cte("overlay_port", "SELECT variant, ts, avg(net) AS net FROM overlay_net JOIN oos_days USING (ts) GROUP BY 1, 2")


@query("x21_overlay_returns", "variant ts:t net:7", "SELECT * FROM overlay_port")
def _x21(t):
    p = forecasts(t)
    return overlay.overlay_portfolio(overlay.overlay_legs(t.bars, p), p)


@query("x32_per_symbol_gain", "variant symbol sharpe_diff:5", f"""
WITH s AS (SELECT variant, symbol, {sharpe('net')} AS sh FROM overlay_net JOIN oos_days USING (ts) GROUP BY 1, 2)
SELECT a.variant, a.symbol, a.sh - b.sh AS sharpe_diff FROM s a JOIN s b ON a.symbol = b.symbol AND b.variant = 'B0' WHERE a.variant <> 'B0'""")
def _x32(t):
    p = forecasts(t)
    return overlay.per_symbol_gain(overlay.overlay_legs(t.bars, p), p)


cte("fold_inc", """
SELECT v.variant, d.fold, avg(v.net - b.net) AS increment FROM overlay_port v JOIN overlay_port b ON b.ts = v.ts AND b.variant = 'B0'
JOIN (SELECT DISTINCT variant, fold, decision_ts - INTERVAL 1 DAY AS ts FROM preds) d ON d.variant = v.variant AND d.ts = v.ts GROUP BY 1, 2""")


@query("a18_fold_increments", "variant folds_positive:i folds_total:i best_fold:i sharpe_gap_wo_best:5", f"""
WITH t AS (SELECT variant, count(CASE WHEN increment > 0 THEN 1 END) AS folds_positive, count(*) AS folds_total, arg_max(fold, row(increment, -fold)) AS best_fold FROM fold_inc GROUP BY 1),
k AS (SELECT v.variant, v.net AS a, b.net AS b FROM overlay_port v JOIN overlay_port b ON b.ts = v.ts AND b.variant = 'B0' JOIN t ON t.variant = v.variant
 WHERE v.ts NOT IN (SELECT decision_ts - INTERVAL 1 DAY FROM preds WHERE preds.variant = v.variant AND preds.fold = t.best_fold)),
g AS (SELECT variant, {sharpe('a')} - {sharpe('b')} AS sharpe_gap_wo_best FROM k GROUP BY 1) SELECT * FROM t JOIN g USING (variant)""")
def _a18(t):
    p = forecasts(t)
    return overlay.increment_summary(overlay.overlay_portfolio(overlay.overlay_legs(t.bars, p), p), p)


# the ladder runs over the variants at hand: B3 is B1 with a gate on top
cte("gate_stats", f"""
WITH s AS (SELECT variant, {sharpe('net')} AS sharpe, avg(net) / stddev_samp(net) AS sr, count(*) AS n, skewness(net) AS sk, kurtosis(net) AS ku,
  (CASE WHEN product(1 + net) <= 0 THEN -1 ELSE pow(product(1 + net), 365.0 / count(*)) - 1 END) * 100 AS cagr_pct FROM overlay_port GROUP BY 1),
e AS (SELECT variant, ts, product(1 + net) OVER (PARTITION BY variant ORDER BY ts) AS eq FROM overlay_port),
d AS (SELECT variant, min(eq / pk - 1) * 100 AS max_dd_pct FROM (SELECT variant, eq, max(eq) OVER (PARTITION BY variant ORDER BY ts) AS pk FROM e) GROUP BY 1),
c AS (SELECT variant, {sharpe('net2')} AS stress_sharpe FROM (SELECT variant, ts, avg(net - cost) AS net2 FROM overlay_net JOIN oos_days USING (ts) GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT variant, count(CASE WHEN increment > 0 THEN 1 END) AS folds_positive, count(*) AS folds_total, arg_max(fold, row(increment, -fold)) AS best_fold FROM fold_inc GROUP BY 1),
k AS (SELECT v.variant, v.net AS a, b.net AS b FROM overlay_port v JOIN overlay_port b ON b.ts = v.ts AND b.variant = 'B0' JOIN t ON t.variant = v.variant
 WHERE v.ts NOT IN (SELECT decision_ts - INTERVAL 1 DAY FROM preds WHERE preds.variant = v.variant AND preds.fold = t.best_fold)),
g AS (SELECT variant, {sharpe('a')} - {sharpe('b')} AS gap FROM k GROUP BY 1)
SELECT *, sr * sqrt(CAST(n - 1 AS DOUBLE)) / sqrt(greatest(1 - sk * sr + (ku + 2) / 4 * sr * sr, 1e-12)) AS z
FROM s JOIN d USING (variant) JOIN c USING (variant) LEFT JOIN t USING (variant) LEFT JOIN g USING (variant)""")


cte("gain_pairs", "SELECT v.variant, v.ts, v.net AS a, b.net AS b FROM overlay_port v JOIN overlay_port b ON b.ts = v.ts AND b.variant = 'B0' WHERE v.variant <> 'B0'")
cte("gain_p", paired_sql("gain_pairs", "variant", "ts"))


@query("x31_gate_verdict", "variant check_name passed:b all_pass:b n_known:i n_passed:i", """
WITH v AS (SELECT s.*, g.sharpe_p, b.sharpe AS b_sharpe, b.max_dd_pct AS b_dd, b.cagr_pct AS b_cagr, (SELECT max(sharpe) FROM gate_stats WHERE variant <> 'B0') AS best
 FROM gate_stats s JOIN gate_stats b ON b.variant = 'B0' AND s.variant <> 'B0' LEFT JOIN gain_p g ON g.variant = s.variant),
l AS (SELECT variant, unnest([
 {'c': 'sharpe_above_base', 'p': sharpe > b_sharpe}, {'c': 'sharpe_above_best_baseline', 'p': sharpe > best}, {'c': 'gain_significant', 'p': sharpe_p < 0.05},
 {'c': 'deflated_sharpe', 'p': n >= 20 AND z >= 1.6448536269514722}, {'c': 'drawdown', 'p': abs(max_dd_pct) <= 0.85 * abs(b_dd)},
 {'c': 'growth', 'p': b_cagr <= 0 OR cagr_pct >= 0.8 * b_cagr}, {'c': 'folds', 'p': folds_positive >= 0.7 * greatest(folds_total, 1)},
 {'c': 'double_costs', 'p': stress_sharpe > 0}, {'c': 'without_best_fold', 'p': gap > 0}], recursive := true) FROM v)
SELECT variant, c AS check_name, p AS passed, bool_and(coalesce(p, TRUE)) OVER w AS all_pass, count(p) OVER w AS n_known, count(CASE WHEN p THEN 1 END) OVER w AS n_passed
FROM l WINDOW w AS (PARTITION BY variant)
UNION ALL SELECT a.variant, 'sharpe_above_B1', a.sharpe > b.sharpe, NULL, NULL, NULL FROM gate_stats a, gate_stats b WHERE a.variant = 'B3' AND b.variant = 'B1'""")
def _x31(t):
    p = forecasts(t)
    path = scratch_path(t.spark, "overlay-legs")
    sinks.replace_table(overlay.overlay_legs(t.bars, p), path)
    stats = overlay.gate_stats(t.spark.read.parquet(path), p, 1)
    v = review.overlay_gate(stats, {"B3": "B1"})
    return v.withColumnRenamed("check", "check_name")


@query("x24_decision_log", "decision_ts:t symbol variant sigma_hat:6 base_weight:6", f"""
WITH l AS (SELECT decision_ts, symbol, c_sigma20d, {har_x()} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY decision_ts DESC) AS rn
 FROM (SELECT DISTINCT feat.* FROM feat JOIN feat_folds ON decision_ts <= test_end)) WHERE rn = 1),
m AS (SELECT decision_ts, symbol, 'B1' AS variant, c_sigma20d AS sigma_hat FROM l
 UNION ALL SELECT decision_ts, symbol, 'B2', {HAR_SIGMA} FROM l CROSS JOIN (SELECT * FROM har_b WHERE fold = (SELECT max(fold) FROM feat_folds)))
SELECT m.*, w.weight AS base_weight FROM m LEFT JOIN base_w w ON w.symbol = m.symbol AND w.ts = m.decision_ts - INTERVAL 1 DAY""")
def _x24(t):
    g = tagged(t)
    f = g.drop("fold", "split", "train_end", "val_end", "test_end", "complete").dropDuplicates(["decision_ts", "symbol"])
    newest = F.broadcast(g.agg(F.max("fold").alias("fold")))  # one row
    har = models.har_fit(g.join(newest, "fold").where("split = 'train' and label_logvol5 is not null"), []).drop("n_fit")
    return overlay.decision_log(f, overlay.base_weights(t.bars), har, 0.8)


@query("x24_reference_log", "decision_ts:t symbol sigma_hat:7 multiplier:7 base_weight:6 shadow_weight:6", """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY decision_ts DESC) AS rn FROM feat) WHERE rn = 1),
m AS (SELECT decision_ts, symbol, c_sigma20d AS sigma_hat, greatest(least(0.8 / greatest(c_sigma20d, 1e-8), 1), 0) AS multiplier FROM l)
SELECT m.*, w.weight AS base_weight, greatest(least(w.weight * multiplier, 1), 0) AS shadow_weight FROM m LEFT JOIN base_w w ON w.symbol = m.symbol AND w.ts = m.decision_ts - INTERVAL 1 DAY""")
def _x24b(t):
    return _x24(t).where("variant = 'B1'")


_LIN = ["c_vol5", "c_vol20", "c_vol60", "c_range", "x_spy_vol20", "x_vix_log", "x_gld_vol20"]
_LIN_OWN = {c: g[0] for g, (cols, _) in X.GROUPS.items() for c in cols}


def _lin_sql(c: str) -> str:
    return f"CASE WHEN v.{_LIN_OWN[c]} THEN {c} ELSE 0 END AS {c}" if c in _LIN_OWN else c


# the normal equations determine a least-squares fit: fitted values have the label's moments with every regressor
@query("m13_linear_forecasts", "variant fold:i n:i n_fit:i eq_0:6 " + " ".join(f"eq_{c}:6" for c in _LIN), f"""
WITH r AS (SELECT v.variant, fold, split, label_logvol5 AS y, {', '.join(_lin_sql(c) for c in _LIN)}
 FROM feat_split CROSS JOIN (VALUES ('E1', FALSE, FALSE, FALSE), ('E2', TRUE, FALSE, FALSE), ('E3', TRUE, TRUE, FALSE), ('E4', TRUE, TRUE, TRUE)) AS v(variant, e, v, g)
 WHERE c_vol60 IS NOT NULL AND label_logvol5 IS NOT NULL),
f AS (SELECT variant, fold, count(*) AS n_fit, avg(y) AS eq_0, {', '.join(f'avg(y * {c}) AS eq_{c}' for c in _LIN)} FROM r
 WHERE split = 'train' AND {' AND '.join(f'{c} IS NOT NULL' for c in _LIN)} GROUP BY ALL)
SELECT f.*, n FROM f JOIN (SELECT variant, fold, count(*) AS n FROM r WHERE split = 'test' GROUP BY ALL) USING (variant, fold)""")
def _m13(t):
    keys = ["variant", "fold"]
    rows = X.ablate(tagged(t)).dropna(subset=["c_vol60", "label_logvol5"])
    train = rows.where("split = 'train'").dropna(subset=_LIN)
    out = models.linear_vol_forecast(train, train.unionByName(rows.where("split = 'test'")), keys, _LIN)
    fitted, fit = F.ln("sigma_hat"), F.col("split") == "train"
    eqs = [F.avg(F.when(fit, fitted * x)).alias(f"eq_{c}") for c, x in [("0", num(1)), *[(c, F.col(c)) for c in _LIN]]]
    return out.groupBy(*keys).agg(F.count_if(~fit).alias("n"), F.count_if(fit).alias("n_fit"), *eqs).where("n > 0")


_TAIL = ["c_vol5", "c_vol20", "c_vol60", "c_ret21_n"]


def score_sql(rows: str, features: list[str]) -> str:
    """Per fold the right sides of the score equations, and the sizes, of rows (fold, split, y, features)."""
    eqs = ", ".join(f"covar_pop({c}, y) / stddev_samp({c}) AS eq_{c}" for c in features)
    return f"""
WITH r AS (SELECT * FROM {rows} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in features)}),
f AS (SELECT fold, count(*) AS n_fit, avg(y) AS eq_0, {eqs} FROM r WHERE split = 'train' AND y IS NOT NULL GROUP BY fold)
SELECT f.*, n, TRUE AS converged FROM f JOIN (SELECT fold, count(*) AS n FROM r WHERE split = 'test' GROUP BY fold) USING (fold)"""


def score_cols(features: list[str]) -> str:
    return "fold:i n:i n_fit:i converged:b eq_0:6 " + " ".join(f"eq_{c}:6" for c in features)


def classifier(g, features: list[str], label: str):
    """Fit all folds together, score their test rows, and report the fit's score equations."""
    train = g.where("split = 'train'")
    fits = models.logistic_fits(train, ["fold"], features, label)
    scored = models.logistic_scores(g.where("split = 'test'"), fits, ["fold"], features, "p")
    sure = scored.where("p between 0 and 1").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    eqs = models.score_equations(train, fits, ["fold"], features, label)
    return eqs.join(fits.select("fold", "converged"), "fold").join(sure, "fold")


@query("m13_tail_classifier", score_cols(_TAIL), score_sql(f"""(SELECT *, CASE WHEN z IS NOT NULL THEN CAST(z <= {TAIL_Z} AS DOUBLE) END AS y
 FROM (SELECT *, label_minz5 * c_sigma20d / greatest(c_sigma20d, 1e-4) AS z FROM feat_split) WHERE c_ret63_n IS NOT NULL)""", _TAIL))
def _m13b(t):
    g = tagged(t).dropna(subset=["c_vol60", "c_ret63_n"])
    return classifier(g.withColumn("y", tail_label("label_minz5", "c_sigma20d", num(1e-4))), _TAIL, "y")
