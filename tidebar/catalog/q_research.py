"""Signals, backtests, walk-forward, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import cte, query
from tidebar.catalog.q_tables import folds_of
from tidebar.catalog.tables_sql import (
    VK, backtest, block_band_sql, donchian_pos, paired_sql, roll, rsi_pos, sharpe, sharpe_pp, sma_pos, tsmom_pos, win as sqlwin,
)
from tidebar.functions.columns import num
from tidebar.functions.normal import expected_max_factor
from tidebar.operators import bootstrap, metrics
from tidebar.operators import windows as win
from tidebar.plans import backtest as bt
from tidebar.plans import carry, grids, registry, research, signals, walkforward

K = "symbol ts:t"


def w():
    """Window of one series; built on use, so the catalog loads without a session."""
    return win.series("symbol")
UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _perf(src: str, keys: str) -> str:
    """Summary SQL over a relation with keys, ts, net."""
    return f"""
SELECT {keys}, {sharpe('net')} AS sharpe, 100 * CASE WHEN count(net) = 0 THEN 0 WHEN product(1 + net) <= 0 THEN -1
   ELSE power(product(1 + net), 365.0 / count(net)) - 1 END AS cagr_pct,
 100 * CASE WHEN count(net) > 2 THEN stddev_samp(net) * sqrt(365.0) ELSE 0 END AS ann_vol_pct, 100 * min(eq / pk - 1) AS max_dd_pct, count(net) AS n_bars
FROM (SELECT *, max(eq) OVER (PARTITION BY {keys} ORDER BY ts {UP}) AS pk FROM (
  SELECT {keys}, ts, net, product(1 + net) OVER (PARTITION BY {keys} ORDER BY ts {UP}) AS eq FROM {src})) GROUP BY {keys}"""


@query("flagship_donchian_performance", "symbol family params sharpe:5 cagr_pct:4 ann_vol_pct:4 max_dd_pct:5 n_bars:i ann_turnover:4", f"""
SELECT p.*, a.ann_turnover FROM ({_perf('dc_net', 'symbol, family, params')}) p
JOIN (SELECT symbol, params, avg(turnover) * 365 AS ann_turnover FROM dc_net GROUP BY 1, 2) a USING (symbol, params)""")
def _flagship(t):
    r = bt.variant_returns(t.bars, ["donchian"])
    k = ["symbol", "family", "params"]
    dd = metrics.with_drawdown(r, k, "ts", "net")
    return dd.groupBy(*k).agg(
        metrics.sharpe("net").alias("sharpe"), (num(100) * metrics.cagr("net")).alias("cagr_pct"),
        (num(100) * metrics.ann_vol("net")).alias("ann_vol_pct"), (num(100) * F.min("drawdown")).alias("max_dd_pct"),
        F.count("net").alias("n_bars"), (F.avg("turnover") * num(365)).alias("ann_turnover"))


@query("x1_buy_and_hold", "symbol sharpe:5 cagr_pct:3 ann_vol_pct:3 max_dd_pct:5 n_bars:i", _perf(
    f"({backtest('(SELECT symbol, ts, 1.0 AS pos FROM bars)')})", "symbol"))
def _x1(t):
    return metrics.summary(bt.run(t.bars, signals.buy_and_hold(t.bars)), ["symbol"], "ts")


@query("x2_sma_cross", f"{K} pos:6", sma_pos(20, 100))
def _x2(t):
    return signals.single(t.bars, "sma_cross", fast=20, slow=100)


@query("x3_donchian", f"{K} pos:6", donchian_pos(55, 27))
def _x3(t):
    return signals.single(t.bars, "donchian", n_entry=55, n_exit=27)


@query("x4_tsmom", f"{K} long_only:6 long_short:6", f"""
SELECT a.symbol, a.ts, a.pos AS long_only, b.pos AS long_short FROM ({tsmom_pos(60, 0.15)}) a JOIN ({tsmom_pos(60, 0.15, True)}) b USING (symbol, ts)""")
def _x4(t):
    a = signals.single(t.bars, "tsmom", lookback=60, target_vol=0.15).withColumnRenamed("pos", "long_only")
    b = signals.single(t.bars, "tsmom", lookback=60, target_vol=0.15, long_short=True).withColumnRenamed("pos", "long_short")
    return a.join(b, ["symbol", "ts"])


@query("x5_rsi_band", f"{K} pos:6", rsi_pos(14, 30, 55))
def _x5(t):
    return signals.single(t.bars, "rsi_meanrev", n=14, buy_below=30, exit_above=55)


@query("x6_grid_expansion", "symbol family params grid_order:i n:i time_in:5 flips:4", f"""
SELECT symbol, family, params, grid_order, count(*) AS n, avg(CAST(pos <> 0 AS DOUBLE)) AS time_in, sum(abs(pos - coalesce(p, 0))) AS flips
FROM (SELECT *, lag(pos) {sqlwin(part=VK)} AS p FROM variant_pos) GROUP BY 1, 2, 3, 4""")
def _x6(t):
    wv = win.series("symbol", "family", "params", "grid_order")
    p = signals.positions(t.bars).withColumn("_t", win.turnover("pos", wv))
    return p.groupBy("symbol", "family", "params", "grid_order").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("pos") != 0).cast("double")).alias("time_in"), F.sum("_t").alias("flips"))


# the same daily funding for the bars of every symbol: the open-to-close move of its busy days
cte("bar_funding", "SELECT symbol, ts, (close / open - 1) / 1000.0::DOUBLE AS funding FROM bars WHERE trades > 2")


def bar_funding(t):
    return t.bars.where("trades > 2").select("symbol", "ts", ((F.col("close") / F.col("open") - 1) / num(1000)).alias("funding"))


_IN_F = "(SELECT i.*, f.funding FROM bt_in i LEFT JOIN bar_funding f ON f.symbol = i.symbol AND f.ts = i.ts)"


@query("x7_position_accounting", f"{K} held:6 turnover:6 gross:7 cost:8 funding_pnl:8 net:7", backtest(
    f"({donchian_pos(20, 10)})", inputs=_IN_F, fund="coalesce(funding, 0)", fee=6.0))
def _x7(t):
    pos = signals.single(t.bars, "donchian", n_entry=20, n_exit=10)
    return bt.run(t.bars, pos, fee_bps=6.0, funding=bar_funding(t))


_IN_A = """(SELECT symbol, ts, close, ret, dvol, coalesce(ddv, quantile_cont(ddv, 0.5) OVER (PARTITION BY symbol)) AS ddv FROM bt_in)"""


@query("x7_accounting_filled_warmup", f"{K} cost:8 net:7", backtest(f"({sma_pos(20, 100)})", inputs=_IN_A))
def _x7b(t):
    return bt.run(t.bars, signals.single(t.bars, "sma_cross", fast=20, slow=100), fill_ahead=True)


@query("j12_all_variant_returns", "symbol family params grid_order:i n:i mean_net:8 total_cost:6 sr:6", f"""
SELECT {VK}, count(*) AS n, avg(net) AS mean_net, sum(cost) AS total_cost, {sharpe_pp('net')} AS sr FROM all_net GROUP BY {VK}""")
def _j12(t):
    r = bt.variant_returns(t.bars)
    return r.groupBy("symbol", "family", "params", "grid_order").agg(
        F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean_net"), F.sum("cost").alias("total_cost"), metrics.sharpe_pp("net").alias("sr"))


_SW = """(SELECT symbol, r.rule, ts, funding, apr, r.a, CASE WHEN r.a IS NULL THEN 1.0 ELSE coalesce(last_value(CASE WHEN apr < r.b THEN 0.0 WHEN apr > r.a THEN 1.0 END IGNORE NULLS)
  OVER (PARTITION BY symbol, r.rule ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) END AS s FROM
 (SELECT symbol, ts, funding, coalesce({roll7} * 365, 0) AS apr FROM bar_funding) CROSS JOIN
 (VALUES ('always_on', NULL, NULL), ('filter_5/0', 0.05, 0.0), ('filter_10/2', 0.1, 0.02)) AS r(rule, a, b))""".replace("{roll7}", roll("avg({})", "funding", 7))
cte("carry_net", f"""
SELECT *, 0.5 * funding * held - switches * 0.0009 AS net FROM (SELECT *, abs(held - coalesce(lag(held) OVER k, 0)) AS switches FROM (
 SELECT *, coalesce(lag(s) OVER (PARTITION BY symbol, rule ORDER BY ts), 0) AS held FROM {_SW}) WINDOW k AS (PARTITION BY symbol, rule ORDER BY ts))""")


@query("x8_carry", "symbol rule time_in_market:5 n_roundtrips:i net_apr_pct:4 avg_funding_apr_pct:4 sharpe:5 max_dd_pct:5", f"""
SELECT a.*, p.sharpe, p.max_dd_pct FROM (SELECT symbol, rule, avg(held) AS time_in_market, CAST(floor(sum(switches) / 2) AS BIGINT) AS n_roundtrips,
 36500 * avg(net) AS net_apr_pct, 36500 * avg(funding) AS avg_funding_apr_pct FROM carry_net GROUP BY 1, 2) a
JOIN ({_perf('carry_net', 'symbol, rule')}) p USING (symbol, rule)""")
def _x8(t):
    return carry.carry_suite(bar_funding(t))


def wf_sql(src: str, train: int, test: int, min_test: int) -> str:
    k = "symbol, family"
    return f"""
WITH n AS (SELECT {VK}, ts, net, row_number() OVER (PARTITION BY {VK} ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY {VK}) AS tt FROM {src}),
f AS (SELECT {k}, max(tt) AS tt, unnest(range(0, CAST(max(tt) AS BIGINT), 1)) AS k FROM n GROUP BY {k}),
g AS (SELECT {k}, k AS fold, {train} + k * {test} AS a, least({train} + (k + 1) * {test}, tt) AS b FROM f WHERE {train} + k * {test} < tt
  AND least({train} + (k + 1) * {test}, tt) - ({train} + k * {test}) >= {min_test}),
s AS (SELECT {VK}, fold, {sharpe_pp('net')} AS sr FROM n JOIN g USING (symbol, family) WHERE i >= a - {train} AND i < a GROUP BY {VK}, fold),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}, fold ORDER BY round(sr, 9) DESC, grid_order) AS r FROM s) WHERE r = 1)
SELECT n.symbol, n.family, c.fold, n.ts, c.sr AS train_sr, c.sr > 0 AS deployed, CASE WHEN c.sr > 0 THEN c.params ELSE '(flat)' END AS chosen,
  CASE WHEN c.sr > 0 THEN n.net ELSE 0 END AS net FROM n JOIN g USING (symbol, family) JOIN c ON c.symbol = n.symbol AND c.family = n.family AND c.fold = g.fold AND c.params = n.params
WHERE n.i >= g.a AND n.i < g.b"""


cte("wf_oos", wf_sql("dc_net", 730, 182, 30))


@query("x9_walk_forward_oos", "symbol family fold:i ts:t net:7", "SELECT symbol, family, fold, ts, net FROM wf_oos")
def _x9(t):
    return walkforward.walk_forward(bt.variant_returns(t.bars, ["donchian"]), ["symbol", "family"])[0]


@query("x9_walk_forward_ledger", "symbol family fold:i chosen train_sr:6 deployed:b fold_start:t fold_end:t oos_sr:6 n_test:i", f"""
SELECT symbol, family, fold, chosen, train_sr, deployed, min(ts) AS fold_start, max(ts) AS fold_end, {sharpe_pp('net')} AS oos_sr, count(*) AS n_test
FROM wf_oos GROUP BY symbol, family, fold, chosen, train_sr, deployed""")
def _x9b(t):
    return walkforward.walk_forward(bt.variant_returns(t.bars, ["donchian"]), ["symbol", "family"])[1]


@query("x11_family_portfolios", "family ts:t net:7", """
WITH e AS (SELECT symbol, family, ts, avg(net) AS net FROM all_net GROUP BY 1, 2, 3), c AS (SELECT *, row_number() OVER (PARTITION BY symbol, family ORDER BY ts) AS i FROM e)
SELECT family, ts, avg(net) AS net FROM c WHERE i > 730 GROUP BY 1, 2 HAVING count(*) = 6""")
def _x11b(t):
    return research.family_portfolios(bt.variant_returns(t.bars))


@query("x22_fold_schedule", "fold:i train_end:t val_end:t test_end:t complete:b", "SELECT * FROM folds")
def _x22(t):
    return folds_of(t)


# ---------------- statistics ----------------

cte("capped", "SELECT symbol, ts, ret AS net FROM ret_bars WHERE ret IS NOT NULL")


def capped(t):
    return t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("net")).where("net is not null")


@query("m1_sharpe", "symbol sr:7 sr_ann:6", f"SELECT symbol, {sharpe_pp('net')} AS sr, {sharpe('net')} AS sr_ann FROM capped GROUP BY 1")
def _m1(t):
    return capped(t).groupBy("symbol").agg(metrics.sharpe_pp("net").alias("sr"), metrics.sharpe("net").alias("sr_ann"))


@query("m2_summary", "symbol sharpe:2 cagr_pct:1 ann_vol_pct:1 n_bars:i", _perf("capped", "symbol"))
def _m2(t):
    return metrics.rounded_summary(metrics.summary(capped(t), ["symbol"], "ts"))


@query("m3_max_drawdown", "symbol max_dd:6", f"SELECT symbol, max_dd_pct / 100 AS max_dd FROM ({_perf('capped', 'symbol')})")
def _m3(t):
    return metrics.with_drawdown(capped(t), ["symbol"], "ts", "net").groupBy("symbol").agg(F.min("drawdown").alias("max_dd"))


_EM = expected_max_factor(4)


@query("m4_expected_max_sharpe", "symbol sr_variance:10 n_trials:i e_max:7", f"""
SELECT symbol, v AS sr_variance, n AS n_trials, CASE WHEN v > 0 THEN sqrt(v) * {_EM!r}::DOUBLE ELSE 0 END AS e_max FROM (
 SELECT symbol, var_samp(sr) AS v, count(*) AS n FROM (SELECT symbol, params, {sharpe_pp('net')} AS sr FROM dc_net GROUP BY 1, 2) GROUP BY 1)""")
def _m4(t):
    from tidebar.functions.normal import expected_max_sharpe

    s = research.trial_sharpes(bt.variant_returns(t.bars, ["donchian"]), ["symbol"])
    return metrics.trial_variance(s, ["symbol"]).withColumn("e_max", expected_max_sharpe(4, F.col("sr_variance")))


@query("m5_deflated_sharpe_z", "symbol n:i sr:6 skew:5 ex_kurt:5 z:5", """
WITH m AS (SELECT symbol, count(*) AS n, avg(net) / stddev_samp(net) AS sr, skewness(net) AS skew, kurtosis(net) AS ex_kurt FROM capped GROUP BY 1)
SELECT *, sr * sqrt(CAST(n - 1 AS DOUBLE)) / sqrt(greatest(1 - skew * sr + (ex_kurt + 2) / 4 * sr * sr, 1e-12)) AS z FROM m""")
def _m5(t):
    m = metrics.moments(capped(t), ["symbol"])
    return m.withColumn("z", metrics.deflated_z(m, 1, num(0)))


def normal_cdf_sql(z: str) -> str:
    """The series phi(z) * (z + z^3/3 + z^5/15 + ...), all terms of one sign; DuckDB has no erf."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) + 0.5 * ln(pi()) - (k + 1) * ln(2) - lgamma(k + 1.5))"
    return (
        f"CASE WHEN {z} > 8 THEN 1 WHEN {z} < -8 THEN 0 ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * "
        f"list_sum([{term} for k in range(0, 200)]) END::DOUBLE")


def dsr_sql(n_trials: int, variance: str) -> str:
    """Deflated Sharpe of a row with n, sr, skew and ex_kurt."""
    z = (f"((sr - CASE WHEN {variance} > 0 THEN sqrt({variance}) * {expected_max_factor(n_trials)!r}::DOUBLE ELSE 0 END) * sqrt(CAST(n - 1 AS DOUBLE)) "
         "/ sqrt(greatest(1 - skew * sr + (ex_kurt + 2) / 4 * sr * sr, 1e-12)))")
    return f"CASE WHEN n < 20 THEN 0 ELSE {normal_cdf_sql(z)} END"


def moments_sql(src: str, keys: str) -> str:
    return f"SELECT {keys}, count(net) AS n, {sharpe_pp('net')} AS sr, coalesce(skewness(net), 0) AS skew, coalesce(kurtosis(net), 0) AS ex_kurt FROM {src} GROUP BY {keys}"


@query("m5_deflated_sharpe", "symbol family dsr:5", f"""
WITH e AS (SELECT symbol, family, ts, avg(net) AS net FROM dc_net GROUP BY 1, 2, 3), m AS ({moments_sql('e', 'symbol, family')}),
v AS (SELECT symbol, coalesce(var_samp(sr), 0) AS v FROM (SELECT symbol, params, {sharpe_pp('net')} AS sr FROM dc_net GROUP BY 1, 2) GROUP BY 1)
SELECT symbol, family, {dsr_sql(4, 'v')} AS dsr FROM m JOIN v USING (symbol)""")
def _m5b(t):
    r = bt.variant_returns(t.bars, ["donchian"])
    v = metrics.trial_variance(research.trial_sharpes(r, ["symbol"]), ["symbol"])
    ens = r.groupBy("symbol", "family", "ts").agg(F.avg("net").alias("net"))
    return metrics.deflated_sharpe(metrics.moments(ens, ["symbol", "family"]).join(v, "symbol"), 4, "sr_variance")


cte("fam_port", """
WITH e AS (SELECT symbol, family, ts, avg(net) AS net FROM all_net GROUP BY 1, 2, 3), c AS (SELECT *, row_number() OVER (PARTITION BY symbol, family ORDER BY ts) AS i FROM e)
SELECT family, ts, avg(net) AS net FROM c WHERE i > 730 GROUP BY 1, 2 HAVING count(net) = (SELECT count(DISTINCT symbol) FROM c WHERE i > 730)""")
cte("trial_port", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY symbol, family, params ORDER BY ts) AS i FROM all_net)
SELECT family, params, ts, avg(net) AS net FROM c WHERE i > 730 GROUP BY 1, 2, 3 HAVING count(net) = (SELECT count(DISTINCT symbol) FROM c WHERE i > 730)""")


@query("x11_portfolio_table", "family sharpe:3 cagr_pct:e9 ann_vol_pct:3 max_dd_pct:e9 n_bars:i dsr_n4:4 dsr_n32:4", f"""
WITH m AS ({moments_sql('fam_port', 'family')}),
v AS (SELECT (SELECT coalesce(var_samp(sr), 0) FROM m) AS v4, (SELECT coalesce(var_samp(sr), 0) FROM (SELECT family, params, {sharpe_pp('net')} AS sr FROM trial_port GROUP BY 1, 2)) AS v32)
SELECT p.*, d.dsr_n4, d.dsr_n32 FROM ({_perf('fam_port', 'family')}) p JOIN (
 SELECT family, {dsr_sql(4, 'v4')} AS dsr_n4, {dsr_sql(32, 'v32')} AS dsr_n32 FROM m CROSS JOIN v) d USING (family)""")
def _x11(t):
    from tidebar.session import cut_lineage

    return research.portfolio_table(cut_lineage(bt.variant_returns(t.bars)))


def pbo_sql(src: str, keys: str, variant: str, order: str) -> str:
    half = lambda on: (
        f"SELECT {keys}, m, {variant}, {order}, round(CASE WHEN v > 0 THEN mu / sqrt(v) ELSE 0 END, 10) AS sr FROM (SELECT {keys}, m, {variant}, {order}, s / n AS mu, "
        f"greatest((q - s * s / n) / (n - 1), 0) AS v FROM (SELECT {keys}, m, {variant}, {order}, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM cells JOIN sizes USING ({keys}, b) CROSS JOIN masks "
        f"WHERE (m >> CAST(b - 1 AS INTEGER)) & 1 = {on} GROUP BY {keys}, m, {variant}, {order}))")
    k2 = ", ".join(f"t.{x.strip()}" for x in keys.split(","))
    return f"""
WITH grid AS (SELECT {keys}, ts, ntile(10) OVER (PARTITION BY {keys} ORDER BY ts) AS b FROM (SELECT DISTINCT {keys}, ts FROM {src})),
sizes AS (SELECT {keys}, b, count(*) AS n FROM grid GROUP BY {keys}, b),
cells AS (SELECT {keys}, {variant}, {order}, b, sum(net) AS s, sum(net * net) AS q FROM {src} JOIN grid USING ({keys}, ts) GROUP BY {keys}, {variant}, {order}, b),
masks AS (SELECT m FROM (SELECT unnest(range(1024)) AS m) WHERE bit_count(m) = 5),
tr AS ({half(1)}), te AS ({half(0)}),
best AS (SELECT {keys}, m, arg_max({variant}, row(sr, -{order})) AS v FROM tr GROUP BY {keys}, m),
o AS (SELECT {k2}, t.m, (count(CASE WHEN t.sr < b.sr THEN 1 END) + 0.5 * count(CASE WHEN t.sr = b.sr THEN 1 END)) / count(*) AS omega
 FROM te t JOIN (SELECT te.* FROM te JOIN best ON {' AND '.join(f'te.{x.strip()} = best.{x.strip()}' for x in keys.split(','))} AND te.m = best.m AND te.{variant} = best.v) b
 ON {' AND '.join(f't.{x.strip()} = b.{x.strip()}' for x in keys.split(','))} AND t.m = b.m GROUP BY {k2}, t.m)
SELECT {keys}, count(*) AS n_splits, avg(CAST(omega < 0.5 AS DOUBLE)) AS pbo FROM o GROUP BY {keys}"""


@query("m6_pbo", "symbol family n_splits:i pbo:6", pbo_sql("all_net", "symbol, family", "params", "grid_order"))
def _m6(t):
    return metrics.pbo(bt.variant_returns(t.bars), ["symbol", "family"], "params", "grid_order", "ts", "net")


@query("j13_block_combinations", "symbol n_splits:i pbo:6", pbo_sql("dc_net", "symbol", "params", "grid_order"))
def _j13(t):
    return metrics.pbo(bt.variant_returns(t.bars, ["donchian"]), ["symbol"], "params", "grid_order", "ts", "net")


@query("m7_block_bootstrap", "symbol p2_5:e6 p10:e6 p50:e6 p90:e6 p97_5:e6 n_paths:i", block_band_sql("capped", "symbol", "ts", "net", 25))
def _m7(t):
    return bootstrap.block_band(capped(t), ["symbol"], "ts", "net", horizon=25)


cte("labelled", """
SELECT event_type, CAST(value > 60 AS INTEGER) AS y, round(least(0.999, (user_id % 50) / 100.0 + CASE WHEN value > 60 THEN 0.2 ELSE 0 END + (event_id % 30) / 100.0), 3) AS p FROM events""")


def labelled(t):
    y = (F.col("value") > 60).cast("int")
    p = (F.col("user_id") % 50) / num(100) + F.when(F.col("value") > 60, num(0.2)).otherwise(num(0)) + (F.col("event_id") % 30) / num(100)
    return t.events.select("event_type", y.alias("y"), F.round(F.least(num(0.999), p), 3).alias("p"))


@query("m9_average_precision", "event_type n:i pr_auc:7 brier:7", """
WITH l AS (SELECT event_type, p, count(*) AS n, sum(y) AS pos FROM labelled GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER k AS cn, sum(pos) OVER k AS cp FROM l WINDOW k AS (PARTITION BY event_type ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT c.event_type, sum(n) AS n, sum(pos * cp / cn) / sum(pos) AS pr_auc, any_value(b.brier) AS brier FROM c
JOIN (SELECT event_type, avg((p - y) * (p - y)) AS brier FROM labelled GROUP BY 1) b USING (event_type) GROUP BY 1""")
def _m9(t):
    return metrics.average_precision(labelled(t), ["event_type"], "y", "p")


cte("hold_net", backtest("(SELECT symbol, ts, 1.0 AS pos FROM bars)"))
cte("ens_hold", "SELECT e.symbol, e.ts, e.a, h.net AS b FROM (SELECT symbol, ts, avg(net) AS a FROM dc_net GROUP BY 1, 2) e JOIN hold_net h USING (symbol, ts)")


_MARKET = "symbol, family"
cte("wf_all", wf_sql("all_net", 730, 182, 30))
_by_family = " ".join(f"WHEN '{f}' THEN {dsr_sql(n, 'vf')}" for f, n in grids.FAMILY_SIZES.items())


@query("x10_market_table", "symbol family full_best_sharpe:3 oos_sharpe:3 oos_cagr_pct:e9 oos_max_dd_pct:e9 n_oos:i dsr:4 dsr_all:4 pbo:4 deployed_frac:4 ens_oos_sharpe:3 ens_oos_max_dd_pct:e9 bh_oos_sharpe:3 family_gate:b", f"""
WITH t AS (SELECT {_MARKET}, params, {sharpe_pp('net')} AS sr FROM all_net GROUP BY {_MARKET}, params),
b AS (SELECT {_MARKET}, max(sr) * sqrt(365.0) AS full_best_sharpe, coalesce(var_samp(sr), 0) AS vf FROM t GROUP BY {_MARKET}),
a AS (SELECT symbol, coalesce(var_samp(sr), 0) AS va FROM t GROUP BY symbol),
o AS (SELECT {_MARKET}, sharpe AS oos_sharpe, cagr_pct AS oos_cagr_pct, max_dd_pct AS oos_max_dd_pct, n_bars AS n_oos FROM ({_perf('wf_all', _MARKET)})),
m AS ({moments_sql('wf_all', _MARKET)}),
d AS (SELECT {_MARKET}, CASE family {_by_family} END AS dsr, {dsr_sql(grids.TOTAL_TRIALS, 'va')} AS dsr_all FROM m JOIN b USING ({_MARKET}) JOIN a USING (symbol)),
p AS ({pbo_sql('all_net', _MARKET, 'params', 'grid_order')}),
f AS (SELECT {_MARKET}, avg(CAST(deployed AS DOUBLE)) AS deployed_frac FROM (SELECT DISTINCT {_MARKET}, fold, deployed FROM wf_all) GROUP BY {_MARKET}),
n AS (SELECT {_MARKET}, ts, avg(net) AS net FROM all_net SEMI JOIN wf_all USING ({_MARKET}, ts) GROUP BY {_MARKET}, ts),
e AS (SELECT {_MARKET}, sharpe AS ens_oos_sharpe, max_dd_pct AS ens_oos_max_dd_pct FROM ({_perf('n', _MARKET)})),
h AS (SELECT w.symbol, w.family, {sharpe('h.net')} AS bh_oos_sharpe FROM wf_all w JOIN hold_net h ON h.symbol = w.symbol AND h.ts = w.ts GROUP BY 1, 2)
SELECT *, oos_sharpe > 0 AND dsr >= {research.GATE_DSR} AS family_gate FROM b JOIN o USING ({_MARKET}) JOIN d USING ({_MARKET}) JOIN p USING ({_MARKET})
JOIN f USING ({_MARKET}) JOIN e USING ({_MARKET}) JOIN h USING ({_MARKET})""")
def _x10(t):
    from tidebar.session import cut_lineage

    # seven branches read the trials table: written once to the shared folder
    return research.market_table(t.bars, cut_lineage(bt.variant_returns(t.bars)))


@query("m10_paired_bootstrap", "symbol n:i sharpe_diff:6 sharpe_p:3 mean_diff:7 mean_p:3", paired_sql("ens_hold", "symbol", "ts"))
def _m10(t):
    pair = bt.variant_returns(t.bars, ["donchian"])
    ens = pair.groupBy("symbol", "ts").agg(F.avg("net").alias("a"))
    hold = bt.run(t.bars, signals.buy_and_hold(t.bars)).select("symbol", "ts", F.col("net").alias("b"))
    return bootstrap.paired_test(ens.join(hold, ["symbol", "ts"]), ["symbol"], "ts", "a", "b")


@query("m11_downside", "symbol sortino:5 es_pct:5", """
SELECT c.symbol, avg(net) / stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(365.0) AS sortino, 100 * avg(CASE WHEN net <= qq THEN net END) AS es_pct
FROM capped c JOIN (SELECT symbol, quantile_cont(net, 0.05) AS qq FROM capped GROUP BY 1) z USING (symbol) GROUP BY 1""")
def _m11(t):
    return metrics.downside(capped(t), ["symbol"])


# Max-min formula: the fit at a score is the largest, over starts at or below it, of the smallest mean from the start
# to an end at or above it. Sums are whole numbers, so equal means are equal doubles and name a pool.
cte("iso_pools", """
WITH l AS (SELECT event_type, p, count(*) AS n, sum(y) AS pos FROM labelled WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(n) OVER k AS BIGINT) AS cn, CAST(sum(pos) OVER k AS BIGINT) AS cp, row_number() OVER k AS i FROM l
 WINDOW k AS (PARTITION BY event_type ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT s.event_type, s.i AS j, e.i, CAST(e.cp - s.cp + s.pos AS DOUBLE) / (e.cn - s.cn + s.n) AS mean FROM c s JOIN c e ON e.event_type = s.event_type AND e.i >= s.i),
b AS (SELECT event_type, j, i, min(mean) OVER (PARTITION BY event_type, j ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM a),
f AS (SELECT event_type, i, max(low) AS value FROM b GROUP BY 1, 2)
SELECT event_type, min(p) AS lo, max(p) AS hi, sum(n) AS w, value FROM f JOIN c USING (event_type, i)
WHERE event_type IN (SELECT event_type FROM labelled WHERE p IS NOT NULL GROUP BY 1 HAVING sum(y) >= 10) GROUP BY event_type, value""")


@query("m12_isotonic_pools", "event_type lo:3 hi:3 w:1 value:6", "SELECT * FROM iso_pools")
def _m12(t):
    from tidebar.operators.models import isotonic_pools

    return isotonic_pools(labelled(t), ["event_type"], "p", "y")


@query("m12_calibrated_scores", "event_type n:i mean_p:6 mean_y:6", """
SELECT l.event_type, count(*) AS n, avg(value) AS mean_p, avg(y) AS mean_y FROM labelled l JOIN iso_pools i ON i.event_type = l.event_type AND l.p BETWEEN lo AND hi GROUP BY 1""")
def _m12b(t):
    from tidebar.functions.columns import interpolate
    from tidebar.operators.models import isotonic_breakpoints, isotonic_pools

    d = labelled(t)
    pts = isotonic_breakpoints(isotonic_pools(d, ["event_type"], "p", "y"), ["event_type"])
    j = d.join(F.broadcast(pts), "event_type").withColumn("cal", interpolate(F.col("p"), F.col("xs"), F.col("ys")))
    return j.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("cal").alias("mean_p"), F.avg("y").alias("mean_y"))


# ---------------- registries ----------------


@query("e1_registered_strategy", f"{K} weight:6", "SELECT symbol, ts, avg(pos) / 3.0 AS weight FROM variant_pos WHERE family = 'tsmom' GROUP BY 1, 2")
def _e1(t):
    return registry.strategy("tsmom_ensemble")(t.bars)


@query("e2_family_registry", "family n_params:i n_held:i", """
SELECT family, count(DISTINCT params) AS n_params, count(CASE WHEN pos > 0 THEN 1 END) AS n_held FROM variant_pos GROUP BY 1""")
def _e2(t):
    p = signals.positions(t.bars)
    return p.groupBy("family").agg(F.countDistinct("params").alias("n_params"), F.count_if(F.col("pos") > 0).alias("n_held"))


_PRE = "(SELECT i.*, c.* FROM bt_in i CROSS JOIN (VALUES " + ", ".join(f"('{n}', {f}::DOUBLE, {s}::DOUBLE)" for n, f, s in grids.COST_PRESETS) + ") AS c(cost_name, fee_bps, floor_bps))"


@query("e3_cost_presets", "symbol cost_name total_cost:6 sharpe:5", f"""
SELECT symbol, cost_name, sum(cost) AS total_cost, {sharpe('net')} AS sharpe FROM (
 SELECT *, gross - cost AS net FROM (SELECT *, held * ret AS gross, turnover * (fee_bps + greatest(coalesce(dvol * sqrt(10000.0 / nullif(ddv, 0)) * 10000.0, floor_bps), floor_bps)) / 10000.0 AS cost FROM
 (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY symbol, cost_name ORDER BY ts), 0)) AS turnover FROM
 (SELECT i.*, coalesce(lag(p.pos) OVER (PARTITION BY i.symbol, cost_name ORDER BY i.ts), 0) AS held FROM {_PRE} i JOIN ({donchian_pos(20, 10)}) p ON p.symbol = i.symbol AND p.ts = i.ts)))) GROUP BY 1, 2""")
def _e3(t):
    inputs, fee, floor = registry.cost_dimension(bt.bar_inputs(t.bars).select("symbol", "ts", "ret", "daily_vol", "dollar_volume"))
    pos = signals.single(t.bars, "donchian", n_entry=20, n_exit=10)
    rows = inputs.withColumnRenamed("cost", "cost_name").join(pos, ["symbol", "ts"])
    net = bt.account(rows, ["symbol", "cost_name"], fee, floor)
    return net.groupBy("symbol", "cost_name").agg(F.sum("cost").alias("total_cost"), metrics.sharpe("net").alias("sharpe"))


@query("e5_book_models", "book symbol n:i weight:5", """
SELECT CASE family WHEN 'donchian' THEN 'donchian_ensemble' ELSE 'tsmom_ensemble' END AS book, symbol, count(DISTINCT ts) AS n, avg(pos) AS weight
FROM variant_pos WHERE family IN ('donchian', 'tsmom') GROUP BY 1, 2""")
def _e5(t):
    p = signals.positions(t.bars, ["donchian", "tsmom"]).join(F.broadcast(grids.books(t.spark)), "family")
    return p.groupBy("book", "symbol").agg(F.countDistinct("ts").alias("n"), F.avg("pos").alias("weight"))


@query("a18_block_increments", "block:i increment:7 n_days:i", """
WITH a AS (SELECT ts, avg(net) AS net FROM dc_net GROUP BY ts), b AS (SELECT ts, avg(ret) AS net FROM bt_in GROUP BY ts),
d AS (SELECT a.net - b.net AS diff, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM a JOIN b USING (ts)),
z AS (SELECT *, greatest(1, n // 182) AS k FROM d), y AS (SELECT *, n // k AS qq, n % k AS rr FROM z)
SELECT CASE WHEN i < rr * (qq + 1) THEN i // (qq + 1) ELSE rr + (i - rr * (qq + 1)) // qq END AS block, avg(diff) AS increment, count(*) AS n_days FROM y GROUP BY 1""")
def _a18(t):
    from tidebar.plans.portfolio import block_increments

    a = bt.variant_returns(t.bars, ["donchian"]).groupBy(F.col("ts").alias("date")).agg(F.avg("net").alias("net"))
    b = bt.bar_inputs(t.bars).groupBy(F.col("ts").alias("date")).agg(F.avg("ret").alias("net"))
    return block_increments(a, b)


@query("x30_frozen_baseline", "family n_days:i first_day:t last_day:t mu_d:8 sd_d:8", """
WITH e AS (SELECT symbol, family, ts, avg(net) AS net FROM dc_net GROUP BY 1, 2, 3), c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM e),
p AS (SELECT family, ts, avg(net) AS net FROM c WHERE i > 730 GROUP BY 1, 2 HAVING count(*) = 6)
SELECT family, count(*) AS n_days, min(ts) AS first_day, max(ts) AS last_day, avg(net) AS mu_d, stddev_samp(net) AS sd_d FROM p GROUP BY 1""")
def _x30(t):
    from tidebar.plans import review
    from tidebar.session import scratch_path

    path = scratch_path(t.spark, "x30")
    review.freeze_baseline(research.family_portfolios(bt.variant_returns(t.bars, ["donchian"])), path)
    return review.baseline_meta(review.load_baseline(t.spark, path), ["family"])


