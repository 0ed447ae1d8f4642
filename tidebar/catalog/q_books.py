"""Ledger, risk rule, portfolio, ranker and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import cte, query
from tidebar.catalog.q_features import classifier, score_cols, score_sql
from tidebar.catalog.q_tables import K
from tidebar.catalog.tables_sql import asof, block_band_sql, donchian_pos, sharpe, win as sqlwin
from tidebar.functions.columns import num
from tidebar.functions.times import plus_days
from tidebar.operators import aggregates, bootstrap, joins, models, selection
from tidebar.operators import windows as win
from tidebar.plans import ledger, portfolio, review, risk, universe, walkforward
from tidebar.plans.signals import single
from tidebar.session import scratch_path

UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

# ---------------- universe and ranker ----------------

ADV_FLOOR, TOP, BARS, MEMBERS = 80_000.0, 40, 60, 20
cte("wgrid", "SELECT date, row_number() OVER (ORDER BY date) AS g FROM (SELECT DISTINCT date FROM panel_w)")
_RS = "(CASE WHEN g - min(g) {f} = {n} - 1 AND count(ret) {f} = {n} THEN {fn} {f} END)"


def _grid(fn: str, n: int) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return _RS.format(f=f, n=n, fn=fn)


cte("ranker", f"""
WITH a AS (SELECT p.*, g, c.n AS n_bars FROM panel_w p JOIN wgrid USING (date) JOIN (SELECT symbol, ts, row_number() {sqlwin()} AS n FROM wbars) c ON c.symbol = p.symbol AND c.ts = p.date),
b AS (SELECT *, CASE WHEN lag(g) OVER s = g - 1 THEN ln(close) - lag(ln(close)) OVER s END AS ret, CASE WHEN lead(g) OVER s = g + 1 THEN lead(close) OVER s / close - 1 END AS ret_next
 FROM a WINDOW s AS (PARTITION BY symbol ORDER BY date)),
c AS (SELECT *, {_grid('stddev_samp(ret)', 20)} AS sigma20, {_grid('sum(ret)', 21)} AS mom21, adv30 >= {ADV_FLOOR} AND rank <= {TOP} AND n_bars >= {BARS} AS m FROM b),
d AS (SELECT *, m AND count(CASE WHEN m THEN 1 END) OVER (PARTITION BY date) >= {MEMBERS} AS member FROM c),
e AS (SELECT *, median(CASE WHEN member THEN ret_next END) OVER (PARTITION BY date) AS med FROM d)
SELECT date, symbol, close, dollar_vol, adv30, rank, n_bars, ret, sigma20, mom21, member, ret_next,
 CASE WHEN member AND ret_next IS NOT NULL THEN CAST(ret_next > med AS DOUBLE) END AS label,
 (10.0 + greatest(coalesce(sigma20 * sqrt(10000.0 / nullif(dollar_vol, 0)) * 10000.0, 1.0), 1.0)) / 10000.0 AS cost_rate FROM e""")


def ranker(t, written: bool = False):
    p = universe.ranker_panel(t.wbars, MEMBERS, ADV_FLOOR, TOP, BARS)
    if not written:
        return p
    path = scratch_path(t.spark, "ranker")
    p.write.parquet(path)
    return t.spark.read.parquet(path)


@query("x17_ranker_panel", "date:t symbol rank:i n_bars:i ret:7 sigma20:7 mom21:6 member:b ret_next:6 label:1 cost_rate:8", "SELECT * FROM ranker")
def _x17(t):
    return ranker(t)


cte("channels", "SELECT *, CASE WHEN sigma20 IS NOT NULL THEN ret / greatest(sigma20, 0.5) END AS z FROM ranker")


@query("x18_return_channels", "date:t symbol z:6 z_rank:7", """
SELECT date, symbol, z, CASE WHEN member AND z IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY CASE WHEN member THEN z END NULLS LAST)
 + (count(*) OVER (PARTITION BY date, CASE WHEN member THEN z END) - 1) / 2.0) / count(CASE WHEN member THEN z END) OVER (PARTITION BY date) END AS z_rank FROM channels""")
def _x18(t):
    return universe.return_channels(ranker(t), 0.5)


cte("picks_r0", "SELECT date, symbol, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM ranker WHERE member")
cte("band_w", """
WITH r AS (SELECT date, symbol, member, mom21, CASE WHEN member AND mom21 IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY CASE WHEN member THEN mom21 END DESC NULLS LAST, symbol) END AS rk FROM ranker),
c AS (SELECT d.date, s.symbol, r.rk, coalesce(r.member AND r.mom21 > 0, FALSE) AS sure FROM (SELECT DISTINCT date FROM ranker) d CROSS JOIN (SELECT DISTINCT symbol FROM ranker) s LEFT JOIN r ON r.date = d.date AND r.symbol = s.symbol),
e AS (SELECT *, CASE WHEN NOT sure OR rk > 10 THEN 0 WHEN rk <= 5 THEN 1 END AS ev FROM c),
h AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM e)
SELECT date, symbol, rk AS rank, 0.2::DOUBLE AS weight FROM h WHERE held = 1""")


@query("x27_rank_band", "date:t symbol rank:i weight:4", "SELECT * FROM band_w")
def _x27(t):
    return portfolio.rank_band(ranker(t, True), "mom21", F.col("mom21") > 0)


def account_sql(weights: str, scale: str = "1", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    p = f"PARTITION BY {k}symbol ORDER BY date"
    return f"""
WITH g AS (SELECT DISTINCT date FROM ranker), s AS (SELECT DISTINCT {k}symbol FROM {weights}),
c AS (SELECT {k}symbol, date, coalesce(w.weight, 0) AS w, ret_next, cost_rate * {scale} AS rate FROM s CROSS JOIN g LEFT JOIN {weights} w USING ({k}symbol, date) LEFT JOIN ranker r USING (symbol, date)),
d AS (SELECT *, coalesce(CASE WHEN lag(ret_next) OVER ({p}) IS NOT NULL THEN lag(w) OVER ({p}) END, 0) AS prev FROM c)
SELECT {k}date, sum(w * coalesce(ret_next, 0)) AS gross, sum(abs(w - prev)) AS turnover,
 sum(abs(w - prev) * coalesce(rate, 0.0011 * {scale}) + CASE WHEN w <> 0 AND ret_next IS NULL THEN abs(w) * coalesce(rate, 0.0011 * {scale}) ELSE 0 END) AS cost,
 count(CASE WHEN w <> 0 AND ret_next IS NOT NULL THEN 1 END) AS n_held FROM d WHERE w <> 0 OR prev <> 0 GROUP BY {k}date"""


def account(weights, p, **more):
    """The account of weights of members: no other symbol's rates are read."""
    return portfolio.holdings_account(weights, universe.member_series(p), calendar=p, **more)


_ACC = "date:t gross:7 cost:7 turnover:6 n_held:i net:7"


@query("x26_holdings_account", _ACC, f"SELECT *, gross - cost AS net FROM ({account_sql('band_w')})")
def _x26(t):
    p = ranker(t, True)
    return account(portfolio.rank_band(p, "mom21", F.col("mom21") > 0), p)


@query("x28_equal_weight_members", _ACC, f"SELECT *, gross - cost AS net FROM ({account_sql('picks_r0')})")
def _x28(t):
    p = ranker(t, True)
    return account(portfolio.equal_weight_members(p), p)


@query("m15_cost_stress", "cost_scale:1 days:i net:6 cost:6", f"""
SELECT 1.0 AS cost_scale, count(*) AS days, sum(gross - cost) AS net, sum(cost) AS cost FROM ({account_sql('band_w')})
UNION ALL SELECT 2.0, count(*), sum(gross - cost), sum(cost) FROM ({account_sql('band_w', '2')})""".replace("AS days", "AS \"days\""))
def _m15(t):
    p = ranker(t, True)
    s = portfolio.cost_stress(portfolio.rank_band(p, "mom21", F.col("mom21") > 0).drop("rank"), universe.member_series(p), calendar=p)
    return s.groupBy("cost_scale").agg(F.count(F.lit(1)).alias("days"), F.sum("net").alias("net"), F.sum("cost").alias("cost"))


@query("m15_turnover_rule", "gross_edge:8 net_edge:8 incremental_cost:8 passes:b", f"""
SELECT ge AS gross_edge, ne AS net_edge, ge - ne AS incremental_cost, NOT (ge > 0 AND ge - ne > 0.5 * ge) AS passes FROM (
 SELECT avg(a.gross - b.gross) AS ge, avg((a.gross - a.cost) - (b.gross - b.cost)) AS ne FROM ({account_sql('band_w')}) a JOIN ({account_sql('picks_r0')}) b USING (date))""")
def _m15b(t):
    p = ranker(t, True)
    a = account(portfolio.rank_band(p, "mom21", F.col("mom21") > 0), p)
    return portfolio.turnover_rule(a, account(portfolio.equal_weight_members(p), p))


cte("picks_ls", """
WITH v AS (SELECT date, symbol, mom21 AS score, row_number() OVER (PARTITION BY date ORDER BY mom21 DESC, symbol) AS r, row_number() OVER (PARTITION BY date ORDER BY mom21, symbol DESC) AS q
 FROM ranker WHERE member AND mom21 IS NOT NULL),
l AS (SELECT date, symbol, score, r AS rank, 0.1::DOUBLE AS weight FROM v WHERE r <= 5 AND score >= 0)
SELECT * FROM l UNION ALL SELECT date, symbol, score, q, -0.1::DOUBLE FROM v WHERE q <= 5 AND score <= 0 AND CAST(substring(symbol, 2) AS INTEGER) % 2 = 0
 AND NOT EXISTS (SELECT 1 FROM l WHERE l.date = v.date AND l.symbol = v.symbol)""")


def picks(t, p):
    short = t.supplier.where(F.col("s_suppkey") % 2 == 0).select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("symbol"))
    scores = p.where("member").select("date", "symbol", F.col("mom21").alias("score"))
    return selection.long_short_picks(scores, "date", "symbol", "score", short, neutral=0.0)


@query("o7_long_short_picks", "date:t symbol rank:i weight:3", "SELECT * FROM picks_ls")
def _o7(t):
    return picks(t, ranker(t, True))


@query("x26_long_short_account", _ACC, f"SELECT *, gross - cost AS net FROM ({account_sql('picks_ls')})")
def _x26b(t):
    p = ranker(t, True)
    return account(picks(t, p), p)


@query("a15_concentration", "max_share:7", """
SELECT coalesce(max(CASE WHEN c > 0 THEN c END) / sum(CASE WHEN c > 0 THEN c END), 0) AS max_share FROM (
 SELECT symbol, sum(weight * ret_next) AS c FROM band_w JOIN ranker USING (date, symbol) WHERE ret_next IS NOT NULL GROUP BY 1)""")
def _a15(t):
    p = ranker(t, True)
    c = portfolio.contributions(portfolio.rank_band(p, "mom21", F.col("mom21") > 0), p)
    return aggregates.concentration(c, [], "symbol", "contribution")


_LOG = """(SELECT 'R1LS' AS variant, date AS decision_ts, symbol, weight FROM picks_ls UNION ALL SELECT 'LS', date, symbol, -weight FROM picks_ls WHERE date < TIMESTAMP '2001-06-01')"""


@query("x25_holdings_state", "variant symbol side weight:3", f"""
SELECT variant, symbol, CASE WHEN weight > 0 THEN 'long' ELSE 'short' END AS side, weight FROM {_LOG} l
WHERE decision_ts = (SELECT max(decision_ts) FROM {_LOG} m WHERE m.variant = l.variant)""")
def _x25(t):
    return portfolio.last_holdings(_log(t, ranker(t, True)))


def _log(t, p):
    a = picks(t, p).select(F.lit("R1LS").alias("variant"), F.col("date").alias("decision_ts"), "symbol", "weight")
    b = a.where("decision_ts < timestamp '2001-06-01'").withColumns({"variant": F.lit("LS"), "weight": -F.col("weight")})
    return a.unionByName(b)


@query("x25_log_rows", "variant symbol weight:3", f"""
WITH o AS (SELECT variant, symbol FROM {_LOG} l WHERE decision_ts = (SELECT max(decision_ts) FROM {_LOG} m WHERE m.variant = l.variant)),
n AS (SELECT 'LS' AS variant, symbol, weight FROM picks_ls WHERE date = (SELECT max(date) FROM picks_ls WHERE date < TIMESTAMP '2001-09-01'))
SELECT variant, symbol, coalesce(weight, 0) AS weight FROM o FULL JOIN n USING (variant, symbol)""")
def _x25b(t):
    p = ranker(t, True)
    pk = picks(t, p).where("date < timestamp '2001-09-01'")
    last = pk.agg(F.max("date").alias("date"))
    new = pk.join(F.broadcast(last), "date").select(F.lit("LS").alias("variant"), "symbol", "weight")
    return portfolio.log_rows(_log(t, p), new)


_RANK = ["z", "z1", "z2", "z3", "z4", "z_rank"]
cte("rank_rows", """
WITH r AS (SELECT *, CASE WHEN member AND z IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY CASE WHEN member THEN z END NULLS LAST)
  + (count(*) OVER (PARTITION BY date, CASE WHEN member THEN z END) - 1) / 2.0) / count(CASE WHEN member THEN z END) OVER (PARTITION BY date) END AS z_rank FROM channels),
l AS (SELECT *, lag(z, 1) OVER s AS z1, lag(z, 2) OVER s AS z2, lag(z, 3) OVER s AS z3, lag(z, 4) OVER s AS z4 FROM r WHERE z IS NOT NULL WINDOW s AS (PARTITION BY symbol ORDER BY date)),
m AS (SELECT * FROM l WHERE z4 IS NOT NULL AND member), b AS (SELECT min(date) AS t0, max(date) AS t_end FROM m),
f AS (SELECT k AS fold, t0 + to_days(CAST(730 + 182 * k AS INTEGER)) AS train_end, t0 + to_days(CAST(912 + 182 * k AS INTEGER)) AS val_end,
  least(t0 + to_days(CAST(1094 + 182 * k AS INTEGER)), t_end) AS test_end FROM b, (SELECT unnest(range(60)) AS k)
 WHERE t0 + to_days(CAST(912 + 182 * k AS INTEGER)) < t_end - INTERVAL 30 DAY)
SELECT m.*, label AS y, fold, CASE WHEN date <= train_end - INTERVAL 5 DAY THEN 'train' WHEN date > val_end AND date <= test_end THEN 'test' END AS split FROM m JOIN f ON date <= test_end""")


@query("m14_ranker_classifier", score_cols(_RANK), score_sql("rank_rows", _RANK))
def _m14(t):
    p = universe.return_channels(universe.member_series(ranker(t, True)), 0.5).where("z is not null")
    w = win.series("symbol", order="date")
    p = p.withColumns({f"z{k}": F.lag("z", k).over(w) for k in range(1, 5)}).where("z4 is not null and member")
    path = scratch_path(t.spark, "ranker-rows")  # few rows, read by every step of the fits
    p.write.parquet(path)
    p = t.spark.read.parquet(path)
    bounds = p.agg(F.min("date").alias("t0"), F.max("date").alias("t_end"))
    g = walkforward.split_rows(p, walkforward.fold_schedule(bounds, 730), "date")
    return classifier(g, _RANK, "label")


# ---------------- ledger ----------------

CAPITAL = 1_000_000.0
cte("flow_t", "SELECT *, CASE WHEN side = 'buy' THEN -notional - fee ELSE notional - fee END AS cash_flow, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS qty_flow FROM trades")


@query("x12_ledger_positions", "book symbol qty:6", "SELECT book, symbol, sum(qty_flow) AS qty FROM flow_t GROUP BY 1, 2 HAVING abs(sum(qty_flow)) > 1e-12")
def _x12(t):
    return ledger.positions_now(t.trades, ["book"])


@query("x12_running_book", "trade_id:i book cash:6 position:4", f"""
SELECT trade_id, book, {CAPITAL} + sum(cash_flow) OVER (PARTITION BY book ORDER BY ts, trade_id {UP}) AS cash,
 sum(qty_flow) OVER (PARTITION BY book, symbol ORDER BY ts, trade_id {UP}) AS position FROM flow_t""")
def _x12b(t):
    return ledger.running_book(t.trades, ["book"], ["ts", "trade_id"], CAPITAL)


cte("equity_d", f"""
WITH d AS (SELECT DISTINCT book, day FROM flow_t), s AS (SELECT DISTINCT book, symbol FROM flow_t),
f AS (SELECT book, symbol, day, sum(qty_flow) AS q FROM flow_t GROUP BY 1, 2, 3),
h AS (SELECT d.book, s.symbol, d.day, sum(coalesce(q, 0)) OVER (PARTITION BY d.book, s.symbol ORDER BY d.day {UP}) AS qty FROM d JOIN s USING (book) LEFT JOIN f ON f.book = d.book AND f.symbol = s.symbol AND f.day = d.day),
v AS (SELECT h.*, m.price FROM h ASOF LEFT JOIN (SELECT symbol, session_date AS day, close / 1000.0::DOUBLE AS price FROM sessions) m ON m.symbol = h.symbol AND h.day >= m.day),
c AS (SELECT book, day, {CAPITAL} + sum(sum(cash_flow)) OVER (PARTITION BY book ORDER BY day {UP}) AS cash FROM flow_t GROUP BY 1, 2)
SELECT c.book, c.day, c.cash, x.positions_value, c.cash + x.positions_value AS equity FROM c JOIN
(SELECT book, day, sum(CASE WHEN abs(qty) > 1e-12 THEN qty * coalesce(price, 0) ELSE 0 END) AS positions_value FROM v GROUP BY 1, 2) x USING (book, day)""")


def marks(t):
    return t.sessions.select("symbol", F.col("session_date").cast("timestamp").alias("day"), (F.col("close") / num(1000)).alias("price"))


def equity(t):
    tr = t.trades.withColumn("day", F.col("day").cast("timestamp"))
    return ledger.daily_equity(tr, marks(t), ["book"], CAPITAL)


@query("x12_daily_equity", "book day:t cash:6 positions_value:6 equity:6", "SELECT * FROM equity_d")
def _x12c(t):
    return equity(t)


_LASTPX = "(SELECT symbol, arg_max(close, session_date) / 1000.0::DOUBLE AS price FROM sessions GROUP BY 1)"


@query("x12_book_weights", "book symbol qty:4 value:3 weight:7", f"""
WITH p AS (SELECT book, symbol, sum(qty_flow) AS qty FROM flow_t GROUP BY 1, 2), c AS (SELECT book, {CAPITAL} + sum(cash_flow) AS cash FROM flow_t GROUP BY 1),
v AS (SELECT p.*, qty * coalesce(price, 0) AS value FROM p LEFT JOIN {_LASTPX} USING (symbol) WHERE abs(qty) > 1e-12),
e AS (SELECT book, cash + coalesce((SELECT sum(value) FROM v WHERE v.book = c.book), 0) AS equity FROM c)
SELECT v.*, CASE WHEN equity <= 0 THEN 0 ELSE value / equity END AS weight FROM v JOIN e USING (book)""")
def _x12d(t):
    px = t.sessions.groupBy("symbol").agg((F.max_by("close", "session_date") / num(1000)).alias("price"))
    pos = ledger.positions_now(t.trades, ["book"])
    return ledger.book_weights(pos, px, ledger.cash_now(t.trades, ["book"], CAPITAL), ["book"])


@query("a14_book_status", "book as_of:t equity:3 return_pct:4 cash:3 n_positions:i", f"""
SELECT e.book, e.day AS as_of, e.equity, 100 * (e.equity / {CAPITAL} - 1) AS return_pct, c.cash, p.n AS n_positions FROM equity_d e
JOIN (SELECT book, {CAPITAL} + sum(cash_flow) AS cash FROM flow_t GROUP BY 1) c USING (book)
JOIN (SELECT book, count(*) AS n FROM (SELECT book, symbol FROM flow_t GROUP BY 1, 2 HAVING abs(sum(qty_flow)) > 1e-12) GROUP BY 1) p USING (book)
WHERE e.day = (SELECT max(day) FROM equity_d x WHERE x.book = e.book)""")
def _a14(t):
    return review.book_status(equity(t), ledger.cash_now(t.trades, ["book"], CAPITAL), ledger.positions_now(t.trades, ["book"]), ["book"], CAPITAL)


@query("x13_rebalance_plan", f"{K} current:6 target:6 side", f"""
SELECT symbol, ts, cur AS current, tgt AS target, CASE WHEN tgt < cur THEN 'sell' ELSE 'buy' END AS side FROM (
 SELECT a.symbol, a.ts, a.pos * 0.3 AS tgt, b.pos * 0.25 AS cur FROM ({donchian_pos(20, 10)}) a JOIN ({donchian_pos(55, 27)}) b USING (symbol, ts)) WHERE abs(tgt - cur) > 0.02""")
def _x13(t):
    a = single(t.bars, "donchian", n_entry=20, n_exit=10).select("symbol", "ts", (F.col("pos") * num(0.3)).alias("target"))
    b = single(t.bars, "donchian", n_entry=55, n_exit=27).select("symbol", "ts", (F.col("pos") * num(0.25)).alias("weight"))
    return ledger.rebalance_plan(a, b, ["ts"])


@query("o8_sells_first", "ts:t seq:i symbol side", f"""
SELECT ts, row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN tgt < cur THEN 0 ELSE 1 END, symbol) AS seq, symbol, CASE WHEN tgt < cur THEN 'sell' ELSE 'buy' END AS side FROM (
 SELECT a.symbol, ts, a.pos * 0.3 AS tgt, b.pos * 0.25 AS cur FROM ({donchian_pos(20, 10)}) a JOIN ({donchian_pos(55, 27)}) b USING (symbol, ts)) WHERE abs(tgt - cur) > 0.02""")
def _o8(t):
    from pyspark.sql import Window as W

    plan = _x13(t)
    first = F.when(F.col("side") == "sell", 0).otherwise(1)
    # a day's plan holds at most one row per symbol of the book
    return ledger.ordered_plan(plan, ["symbol"]).withColumn("seq", F.row_number().over(W.partitionBy("ts").orderBy(first, "symbol")))


# ---------------- risk rules ----------------

cte("gate_f", """
SELECT day, asset, sum(net_flow_usd_m) AS net_usd_m, count(*) AS n_rows, count(CASE WHEN net_flow_usd_m < 0 THEN 1 END) AS n_out,
 CASE WHEN -sum(net_flow_usd_m) >= 1000 THEN 'halve' WHEN -sum(net_flow_usd_m) >= 300 THEN 'block' END AS action FROM flow_last5 WHERE asset IN ('click', 'purchase') GROUP BY 1, 2 HAVING count(*) >= 3""")
# the two event types that stand for the gated assets
GATED = ("click", "purchase")


@query("x15_flow_gate", "day:t asset net_usd_m:3 n_rows:i n_out:i action", "SELECT * FROM gate_f")
def _x15(t):
    return risk.flow_gate(t.flows.select(plus_days("date", 1).alias("day")), t.flows, assets=GATED)


_EV = "(SELECT 'E' || event_id AS name, ts AS utc FROM events WHERE value > 350)"
_SEV = "(SELECT event_type AS symbol, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS sev_ts, max(least(5, CAST(floor(value / 45) AS BIGINT))) AS sev FROM events WHERE value > 100 GROUP BY 1, 2)"
cte("decisions", f"""
WITH b AS (SELECT symbol, ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, (trades % 10) / 10.0::DOUBLE AS target, lag((trades % 10) / 10.0::DOUBLE) {sqlwin()} AS current FROM hbars),
g AS (SELECT b.*, EXISTS (SELECT 1 FROM {_EV} e WHERE b.ts BETWEEN e.utc - INTERVAL 36 HOUR AND e.utc + INTERVAL 1 HOUR) AS event_blocked FROM b),
f AS (SELECT g.*, x.action AS flow_action FROM g LEFT JOIN gate_f x ON x.asset = g.symbol AND x.day = g.day),
s AS ({asof('f', _SEV, '', 'ts', 'sev_ts', 'r.sev_ts, r.sev', 'symbol')}),
m AS ({asof('s', "(SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS mk_ts, max(least(5, CAST(floor(value / 75) AS BIGINT))) AS mk FROM events WHERE value > 300 GROUP BY 1)", '', 'ts', 'mk_ts', 'r.mk_ts, r.mk')})
SELECT *, current IS NULL AS cold_start, (sev_ts IS NULL OR sev_ts < ts - INTERVAL 24 HOUR) AS flags_unknown, CASE WHEN sev_ts >= ts - INTERVAL 24 HOUR THEN sev ELSE 0 END AS asset_severity,
 CASE WHEN mk_ts >= ts - INTERVAL 6 HOUR THEN mk ELSE 0 END AS market_severity FROM m""")


@query("x14_risk_cascade", f"{K} target:3 adjusted:4 notes", """
WITH a AS (SELECT *, coalesce(current, 0) AS cur, CASE WHEN event_blocked AND NOT cold_start THEN least(target, coalesce(current, 0)) ELSE target END AS t1 FROM decisions),
b AS (SELECT *, CASE WHEN flow_action = 'halve' THEN least(t1, cur) * 0.5 WHEN flow_action = 'block' AND t1 > cur THEN cur ELSE t1 END AS t2 FROM a)
SELECT symbol, ts, target, CASE WHEN flags_unknown THEN least(t2, cur) WHEN asset_severity >= 5 THEN least(t2, cur) * 0.5
  WHEN (asset_severity >= 4 OR market_severity >= 5) AND t2 > cur THEN cur ELSE t2 END AS adjusted,
 concat_ws(',', CASE WHEN event_blocked AND cold_start THEN 'event_gate bypassed' END, CASE WHEN event_blocked AND NOT cold_start THEN 'event_gate' END,
  CASE WHEN flow_action = 'halve' THEN 'flow halve' END, CASE WHEN flow_action = 'block' AND t1 > cur THEN 'flow block' END, CASE WHEN flags_unknown THEN 'flags unknown' END,
  CASE WHEN NOT flags_unknown AND asset_severity >= 5 THEN 'severity halve' END,
  CASE WHEN NOT flags_unknown AND asset_severity < 5 AND (asset_severity >= 4 OR market_severity >= 5) AND t2 > cur THEN 'severity no add' END) AS notes FROM b""")
def _x14(t):
    w = win.series("symbol")
    ten = (F.col("trades") % 10) / num(10)
    b = t.hbars.select("symbol", "ts", F.date_trunc("day", "ts").alias("day"), ten.alias("target"), F.lag(ten).over(w).alias("current"))
    ts = F.col("ts").cast("timestamp")
    events = t.events.where("value > 350").select(F.concat(F.lit("E"), F.col("event_id")).alias("name"), F.lit("big").alias("kind"), ts.alias("utc"))
    gate = joins.event_gate(b, events).select("ts", F.col("blocked").alias("event_blocked"))
    flow = risk.flow_gate(t.flows.select(plus_days("date", 1).alias("day")), t.flows, assets=GATED).select("day", F.col("asset").alias("symbol"), F.col("action").alias("flow_action"))
    minute = F.date_trunc("minute", ts)
    sev = t.events.where("value > 100").groupBy(F.col("event_type").alias("symbol"), minute.alias("sev_ts")).agg(F.max(F.least(F.lit(5), F.floor(F.col("value") / 45))).alias("asset_severity"))
    mkt = t.events.where("value > 300").groupBy(minute.alias("mk_ts")).agg(F.max(F.least(F.lit(5), F.floor(F.col("value") / 75))).alias("market_severity"))
    d = b.join(gate, "ts").join(flow, ["day", "symbol"], "left")
    d = joins.asof_join(d, sev, "ts", "sev_ts", ["symbol"], ["asset_severity"], max_age_hours=24, span="day")
    d = joins.asof_join(d, mkt, "ts", "mk_ts", cols=["market_severity"], max_age_hours=6, span="day")
    d = d.withColumns({"cold_start": F.col("current").isNull(), "flags_unknown": F.col("asset_severity").isNull()})
    return risk.apply_rules(d).withColumn("notes", F.concat_ws(",", "notes"))


# ---------------- review ----------------


cte("model_day", "SELECT ts AS day, avg(ret) AS net FROM bt_in GROUP BY ts")


@query("x29_book_review", "book n_days:i cum_paper:5 cum_model:e6 te_ann:e6 sharpe_paper:4 sharpe_model:4", f"""
WITH r AS (SELECT book, day, equity / coalesce(lag(equity) OVER (PARTITION BY book ORDER BY day), {CAPITAL}) - 1 AS ret FROM equity_d),
j AS (SELECT book, ret, coalesce(net, 0) AS model FROM r LEFT JOIN model_day USING (day))
SELECT book, count(*) AS n_days, product(1 + ret) - 1 AS cum_paper, product(1 + model) - 1 AS cum_model, stddev_samp(ret - model) * sqrt(365.0) AS te_ann,
 {sharpe('ret')} AS sharpe_paper, {sharpe('model')} AS sharpe_model FROM j GROUP BY 1""")
def _x29(t):
    return review.compare_to_model(*_paper_and_model(t), ["book"])


def _paper_and_model(t):
    from tidebar.plans.backtest import bar_inputs

    paper = review.paper_returns(equity(t), ["book"], CAPITAL)
    # the model holds all symbols in equal parts
    model = bar_inputs(t.bars).groupBy(F.col("ts").alias("day")).agg(F.avg("ret").alias("net"))
    return paper, model.crossJoin(F.broadcast(t.trades.select("book").distinct()))


@query("x29_band_flags", "book cum_paper:5 p2_5:e6 p97_5:e6 in_band95:b", f"""
WITH r AS (SELECT book, equity / coalesce(lag(equity) OVER (PARTITION BY book ORDER BY day), {CAPITAL}) - 1 AS ret FROM equity_d),
c AS (SELECT book, product(1 + ret) - 1 AS cum_paper FROM r GROUP BY 1),
b AS ({block_band_sql('(SELECT 1 AS one, * FROM model_day)', 'one', 'day', 'net', 60)})
SELECT book, cum_paper, p2_5, p97_5, cum_paper BETWEEN p2_5 AND p97_5 AS in_band95 FROM c CROSS JOIN b""")
def _x29b(t):
    paper, model = _paper_and_model(t)
    r = review.compare_to_model(paper, model, ["book"])
    return review.band_flags(r, bootstrap.block_band(model, ["book"], "day", "net", 60), ["book"])


_PROVIDERS = ("vendor_csv", "index_csv", "chart_json")
_E4 = f"""
SELECT provider, symbol, count(*) AS n, min(session_date) AS first, avg(close) AS close, sum(volume) AS volume
FROM sessions CROSS JOIN (SELECT unnest({list(_PROVIDERS)}) AS provider) GROUP BY 1, 2"""


def session_files(t) -> dict[str, str]:
    """The sessions as files of each provider, a folder per symbol."""
    from tidebar.functions.times import seconds

    cols = ("open", "high", "low", "close", "volume")
    csv, json = scratch_path(t.spark, "e4"), scratch_path(t.spark, "e4")
    text = [F.col(c).cast("string").alias(c.upper()) for c in cols]
    t.sessions.select("symbol", F.col("session_date").cast("string").alias("Date"), *text).write.partitionBy("symbol").option("header", True).csv(csv)
    # a symbol's chart is one file, whose parallel arrays hold all its sessions
    bar = F.struct(seconds("bar_start").cast("long").alias("timestamp"), *cols)
    bars = t.sessions.groupBy("symbol").agg(F.collect_list(bar).alias("_b"))
    body = F.to_json(F.struct(*[F.col("_b")[c].alias(c) for c in ("timestamp", *cols)]))
    bars.select("symbol", body.alias("body")).write.partitionBy("symbol").text(json)
    return {name: json if name == "chart_json" else csv for name in _PROVIDERS}


def _by_provider(parts):
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy(F.col("source").alias("provider"), "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("session_date").alias("first"), F.avg("close").alias("close"), F.sum("volume").alias("volume"))


@query("e4_session_providers", "provider symbol n:i first:d close:5 volume:1", _E4)
def _e4(t):
    from tidebar.sources.readers import read_sessions

    now = F.lit("2010-01-01 00:00:00").cast("timestamp")
    return _by_provider([read_sessions(name, t.spark, path, None, now) for name, path in session_files(t).items()])


@query("e4_provider_formats", "provider symbol n:i first:d close:5 volume:1", _E4)
def _e4_formats(t):
    from tidebar.sources import providers

    providers.register(t.spark)
    now = F.lit("2010-01-01 00:00:00").cast("timestamp")
    return _by_provider([providers.sessions(t.spark, name, path, now) for name, path in session_files(t).items()])
