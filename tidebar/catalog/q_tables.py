"""Filter, join, aggregate, selection and upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import cte, query
from tidebar.catalog.tables_sql import asof, donchian_pos, roll, sharpe, win as sqlwin
from tidebar.functions.columns import clip, num
from tidebar.functions.text import score_headlines
from tidebar.functions.times import plus_days
from tidebar.operators import aggregates, joins, selection, sets
from tidebar.operators import windows as win
from tidebar.plans import ledger, universe, walkforward
from tidebar.plans.signals import single
from tidebar.sources import readers

K = "symbol ts:t"


def w():
    """Window of one series; built on use, so the catalog loads without a session."""
    return win.series("symbol")

# ---------------- projections and filters ----------------


@query("p1_universe_eligible", "symbol", """
SELECT symbol FROM (SELECT upper(replace(p_name, ' ', '')) || CASE WHEN p_partkey % 3 = 0 THEN 'UP' WHEN p_partkey % 7 = 0 THEN 'USDC' ELSE '' END
  || CASE WHEN p_size > 5 THEN 'USDT' ELSE 'EUR' END AS symbol FROM part
  UNION ALL SELECT upper(substring(n_name, 1, 3)) || 'USDT' FROM nation UNION ALL SELECT 'PAXGUSDT' FROM region)
WHERE symbol LIKE '%USDT' AND symbol <> 'USDT' AND regexp_replace(symbol, 'USDT$', '') NOT LIKE '%USD%'
  AND regexp_replace(symbol, 'USDT$', '') NOT IN ('PAXG', 'DAI', 'WBTC')
  AND NOT regexp_matches(regexp_replace(symbol, 'USDT$', ''), '(UP|DOWN|BULL|BEAR)$')""")
def _p1(t):
    tail = F.when(F.col("p_partkey") % 3 == 0, "UP").when(F.col("p_partkey") % 7 == 0, "USDC").otherwise("")
    quote = F.when(F.col("p_size") > 5, "USDT").otherwise("EUR")
    a = t.part.select(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), tail, quote).alias("symbol"))
    b = t.nation.select(F.concat(F.upper(F.substring("n_name", 1, 3)), F.lit("USDT")).alias("symbol"))
    c = t.region.select(F.lit("PAXGUSDT").alias("symbol"))
    return universe.eligible(a.unionByName(b).unionByName(c))


@query("p2_canonical_sessions", "symbol session_date:d bar_start:t bar_end:t available_at:t close:4", """
SELECT symbol, session_date, bar_start, bar_end, available_at, close FROM (
  SELECT s.*, o.close AS close2 FROM sessions s JOIN (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS session_date,
    arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2) o USING (symbol, session_date))
WHERE available_at <= TIMESTAMP '2000-12-29 21:00:00'""")
def _p2(t):
    o = t.orders.where(F.weekday("o_orderdate") < 5)
    raw = o.select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("session_date"),
        *[F.col("o_totalprice").alias(c) for c in ("open", "high", "low", "close")], F.col("o_orderkey").alias("arrival"))
    now = F.lit("2000-12-29 21:00:00").cast("timestamp")
    return readers.canonical_sessions(raw, F.lit("orders"), now, arrival="arrival")


cte("spans", "SELECT min(ts) AS t0, max(ts) AS t_end FROM bars")
cte("folds", """
SELECT k AS fold, t0 + to_days(CAST(1095 + 182 * k AS INTEGER)) AS train_end, t0 + to_days(CAST(1277 + 182 * k AS INTEGER)) AS val_end,
  least(t0 + to_days(CAST(1459 + 182 * k AS INTEGER)), t_end) AS test_end,
  t0 + to_days(CAST(1459 + 182 * k AS INTEGER)) <= t_end AS complete
FROM spans, (SELECT unnest(range(60)) AS k) WHERE t0 + to_days(CAST(1277 + 182 * k AS INTEGER)) < t_end - INTERVAL 30 DAY""")
cte("tagged_rows", """
SELECT symbol, ts, fold, CASE WHEN ts <= train_end - INTERVAL 5 DAY THEN 'train'
  WHEN ts > train_end AND ts <= val_end - INTERVAL 5 DAY THEN 'val' WHEN ts > val_end AND ts <= test_end THEN 'test' END AS split
FROM bars JOIN folds ON ts <= test_end""")


def folds_of(t):
    bounds = t.bars.agg(F.min("ts").alias("t0"), F.max("ts").alias("t_end"))
    return walkforward.fold_schedule(bounds, 1095)


@query("p3_fold_split", "fold:i n_train:i n_val:i n_test:i", """
SELECT * FROM (SELECT fold, count(CASE WHEN split = 'train' THEN 1 END) AS n_train, count(CASE WHEN split = 'val' THEN 1 END) AS n_val,
  count(CASE WHEN split = 'test' THEN 1 END) AS n_test FROM tagged_rows GROUP BY fold) WHERE n_train >= 500 AND n_val >= 100 AND n_test >= 50""")
def _p3(t):
    return walkforward.usable_folds(walkforward.split_rows(t.bars.select("symbol", "ts"), folds_of(t), "ts"))


_REG = [("early", None, "1997-01-01"), ("middle", "1997-01-01", "1999-06-01"), ("late", "1999-06-01", "2001-10-20"), ("tail", "2001-10-20", None)]


@query("p4_regime_slices", "symbol regime n:i sharpe:5", f"""
SELECT symbol, regime, count(ret) AS n, CASE WHEN count(ret) > 60 THEN {sharpe('ret')} END AS sharpe FROM (
  SELECT symbol, ret, CASE WHEN ts < DATE '1997-01-01' THEN 'early' WHEN ts < DATE '1999-06-01' THEN 'middle'
    WHEN ts < DATE '2001-10-20' THEN 'late' ELSE 'tail' END AS regime FROM ret_bars) GROUP BY 1, 2""")
def _p4(t):
    r = t.bars.withColumn("ret", win.pct_change("close", w()))
    return walkforward.regime_slices(r, ["symbol"], "ts", "ret", _REG)


@query("p7_warmup_drop", "symbol n:i first_ts:t", """
SELECT symbol, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)
WHERE rn > 730 GROUP BY symbol""")
def _p7(t):
    b = t.bars.withColumn("rn", F.row_number().over(w())).where("rn > 730")
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


@query("p8_clip_to_grid", f"{K} pos:6", """
SELECT b.symbol, b.ts, greatest(least(coalesce(h.volume / 20.0, 0), 3), -3) AS pos FROM bars b
LEFT JOIN (SELECT * FROM bars WHERE volume > 100) h ON h.symbol = b.symbol AND h.ts = b.ts""")
def _p8(t):
    pos = t.bars.where("volume > 100").select("symbol", "ts", (F.col("volume") / 20.0).alias("p"))
    j = t.bars.select("symbol", "ts").join(pos, ["symbol", "ts"], "left")
    return j.withColumn("pos", clip(F.coalesce("p", num(0)), -3, 3))


cte("dc_weights", f"SELECT symbol, ts, pos / 3.0 AS weight FROM ({donchian_pos(20, 10)})")


@query("p9_strict_targets", "day:t symbol target:6", """
SELECT ts + INTERVAL 1 DAY AS day, symbol, weight AS target FROM dc_weights
WHERE ts IN (SELECT ts FROM dc_weights GROUP BY ts HAVING count(weight) = (SELECT count(DISTINCT symbol) FROM dc_weights))""")
def _p9(t):
    wts = single(t.bars, "donchian", n_entry=20, n_exit=10).withColumn("weight", F.col("pos") / num(3))
    return ledger.strict_targets(wts, wts)


@query("p9_lenient_targets", "day:t symbol target:6", """
WITH d AS (SELECT DISTINCT CAST(session_date AS TIMESTAMP) AS day FROM sessions),
l AS (SELECT day, (SELECT max(ts) FROM dc_weights WHERE ts <= day - INTERVAL 1 DAY) AS ts FROM d)
SELECT day, symbol, coalesce(weight, 0) AS target FROM l JOIN dc_weights USING (ts)""")
def _p9b(t):
    wts = single(t.bars, "donchian", n_entry=20, n_exit=10).withColumn("weight", F.col("pos") / num(3))
    days = t.sessions.select(F.col("session_date").cast("timestamp").alias("day"))
    return ledger.lenient_targets(wts, days)


@query("p10_missing_decision_bars", "day:t symbol", """
SELECT day, symbol FROM (SELECT DISTINCT CAST(session_date AS TIMESTAMP) AS day FROM sessions) CROSS JOIN (SELECT DISTINCT symbol FROM bars)
ANTI JOIN (SELECT ts + INTERVAL 1 DAY AS day, symbol FROM bars WHERE open IS NOT NULL AND close IS NOT NULL) v USING (day, symbol)""")
def _p10(t):
    days = t.sessions.select(F.col("session_date").cast("timestamp").alias("day")).distinct()
    return ledger.missing_decision_bars(t.bars, days, t.bars)


@query("p11_settled_only", "book day:d equity:2", """
SELECT 'b' || (o_custkey % 3) AS book, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS equity FROM orders
WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def _p11(t):
    e = t.orders.groupBy(
        F.concat(F.lit("b"), F.col("o_custkey") % 3).alias("book"), F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "settled").otherwise("intraday").alias("note"),
    ).agg(F.sum("o_totalprice").alias("equity"))
    return ledger.settled_only(e)


@query("p12_midnight_snapshots", f"{K} close:6", """
SELECT symbol, ts - INTERVAL 1 DAY AS ts, close FROM hbars WHERE ts = date_trunc('day', ts)""")
def _p12(t):
    snap = t.hbars.where(F.col("ts") == F.date_trunc("day", "ts"))
    return snap.select("symbol", plus_days("ts", -1).alias("ts"), "close")


@query("p13_recent_window", "event_id:i", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 48 HOUR""")
def _p13(t):
    now = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    return t.events.where(F.col("ts") >= now - F.expr("interval 48 hours"))


@query("p14_wide_and_long", f"{K} close:8", """
SELECT s.symbol, d.ts, b.close FROM (SELECT DISTINCT ts FROM bars) d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s
LEFT JOIN bars b ON b.ts = d.ts AND b.symbol = s.symbol""")
def _p14(t):
    names = ["AF", "AO", "NF", "NO", "RF", "RO"]
    wide = t.bars.groupBy("ts").pivot("symbol", names).agg(F.first("close"))
    return wide.unpivot(["ts"], names, "symbol", "close")


# ---------------- joins ----------------


@query("j1_asof_sessions", f"{K} close:8 session_date:d x_close:4 days_since:6", f"""
SELECT symbol, decision_ts - INTERVAL 1 DAY AS ts, close, session_date, x_close,
  (epoch_us(decision_ts) - epoch_us(bar_end)) / 86400e6 AS days_since FROM (
  {asof("(SELECT symbol, ts + INTERVAL 1 DAY AS decision_ts, close FROM bars)",
        "(SELECT max(session_date) AS session_date, available_at, max(bar_end) AS bar_end, avg(close) AS x_close FROM sessions GROUP BY available_at)",
        '', 'decision_ts', 'available_at', 'r.session_date, r.bar_end, r.x_close')})""")
def _j1(t):
    from tidebar.functions.times import staleness_days

    left = t.bars.select("symbol", "ts", "close", plus_days("ts", 1).alias("decision_ts"))
    # the session market as a whole: one row per time at which it becomes known
    right = t.sessions.groupBy("available_at").agg(
        F.max("session_date").alias("session_date"), F.max("bar_end").alias("bar_end"), F.avg("close").alias("x_close"))
    out = joins.asof_join(left, right, "decision_ts", "available_at", cols=["session_date", "bar_end", "x_close"], span="year")
    return out.withColumn("days_since", staleness_days("decision_ts", "bar_end"))


@query("j1_asof_by_key_hot", "event_id:i event_type bar_close:6", f"""
{asof('(SELECT event_id, event_type, ts FROM events)', "(SELECT symbol AS event_type, ts + INTERVAL 1 HOUR AS known_at, close AS bar_close FROM hbars)",
      '', 'ts', 'known_at', 'r.bar_close', 'event_type')}""")
def _j1b(t):
    left = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    right = t.hbars.select(
        F.col("symbol").alias("event_type"), (F.col("ts") + F.expr("interval 1 hour")).alias("known_at"), F.col("close").alias("bar_close"))
    return joins.asof_join(left, right, "ts", "known_at", ["event_type"], ["bar_close"], span="day")


@query("j2_asof_max_age", f"{K} flag:4", f"""
SELECT symbol, ts, CASE WHEN at_ts >= ts - INTERVAL 24 HOUR THEN flag END AS flag FROM (
{asof('(SELECT symbol, ts FROM hbars)', "(SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS at_ts, max(value) AS flag FROM events WHERE value > 250 GROUP BY 1)", '', 'ts', 'at_ts', 'r.at_ts, r.flag')})""")
def _j2(t):
    flags = t.events.where("value > 250").groupBy(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("at")).agg(F.max("value").alias("flag"))
    return joins.asof_join(t.hbars.select("symbol", "ts"), flags, "ts", "at", cols=["flag"], max_age_hours=24, span="day")


cte("flow_last5", """
SELECT d.day, f.asset, f.date, f.net_flow_usd_m FROM (SELECT DISTINCT date + INTERVAL 1 DAY AS day FROM flows) d
JOIN (SELECT *, lead(date, 5) OVER (PARTITION BY asset ORDER BY date) AS out_at FROM flows) f
  ON f.date <= d.day AND (f.out_at IS NULL OR f.out_at > d.day)""")


@query("j3_asof_top_k", "day:t asset date:t net_flow_usd_m:4", "SELECT * FROM flow_last5")
def _j3(t):
    days = t.flows.select(plus_days("date", 1).alias("day"))
    return joins.asof_top_k(days, t.flows, "day", "date", "asset", 5)


@query("j4_event_gate", "ts:t blocked:b event_name event_utc:t n_events:i", """
SELECT b.ts, count(e.name) > 0 AS blocked, arg_min(e.name, row(e.utc, e.name)) AS event_name, min(e.utc) AS event_utc, count(e.name) AS n_events
FROM (SELECT DISTINCT ts FROM bars) b LEFT JOIN calendar_t e ON b.ts BETWEEN e.utc - INTERVAL 36 HOUR AND e.utc + INTERVAL 1 HOUR GROUP BY b.ts""")
def _j4(t):
    return joins.event_gate(t.bars, t.calendar)


@query("j5_inner_on_session", "session_date:d spread:6", f"""
WITH r AS (SELECT symbol, session_date, ln(close) - lag(ln(close)) {sqlwin('session_date')} AS lr FROM sessions)
SELECT a.session_date, b.lr - a.lr AS spread FROM r a JOIN r b USING (session_date) WHERE a.symbol = '1-URGENT' AND b.symbol = '2-HIGH'""")
def _j5(t):
    r = t.sessions.select("symbol", "session_date", win.log_diff("close", win.series("symbol", order="session_date")).alias("lr"))
    a = r.where("symbol = '1-URGENT'").select("session_date", F.col("lr").alias("x"))
    b = r.where("symbol = '2-HIGH'").select("session_date", F.col("lr").alias("y"))
    return a.join(b, "session_date").withColumn("spread", F.col("y") - F.col("x"))


@query("j6_left_features", f"{K} n_sessions:i", """
SELECT b.symbol, b.ts, s.n AS n_sessions FROM bars b LEFT JOIN (SELECT session_date, count(*) AS n FROM sessions GROUP BY 1) s ON s.session_date = b.ts""")
def _j6(t):
    s = t.sessions.groupBy(F.col("session_date").cast("timestamp").alias("ts")).agg(F.count(F.lit(1)).alias("n_sessions"))
    return t.bars.join(s, "ts", "left")


@query("j7_funding_on_bars", f"{K} funding:9", """
SELECT h.symbol, h.ts, coalesce(f.funding, 0) AS funding FROM hbars h LEFT JOIN fday f ON f.symbol = h.symbol AND f.ts = h.ts""")
def _j7(t):
    f = aggregates.daily_funding(t.funding)
    return joins.fill_join(t.hbars.select("symbol", "ts"), f, ["symbol", "ts"], {"funding": 0.0})


@query("j8_outer_alignment", f"{K} weight:6", """
SELECT s.symbol, d.ts, x.weight FROM (SELECT DISTINCT ts FROM dc_weights) d CROSS JOIN (SELECT DISTINCT symbol FROM dc_weights) s
LEFT JOIN dc_weights x ON x.symbol = s.symbol AND x.ts = d.ts""")
def _j8(t):
    wts = single(t.bars, "donchian", n_entry=20, n_exit=10).withColumn("weight", F.col("pos") / num(3))
    return joins.align_outer(wts, "ts", "symbol", "weight")


@query("j9_complete_dates", "ts:t", """
SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)""")
def _j9(t):
    return joins.complete_dates(t.bars, "ts", "symbol", "close")


@query("j10_anti_insert", "doc_id:i title_hash", """
SELECT min(doc_id) AS doc_id, sha1(title) AS title_hash FROM headlines WHERE feed = 'open'
  AND title NOT IN (SELECT title FROM headlines WHERE feed = 'curated') GROUP BY title""")
def _j10(t):
    from tidebar.functions.text import url_key

    h = t.headlines.withColumn("title_hash", url_key("title"))
    first = sets.pick(h.where("feed = 'open'"), ["title_hash"], ["doc_id"])
    return sets.append_unseen(h.where("feed = 'curated'"), first, ["title_hash"])


@query("j11_semi_restrict", "symbol n:i", """
SELECT symbol, count(*) AS n FROM wbars WHERE ts IN (SELECT DISTINCT CAST(session_date AS TIMESTAMP) FROM sessions WHERE volume >= 3) GROUP BY 1""")
def _j11(t):
    days = t.sessions.where("volume >= 3").select(F.col("session_date").cast("timestamp").alias("ts")).distinct()
    return t.wbars.join(days, "ts", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("j15_compare_sources", f"{K} diff_pct:6", """
SELECT a.symbol, a.ts, 100 * abs(a.close - b.close) / b.close AS diff_pct FROM bars a JOIN (SELECT symbol, ts, open AS close FROM bars WHERE trades > 2) b USING (symbol, ts)""")
def _j15(t):
    theirs = t.bars.where("trades > 2").select("symbol", "ts", F.col("open").alias("close"))
    return joins.compare_sources(t.bars, theirs, ["symbol", "ts"], "close")


@query("j17_base_weight_lookup", "symbol decision_ts:t base_weight:6", """
SELECT b.symbol, b.ts + INTERVAL 1 DAY AS decision_ts, d.weight AS base_weight FROM (SELECT symbol, max(ts) AS ts FROM bars GROUP BY 1) b
LEFT JOIN dc_weights d ON d.symbol = b.symbol AND d.ts = b.ts""")
def _j17(t):
    wts = single(t.bars, "donchian", n_entry=20, n_exit=10).select("symbol", plus_days("ts", 1).alias("decision_ts"), (F.col("pos") / num(3)).alias("base_weight"))
    last = t.bars.groupBy("symbol").agg(plus_days(F.max("ts"), 1).alias("decision_ts"))
    return last.join(wts, ["symbol", "decision_ts"], "left")


@query("j18_missing_days", "symbol day:d", """
WITH d AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS day FROM bars)
SELECT symbol, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY symbol
EXCEPT SELECT symbol, day FROM d""")
def _j18(t):
    return joins.missing_days(t.bars, ["symbol"], "ts")


@query("j19_source_fill", f"{K} close:8 quote_volume:8 origin", """
SELECT symbol, ts, close, quote_volume, 'primary' AS origin FROM bars WHERE ts < TIMESTAMP '2001-01-01'
UNION ALL SELECT b.symbol, b.ts, b.close, b.volume * b.close, 'secondary' FROM bars b
JOIN (SELECT symbol, max(ts) AS last FROM bars WHERE ts < TIMESTAMP '2001-01-01' GROUP BY 1) p ON p.symbol = b.symbol
WHERE b.ts > p.last AND b.ts <= TIMESTAMP '2001-03-01'""")
def _j19(t):
    cols = ["symbol", "ts", "close", "volume", "quote_volume"]
    first = t.bars.where("ts < timestamp '2001-01-01'").select(*cols)
    return joins.source_fill(first, t.bars.select(*cols[:4]), "symbol", "ts", F.lit("2001-03-01").cast("timestamp"))


# ---------------- aggregates ----------------


@query("a1_daily_funding", f"{K} funding:9", "SELECT * FROM fday")
def _a1(t):
    return aggregates.daily_funding(t.funding)


@query("a2_inventory", "market symbol n_rows:i first_ts:t last_ts:t", """
SELECT 'spot' AS market, symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 2
UNION ALL SELECT 'um', symbol, count(*), min(ts), max(ts) FROM hbars GROUP BY 2""")
def _a2(t):
    a = t.bars.select(F.lit("spot").alias("market"), "symbol", "ts")
    b = t.hbars.select(F.lit("um").alias("market"), "symbol", "ts")
    return aggregates.inventory(a.unionByName(b), ["market", "symbol"])


@query("a3_incident_counts", "level n:i", """
SELECT l.level, count(e.event_id) AS n FROM (SELECT unnest(['P0', 'P1', 'P2', 'P3']) AS level) l LEFT JOIN
(SELECT *, CASE WHEN value > 300 THEN 'P1' WHEN value > 50 THEN 'P2' ELSE 'P3' END AS level FROM events
 WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10') e ON e.level = l.level GROUP BY 1""")
def _a3(t):
    inc = t.events.where("event_type = 'error'").select(
        F.when(F.col("value") > 300, "P1").when(F.col("value") > 50, "P2").otherwise("P3").alias("level"),
        F.col("ts").cast("date").alias("day"))
    return aggregates.incident_counts(inc, F.lit("2024-01-10").cast("date"))


cte("panel_w", f"""
SELECT *, row_number() OVER (PARTITION BY date ORDER BY adv30 DESC, symbol) AS rank FROM (
  SELECT ts AS date, symbol, close, quote_volume AS dollar_vol, {roll('avg({})', 'quote_volume', 30)} AS adv30 FROM wbars) WHERE adv30 IS NOT NULL""")


@query("a4_universe_coverage", "year:i assets_median:i enough:b", """
SELECT year, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS assets_median, floor(quantile_cont(n, 0.5)) >= 30 AS enough FROM (
  SELECT year(date) AS year, date, count(*) AS n FROM panel_w GROUP BY 1, 2) GROUP BY 1""")
def _a4(t):
    return aggregates.universe_coverage(universe.panel(t.wbars))


@query("a5_parameter_ensemble", f"{K} weight:6", "SELECT symbol, ts, avg(pos) / 3.0 AS weight FROM donchian_variants GROUP BY 1, 2")
def _a5(t):
    from tidebar.plans.signals import positions

    return aggregates.ensemble_weights(positions(t.bars, ["donchian"]), ["symbol", "ts"])


@query("a6_portfolios", "mode ts:t net:7", """
WITH r AS (SELECT symbol, ts, ret AS net FROM ret_bars WHERE ret IS NOT NULL)
SELECT 'skip' AS mode, ts, avg(net) AS net FROM r GROUP BY ts UNION ALL SELECT 'complete', ts, avg(net) FROM r GROUP BY ts HAVING count(net) = 6""")
def _a6(t):
    r = t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("net")).where("net is not null")
    a = aggregates.portfolio(r, ["ts"]).withColumn("mode", F.lit("skip"))
    b = aggregates.portfolio(r, ["ts"], need=6).withColumn("mode", F.lit("complete"))
    return a.unionByName(b)


# the invented prose has no real headlines, so rules are matched on its own words
_RULES = [("the", "reg", "neg", 4), ("que|ion", "market", "neg", 3), ("ung|sch", "hack", "neg", 5), ("an", "macro", "pos", 3)]
cte("scored", """
SELECT doc_id, title, CASE WHEN hit('ung|sch') THEN 'hack' WHEN hit('the') THEN 'reg' WHEN hit('que|ion') THEN 'market' WHEN hit('an') THEN 'macro' ELSE 'other' END AS category,
 CASE WHEN hit('ung|sch') OR hit('the') OR hit('que|ion') THEN 'neg' WHEN hit('an') THEN 'pos' ELSE 'neutral' END AS direction,
 CASE WHEN hit('ung|sch') THEN 5 WHEN hit('the') THEN 4 WHEN hit('que|ion') THEN 3 WHEN hit('an') THEN 3 ELSE 1 END AS severity,
 CASE WHEN doc_id % 3 = 0 THEN 'BTC' WHEN doc_id % 3 = 1 THEN 'ETH' ELSE 'ALL' END AS asset FROM headlines""".replace(
    "hit('ung|sch')", "regexp_matches(lower(title), 'ung|sch')").replace("hit('the')", "regexp_matches(lower(title), 'the')")
    .replace("hit('que|ion')", "regexp_matches(lower(title), 'que|ion')").replace("hit('an')", "regexp_matches(lower(title), 'an')"))


def _scored(t):
    tagged = F.concat("title", F.lit(" "), F.when(F.col("doc_id") % 3 == 0, "btc").when(F.col("doc_id") % 3 == 1, "ethereum").otherwise(""))
    return score_headlines(t.headlines.withColumn("title", tagged), rules=_RULES)


@query("a7_negative_severity", "asset severity:i", """
SELECT a.asset, coalesce(max(severity), 0) AS severity FROM (SELECT unnest(['BTC', 'ETH', 'SOL', 'ALL']) AS asset) a
LEFT JOIN (SELECT * FROM scored WHERE direction = 'neg') s ON s.asset = a.asset GROUP BY 1""")
def _a7(t):
    return aggregates.negative_severity(_scored(t))


@query("a12_cross_median", "ts:t med:7", "SELECT ts, median(ret) AS med FROM ret_bars WHERE ret IS NOT NULL GROUP BY ts")
def _a12(t):
    from pyspark.sql import Window as W

    r = t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("ret")).where("ret is not null")
    return r.select("ts", F.median("ret").over(W.partitionBy("ts")).alias("med")).distinct()


@query("a13_trade_stats", "book n_trades:i fees:3 n_live:i n_catchup:i", """
SELECT book, count(*) AS n_trades, sum(fee) AS fees, count(CASE WHEN mode = 'live' THEN 1 END) AS n_live,
  count(CASE WHEN mode = 'catchup' THEN 1 END) AS n_catchup FROM trades GROUP BY book""")
def _a13(t):
    return aggregates.trade_stats(t.trades, ["book"])


@query("a16_duplicate_counts", "symbol n_rows:i n_distinct:i n_dup:i", """
SELECT event_type AS symbol, count(*) AS n_rows, count(DISTINCT date_trunc('minute', ts)) AS n_distinct, count(*) - count(DISTINCT date_trunc('minute', ts)) AS n_dup
FROM events GROUP BY 1""")
def _a16(t):
    e = t.events.select(F.col("event_type").alias("symbol"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("m"))
    return aggregates.duplicate_counts(e, ["symbol"], "m")


# ---------------- selections ----------------


@query("o1_point_in_time_universe", "date:t symbol rank:i adv30:5", "SELECT date, symbol, rank, adv30 FROM panel_w WHERE rank <= 50")
def _o1(t):
    return universe.panel(t.wbars).where("in_universe")


@query("o2_top_negative", "doc_id:i severity:i", """
SELECT doc_id, severity FROM scored WHERE direction = 'neg' ORDER BY severity DESC, doc_id LIMIT 10""")
def _o2(t):
    return _scored(t).where("direction = 'neg'").orderBy(F.col("severity").desc(), "doc_id").limit(10)


@query("o3_quota_top_k", "doc_id:i feed", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY t DESC, doc_id) AS rn, count(CASE WHEN feed = 'curated' THEN 1 END) OVER () AS nc,
  count(CASE WHEN feed = 'open' THEN 1 END) OVER () AS no FROM headlines),
o AS (SELECT *, least(no, greatest(0, 80 - least(40, nc))) AS other FROM c)
SELECT doc_id, feed FROM o WHERE rn <= CASE WHEN feed = 'curated' THEN 80 - other ELSE other END ORDER BY t DESC, doc_id LIMIT 80""")
def _o3(t):
    return selection.quota_top_k(t.headlines, "feed", "curated", "t", "doc_id", 80, 40)


@query("o4_last_trades", "book trade_id:i", """
SELECT book, trade_id FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ts DESC, trade_id DESC) AS rn FROM trades) WHERE rn <= 5""")
def _o4(t):
    return selection.last_n(t.trades, ["book"], ["ts", "trade_id"], 5)


@query("o5_best_variant", "symbol params sr:6", f"""
SELECT symbol, params, sr FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(sr, 9) DESC, grid_order) AS rn FROM (
  SELECT symbol, params, grid_order, CASE WHEN count(net) < 3 OR stddev_samp(net) = 0 THEN 0 ELSE avg(net) / stddev_samp(net) END AS sr FROM dc_net GROUP BY 1, 2, 3))
WHERE rn = 1 AND sr > 0""")
def _o5(t):
    from tidebar.operators.metrics import sharpe_pp
    from tidebar.plans.backtest import variant_returns

    s = variant_returns(t.bars, ["donchian"]).groupBy("symbol", "params", "grid_order").agg(sharpe_pp("net").alias("sr"))
    return selection.best_variant(s, ["symbol"], "sr", "grid_order", ["params"]).where("sr > 0")


# each width trades the sign of the change over so many bars before
@query("o6_parameter_choice", "symbol best_width:i", f"""
WITH m AS (SELECT symbol, ret, sign(lag(close) {sqlwin()} - lag(close, 33) {sqlwin()}) AS a, sign(lag(close) {sqlwin()} - lag(close, 65) {sqlwin()}) AS b,
  sign(lag(close) {sqlwin()} - lag(close, 129) {sqlwin()}) AS c FROM ret_bars)
SELECT symbol, arg_max(width, row(s, -width)) AS best_width FROM (SELECT symbol, width, round({sharpe('x')}, 2) AS s FROM (
  SELECT symbol, width, CASE width WHEN 32 THEN ret * a WHEN 64 THEN ret * b ELSE ret * c END AS x FROM m CROSS JOIN (SELECT unnest([32, 64, 128]) AS width)) GROUP BY 1, 2) GROUP BY 1""")
def _o6(t):
    from tidebar.operators.metrics import sharpe as sh

    side = lambda n: F.signum(F.lag("close").over(w()) - F.lag("close", n + 1).over(w())).alias("side")
    trades = F.array(*[F.struct(F.lit(n).cast("long").alias("width"), side(n)) for n in (32, 64, 128)])
    r = t.bars.select("symbol", win.pct_change("close", w()).alias("x"), trades.alias("_w")).select("symbol", "x", F.inline("_w"))
    s = r.groupBy("symbol", "width").agg(sh(F.col("x") * F.col("side")).alias("s"))
    return selection.widest_first(s, ["symbol"], "s", "width", 2)


# ---------------- upserts ----------------


@query("u1_upsert_last", "symbol ts:t close:8 src:i", """
SELECT symbol, ts, close, 1 AS src FROM bars WHERE ts >= TIMESTAMP '2000-01-01'
UNION ALL SELECT symbol, ts, open, 0 FROM bars WHERE ts < TIMESTAMP '2000-01-01'""")
def _u1(t):
    old = t.bars.where("ts < timestamp '2000-06-01'").select("symbol", "ts", F.col("open").alias("close"), F.lit(0).alias("src"))
    new = t.bars.where("ts >= timestamp '2000-01-01'").select("symbol", "ts", "close", F.lit(1).alias("src"))
    return sets.upsert_last(old, new, ["symbol", "ts"])


@query("u2_upsert_first", "symbol session_date:d close:4", """
SELECT symbol, session_date, CASE WHEN session_date < DATE '2000-06-01' THEN open ELSE close END AS close FROM sessions""")
def _u2(t):
    old = t.sessions.where("session_date < date '2000-06-01'").select("symbol", "session_date", F.col("open").alias("close"))
    new = t.sessions.where("session_date >= date '2000-01-01'").select("symbol", "session_date", "close")
    return sets.upsert_first(old, new, ["symbol", "session_date"])


@query("u3_flow_upsert", "asset date:t net:4 source", """
SELECT asset, date, net_flow_usd_m AS net, CASE WHEN asset IN ('click', 'view') THEN 'api' ELSE 'html' END AS source FROM flows WHERE date >= TIMESTAMP '2024-01-10'
UNION ALL SELECT asset, date, net_flow_usd_m, 'old' FROM flows WHERE date < TIMESTAMP '2024-01-10'""")
def _u3(t):
    f = t.flows.select("asset", "date", F.col("net_flow_usd_m").alias("net"))
    old = f.where("date < timestamp '2024-01-20'").withColumn("source", F.lit("old"))
    new = f.where("date >= timestamp '2024-01-10'")
    api = new.where("asset in ('click', 'view')").withColumn("source", F.lit("api"))
    html = new.withColumn("source", F.lit("html"))
    return sets.upsert_with_fallback(old, api, html, ["asset", "date"], "asset")


@query("u4_decision_log", "decision_ts:t symbol variant weight:6", """
SELECT ts + INTERVAL 1 DAY AS decision_ts, symbol, v AS variant, CASE WHEN ts < TIMESTAMP '2001-06-01' THEN weight ELSE weight / 2 END AS weight
FROM dc_weights CROSS JOIN (SELECT unnest(['B1', 'B2']) AS v)""")
def _u4(t):
    wts = single(t.bars, "donchian", n_entry=20, n_exit=10)
    rows = wts.select(plus_days("ts", 1).alias("decision_ts"), "symbol", F.explode(F.array(F.lit("B1"), F.lit("B2"))).alias("variant"), (F.col("pos") / num(3)).alias("weight"))
    old = rows.where("decision_ts < timestamp '2001-06-02'")
    new = rows.where("decision_ts > timestamp '2001-01-01'").withColumn("weight", F.col("weight") / 2)
    return sets.upsert_first(old, new, ["decision_ts", "symbol", "variant"])


@query("u5_day_replace", "book day:d equity:2 note", """
SELECT 'b' || (o_custkey % 3) AS book, CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS equity, 'settled' AS note FROM orders GROUP BY 1, 2""")
def _u5(t):
    rows = t.orders.select(
        F.concat(F.lit("b"), F.col("o_custkey") % 3).alias("book"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").alias("equity"), F.col("o_orderkey").alias("at"))
    marks = rows.withColumn("note", F.lit("intraday")).withColumn("equity", F.col("equity") / 2)
    return sets.upsert_last(marks, rows.withColumn("note", F.lit("settled")), ["book", "day"], ["at"])


@query("u6_union_frames", "kind n:i", "SELECT 'day' AS kind, count(*) AS n FROM bars UNION ALL SELECT 'hour', count(*) FROM hbars UNION ALL SELECT 'week', count(*) FROM wbars")
def _u6(t):
    u = sets.union_all(*[d.withColumn("kind", F.lit(k)) for k, d in (("day", t.bars), ("hour", t.hbars), ("week", t.wbars))])
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("u7_oos_dates", "bar_date:d", "SELECT DISTINCT CAST(ts AS DATE) - 1 AS bar_date FROM hbars")
def _u7(t):
    return sets.shifted_dates(t.hbars, "ts")


@query("u8_date_sets", "kind n:i", """
WITH a AS (SELECT DISTINCT ts FROM bars WHERE symbol = 'NO'), b AS (SELECT DISTINCT ts FROM bars WHERE symbol = 'AF')
SELECT 'both' AS kind, count(*) AS n FROM (SELECT ts FROM a INTERSECT SELECT ts FROM b) UNION ALL
SELECT 'only_no', count(*) FROM (SELECT ts FROM a EXCEPT SELECT ts FROM b)""")
def _u8(t):
    a, b = t.bars.where("symbol = 'NO'").select("ts"), t.bars.where("symbol = 'AF'").select("ts")
    n = F.count(F.lit(1)).alias("n")
    return (sets.intersect_keys(a, b, ["ts"]).agg(n).withColumn("kind", F.lit("both"))
            .unionByName(sets.subtract_keys(a, b, ["ts"]).agg(n).withColumn("kind", F.lit("only_no"))))


@query("u9_title_dedup", "title doc_id:i", "SELECT title, arg_max(doc_id, row(t, doc_id)) AS doc_id FROM headlines GROUP BY title")
def _u9(t):
    return sets.pick(t.headlines, ["title"], ["t", "doc_id"], last=True)
