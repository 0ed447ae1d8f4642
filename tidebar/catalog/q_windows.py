"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import query
from tidebar.catalog.tables_sql import donchian_pos, ewm, roll, win as sqlwin
from tidebar.functions.columns import num
from tidebar.operators import blocks, selection
from tidebar.operators import windows as win
from tidebar.operators.joins import next_on_spine
from tidebar.plans.signals import single
from tidebar.plans.universe import bar_counts_on_spine

K = "symbol ts:t"


def w():
    """Window of one series; built on use, so the catalog loads without a session."""
    return win.series("symbol")


@query("w1_pct_change", f"{K} ret1:8 ret5:8", f"""
SELECT symbol, ts, close / lag(close) {sqlwin()} - 1 AS ret1, close / lag(close, 5) {sqlwin()} - 1 AS ret5 FROM bars""")
def _w1(t):
    return t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("ret1"), win.pct_change("close", w(), 5).alias("ret5"))


@query("w2_log_diff", f"{K} lr1:8 lr5:8", f"""
SELECT symbol, ts, ln(close) - lag(ln(close)) {sqlwin()} AS lr1, ln(close) - lag(ln(close), 5) {sqlwin()} AS lr5 FROM bars""")
def _w2(t):
    return t.bars.select("symbol", "ts", win.log_diff("close", w()).alias("lr1"), win.log_diff("close", w(), 5).alias("lr5"))


@query("w3_execution_delay", f"{K} pos:6 held:6", f"""
SELECT *, coalesce(lag(pos) {sqlwin()}, 0) AS held FROM ({donchian_pos(20, 10)})""")
def _w3(t):
    return single(t.bars, "donchian", n_entry=20, n_exit=10).withColumn("held", win.held("pos", w()))


@query("w4_turnover", f"{K} turnover:6", f"""
SELECT symbol, ts, abs(pos - coalesce(lag(pos) {sqlwin()}, 0)) AS turnover FROM ({donchian_pos(20, 10)})""")
def _w4(t):
    return single(t.bars, "donchian", n_entry=20, n_exit=10).withColumn("turnover", win.turnover("pos", w()))


@query("w5_rolling_mean", f"{K} ma20:5 ma100:5", f"""
SELECT symbol, ts, {roll('avg({})', 'close', 20)} AS ma20, {roll('avg({})', 'close', 100)} AS ma100 FROM bars""")
def _w5(t):
    return t.bars.select("symbol", "ts", win.rolling_mean("close", w(), 20).alias("ma20"), win.rolling_mean("close", w(), 100).alias("ma100"))


@query("w6_rolling_std", f"{K} vol20:7", f"""
SELECT symbol, ts, {roll('stddev_samp({})', 'ret', 20)} * sqrt(365.0) AS vol20 FROM ret_bars""")
def _w6(t):
    r = t.bars.withColumn("ret", win.pct_change("close", w()))
    return r.select("symbol", "ts", (win.rolling_std("ret", w(), 20) * F.sqrt(num(365))).alias("vol20"))


@query("w7_rolling_extremes", f"{K} hi20:8 lo10:8 hi55:8", f"""
SELECT symbol, ts, {roll('max({})', 'close', 20, lag=1)} AS hi20, {roll('min({})', 'close', 10, lag=1)} AS lo10,
  {roll('max({})', 'close', 55)} AS hi55 FROM bars""")
def _w7(t):
    return t.bars.select(
        "symbol", "ts", win.rolling_max("close", w(), 20, lag=1).alias("hi20"),
        win.rolling_min("close", w(), 10, lag=1).alias("lo10"), win.rolling_max("close", w(), 55).alias("hi55"))


@query("w8_rolling_sum_normalised", f"{K} r21_n:6", f"""
SELECT symbol, ts, {roll('sum({})', 'lr', 21)} / nullif({roll('stddev_samp({})', 'lr', 20)} * sqrt(21.0), 0) AS r21_n
FROM (SELECT *, ln(close) - lag(ln(close)) {sqlwin()} AS lr FROM bars)""")
def _w8(t):
    b = t.bars.withColumn("lr", win.log_diff("close", w()))
    scale = F.nullif(win.rolling_std("lr", w(), 20) * F.sqrt(num(21)), num(0))
    return b.select("symbol", "ts", F.try_divide(win.rolling_sum("lr", w(), 21), scale).alias("r21_n"))


@query("w9_rolling_median", f"{K} med20:3 med20_filled:3", f"""
SELECT symbol, ts, m AS med20, coalesce(m, quantile_cont(m, 0.5) OVER (PARTITION BY symbol)) AS med20_filled
FROM (SELECT symbol, ts, {roll('quantile_cont({}, 0.5)', 'quote_volume', 20)} AS m FROM bars)""")
def _w9(t):
    b = t.bars.select("symbol", "ts", win.rolling_median("quote_volume", w(), 20).alias("med20"))
    return b.withColumn("med20_filled", win.median_fill(F.col("med20"), "med20", ["symbol"]))


_PAIR = f"""(SELECT a.symbol, a.ts, a.ret AS x, b.ret AS y FROM ret_bars a JOIN ret_bars b ON a.ts = b.ts AND b.symbol = 'NO')"""


def _roll2(fn: str, n: int) -> str:
    f = sqlwin(frame=f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    return f"(CASE WHEN count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) {f} = {n} THEN {fn} {f} END)"


@query("w10_rolling_corr_beta", f"{K} corr20:6 cov60:8 beta60:6", f"""
SELECT symbol, ts, {_roll2('corr(x, y)', 20)} AS corr20, {_roll2('covar_samp(x, y)', 60)} AS cov60,
  {_roll2('covar_samp(x, y)', 60)} / {roll('var_samp({})', 'y', 60)} AS beta60 FROM {_PAIR}""")
def _w10(t):
    r = t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("x"))
    lead = r.where(F.col("symbol") == "NO").select("ts", F.col("x").alias("y"))
    j = r.join(lead, "ts")
    return j.select(
        "symbol", "ts", win.rolling_corr("x", "y", w(), 20).alias("corr20"),
        win.rolling_cov("x", "y", w(), 60).alias("cov60"), win.rolling_beta("x", "y", w(), 60).alias("beta60"))


@query("w11_rolling_zscore", f"{K} volz20:6", f"""
SELECT symbol, ts, (volume - {roll('avg({})', 'volume', 20)}) / nullif({roll('stddev_samp({})', 'volume', 20)}, 0) AS volz20 FROM bars""")
def _w11(t):
    return t.bars.select("symbol", "ts", win.rolling_zscore("volume", w(), 20).alias("volz20"))


@query("w12_rolling_mean_min_rows", f"{K} fund_m21:10", f"""
SELECT symbol, ts, {roll('avg({})', 'f', 21, need=10)} AS fund_m21
FROM (SELECT b.symbol, b.ts, f.funding AS f FROM hbars b LEFT JOIN fday f ON f.symbol = b.symbol AND f.ts = b.ts)""")
def _w12(t):
    from tidebar.operators.aggregates import daily_funding

    f = daily_funding(t.funding).withColumnRenamed("funding", "f")
    j = t.hbars.select("symbol", "ts").join(f, ["symbol", "ts"], "left")
    return j.select("symbol", "ts", win.rolling_mean("f", w(), 21, min_rows=10).alias("fund_m21"))


@query("w13_expanding_pct_rank", f"{K} pctile:8", """
SELECT a.symbol, a.ts, CASE WHEN count(*) >= 60 THEN
  (count(CASE WHEN b.close < a.close THEN 1 END) + (count(CASE WHEN b.close = a.close THEN 1 END) + 1) / 2.0) / count(*) END AS pctile
FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.ts <= a.ts GROUP BY 1, 2""")
def _w13(t):
    return win.expanding_pct_rank(t.bars.select("symbol", "ts", "close"), ["symbol"], "ts", "close", "pctile")


@query("w14_forward_fill", "event_id:i event_type last_big:4", """
SELECT event_id, event_type, last_value(CASE WHEN value > 100 THEN value END IGNORE NULLS) OVER (
  PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_big FROM events""")
def _w14(t):
    e = t.events.select("event_id", "event_type", "ts", F.when(F.col("value") > 100, F.col("value")).alias("big"))
    return blocks.carry_forward(e, ["event_type"], ["ts", "event_id"], {"last_big": "big"}, span="day")


_LEADS = " AND ".join(f"lead(lr, {h}) {sqlwin()} IS NOT NULL" for h in range(1, 6))
_SQ = " + ".join(f"power(lead(lr, {h}) {sqlwin()}, 2)" for h in range(1, 6))
_Z = ", ".join(f"(lead(lc, {h}) {sqlwin()} - lc) / nullif(s * sqrt({h}.0), 0)" for h in range(1, 6))


@query("w15_forward_labels", f"{K} logvol5:6 minz5:6", f"""
SELECT symbol, ts, CASE WHEN {_LEADS} THEN ln(sqrt(({_SQ}) / 5)) END AS logvol5,
  CASE WHEN {_LEADS} AND s IS NOT NULL THEN least({_Z}) END AS minz5
FROM (SELECT *, {roll('stddev_samp({})', 'lr', 20)} AS s FROM
  (SELECT symbol, ts, ln(close) AS lc, ln(close) - lag(ln(close)) {sqlwin()} AS lr FROM bars))""")
def _w15(t):
    b = t.bars.withColumn("lr", win.log_diff("close", w())).withColumn("s", win.rolling_std("lr", w(), 20))
    return b.select("symbol", "ts", win.forward_log_vol("lr", w()).alias("logvol5"),
                    win.forward_min_z(F.ln("close"), "s", w()).alias("minz5"))


@query("w16_next_on_date_grid", f"{K} ret_next:7", """
SELECT b.symbol, b.ts, n.close / b.close - 1 AS ret_next FROM wbars b
LEFT JOIN (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nx FROM (SELECT DISTINCT ts FROM wbars)) g ON g.ts = b.ts
LEFT JOIN wbars n ON n.symbol = b.symbol AND n.ts = g.nx""")
def _w16(t):
    n = next_on_spine(t.wbars.select("symbol", "ts", "close"), "symbol", "ts", "close")
    return n.withColumn("ret_next", F.try_divide(F.col("close_next"), F.col("close")) - 1)


@query("w17_equity_drawdown", f"{K} equity:e6 drawdown:6", f"""
SELECT symbol, ts, eq AS equity, eq / max(eq) {sqlwin(frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} - 1 AS drawdown
FROM (SELECT symbol, ts, product(1 + r) {sqlwin(frame='ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS eq
  FROM (SELECT symbol, ts, ret AS r FROM ret_bars WHERE ret IS NOT NULL))""")
def _w17(t):
    from tidebar.operators.metrics import with_drawdown

    r = t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("r"))
    return with_drawdown(r, ["symbol"], "ts", "r")


@query("w18_bars_since_listing", "date:t symbol n_bars:i", """
SELECT g.ts AS date, s.symbol, (SELECT count(*) FROM wbars b WHERE b.symbol = s.symbol AND b.ts <= g.ts) AS n_bars
FROM (SELECT DISTINCT ts FROM wbars) g CROSS JOIN (SELECT DISTINCT symbol FROM wbars) s""")
def _w18(t):
    from tidebar.operators.joins import align_outer

    cells = align_outer(t.wbars, "ts", "symbol", "close").select(F.col("ts").alias("date"), "symbol")
    return bar_counts_on_spine(t.wbars, cells).withColumn("n_bars", F.coalesce("n_bars", F.lit(0)))


@query("w19_cross_rank", f"{K} rank:i", """
SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY quote_volume DESC, symbol) AS rank FROM wbars""")
def _w19(t):
    return t.wbars.select("symbol", "ts", win.first_tie_rank("quote_volume", "ts", "symbol").alias("rank"))


@query("w20_cross_pct_rank", f"{K} prank:8", """
SELECT symbol, ts, CASE WHEN member THEN
  (rank() OVER (PARTITION BY ts ORDER BY CASE WHEN member THEN volume END NULLS LAST)
   + (count(*) OVER (PARTITION BY ts, CASE WHEN member THEN volume END) - 1) / 2.0)
  / count(CASE WHEN member THEN volume END) OVER (PARTITION BY ts) END AS prank
FROM (SELECT *, trades >= 2 AS member FROM wbars)""")
def _w20(t):
    return t.wbars.select("symbol", "ts", win.pct_rank("volume", "ts", F.col("trades") >= 2).alias("prank"))


@query("w21_recursive_mean", f"{K} up14:6 dn14:6", f"""
SELECT symbol, ts, {ewm('up', 14)} AS up14, {ewm('dn', 14)} AS dn14 FROM moves""")
def _w21(t):
    d = F.col("close") - F.lag("close").over(w())
    b = t.bars.select("symbol", "ts", F.when(d.isNotNull(), F.greatest(d, num(0))).alias("up"),
                      F.when(d.isNotNull(), -F.least(d, num(0))).alias("dn"))
    e = win.ewm(b, ["symbol"], "ts", ["up", "dn"], 14)
    return e.withColumnsRenamed({"up_ewm": "up14", "dn_ewm": "dn14"})


@query("w22_sequence_window", f"{K} n:i first:7 mean:7", f"""
SELECT symbol, ts, 90 AS n, f AS first, m AS mean FROM (
  SELECT symbol, ts, {roll('avg({})', 'ret', 90)} AS m, lag(ret, 89) {sqlwin()} AS f,
    count(ret) {sqlwin(frame='ROWS BETWEEN 89 PRECEDING AND CURRENT ROW')} AS c FROM ret_bars) WHERE c = 90""")
def _w22(t):
    r = t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("ret"))
    s = r.withColumn("seq", win.sequence_window(F.col("ret"), w(), 90, F.col("ret").isNotNull()))
    s = s.where("seq is not null")
    mean = F.aggregate("seq", num(0), lambda a, x: a + x) / F.size("seq")
    return s.select("symbol", "ts", F.size("seq").alias("n"), F.col("seq")[0].alias("first"), mean.alias("mean"))


@query("w23_latest_rows", f"{K} close:6", """
SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 5""")
def _w23(t):
    return selection.last_n(t.bars, ["symbol"], ["ts"], 5)


@query("w24_session_gaps", "symbol n_gaps:i median_gap_h:6", f"""
SELECT symbol, count(CASE WHEN g > 168 THEN 1 END) AS n_gaps, quantile_cont(g, 0.5) AS median_gap_h FROM (
  SELECT symbol, date_diff('hour', lag(session_date) {sqlwin('session_date')}, session_date) AS g FROM sessions) GROUP BY 1""")
def _w24(t):
    ws = win.series("symbol", order="session_date")
    g = t.sessions.withColumn("g", F.datediff("session_date", F.lag("session_date").over(ws)) * 24)
    return g.groupBy("symbol").agg(F.count_if(F.col("g") > 168).alias("n_gaps"), F.percentile("g", 0.5).alias("median_gap_h"))


@query("w25_annualised_funding", f"{K} apr:8", f"""
SELECT symbol, ts, coalesce({roll('avg({})', 'funding', 7)} * 365, 0) AS apr FROM fday""")
def _w25(t):
    from tidebar.operators.aggregates import daily_funding

    f = daily_funding(t.funding)
    return f.select("symbol", "ts", F.coalesce(win.rolling_mean("funding", w(), 7) * num(365), num(0)).alias("apr"))


@query("w_long_series_rolling", "event_id:i event_type mean50:6", f"""
SELECT event_id, event_type, {roll('avg({})', 'value', 50, order='ts, event_id', part='event_type')} AS mean50 FROM events""")
def _wlong(t):
    e = t.events.select("event_id", "event_type", F.col("ts"), "value")
    return blocks.rolling_blocks(e, ["event_type"], ["ts", "event_id"], 50,
                                 lambda ww: {"mean50": win.rolling_mean("value", ww, 50)}, span="day")


