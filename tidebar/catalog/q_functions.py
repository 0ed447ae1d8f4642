"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import query
from tidebar.catalog.tables_sql import roll
from tidebar.functions import columns as C
from tidebar.functions import text as X
from tidebar.functions import times as TM
from tidebar.functions.columns import num
from tidebar.operators import windows as win

K = "symbol ts:t"


def w():
    """Window of one series; built on use, so the catalog loads without a session."""
    return win.series("symbol")


@query("f1_epoch_units", "event_id:i ts:t", """
SELECT event_id, CASE WHEN event_type < 'd' THEN date_trunc('second', ts) WHEN event_type < 'q' THEN date_trunc('millisecond', ts) ELSE ts END AS ts FROM events""")
def _f1(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    v = F.when(F.col("event_type") < "d", F.floor(us / 1_000_000)).when(F.col("event_type") < "q", F.floor(us / 1000)).otherwise(us)
    e = t.events.select("event_id", "event_type", v.cast("string").alias("epoch"))
    return TM.normalize_epochs(e, "epoch", ["event_type"])


CLEANED = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("f2_clean_text", "page_id:i body", f"SELECT page_id, {CLEANED} AS body FROM pages")
def _f2(t):
    return t.pages.select("page_id", X.clean_text("html").alias("body"))


@query("f2_limited_text", "page_id:i body n:i", f"SELECT page_id, substring({CLEANED}, 1, 1000) AS body, length({CLEANED}) AS n FROM pages")
def _f2_limited(t):
    """The optional limit, beside the length of the whole."""
    return t.pages.select("page_id", X.clean_text("html", 1000).alias("body"), F.length(X.clean_text("html")).alias("n"))


@query("f3_parse_dates", "doc_id:i at_ts:t", """
SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 1 THEN t - INTERVAL 2 HOUR ELSE t END AS at_ts FROM headlines""")
def _f3(t):
    k = F.col("doc_id") % 4
    text = (F.when(k == 0, F.concat(F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .when(k == 1, F.concat(F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
            .when(k == 2, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon"))
    return t.headlines.select("doc_id", TM.parse_pubdate(text).alias("at_ts"))


@query("f4_hash_keys", "doc_id:i k1 k2", "SELECT doc_id, sha1(text) AS k1, substring(sha256(text), 1, 16) AS k2 FROM documents")
def _f4(t):
    return t.documents.select("doc_id", X.url_key("text").alias("k1"), X.short_hash("text").alias("k2"))


@query("f5_money_text", "o_orderkey:i v:2", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice WHEN 2 THEN o_totalprice WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE o_totalprice END AS v FROM orders""")
def _f5(t):
    p = F.format_number("o_totalprice", 2)
    k = F.col("o_orderkey") % 6
    text = (F.when(k == 0, p).when(k == 1, F.concat(F.lit("("), p, F.lit(")"))).when(k == 2, F.concat(F.lit("US$"), p))
            .when(k == 3, "–").when(k == 4, "12x").otherwise(F.concat(F.lit(" +"), p)))
    return t.orders.select("o_orderkey", X.parse_money(text).alias("v"))


_CHARS, _PLAIN, _MANY = X.folding()
_PAIRS = "[" + ", ".join(f"['{a}', '{b}']" for a, b in _MANY) + "]"
_SEVERAL = f"list_reduce(list_prepend([title], {_PAIRS}), lambda t, m: [replace(t[1], m[1], m[2])])[1]"
_FOLD = f"translate(CASE WHEN regexp_matches(title, '{X.several_letters()}') THEN {_SEVERAL} ELSE title END, '{_CHARS}', '{_PLAIN}')"
TOKENS = (
    f"list_sort(list_distinct(list_filter(string_split(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g'), ' '), "
    "lambda x: len(x) >= 3 OR regexp_matches(x, '^[0-9]+$'))))"
)


@query("f6_folded_tokens", "doc_id:i toks", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS toks FROM headlines")
def _f6(t):
    return t.headlines.select("doc_id", F.concat_ws(" ", X.fold_tokens("title")).alias("toks"))


@query("f6_exact_folding", "doc_id:i n:i", f"SELECT doc_id, len({TOKENS}) AS n FROM headlines")
def _f6b(t):
    return t.headlines.select("doc_id", F.size(X.fold_tokens("title")).alias("n"))


@query("f7_detect_assets", "conv_id:i turn:i assets", r"""
SELECT conv_id, turn, CASE WHEN b = '' THEN 'ALL' ELSE substring(b, 2) END AS assets FROM (SELECT conv_id, turn,
 (CASE WHEN regexp_matches(x, 'bitcoin|\bbtc\b') THEN ',BTC' ELSE '' END) || (CASE WHEN regexp_matches(x, 'ethereum|\beth\b') THEN ',ETH' ELSE '' END)
 || (CASE WHEN regexp_matches(x, 'solana|\bsol\b') THEN ',SOL' ELSE '' END) AS b
 FROM (SELECT conv_id, turn, lower(text) || CASE WHEN conv_id % 3 = 0 THEN ' btc and ether' WHEN conv_id % 3 = 1 THEN ' bitcoin solana' ELSE '' END AS x FROM conversations))""")
def _f7(t):
    tail = F.when(F.col("conv_id") % 3 == 0, " btc and Ether").when(F.col("conv_id") % 3 == 1, " Bitcoin SOLANA").otherwise("")
    return t.conversations.select("conv_id", "turn", F.concat_ws(",", X.detect_assets(F.concat("text", tail))).alias("assets"))


_CASES = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{c}|{d}|{s}'" for _, (p, c, d, s) in sorted(enumerate(X.KEYWORD_RULES), key=lambda e: (-e[1][3], e[0])))


@query("f8_keyword_rules", "doc_id:i outcome", f"""
SELECT doc_id, CASE {_CASES} ELSE 'other|neutral|1' END AS outcome FROM (
  SELECT doc_id, lower(text) || CASE doc_id % 5 WHEN 0 THEN ' exchange hack and delisting' WHEN 1 THEN ' rate cut ahead' WHEN 2 THEN ' etf inflow after crash' ELSE '' END AS x FROM documents)""")
def _f8(t):
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, " Exchange hack and delisting").when(k == 1, " Rate cut ahead").when(k == 2, " ETF inflow after crash").otherwise("")
    c = X.classify(F.concat("text", tail))
    return t.documents.select("doc_id", F.concat_ws("|", c["category"], c["direction"], c["severity"].cast("string")).alias("outcome"))


@query("f9_availability_floor", "symbol session_date:d available_at:t", "SELECT symbol, session_date, available_at FROM sessions")
def _f9(t):
    return t.sessions.select("symbol", "session_date", TM.availability_floor("session_date").alias("available_at"))


@query("f10_session_bounds", "symbol session_date:d bar_start:t bar_end:t vix_end:t", """
SELECT symbol, session_date, bar_start, bar_end, bar_end + INTERVAL 15 MINUTE AS vix_end FROM sessions""")
def _f10(t):
    a, b = TM.session_bounds("session_date")
    return t.sessions.select("symbol", "session_date", a.alias("bar_start"), b.alias("bar_end"), TM.session_bounds("session_date", 16, 15)[1].alias("vix_end"))


@query("f11_months", "symbol n:i first last_full", """
SELECT symbol, date_diff('month', min(ts), max(ts)) + 1 AS n, strftime(min(ts), '%Y-%m') AS first,
  strftime(date_trunc('month', max(ts)) - INTERVAL 1 MONTH, '%Y-%m') AS last_full FROM wbars GROUP BY 1""")
def _f11(t):
    g = t.wbars.groupBy("symbol").agg(F.min(F.col("ts").cast("date")).alias("a"), F.max(F.col("ts").cast("date")).alias("b"))
    m = g.withColumn("m", TM.month_range(F.col("a"), F.col("b")))
    return m.select("symbol", F.size("m").alias("n"), F.col("m")[0].alias("first"), TM.last_complete_month(F.col("b")).alias("last_full"))


@query("f12_symbol_slug", "p_partkey:i slug", """
SELECT p_partkey, 'P' || p_partkey || CASE WHEN p_size % 2 = 0 THEN 'USDT_PERP' ELSE 'USDT' END AS slug FROM part""")
def _f12(t):
    pair = F.concat(F.lit("P"), F.col("p_partkey"), F.when(F.col("p_size") % 2 == 0, "/USDT:USDT").otherwise("/USDT"))
    return t.part.select("p_partkey", X.symbol_slug(pair).alias("slug"))


@query("f13_cost_rate", f"{K} slip:6 rate:9", """
SELECT symbol, ts, greatest(coalesce(dvol * sqrt(10000.0 / nullif(ddv, 0)) * 10000.0, 1.0), 1.0) AS slip,
 (10.0 + greatest(coalesce(dvol * sqrt(10000.0 / nullif(ddv, 0)) * 10000.0, 1.0), 1.0)) / 10000.0 AS rate FROM bt_in""")
def _f13(t):
    from tidebar.plans.backtest import bar_inputs

    s = bar_inputs(t.bars).withColumn("slip", C.slippage_bps("daily_vol", "dollar_volume"))
    return s.withColumn("rate", C.cost_rate(10.0, F.col("slip")))


@query("f14_vol_target", f"{K} scale:7", f"""
SELECT symbol, ts, CASE WHEN v IS NULL THEN 0.0 WHEN v = 0 THEN 1.0 ELSE least(0.15 / v, 1.0) END AS scale FROM (
  SELECT symbol, ts, {roll('stddev_samp({})', 'ret', 20)} * sqrt(365.0) AS v FROM ret_bars)""")
def _f14(t):
    r = t.bars.withColumn("ret", win.pct_change("close", w()))
    v = win.rolling_std("ret", w(), 20) * F.sqrt(num(365))
    return r.select("symbol", "ts", C.vol_target_scale(v, 0.15).alias("scale"))


@query("f15_math", "l_orderkey:i s:1 a:6 c:6 l:6 e:6 p:6", """
SELECT l_orderkey, sign(x) AS s, abs(x) AS a, greatest(least(x, 0.5), -0.5) AS c, ln(l_extendedprice) AS l, exp(x) AS e, power(l_quantity, 0.25) + sqrt(l_tax) AS p
FROM (SELECT *, l_discount - 0.05::DOUBLE AS x FROM lineitem)""")
def _f15(t):
    x = F.col("l_discount") - num(0.05)
    return t.lineitem.select(
        "l_orderkey", C.sign(x).alias("s"), F.abs(x).alias("a"), C.clip(x, -0.5, 0.5).alias("c"), F.ln("l_extendedprice").alias("l"),
        F.exp(x).alias("e"), (F.pow("l_quantity", F.lit(0.25)) + F.sqrt("l_tax")).alias("p"))


@query("f16_risk_multiplier", f"{K} mult:7", f"""
SELECT symbol, ts, CASE WHEN s IS NOT NULL THEN greatest(least(0.8 / greatest(s, 1e-8), 1), 0) END * CASE WHEN p IS NULL THEN 1 WHEN p >= 0.5 THEN 0 WHEN p >= 0.25 THEN 0.5 ELSE 1 END AS mult
FROM (SELECT symbol, ts, {roll('stddev_samp({})', 'ret', 20)} AS s, CASE WHEN volume > 20 THEN (volume % 40) / 40.0 END AS p FROM ret_bars)""")
def _f16(t):
    r = t.bars.withColumn("ret", win.pct_change("close", w()))
    p = F.when(F.col("volume") > 20, (F.col("volume") % 40) / num(40))
    s = r.withColumn("s", win.rolling_std("ret", w(), 20))
    return s.select("symbol", "ts", C.risk_multiplier("s", num(0.8), p).alias("mult"))


@query("f17_tail_label", f"{K} strict:1 zeroed:1", """
SELECT symbol, ts, CASE WHEN y IS NOT NULL THEN CAST(y <= -2 AS DOUBLE) END AS strict, coalesce(CAST(y <= -2 AS DOUBLE), 0) AS zeroed
FROM (SELECT symbol, ts, -volume / 20.0 * (ret / nullif(greatest(ret, 0.3), 0)) AS y FROM (SELECT symbol, ts, volume, abs(ret) AS ret FROM ret_bars))""")
def _f17(t):
    r = t.bars.select("symbol", "ts", F.abs(win.pct_change("close", w())).alias("s"), (-F.col("volume") / num(20)).alias("z"))
    return r.select("symbol", "ts", C.tail_label("z", "s", num(0.3)).alias("strict"), C.tail_label("z", "s", num(0.3), True).alias("zeroed"))


@query("f18_har_design", f"{K} x1:6 x2:6 x3:6", f"""
SELECT symbol, ts, ln(abs(r / nullif(s, 0) * s) + 1e-6) AS x1, ln(v5 * sqrt(365.0) / sqrt(365.0) + 1e-6) AS x2, ln(v22 * sqrt(365.0) / sqrt(365.0) + 1e-6) AS x3 FROM (
 SELECT symbol, ts, ret AS r, {roll('stddev_samp({})', 'ret', 20)} AS s, {roll('stddev_samp({})', 'ret', 5)} AS v5, {roll('stddev_samp({})', 'ret', 22)} AS v22 FROM ret_bars)""")
def _f18(t):
    r = t.bars.select("symbol", "ts", win.pct_change("close", w()).alias("ret"))
    sd = {n: win.rolling_std("ret", w(), n) for n in (20, 5, 22)}
    root = F.sqrt(num(365))
    s = r.select("symbol", "ts", "ret", sd[20].alias("s"), (sd[5] * root).alias("v5"), (sd[22] * root).alias("v22"))
    x1, x2, x3 = C.har_design(F.try_divide("ret", "s"), F.col("s"), F.col("v5"), F.col("v22"))
    return s.select("symbol", "ts", x1.alias("x1"), x2.alias("x2"), x3.alias("x3"))


@query("f19_param_label", "p_partkey:i label", """
SELECT p_partkey, 'size=' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ',brand=' || p_brand ELSE '' END AS label FROM part""")
def _f19(t):
    return t.part.select("p_partkey", X.param_label({"size": "p_size", "brand": F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))}).alias("label"))


@query("f20_json_map", "event_id:i k:i", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _f20(t):
    m = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"))


@query("f21_interpolate", "event_id:i y:7", """
SELECT event_id, CASE WHEN value <= 10 THEN 0.05 WHEN value <= 50 THEN 0.05 + (value - 10) / 40 * 0.15 WHEN value <= 120 THEN 0.2 + (value - 50) / 70 * 0.3
  WHEN value <= 300 THEN 0.5 + (value - 120) / 180 * 0.4 ELSE 0.9 END AS y FROM events""")
def _f21(t):
    xs = F.array(*[num(v) for v in (10, 50, 120, 300)])
    ys = F.array(*[num(v) for v in (0.05, 0.2, 0.5, 0.9)])
    return t.events.select("event_id", C.interpolate(F.col("value"), xs, ys).alias("y"))


