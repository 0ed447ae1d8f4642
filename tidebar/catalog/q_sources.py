"""Source and sink queries. Files are written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.base import query
from tidebar.catalog.tables_sql import donchian_pos
from tidebar.functions.columns import num
from tidebar.operators import aggregates
from tidebar.operators import windows as win
from tidebar.plans import registry
from tidebar.session import scratch_path
from tidebar.sources import readers, sinks


def _store_bars(t, name: str) -> str:
    """Daily and hourly bars as one partitioned bar table."""
    root = scratch_path(t.spark, name)
    day = t.bars.withColumn("market", F.lit("spot")).withColumn("timeframe", F.lit("1d"))
    hour = t.hbars.withColumn("market", F.lit("um")).withColumn("timeframe", F.lit("1h"))
    both = day.unionByName(hour).withColumns(
        {"taker_buy_base": F.col("volume") / 2, "taker_buy_quote": F.col("quote_volume") / 2})
    sinks.replace_table(both, f"{root}/market", ["market", "timeframe"])
    return root


@query("s1_bar_scan", "symbol ts:t close:8 market timeframe", """
SELECT symbol, ts, close, 'spot' AS market, '1d' AS timeframe FROM bars WHERE symbol IN ('NO', 'AF')""")
def _s1(t):
    root = _store_bars(t, "s1")
    return readers.read_bars(t.spark, f"{root}/market", "spot", "1d", ["NO", "AF"])


@query("s1_bucketed_rolling", "symbol ts:t close:8 mean20:6 funding_rate:9", """
SELECT symbol, ts, close, CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END AS mean20, funding_rate
FROM hbars LEFT JOIN funding USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _s1_bucketed(t):
    """Hourly bars and funding stored by series: the rolling mean needs no shuffle, nor does the join where the session allows it."""
    def store(rows, name):
        path = scratch_path(t.spark, name)
        return sinks.bucket_bars(rows, path.rsplit("/", 1)[1].replace("-", "_"), path, 8)

    bars, funding = store(t.hbars.select("symbol", "ts", "close"), "s1-bars"), store(t.funding, "s1-funding")
    mean = win.rolling_mean("close", win.series("symbol"), 20)
    return bars.withColumn("mean20", mean).join(funding.hint("merge"), ["symbol", "ts"], "left")


@query("s2_named_views", "market symbol n:i", """
SELECT 'spot' AS market, symbol, count(*) AS n FROM bars GROUP BY 2
UNION ALL SELECT 'um', symbol, count(*) FROM hbars GROUP BY 2""")
def _s2(t):
    made = readers.register_views(t.spark, _store_bars(t, "s2"), {"klines": "market", "rates": "funding"})
    assert made == ["klines"], made
    return t.spark.sql("SELECT market, symbol, count(*) AS n FROM klines GROUP BY market, symbol")


@query("s3_kline_csv", "ts:t open:6 high:6 low:6 close:6 volume:4 trades:i", """
SELECT ts, open, high, low, close, volume, trades FROM hbars""")
def _s3(t):
    ms = F.unix_millis("ts")
    one = lambda c: F.col(c).cast("string")
    lines = t.hbars.select(
        ms.alias("open_time"), *[one(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
        (ms + 3_599_999).alias("close_time"), one("quote_volume").alias("quote_volume"), "trades",
        F.lit("0").alias("taker_buy_base"), F.lit("x").alias("taker_buy_quote"), F.lit("0").alias("ignore"))
    path = scratch_path(t.spark, "s3")
    lines.write.option("header", True).csv(path)
    return readers.read_kline_csv(t.spark, path)


@query("s4_funding_csv", "symbol ts:t funding_rate:9 interval_hours:1", """
SELECT symbol, ts, funding_rate, 8.0 AS interval_hours FROM funding""")
def _s4(t):
    # headerless files for some symbols in swapped column order, as strings
    swapped = F.col("symbol") < "e"
    rate, hours = F.col("funding_rate").cast("string"), F.lit("8")
    raw = t.funding.select(
        "symbol", F.unix_millis("ts").cast("string").alias("c0"),
        F.when(swapped, rate).otherwise(hours).alias("c1"), F.when(swapped, hours).otherwise(rate).alias("c2"))
    path = scratch_path(t.spark, "s4")
    raw.write.partitionBy("symbol").csv(path)
    schema = "c0 string, c1 string, c2 string"
    back = t.spark.read.schema(f"{schema}, symbol string").csv(path)
    return readers.shape_funding(back, "symbol")


@query("s5_rss_items", "link_hash title link published_utc:t", """
SELECT sha1('http://n.example/' || doc_id) AS link_hash, 'Item ' || doc_id || ' ' || lang AS title,
  'http://n.example/' || doc_id AS link, t AS published_utc FROM headlines""")
def _s5(t):
    item = F.concat(
        F.lit("<item><title>Item &lt;b&gt;"), F.col("doc_id").cast("string"), F.lit("&lt;/b&gt;  "), F.col("lang"),
        F.lit("</title><link> http://n.example/"), F.col("doc_id").cast("string"), F.lit(" </link><pubDate>"),
        F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>d</description></item>"))
    docs = t.headlines.select(item.alias("xml"), F.col("source"))
    return readers.shape_rss_text(docs, "xml", F.col("source"), F.lit("2024-02-01"))


@query("s6_article_json", "url_hash url domain seen_utc:t", """
SELECT sha1('http://a.example/' || doc_id) AS url_hash, 'http://a.example/' || doc_id AS url, source AS domain, t AS seen_utc
FROM headlines""")
def _s6(t):
    # one payload per source and hour, so a payload stays small however hot a source is
    art = F.struct(
        F.col("title"), F.concat(F.lit("http://a.example/"), F.col("doc_id")).alias("url"),
        F.col("source").alias("domain"), F.date_format("t", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    hour = F.date_trunc("hour", "t")
    body = t.headlines.groupBy("source", hour).agg(F.to_json(F.struct(F.collect_list(art).alias("articles"))).alias("body"))
    return readers.shape_articles(body, "body", F.lit("2024-02-01"))


@query("s7_flow_json", "asset date:t net_flow_usd_m:3 price_usd:4", """
SELECT asset, date, round(round(net_flow_usd_m * 1000) * 1000.0 / 1e6, 3) AS net_flow_usd_m, 100.0 AS price_usd FROM flows""")
def _s7(t):
    rec = F.struct(
        (F.unix_millis("date") + 3_600_000).alias("timestamp"),
        (F.round(F.col("net_flow_usd_m") * 1000) * num(1000)).alias("flow_usd"), num(100).alias("price_usd"))
    month = F.date_trunc("month", "date")
    body = t.flows.groupBy("asset", month).agg(F.to_json(F.struct(F.collect_list(rec).alias("data"))).alias("body"))
    return readers.shape_flow_json(body, "asset", "body", F.lit("2024-02-01"))


@query("s8_flow_html", "asset date:t net_flow_usd_m:1", """
SELECT asset, date, round(net_flow_usd_m + 1e-6, 1) AS net_flow_usd_m FROM flows""")
def _s8(t):
    v = F.round(F.col("net_flow_usd_m") + num(1e-6), 1)  # keeps halves off the rounding edge
    shown = F.format_number(F.abs(v), 1)
    text = F.when(v < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    row = F.concat(F.lit("<tr><td>"), F.date_format("date", "d MMM yyyy"), F.lit("</td><td>-</td><td class='t'>"), text,
                   F.lit("</td><td></td></tr>"))
    # a page covers one asset and month, as the published pages do
    page = t.flows.groupBy("asset", F.date_trunc("month", "date").alias("m")).agg(F.concat_ws("", F.collect_list(row)).alias("_rows"))
    html = F.concat(F.lit("<table><tr><th></th><th>Fee</th></tr>"), F.col("_rows"),
                    F.lit("<tr><td>Total</td><td>1,234.5</td></tr></table>"))
    return readers.shape_flow_html(page.withColumn("html", html), "asset", "html", F.lit("2024-02-01"))


# the lists of the pages as tables: an item becomes a row of its number of characters and its text
@query("s8_html_cells", "page_id:i n_cells:i first last", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS item FROM pages)
SELECT page_id, 2 AS n_cells, 'li' AS first, trim(regexp_replace(item, '<[^>]*>', '', 'g')) AS last FROM l""")
def _s8b(t):
    table = F.replace(F.replace("html", F.lit("<li>"), F.lit("<TR class='i'><th>li</th><td>&nbsp;")), F.lit("</li>"), F.lit("</td >\n</TR>"))
    cells = readers.html_rows(t.pages.select("page_id", table.alias("html")), ["page_id"], "html")
    return cells.select("page_id", F.size("cells").alias("n_cells"), F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("last"))


@query("s9_vendor_csv", "symbol session_date:d open:6 close:6", """
SELECT symbol, session_date, open, CASE WHEN volume >= 2 THEN close END AS close FROM sessions""")
def _s9(t):
    raw = t.sessions.select(
        "symbol", F.col("session_date").cast("string").alias(" DATE "), F.col("open").cast("string").alias("Open"),
        F.when(F.col("volume") >= 2, F.col("close").cast("string")).otherwise(".").alias("CLOSE"))
    path = scratch_path(t.spark, "s9")
    raw.write.partitionBy("symbol").option("header", True).csv(path)
    return readers.read_vendor_csv(t.spark, path)


@query("s10_chart_json", "symbol session_date:d close:4 volume:1", """
SELECT symbol, session_date, close, volume FROM sessions""")
def _s10(t):
    from tidebar.functions.times import seconds

    s = t.sessions.withColumn("y", F.year("session_date"))
    arr = lambda e: F.transform("_b", lambda b: b[e])
    bar = F.struct(seconds("bar_start").cast("long").alias("ts"), "open", "high", "low", "close", "volume")
    g = s.groupBy("symbol", "y").agg(F.collect_list(bar).alias("_b"))
    body = F.to_json(F.struct(
        arr("ts").alias("timestamp"), *[arr(c).alias(c) for c in ("open", "high", "low", "close", "volume")]))
    return readers.shape_chart_json(g.select("symbol", body.alias("body")), "symbol", "body")


@query("s11_event_calendar", "name kind utc:t", """
SELECT name, kind, utc FROM calendar_t WHERE name <> 'NATION_3'""")
def _s11(t):
    text = F.when(F.col("name") == "NATION_3", "not a time").otherwise(F.date_format("utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return readers.shape_calendar(t.calendar.select("name", "kind", text.alias("utc")))


@query("s12_quote_snapshot", "market symbol last:4 bid:4", """
SELECT CASE WHEN doc % 2 = 0 THEN 'spot' ELSE 'swap' END AS market,
  'P' || doc || CASE WHEN doc % 2 = 0 THEN 'USDT' ELSE 'USDT_PERP' END AS symbol, p_retailprice AS last, p_retailprice - 1 AS bid
FROM (SELECT p_partkey AS doc, p_retailprice FROM part)""")
def _s12(t):
    swap = F.col("p_partkey") % 2 == 1
    name = F.concat(F.lit("P"), F.col("p_partkey"), F.when(swap, "/USDT:USDT").otherwise("/USDT"))
    q = F.struct(F.col("p_retailprice").alias("last"), (F.col("p_retailprice") - 1).alias("bid"))
    # snapshots of at most a few hundred pairs each
    p = t.part.withColumn("_snap", F.floor(F.col("p_partkey") / 200)).withColumn("_e", F.struct(name.alias("k"), q.alias("v")))
    side = lambda c: F.map_from_entries(F.collect_list(F.when(c, F.col("_e"))))
    g = p.groupBy("_snap").agg(side(~swap).alias("spot"), side(swap).alias("swap"))
    return readers.shape_quotes(g.select(F.to_json(F.struct("spot", "swap")).alias("body")), "body")


@query("s13_funding_records", "symbol ts:t funding_rate:6", """
SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_max(value, event_id) / 100 AS funding_rate
FROM events WHERE value > 1 GROUP BY 1, 2""")
def _s13(t):
    hour = F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    rec = t.events.select(
        "event_type", hour.alias("timestamp"), F.when(F.col("value") > 1, F.col("value") / 100).alias("rate"),
        F.col("event_id").alias("arrival"))
    return readers.shape_funding_records(rec, F.col("event_type"))


@query("s14_table_replace", "symbol n:i", """
SELECT symbol, CASE WHEN symbol = 'NO' THEN 1 ELSE count(*) END AS n FROM bars GROUP BY symbol""")
def _s14(t):
    path = scratch_path(t.spark, "s14")
    b = t.bars.select("symbol", "ts", "close")
    sinks.replace_table(b, path, ["symbol"])
    last = b.where("symbol = 'NO'").groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))
    sinks.replace_table(last.select("ts", "close", "symbol"), path, ["symbol"])
    return t.spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("s15_append_history", "level n:i", """
SELECT CASE WHEN value > 200 THEN 'P1' ELSE 'P2' END AS level, 2 * count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1""")
def _s15(t):
    path = scratch_path(t.spark, "s15")
    inc = t.events.where("event_type = 'error'").select(
        F.when(F.col("value") > 200, "P1").otherwise("P2").alias("level"), F.col("ts").cast("date").alias("day"))
    sinks.append_history(inc, path, ["day"])
    sinks.append_history(inc, path, ["day"])
    return t.spark.read.parquet(path).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


_W = " UNION ALL ".join(
    f"SELECT symbol, ts, pos FROM ({donchian_pos(n, x)})" for n, x in [(20, 10), (40, 20), (55, 27), (100, 50)])


@query("s16_signal_sink", "decision_date:t effective_from:d gross_exposure:6 legs", f"""
WITH w AS (SELECT symbol, ts, avg(pos) / 3.0 AS weight FROM ({_W}) GROUP BY 1, 2),
last AS (SELECT max(ts) AS d FROM w),
legs AS (SELECT s.symbol, w.weight FROM (SELECT DISTINCT symbol FROM w) s CROSS JOIN last LEFT JOIN w ON w.symbol = s.symbol AND w.ts = last.d)
SELECT d AS decision_date, CAST(d AS DATE) + 1 AS effective_from,
  CASE WHEN count(weight) = count(*) THEN round(sum(weight), 6) END AS gross_exposure,
  string_agg(symbol || CASE WHEN weight IS NULL THEN '?' ELSE '=' || CAST(CAST(round(weight * 1000) AS INTEGER) AS VARCHAR) END, ',' ORDER BY symbol) AS legs
FROM legs, last GROUP BY d""")
def _s16(t):
    path = scratch_path(t.spark, "s16")
    w = registry.strategy("donchian_ensemble")(t.bars)
    sinks.write_signals(w, path, "donchian_ensemble")
    back = t.spark.read.schema(
        "decision_date timestamp, effective_from date, target_weights map<string,double>, gross_exposure double"
    ).json(f"{path}/donchian_ensemble.latest")
    entries = F.array_sort(F.transform(F.map_entries("target_weights"), lambda e: F.concat(
        e["key"], F.when(e["value"].isNull(), "?").otherwise(F.concat(F.lit("="), F.round(e["value"] * 1000).cast("int").cast("string"))))))
    return back.withColumn("legs", F.concat_ws(",", entries))


@query("s18_csv_summary", "symbol n:i total:2", """
SELECT symbol, count(*) AS n, sum(volume) AS total FROM bars GROUP BY symbol""")
def _s18(t):
    path = scratch_path(t.spark, "s18")
    s = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("total"))
    sinks.write_summary_csv(s, path)
    return t.spark.read.schema("symbol string, n long, total double").option("header", True).csv(path)


@query("s19_series_manifest", "symbol n_rows:i first_ts:t last_ts:t", """
SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM wbars GROUP BY symbol""")
def _s19(t):
    return aggregates.inventory(t.wbars, ["symbol"])


@query("s19_month_gaps", "symbol month is_leading:b", """
WITH m AS (SELECT DISTINCT symbol, CAST(date_trunc('month', ts) AS DATE) AS ym FROM wbars),
r AS (SELECT symbol, min(ym) AS a, max(ym) AS b FROM m GROUP BY symbol),
s AS (SELECT symbol, a, CAST(unnest(generate_series(CAST(least(a, DATE '1994-11-01') AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ym FROM r)
SELECT s.symbol, strftime(s.ym, '%Y-%m') AS month, s.ym < s.a AS is_leading FROM s ANTI JOIN m ON m.symbol = s.symbol AND m.ym = s.ym""")
def _s19b(t):
    return aggregates.month_gaps(t.wbars, ["symbol"], F.lit("1994-11-15").cast("date")).withColumnRenamed("leading", "is_leading")


