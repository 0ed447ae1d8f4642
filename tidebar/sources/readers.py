"""Raw files to model tables.

Each source has a ``shape_*`` function (DataFrame of raw fields in, model rows
out) and a ``read_*`` function that scans files with an explicit schema.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar import schemas
from tidebar.functions.columns import num
from tidebar.functions.text import clean_text, parse_money, symbol_slug, url_key
from tidebar.functions.times import availability_floor, normalize_epochs, parse_pubdate, session_bounds
from tidebar.operators.sets import pick

# ---------------- stored tables ----------------


def read_bars(
    spark: SparkSession, root: str, market: str | None = None, timeframe: str | None = None,
    symbols: list[str] | None = None,
) -> DataFrame:
    """Bar table scan. Market and timeframe prune partitions, symbols push down."""
    df = spark.read.schema(schemas.BARS).parquet(root)
    if market is not None:
        df = df.where(F.col("market") == market)
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    return df


def register_views(spark: SparkSession, root: str, views: dict[str, str]) -> list[str]:
    """Create a temp view per stored table, ``views`` maps its name to its folder; a folder that does not exist is skipped."""
    from pyspark.errors import AnalysisException

    made = []
    for name, folder in views.items():
        try:
            spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/{folder}").createOrReplaceTempView(name)
            made.append(name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return made


# ---------------- bar and funding files ----------------


def shape_klines(raw: DataFrame, source: list[str] | None = None) -> DataFrame:
    """Twelve string columns to bars. A header or any row without an epoch drops out;
    the epoch unit is detected per source."""
    src = source or []
    df = raw if src else raw.withColumn("_src", F.lit(""))
    keyed = df.where(F.col("open_time").try_cast("long").isNotNull())
    ts = normalize_epochs(keyed, "open_time", src or ["_src"])
    doubles = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote"]
    return ts.select(
        *src, "ts", *[F.col(c).try_cast("double").alias(c) for c in doubles],
        F.col("trades").try_cast("double").try_cast("long").alias("trades"),
    )


def read_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.KLINE_STRINGS).csv(path).withColumn("file", F.input_file_name())
    return shape_klines(raw, ["file"])


def _unzip(columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            # chunked, so one archive never becomes one frame
                            for part in pd.read_csv(f, header=None, dtype=str, chunksize=50_000):
                                part = part.reindex(columns=range(len(columns)))
                                part.columns = columns
                                part.insert(0, "file", path)
                                yield part

    return one


def unzipped(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of zipped CSV archives (path, content) as string columns plus their file, one archive per task row."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["file", *columns]])
    return files.select("path", "content").mapInPandas(_unzip(columns), schema)


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return unzipped(spark.read.format("binaryFile").load(path), columns)


def read_kline_zip(spark: SparkSession, path: str) -> DataFrame:
    return shape_klines(read_zipped_csv(spark, path, schemas.KLINE_COLUMNS), ["file"])


def shape_funding(raw: DataFrame, source: str) -> DataFrame:
    """Three string columns c0, c1, c2 to funding rows, roles decided per source file.

    With a header the names decide, in whatever place the columns stand. Without one c0 is the epoch and the column
    of smaller median magnitude is the rate. Both facts are one aggregate per file.
    """
    cols = ["c0", "c1", "c2"]
    v = lambda c: F.col(c).try_cast("double")
    titled = lambda c: v(c).isNull() & F.lower(c).contains("time")
    is_header = F.coalesce(titled("c0"), F.lit(False)) | F.coalesce(titled("c1"), F.lit(False)) | F.coalesce(titled("c2"), F.lit(False))

    def place(word: str) -> Column:
        found = F.coalesce(*[F.when(F.lower(c).contains(word), F.lit(i)) for i, c in enumerate(cols)])
        return F.max(F.when(is_header, found))

    mag = lambda c: F.median(F.abs(v(c)))
    facts = raw.groupBy(source).agg(
        place("time").alias("_time"), place("rate").alias("_rate"), mag("c1").alias("_m1"), mag("c2").alias("_m2")
    )
    by_size = F.when(F.col("_m2").isNull() | (F.col("_m1") <= F.col("_m2")), 1).otherwise(2)
    roles = facts.select(source, F.coalesce("_time", F.lit(0)).alias("_time"), F.coalesce("_rate", by_size).alias("_rate"))
    j = raw.join(roles, source)
    at = lambda i: F.get(F.array(*cols), i)
    shaped = j.select(
        source, at(F.col("_time")).alias("c0"), at(F.col("_rate")).try_cast("double").alias("funding_rate"),
        at(F.lit(3) - F.col("_time") - F.col("_rate")).try_cast("double").alias("interval_hours"),
    )
    shaped = shaped.where(F.col("c0").try_cast("long").isNotNull() & F.col("funding_rate").isNotNull())
    return normalize_epochs(shaped, "c0", [source]).select(source, "ts", "funding_rate", "interval_hours")


def read_funding_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("c0", "c1", "c2")])
    raw = spark.read.schema(schema).csv(path).withColumn("file", F.input_file_name())
    return shape_funding(raw, "file")


def shape_funding_records(records: DataFrame, symbol: Column) -> DataFrame:
    """(timestamp ms, rate) records to funding rows; null rates drop, last record per instant wins."""
    rows = records.where("timestamp is not null and rate is not null").select(
        F.timestamp_millis("timestamp").alias("ts"), F.col("rate").cast("double").alias("funding_rate"),
        symbol.alias("symbol"), "arrival",
    )
    return pick(rows, ["symbol", "ts"], ["arrival"], last=True).drop("arrival")


# ---------------- news ----------------

RSS_ITEM = "struct<title:string,link:string,pubDate:string,description:string>"


def shape_rss(
    items: DataFrame, source: Column, fetched_at: Column, title_limit: int | None = None, summary_limit: int | None = None,
) -> DataFrame:
    """Feed items (title, link, pubDate, description) to news rows.

    Items without link or title drop out. The limits cut titles and summaries; None keeps them whole.
    """
    link = F.trim(F.coalesce("link", F.lit("")))
    out = items.select(
        source.alias("source"), clean_text("title", title_limit).alias("title"), link.alias("link"),
        url_key(link).alias("link_hash"), parse_pubdate("pubDate").alias("published_utc"),
        clean_text("description", summary_limit).alias("summary"), fetched_at.alias("fetched_at"),
    )
    return out.where((F.col("link") != "") & (F.col("title") != ""))


def read_rss(spark: SparkSession, path: str, source: str, fetched_at: Column) -> DataFrame:
    items = (
        spark.read.format("xml").option("rowTag", "item")
        .schema("title string, link string, pubDate string, description string").load(path)
    )
    return shape_rss(items, F.lit(source), fetched_at)


def shape_rss_text(items: DataFrame, xml: str, source: Column, fetched_at: Column) -> DataFrame:
    """The same from one ``<item>`` document per row."""
    parsed = items.withColumn("_i", F.from_xml(F.col(xml), RSS_ITEM, {"rowTag": "item"}))
    flat = parsed.withColumn("_src", source).select("_src", "_i.*")
    return shape_rss(flat, F.col("_src"), fetched_at)


ARTICLES = (
    "struct<articles:array<struct<title:string,url:string,domain:string,language:string,"
    "sourcecountry:string,seendate:string>>>"
)


def shape_articles(payloads: DataFrame, body: str, fetched_at: Column, title_limit: int | None = None) -> DataFrame:
    """Article-list JSON bodies to rows; anything that is not JSON yields none."""
    arts = payloads.select(F.explode(F.from_json(body, ARTICLES)["articles"]).alias("_a")).select("_a.*")
    url, title = F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))
    return arts.where(url != "").select(
        (title if title_limit is None else F.substring(title, 1, title_limit)).alias("title"),
        url.alias("url"), url_key(url).alias("url_hash"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("sourcecountry", F.lit("")).alias("source_country"),
        F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("seen_utc"),
        fetched_at.alias("fetched_at"),
    )


# ---------------- flows ----------------

FLOW_RECORDS = "struct<data:array<struct<timestamp:bigint,flow_usd:double,price_usd:double>>>"


def shape_flow_json(payloads: DataFrame, asset: str, body: str, fetched_at: Column) -> DataFrame:
    """Flow-history JSON: epoch ms to its UTC day, dollars to millions with 3 digits."""
    recs = payloads.select(F.col(asset).alias("asset"), F.explode(F.from_json(body, FLOW_RECORDS)["data"]).alias("_r"))
    recs = recs.select("asset", "_r.*").where("timestamp is not null and flow_usd is not null")
    return recs.select(
        "asset", F.date_trunc("day", F.timestamp_millis("timestamp")).alias("date"),
        F.round(F.col("flow_usd") / num(1e6), 3).alias("net_flow_usd_m"), "price_usd",
        F.lit("api").alias("source"), fetched_at.alias("fetched_at"),
    )


def html_rows(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Cell-text arrays of every table row of a page."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("_row"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1))
    text = F.transform(
        cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"&nbsp;", " "))
    )
    return pages.select(*keys, F.explode(rows).alias("_row")).select(*keys, text.alias("cells"))


def shape_flow_html(pages: DataFrame, asset: str, html: str, fetched_at: Column) -> DataFrame:
    """A row counts when its first cell is a '2 Jan 2024' date; its value is the last non-empty cell."""
    rows = html_rows(pages, [asset], html).where(F.size("cells") >= 2)
    day = F.try_to_timestamp(F.col("cells")[0], F.lit("d MMM yyyy"))
    full = F.filter("cells", lambda c: c != "")
    value = parse_money(F.coalesce(F.try_element_at(full, F.lit(-1)), F.lit("")))
    out = rows.select(
        F.col(asset).alias("asset"), day.alias("date"), F.round(value, 3).alias("net_flow_usd_m"),
        F.lit(None).cast("double").alias("price_usd"), F.lit("html").alias("source"), fetched_at.alias("fetched_at"),
    )
    return out.where("date is not null and net_flow_usd_m is not null")


# ---------------- sessions ----------------


def canonical_sessions(
    raw: DataFrame, source: Column, now: Column, close_hour: int = 16, close_minute: int = 0,
    arrival: str | None = None,
) -> DataFrame:
    """Provider rows (symbol, session_date, OHLC[, volume]) to the session contract.

    Null prices drop, the last row per session wins, and a session is admitted
    only once its availability floor has passed.
    """
    ok = raw.dropna(subset=["open", "high", "low", "close"])
    if "volume" not in ok.columns:
        ok = ok.withColumn("volume", F.lit(None).cast("double"))
    base = ok.select("symbol", F.col("session_date").cast("date").alias("session_date"), "open", "high", "low",
                     "close", "volume", *([arrival] if arrival else []))
    one = pick(base, ["symbol", "session_date"], [arrival] if arrival else ["open"], last=True)
    start, end = session_bounds("session_date", close_hour, close_minute)
    out = one.select(
        "symbol", "session_date", start.alias("bar_start"), end.alias("bar_end"),
        availability_floor("session_date").alias("available_at"),
        "open", "high", "low", "close", "volume", F.lit(True).alias("is_market_open"),
        source.alias("source"), now.alias("ingested_at"),
    )
    return out.where(F.col("available_at") <= F.col("ingested_at"))


def shape_vendor_csv(
    raw: DataFrame, symbol: Column, date: str, first: Column | None = None, last: Column | None = None,
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """String columns with any header case; '.' and junk become null; date range filter."""
    low = raw.toDF(*[c.strip().lower() for c in raw.columns])
    day = F.to_date(F.try_to_timestamp(F.col(date.lower()), F.lit(date_format)))
    prices = [c for c in ("open", "high", "low", "close", "volume") if c in low.columns]
    out = low.select(
        symbol.alias("symbol"), day.alias("session_date"), *[F.col(c).try_cast("double").alias(c) for c in prices]
    ).where(F.col("session_date").isNotNull())
    if first is not None:
        out = out.where(F.col("session_date") >= first)
    return out if last is None else out.where(F.col("session_date") <= last)


def read_vendor_csv(spark: SparkSession, path: str, symbol: str | None = None, date: str = "date", **kw) -> DataFrame:
    """One symbol's files, or, without ``symbol``, a folder with a part per symbol (symbol=...)."""
    raw = spark.read.option("header", True).option("nullValue", ".").option("inferSchema", False).csv(path)
    return shape_vendor_csv(raw, F.col("symbol") if symbol is None else F.lit(symbol), date, **kw)


CHART = (
    "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,"
    "close:array<double>,volume:array<double>>"
)


def shape_chart_json(payloads: DataFrame, symbol: str, body: str) -> DataFrame:
    """Parallel arrays to one row per bar; the open epoch gives the New York session date."""
    c = payloads.select(F.col(symbol).alias("symbol"), F.from_json(body, CHART).alias("_c"))
    zipped = F.arrays_zip(*[F.col(f"_c.{n}").alias(n) for n in ("timestamp", "open", "high", "low", "close", "volume")])
    rows = c.select("symbol", F.explode(zipped).alias("_b")).select("symbol", "_b.*")
    local = F.from_utc_timestamp(F.timestamp_seconds("timestamp"), "America/New_York")
    return rows.select("symbol", F.to_date(local).alias("session_date"), "open", "high", "low", "close", "volume")


# ---------------- calendar and quotes ----------------


def shape_calendar(entries: DataFrame) -> DataFrame:
    """(name, kind, utc text) entries; one without a name or a readable time is skipped."""
    out = entries.select(
        "name", F.coalesce("kind", F.lit("event")).alias("kind"), F.try_to_timestamp("utc").alias("utc")
    )
    return out.where("name is not null and utc is not null")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return shape_calendar(spark.read.schema("name string, kind string, utc string").json(path))


QUOTE = "struct<last:double,bid:double,ask:double,quote_volume_24h:double,ts:string,funding_rate:double,open_interest:double>"


def shape_quotes(payloads: DataFrame, body: str) -> DataFrame:
    """Snapshot JSON with spot and swap maps to rows per (market, symbol)."""
    parsed = payloads.select(
        F.from_json(body, f"struct<fetched_at:string,spot:map<string,{QUOTE}>,swap:map<string,{QUOTE}>>").alias("_p")
    )
    side = lambda m: parsed.select(
        F.lit(m).alias("market"), F.col("_p.fetched_at").alias("fetched_at"), F.explode(f"_p.{m}").alias("pair", "_q")
    )
    return side("spot").unionByName(side("swap")).select(
        "market", symbol_slug("pair").alias("symbol"), "fetched_at", "_q.*"
    )


# ---------------- providers ----------------

PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def provider(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a session source; every provider ends in ``canonical_sessions``."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        PROVIDERS[name] = fn
        return fn

    return add


@provider("vendor_csv")
def vendor_sessions(spark: SparkSession, path: str, symbol: str | None, now: Column, **kw) -> DataFrame:
    return canonical_sessions(read_vendor_csv(spark, path, symbol, **kw), F.lit("vendor_csv"), now)


@provider("index_csv")
def index_sessions(spark: SparkSession, path: str, symbol: str | None, now: Column, **kw) -> DataFrame:
    """An index computed into the 16:15 settlement window."""
    return canonical_sessions(read_vendor_csv(spark, path, symbol, **kw), F.lit("index_csv"), now, 16, 15)


@provider("chart_json")
def chart_sessions(spark: SparkSession, path: str, symbol: str | None, now: Column) -> DataFrame:
    body = spark.read.text(path, wholetext=True)
    body = body if symbol is None else body.withColumn("symbol", F.lit(symbol))
    return canonical_sessions(shape_chart_json(body, "symbol", "value"), F.lit("chart_json"), now)


def read_sessions(name: str, *args, **kw) -> DataFrame:
    if name not in PROVIDERS:
        raise KeyError(f"unknown provider {name!r}; registered: {sorted(PROVIDERS)}")
    return PROVIDERS[name](*args, **kw)
