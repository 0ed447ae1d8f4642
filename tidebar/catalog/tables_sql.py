"""Check SQL of the model tables, and small SQL builders."""

from __future__ import annotations

from tidebar.catalog.base import cte
from tidebar.plans import grids


def win(order: str = "ts", part: str = "symbol", frame: str = "") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order} {frame})"


def rows(n: int, lag: int = 0) -> str:
    end = "CURRENT ROW" if lag == 0 else f"{lag} PRECEDING"
    return f"ROWS BETWEEN {n - 1 + lag} PRECEDING AND {end}"


def roll(fn: str, x: str, n: int, order: str = "ts", part: str = "symbol", lag: int = 0, need: int | None = None) -> str:
    """Guarded rolling aggregate; ``fn`` has {} for the argument."""
    w = win(order, part, rows(n, lag))
    return f"(CASE WHEN count({x}) {w} >= {n if need is None else need} THEN {fn.format(x)} {w} END)"


def ohlc(px: str, order: str) -> str:
    return f"arg_min({px}, {order}) AS open, max({px}) AS high, min({px}) AS low, arg_max({px}, {order}) AS close"


_LI = (
    "(SELECT *, l_extendedprice / l_quantity AS px, "
    "row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem)"
)
cte("bars", f"""
SELECT l_returnflag || l_linestatus AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
  {ohlc('px', 'ord')}, sum(l_quantity) AS volume, sum(l_extendedprice) AS quote_volume, count(*) AS trades
FROM {_LI} GROUP BY 1, 2""")
cte("wbars", f"""
SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS symbol,
  CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts,
  {ohlc('px', 'ord')}, sum(l_quantity) AS volume, sum(l_extendedprice) AS quote_volume, count(*) AS trades
FROM {_LI} GROUP BY 1, 2""")
cte("hbars", f"""
SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
  {ohlc('value', 'ord')}, sum(value) AS volume, sum(value * 10) AS quote_volume, count(*) AS trades
FROM (SELECT event_type, ts, value, row(ts, event_id) AS ord FROM events) GROUP BY event_type, 2""")
cte("funding", """
SELECT event_type AS symbol, time_bucket(INTERVAL '8 hours', ts) AS ts,
  avg(value - 50.0::DOUBLE) / 1e5 AS funding_rate FROM events GROUP BY 1, 2""")
cte("fday", """
SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, sum(funding_rate) AS funding FROM funding GROUP BY 1, 2""")
# New York wall clock by the April-to-October daylight rule that holds for the orders' years
cte("ny_offset", """
SELECT y, y_apr + CAST((7 - isodow(y_apr)) % 7 AS INTEGER) AS dst_from,
  y_oct - CAST(isodow(y_oct) % 7 AS INTEGER) AS dst_to
FROM (SELECT y, make_date(y, 4, 1) AS y_apr, make_date(y, 10, 31) AS y_oct
      FROM (SELECT unnest(range(1990, 2007)) AS y))""")
cte("sessions", f"""
SELECT s.*, session_date + (CASE WHEN session_date >= dst_from AND session_date < dst_to
    THEN INTERVAL '13 hours 30 minutes' ELSE INTERVAL '14 hours 30 minutes' END) AS bar_start,
  session_date + (CASE WHEN session_date >= dst_from AND session_date < dst_to
    THEN INTERVAL '20 hours' ELSE INTERVAL '21 hours' END) AS bar_end,
  session_date + INTERVAL '21 hours 30 minutes' AS available_at
FROM (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS session_date,
        {ohlc('o_totalprice', 'o_orderkey')}, CAST(count(*) AS DOUBLE) AS volume
      FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1, 2) s
JOIN ny_offset ON y = year(session_date)""")
cte("flows", """
SELECT event_type AS asset, CAST(date_trunc('day', ts) AS TIMESTAMP) AS date,
  sum(value - 50.0::DOUBLE) AS net_flow_usd_m FROM events GROUP BY 1, 2""")
cte("headlines", """
SELECT doc_id, text AS title, source, lang,
  CASE WHEN doc_id % 4 = 0 THEN 'curated' ELSE 'open' END AS feed,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS t FROM documents""")
cte("trades", """
SELECT trade_id, ts, day, book, symbol, side, qty, price, round(qty * price, 4) AS notional,
  round(round(qty * price, 4) * 0.001::DOUBLE + 1e-9::DOUBLE, 6) AS fee, mode
FROM (SELECT o_orderkey AS trade_id, o_orderdate + to_minutes(o_orderkey % 1440) AS ts,
  CAST(o_orderdate AS DATE) AS day, 'book' || (o_custkey % 3) AS book, o_orderpriority AS symbol,
  CASE WHEN o_orderstatus = 'O' THEN 'buy' ELSE 'sell' END AS side,
  CAST(1 + o_orderkey % 7 AS DOUBLE) AS qty, round(o_totalprice / 1000.0::DOUBLE + 1e-9::DOUBLE, 4) AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN 'catchup' ELSE 'live' END AS mode FROM orders)""")
cte("calendar_t", """
SELECT n_name AS name, r_name AS kind,
  TIMESTAMP '1995-03-01 12:30:00' + to_days(CAST(n_nationkey * 97 AS INTEGER)) AS utc
FROM nation JOIN region ON n_regionkey = r_regionkey""")

# ---------------- backtest ----------------

cte("ret_bars", f"SELECT *, close / lag(close) {win()} - 1 AS ret FROM bars")
cte("bt_in", f"""
SELECT symbol, ts, close, coalesce(ret, 0) AS ret, coalesce({roll('stddev_samp({})', 'ret', 20)}, 0.02) AS dvol,
  {roll('quantile_cont({}, 0.5)', 'quote_volume', 20)} AS ddv FROM ret_bars""")


def backtest(pos: str, keys: str = "symbol", fee: float | str = 10.0, floor: float | str = 1.0, inputs: str = "bt_in", fund: str = "0.0") -> str:
    """Accounting over a position relation with columns keys, ts, pos."""
    w = win(part=keys)
    slip = f"greatest(coalesce(dvol * sqrt(10000.0 / nullif(ddv, 0)) * 10000.0, {floor}), {floor})"
    return f"""
SELECT *, gross - cost + funding_pnl AS net FROM (
 SELECT *, held * ret AS gross, turnover * ({fee} + {slip}) / 10000.0::DOUBLE AS cost, -held * {fund} AS funding_pnl FROM (
  SELECT *, abs(held - coalesce(lag(held) {w}, 0)) AS turnover FROM (
   SELECT p.*, i.* EXCLUDE (symbol, ts), coalesce(lag(greatest(least(p.pos, 3), -3)) {win(part=', '.join('p.' + k.strip() for k in keys.split(',')), order='p.ts')}, 0) AS held
   FROM {pos} p JOIN {inputs} i ON p.symbol = i.symbol AND p.ts = i.ts)))"""


def ffill_state(event: str, part: str = "symbol") -> str:
    return (
        f"coalesce(last_value({event} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY ts "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
    )


def donchian_event(n: int, x: int) -> str:
    up = roll("max({})", "close", n, lag=1)
    down = roll("min({})", "close", x, lag=1)
    return f"(CASE WHEN close < {down} THEN 0.0 WHEN close > {up} THEN 1.0 END)"


def donchian_pos(n: int, x: int, src: str = "bars") -> str:
    return f"SELECT symbol, ts, {ffill_state('e')} AS pos FROM (SELECT symbol, ts, {donchian_event(n, x)} AS e FROM {src})"


def sma_pos(f: int, s: int) -> str:
    a, b = roll("avg({})", "close", f), roll("avg({})", "close", s)
    return f"SELECT symbol, ts, coalesce(CAST({a} > {b} AS DOUBLE), 0) AS pos FROM bars"


def tsmom_pos(lb: int, tv: float, long_short: bool = False) -> str:
    vol = f"{roll('stddev_samp({})', 'ret', 20)} * sqrt(365.0)"
    mom = f"(close / lag(close, {lb}) {win()} - 1)"
    raw = f"sign({mom})" if long_short else f"coalesce(CAST({mom} > 0 AS DOUBLE), 0)"
    return f"""SELECT symbol, ts, coalesce(raw * (CASE WHEN v IS NULL THEN 0.0 WHEN v = 0 THEN 1.0
      ELSE least({tv} / v, 1.0) END), 0) AS pos
    FROM (SELECT symbol, ts, {raw} AS raw, {vol} AS v FROM ret_bars)"""


cte("moves", f"""
SELECT symbol, ts, rn, CASE WHEN rn > 1 THEN greatest(d, 0) END AS up, CASE WHEN rn > 1 THEN -least(d, 0) END AS dn
FROM (SELECT symbol, ts, row_number() {win()} AS rn, close - lag(close) {win()} AS d FROM bars)""")


def ewm(x: str, n: int) -> str:
    """Closed form of the recursive mean seeded by row 2: q^t * sum(w_i x_i q^-i)."""
    q = f"(1.0::DOUBLE - 1.0::DOUBLE / {n})"
    w = win(frame="ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return f"(power({q}, rn) * sum((CASE WHEN rn = 2 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / {n} END) * {x} * power({q}, -rn)) {w})"


def rsi_value(n: int) -> str:
    return f"coalesce(100 - 100 / (1 + {ewm('up', n)} / nullif({ewm('dn', n)}, 0)), 50)"


def rsi_pos(n: int, b: float, e: float) -> str:
    return f"""SELECT symbol, ts, {ffill_state('ev')} AS pos FROM (
      SELECT symbol, ts, CASE WHEN r > {e} THEN 0.0 WHEN r < {b} THEN 1.0 END AS ev
      FROM (SELECT symbol, ts, {rsi_value(n)} AS r FROM moves))"""


def variants(families: list[str] | None = None) -> str:
    parts = []
    for r in grids._rows():
        fam, label, order = r[0], r[1], r[2]
        f, s, ne, nx, lb, tv, n, b, e = r[3:]
        if families and fam not in families:
            continue
        body = {
            "sma_cross": lambda: sma_pos(f, s), "donchian": lambda: donchian_pos(ne, nx),
            "tsmom": lambda: tsmom_pos(lb, tv), "rsi_meanrev": lambda: rsi_pos(n, b, e),
        }[fam]()
        parts.append(f"SELECT symbol, ts, '{fam}' AS family, '{label}' AS params, {order} AS grid_order, pos FROM ({body})")
    return " UNION ALL ".join(parts)


VK = "symbol, family, params, grid_order"
cte("variant_pos", variants())
cte("donchian_variants", variants(["donchian"]))
cte("dc_net", backtest("donchian_variants", VK))
cte("all_net", backtest("variant_pos", VK))

SHARPE = "CASE WHEN count({0}) < 3 OR stddev_samp({0}) = 0 THEN 0 ELSE avg({0}) / stddev_samp({0}) END"


def sharpe_pp(x: str) -> str:
    return f"({SHARPE.format(x)})"


def sharpe(x: str) -> str:
    return f"({SHARPE.format(x)} * sqrt(365.0))"


def md5_draw(*parts: str) -> str:
    """An integer in [0, 2^52) from SQL expressions and quoted texts."""
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 13))::BIGINT"


def block_band_sql(src: str, key: str, ts: str, ret: str, horizon: int, n_boot: int = 4000, block: int = 10, seed: int = 42) -> str:
    """Every row of every path, multiplied up: (key, p2_5 ... n_paths)."""
    qs = ", ".join(f"quantile_cont(sim, {q}) AS {n}" for n, q in (("p2_5", 0.025), ("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p97_5", 0.975)))
    return f"""
WITH r AS (SELECT {key}, {ret} AS r, row_number() OVER (PARTITION BY {key} ORDER BY {ts}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS t FROM {src} WHERE {ret} IS NOT NULL),
d AS (SELECT {key}, t, path, b, {md5_draw(f"'{seed}'", "path", "b")} % greatest(1, t - {block}) AS s FROM (SELECT DISTINCT {key}, t FROM r), range({n_boot}) AS p(path), range({-(-horizon // block)}) AS q(b)),
e AS (SELECT {key}, path, (s + k) % t AS i FROM d, range({block}) AS o(k) WHERE b * {block} + k < {horizon})
SELECT {key}, {qs}, count(*) AS n_paths FROM (SELECT {key}, path, product(1 + r) - 1 AS sim FROM e JOIN r USING ({key}, i) GROUP BY {key}, path) GROUP BY {key}"""


def paired_sql(src: str, key: str, ts: str, n_boot: int = 2000, mean: int = 20, seed: int = 7, least: int = 100) -> str:
    """Every row of every draw: blocks of random start and geometric length until the draw is as long as the series."""
    return f"""
WITH r AS (SELECT {key}, a::DOUBLE AS a, b::DOUBLE AS b, row_number() OVER (PARTITION BY {key} ORDER BY {ts}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS t FROM {src} WHERE a IS NOT NULL AND b IS NOT NULL),
z AS (SELECT {key}, t, CAST(ceil({1.5 / mean}::DOUBLE * t) AS BIGINT) + 40 AS blocks FROM r WHERE t >= {least} GROUP BY ALL),
g AS (SELECT {key}, t, blocks, draw, unnest(range(blocks)) AS j FROM z, range({n_boot}) AS n(draw)),
l AS (SELECT *, {md5_draw(f"'{seed}'", "draw", "j", "'s'")} % t AS s, floor(ln(({md5_draw(f"'{seed}'", "draw", "j", "'l'")} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / ln(1 - 1 / {mean}.0::DOUBLE))::BIGINT + 1 AS n FROM g),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {key}, draw ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done FROM l),
u AS (SELECT {key}, draw, t, s, CASE WHEN j = blocks - 1 THEN t - done ELSE least(n, t - done) END AS n FROM c WHERE done < t),
e AS (SELECT {key}, draw, (s + unnest(range(n))) % t AS i FROM u),
p AS (SELECT {key}, draw, {sharpe_pp('a')} - {sharpe_pp('b')} AS d_sr, avg(a - b) AS d_mu FROM e JOIN r USING ({key}, i) GROUP BY {key}, draw),
v AS (SELECT {key}, avg(CAST(d_sr <= 0 AS DOUBLE)) AS sharpe_p, avg(CAST(d_mu <= 0 AS DOUBLE)) AS mean_p FROM p GROUP BY {key})
SELECT o.*, v.sharpe_p, v.mean_p FROM (SELECT {key}, count(*) AS n, {sharpe_pp('a')} - {sharpe_pp('b')} AS sharpe_diff, avg(a - b) AS mean_diff FROM r GROUP BY {key}) o LEFT JOIN v USING ({key})"""


def asof(left: str, right: str, on: str, lt: str, rt: str, cols: str, by: str = "") -> str:
    link = f"l.{by} = r.{by} AND " if by else ""
    return f"SELECT l.*, {cols} FROM {left} l ASOF LEFT JOIN {right} r ON {link}l.{lt} >= r.{rt}"
