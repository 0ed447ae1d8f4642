"""Explicit schemas of the model tables; no reader infers."""

from pyspark.sql import types as T

TS, D, S, L, DT, B = (
    T.TimestampType(),
    T.DoubleType(),
    T.StringType(),
    T.LongType(),
    T.DateType(),
    T.BooleanType(),
)


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in cols.items()])


BARS = _struct(
    ts=TS, open=D, high=D, low=D, close=D, volume=D, quote_volume=D,
    taker_buy_base=D, taker_buy_quote=D, trades=L, symbol=S, market=S, timeframe=S,
)
FUNDING = _struct(ts=TS, funding_rate=D, interval_hours=D, symbol=S)
SESSIONS = _struct(
    symbol=S, session_date=DT, bar_start=TS, bar_end=TS, available_at=TS,
    open=D, high=D, low=D, close=D, volume=D, is_market_open=B, source=S, ingested_at=TS,
)
FLOWS = _struct(asset=S, date=TS, net_flow_usd_m=D, price_usd=D, source=S, fetched_at=S)
TRADES = _struct(
    ts=TS, day=DT, symbol=S, side=S, qty=D, price=D, notional=D, fee=D, mode=S, reason=S,
)
CALENDAR = _struct(name=S, kind=S, utc=TS)
PANEL = _struct(
    date=TS, symbol=S, close=D, dollar_vol=D, adv30=D, rank=L, in_universe=B,
)
FORECASTS = _struct(
    variant=S, fold=L, decision_ts=TS, symbol=S, sigma_hat=D, p_tail_cal=D,
    multiplier=D, sigma_floor=D,
)

# The twelve positional columns of a raw bar file.
KLINE_COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time",
    "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore",
]
KLINE_STRINGS = _struct(**{c: S for c in KLINE_COLUMNS})
