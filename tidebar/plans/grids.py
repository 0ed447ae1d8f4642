"""Strategy families, their parameter grids and cost presets, as small tables.

The grids are fixed before any result is seen; the trial counts of the Deflated
Sharpe Ratio follow from their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Parameter grids per family (8 + 4 + 12 + 8 = 32 trials).
SMA = [(f, s) for f in (20, 50, 100) for s in (100, 200, 300) if f < s]
DONCHIAN = [(n, max(5, n // 2)) for n in (20, 40, 55, 100)]
TSMOM = [(lb, tv) for lb in (30, 60, 90, 180) for tv in (0.10, 0.15, 0.20)]
RSI = [(n, b, e) for n in (7, 14) for b in (25, 30) for e in (55, 70)]

FAMILY_SIZES = {"sma_cross": len(SMA), "donchian": len(DONCHIAN), "tsmom": len(TSMOM), "rsi_meanrev": len(RSI)}
TOTAL_TRIALS = sum(FAMILY_SIZES.values())

# Cost presets as (name, fee per side in bps, slippage floor in bps).
COST_PRESETS = [
    ("spot_taker10", 10.0, 1.0),
    ("um_taker6", 6.0, 1.0),
    ("um_maker2", 2.0, 1.0),
    ("spot_stress2x", 20.0, 2.0),
]

# Paper book -> (family, fixed parameters).
BOOKS = [
    ("donchian_ensemble", "donchian", {}),
    ("tsmom_ensemble", "tsmom", {"long_short": "false", "max_lev": "1.0"}),
]

PARAM_SCHEMA = (
    "family string, params string, grid_order long, fast long, slow long, n_entry long, n_exit long, "
    "lookback long, target_vol double, rsi_n long, buy_below double, exit_above double"
)


def _rows() -> list[tuple]:
    rows: list[tuple] = []

    def add(family: str, label: str, **p):
        names = ["fast", "slow", "n_entry", "n_exit", "lookback", "target_vol", "rsi_n", "buy_below", "exit_above"]
        rows.append((family, label, len(rows), *[p.get(n) for n in names]))

    for f, s in SMA:
        add("sma_cross", f"fast={f},slow={s}", fast=f, slow=s)
    for n, x in DONCHIAN:
        add("donchian", f"n_entry={n},n_exit={x}", n_entry=n, n_exit=x)
    for lb, tv in TSMOM:
        add("tsmom", f"lookback={lb},target_vol={tv}", lookback=lb, target_vol=tv)
    for n, b, e in RSI:
        add("rsi_meanrev", f"n={n},buy_below={b},exit_above={e}", rsi_n=n, buy_below=float(b), exit_above=float(e))
    return rows


def grid(spark: SparkSession, families: list[str] | None = None) -> DataFrame:
    """The parameter table: one row per (family, params)."""
    rows = [r for r in _rows() if families is None or r[0] in families]
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def cost_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COST_PRESETS, "cost string, fee_bps double, floor_bps double")


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOOKS, "book string, family string, fixed map<string,string>")
