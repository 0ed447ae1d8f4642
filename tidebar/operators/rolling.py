"""Many rolling measures of a series in one pass.

A window frame per measure and width makes a plan grow with their number, and every frame walks its rows again. Here one
kernel serves a whole list of measures: sums come from running sums about the series' first value (so that large levels
do not cancel), extremes from block maxima (each block's running maximum from both sides), both in time linear in the
series whatever the widths. A series is one Arrow group, bounded by the calendar as for ``tidebar.operators.windows``.

Every measure looks at its row and rows before only. Nulls, and NaN, do not count; a measure is null until ``min_rows``
(default: all) rows of its frame are known.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roll:
    """``op`` of column ``x`` over the ``width`` rows that end with a row: sum, mean, std, max, min; change (the value less
    the one ``width`` rows before); corr and beta (slope of x on y) with column ``y``; rank (share of the values so far
    that are below, ties by half, whatever the width)."""

    op: str
    x: str
    width: int
    min_rows: int | None = None
    y: str | None = None


def ending(run: np.ndarray, width: int) -> np.ndarray:
    """Sums of the last ``width`` values from running sums."""
    out = run.copy()
    out[width:] -= run[:-width]
    return out


def totals(x: np.ndarray, width: int) -> np.ndarray:
    return ending(np.cumsum(x), width)


def largest(x: np.ndarray, width: int) -> np.ndarray:
    """Maximum of the last ``width`` values: of the tail of the block before and the head of its own."""
    n = len(x)
    pad = np.full(-(-n // width) * width - n, -np.inf)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    head = np.maximum.accumulate(blocks, axis=1).ravel()[:n]
    tail = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    out = head.copy()
    out[width - 1 :] = np.maximum(head[width - 1 :], tail[: n - width + 1])
    return out


def expanding_rank(x: np.ndarray, least: int) -> np.ndarray:
    seen: list[float] = []
    out = np.full(len(x), np.nan)
    for i in np.flatnonzero(~np.isnan(x)):
        insort(seen, x[i])
        if len(seen) >= least:
            out[i] = (bisect_left(seen, x[i]) + 1 + bisect_right(seen, x[i])) / 2 / len(seen)
    return out


def measured(cols: dict[str, np.ndarray], r: Roll) -> np.ndarray:
    x, width = cols[r.x], r.width
    known = ~np.isnan(x)
    if r.op == "rank":
        return expanding_rank(x, r.min_rows or 1)
    if r.op == "change":
        out = np.full(len(x), np.nan)
        out[width:] = x[width:] - x[:-width]
        return out
    if r.op in ("max", "min"):
        sign = 1 if r.op == "max" else -1
        out = sign * largest(np.where(known, sign * x, -np.inf), width)
    else:
        if r.y is not None:
            known &= ~np.isnan(cols[r.y])
        centre = x[known][0] if known.any() else 0.0
        a = np.where(known, x - centre, 0.0)
        n, s = np.maximum(totals(known.astype(float), width), 1.0), totals(a, width)
        if r.op in ("sum", "mean"):
            out = s / n + centre if r.op == "mean" else s + n * centre
        else:
            squares = np.maximum(totals(a * a, width) - s * s / n, 0.0)
            if r.op == "std":
                out = np.sqrt(squares / np.where(n > 1, n - 1, np.nan))
            else:
                y = cols[r.y]
                b = np.where(known, y - (y[known][0] if known.any() else 0.0), 0.0)
                t = totals(b, width)
                other, both = np.maximum(totals(b * b, width) - t * t / n, 0.0), totals(a * b, width) - s * t / n
                under = np.sqrt(squares * other) if r.op == "corr" else other
                out = np.divide(both, under, out=np.full(len(x), np.nan), where=under > 0)
    need = width if r.min_rows is None else r.min_rows
    return np.where(totals(known.astype(float), width) >= need, out, np.nan)


def rolling_many(df: DataFrame, keys: list[str], order: str, made: dict[str, Roll]) -> DataFrame:
    """``df`` with one column per entry of ``made``, each series (``keys``) in order of ``order``: one shuffle, one kernel."""
    used = sorted({c for r in made.values() for c in (r.x, r.y) if c})
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in made]])

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        cols = {c: table.column(c).cast(pa.float64()).to_numpy() for c in used}
        for name, r in made.items():
            table = table.append_column(name, pa.array(measured(cols, r), pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*keys).applyInArrow(one, schema)
