"""Numeric column expressions. All JVM-side, all null-propagating unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 1e4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(x: float) -> Column:
    return F.lit(float(x))


def div(a: Column | str, b: Column | str) -> Column:
    """Ratio that is null on a zero denominator (ANSI mode would raise)."""
    return F.try_divide(col(a), col(b))


def clip(x: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value and keep null (``least``/``greatest`` alone would skip it)."""
    x = col(x)
    y = x
    if lo is not None:
        y = F.greatest(y, num(lo))
    if hi is not None:
        y = F.least(y, num(hi))
    return F.when(x.isNotNull(), y)


def exact_sum(x: Column | str) -> Column:
    """Aggregate: the sum of doubles rounded once, so it is the same in whatever order tasks add them up, and equal rows tie.

    Whole parts and two digits of 26 bits behind the point are summed as longs; bits below 2^-52, which values from 1 on do
    not have, are rounded off. Values of 2^36 or more, infinities and NaN are added as doubles.
    """
    x, mask = col(x), (1 << 26) - 1
    small = F.abs(x) < num(1 << 36)
    whole = F.floor(x)
    rest = (x - whole) * num(1 << 26)
    parts = (whole, F.floor(rest), F.floor((rest - F.floor(rest)) * num(1 << 26)))
    a, b, c = (F.sum(F.when(small, p)) for p in parts)
    b = b + F.shiftright(c, 26)
    a = a + F.shiftright(b, 26)
    behind = F.shiftleft(b.bitwiseAND(mask), 26) + c.bitwiseAND(mask)
    exact = a.cast("double") + behind.cast("double") / num(1 << 52)
    large = F.sum(F.when(~small, x))
    return F.when(large.isNull(), exact).otherwise(large + F.coalesce(exact, num(0)))


def sign(x: Column | str) -> Column:
    return F.signum(col(x))


def simple_return(x: Column, previous: Column) -> Column:
    return div(x, previous) - num(1)


def slippage_bps(
    daily_vol: Column | str,
    dollar_volume: Column | str,
    notional: float | Column = 10_000.0,
    impact: float | Column = 1.0,
    floor_bps: float | Column = 1.0,
) -> Column:
    """Square-root impact in basis points, never below the floor, floor when unknown."""
    n = notional if isinstance(notional, Column) else num(notional)
    y = impact if isinstance(impact, Column) else num(impact)
    floor = floor_bps if isinstance(floor_bps, Column) else num(floor_bps)
    size = F.sqrt(div(n, F.nullif(col(dollar_volume), num(0))))
    return F.greatest(F.coalesce(y * col(daily_vol) * size * num(BPS), floor), floor)


def cost_rate(fee_bps: float | Column, slip_bps: Column) -> Column:
    fee = fee_bps if isinstance(fee_bps, Column) else num(fee_bps)
    return (fee + slip_bps) / num(BPS)


def vol_target_scale(realised: Column, target: float | Column, max_lev: float = 1.0) -> Column:
    """min(max_lev, target / realised); zero where volatility is unknown, the cap where it is 0."""
    t = target if isinstance(target, Column) else num(target)
    capped = F.when(realised == 0, num(max_lev)).otherwise(F.least(div(t, realised), num(max_lev)))
    return F.when(realised.isNull(), num(0)).otherwise(capped)


# Fixed values of the overlay rule.
GATE_HALF_P, GATE_ZERO_P, SIGMA_EPS = 0.25, 0.50, 1e-8
TAIL_Z = -2.0


def tail_gate(p: Column) -> Column:
    return (
        F.when(p.isNull(), num(1))
        .when(p >= GATE_ZERO_P, num(0))
        .when(p >= GATE_HALF_P, num(0.5))
        .otherwise(num(1))
    )


def risk_multiplier(sigma_hat: Column | str, sigma_ref: Column | str, p_tail: Column) -> Column:
    """Volatility ratio clipped to [0, 1] times the tail gate."""
    ratio = col(sigma_ref) / F.greatest(col(sigma_hat), num(SIGMA_EPS))
    vol = F.when(col(sigma_hat).isNotNull(), clip(ratio, 0.0, 1.0))
    return vol * tail_gate(p_tail)


def tail_label(
    min_z: Column | str, sigma: Column | str, floor: Column | str, null_as_zero: bool = False
) -> Column:
    """1 when the floored forward minimum breaches the tail threshold."""
    scaled = col(min_z) * div(sigma, F.greatest(col(sigma), col(floor)))
    hit = F.when(scaled.isNotNull(), (scaled <= num(TAIL_Z)).cast("double"))
    return F.coalesce(hit, num(0)) if null_as_zero else hit


HAR_EPS = 1e-6


def har_design(ret1_n: Column, sigma20: Column, vol5_ann: Column, vol22_ann: Column) -> list[Column]:
    """The three log-volatility regressors at one, five and 22 days."""
    root = F.sqrt(num(365))
    return [
        F.ln(F.abs(ret1_n * sigma20) + num(HAR_EPS)),
        F.ln(vol5_ann / root + num(HAR_EPS)),
        F.ln(vol22_ann / root + num(HAR_EPS)),
    ]


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear map through sorted breakpoint arrays, clamped at both ends."""
    n = F.size(xs)
    # index of the last breakpoint at or below x (1-based; 0 when x is left of all)
    k = F.size(F.filter(xs, lambda b: b <= x))
    x0, x1 = F.try_element_at(xs, k), F.try_element_at(xs, k + 1)
    y0, y1 = F.try_element_at(ys, k), F.try_element_at(ys, k + 1)
    inner = y0 + (y1 - y0) * div(x - x0, x1 - x0)
    return (
        F.when(x.isNull() | (n == 0), F.lit(None).cast("double"))
        .when(k == 0, F.try_element_at(ys, F.lit(1)))
        .when(k >= n, F.try_element_at(ys, n))
        .otherwise(inner)
    )
