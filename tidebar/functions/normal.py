"""Normal distribution helpers and the expected maximum Sharpe ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: Euler-Mascheroni constant.
EULER_GAMMA = 0.5772156649015329


@F.pandas_udf(T.DoubleType())
def normal_cdf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Standard normal CDF; Spark SQL has no erf."""
    erf = np.vectorize(math.erf, otypes=[float])
    for z in batches:
        v = z.to_numpy(dtype=float)
        out = np.full(len(v), np.nan)
        ok = ~np.isnan(v)
        if ok.any():
            out[ok] = 0.5 * (1.0 + erf(v[ok] / math.sqrt(2.0)))
        yield pd.Series(out).where(ok, None)


def expected_max_factor(n_trials: int) -> float:
    """Standardised expected maximum of ``n_trials`` independent Sharpe estimates.

    A scalar of the trial count alone, so it is computed while planning.
    """
    if n_trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * inv(1 - 1 / n_trials) + EULER_GAMMA * inv(
        1 - 1 / (n_trials * math.e)
    )


def expected_max_sharpe(n_trials: int, variance: Column) -> Column:
    k = expected_max_factor(n_trials)
    return F.when(variance > 0, F.sqrt(variance) * F.lit(k)).otherwise(F.lit(0.0))
