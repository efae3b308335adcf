"""Tail probabilities that Spark's built-ins do not have; for single rows of finished aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(1.0, max(0.0, x))
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation over ``n`` pairs (Student's t with ``n - 2`` degrees)."""
    if rho is None or rho != rho or n < 3:
        return None
    df = n - 2
    return beta_inc(df / 2.0, 0.5, 1.0 - min(1.0, rho * rho))


@pandas_udf(DoubleType())
def correlation_p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(None if r is None or r != r else float(r), int(k)) for r, k in zip(rho, n)], dtype="float64")
