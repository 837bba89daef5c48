"""Special functions used on aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def digamma(n: Column) -> Column:
    """psi(n) for n >= 1: shifted up by 8, then the asymptotic series."""
    n = n.cast("double")
    x = n + 8
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    series = series + 1 / (240 * F.pow(x, F.lit(8)))
    for i in range(8):
        series = series - 1 / (n + i)
    return series


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; NULL when one is constant
    (the built-in fails with a division by zero in ANSI mode)."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


def _p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    out = [np.nan if pd.isna(a) or m < 3 else beta_inc((m - 2) / 2, 0.5, 1 - a * a) for a, m in zip(r, n)]
    return pd.Series(out, dtype=float)


def correlation_p_value(r: Column | str, n: Column | str) -> Column:
    """Two-sided p of a correlation with n pairs: t^2 = r^2 (n-2) / (1-r^2) has
    P(|T| > t) = I_{1-r^2}((n-2)/2, 1/2). Meant for one row per feature."""
    return F.pandas_udf(_p_values, DoubleType())(r, n)
