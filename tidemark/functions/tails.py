"""Tail probabilities of t, chi-square and normal, for one row per test.

Spark has no distribution functions, so these are small Arrow helpers applied to
results that hold one row per test.
"""

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_upper(t, df):
    """P(T > t)."""
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def chi2_upper(x, k):
    """P(X > x): series below the mean, continued fraction above it."""
    if x <= 0:
        return 1.0
    a, y = k / 2.0, x / 2.0
    scale = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1:
        term = s = 1.0 / a
        n = a
        while term > s * 1e-16:
            n += 1
            term *= y / n
            s += term
        return 1.0 - s * scale
    b = y + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def normal_cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _pairwise(fn):
    def run(a, b):
        return pd.Series([fn(x, y) if x == x and y == y and x is not None and y is not None and y > 0 else None for x, y in zip(a, b)], dtype="float64")
    return run


@F.pandas_udf(DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _pairwise(t_upper)(t, df)


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _pairwise(chi2_upper)(x, df)


@F.pandas_udf(DoubleType())
def norm_cdf(z: pd.Series) -> pd.Series:
    return pd.Series([normal_cdf(x) if x == x and x is not None else None for x in z], dtype="float64")


def t_quantile(p, df):
    """Inverse of the t distribution by bisection (one value per test)."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_upper(mid, df) < p else (lo, mid)
    return (lo + hi) / 2
