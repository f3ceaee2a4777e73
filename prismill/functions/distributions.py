"""Tail probabilities of the test statistics. Applied to report rows, never to data rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov distance, as a JVM expression."""
    x2 = d * d * (n1.cast("double") * n2) / (n1 + n2)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x2),
    )
    # Below 0.09 the alternating series converges too slowly, and the probability is 1 to six digits.
    return F.when(x2 < 0.09, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, result = 1e-300, 1.0
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return result


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi_square_tail(x: float, df: float) -> float:
    """Upper regularised incomplete gamma at (df/2, x/2): series below the mean, continued fraction above."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        for n in range(1, 2000):
            term *= z / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1.0 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for n in range(1, 2000):
        step = -n * (n - a)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation over n pairs."""

    def one(r: float, n: float) -> float | None:
        if pd.isna(r) or pd.isna(n) or n < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        return student_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(*pair) for pair in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or b < 1 else chi_square_tail(a, b) for a, b in zip(x, df)], dtype="float64")
