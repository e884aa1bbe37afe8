"""Tail probabilities of t, F and chi-square, exact and by closed-form approximation.

The exact ones run on already aggregated rows, one per test, as Arrow batches on the executors.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

PI = math.pi


def normal_two_sided(z: Column) -> Column:
    """Approximate two-sided tail of the normal distribution."""
    return 1 - F.sqrt(1 - F.exp(-2 * z * z / PI))


def t_approx(t: Column) -> Column:
    """Normal approximation of the two-sided p-value of t."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), normal_two_sided(t)))


def _upper(z: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * (1 - F.signum(z) * F.sqrt(1 - F.exp(-2 * z * z / PI)))))


def f_approx(f: Column, df1: Column, df2: Column) -> Column:
    """Cube-root normal approximation of the upper tail of F."""
    a, b = 2 / (9 * df1), 2 / (9 * df2)
    root = F.pow(f, F.lit(1 / 3))
    z = (root * (1 - b) - (1 - a)) / F.sqrt(a + root * root * b)
    return F.when((f > 0) & (df1 > 0) & (df2 > 0), _upper(z)).otherwise(1.0)


def chi2_approx(x: Column, df: Column) -> Column:
    """Cube-root normal approximation of the upper tail of chi-square."""
    s = 2 / (9 * df)
    z = (F.pow(x / df, F.lit(1 / 3)) - (1 - s)) / F.sqrt(s)
    return F.when((x > 0) & (df > 0), _upper(z)).otherwise(1.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 + even * d
        c = 1 + even / c
        d = 1 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + odd * d
        c = 1 + odd / c
        d = 1 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-14:
            break
    return front * h


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of F."""
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def _exact(fn):
    """A pandas UDF of a scalar tail function for rows that are already one per test."""

    def apply(*series: pd.Series) -> pd.Series:
        rows = zip(*[s.astype(float) for s in series])
        return pd.Series([fn(*r) if all(math.isfinite(v) for v in r) else None for r in rows], dtype="float64")

    return apply


@F.pandas_udf(T.DoubleType())
def f_exact(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of F per aggregated row."""
    return _exact(f_tail)(f, df1, df2)


@F.pandas_udf(T.DoubleType())
def t_exact(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t per aggregated row, by F(1, df) = t squared."""
    return _exact(lambda v, n: f_tail(v * v, 1.0, n))(t, df)


@F.pandas_udf(T.DoubleType())
def chi2_exact(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-square per aggregated row."""
    return _exact(lambda v, n: upper_gamma(n / 2, v / 2))(x, df)
