"""Probabilities of test statistics (NUM3). The statistics come from Spark
aggregates; these helpers see one row per test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, else the
    continued fraction by Lentz's method."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def chi_squared_p(x2: float, df: float) -> float:
    return upper_gamma(df / 2, x2 / 2)


def student_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def normal_cdf(x: float, mean: float = 0.0, deviation: float = 1.0) -> float:
    return 0.5 * math.erfc((mean - x) / (deviation * math.sqrt(2)))


def kolmogorov_p(gap: float, n1: float, n2: float) -> float:
    """Two-sample Kolmogorov-Smirnov, asymptotic."""
    n = math.sqrt(n1 * n2 / (n1 + n2))
    x = (n + 0.12 + 0.11 / n) * gap
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


#: Tables a step of ``fisher_p``, and the log ratio to the likeliest table below
#: which all further ones together are nothing in double precision.
TABLES, NOTHING = 1 << 16, -800.0


def fisher_p(a: float, b: float, c: float, d: float) -> float:
    """Fisher's exact test of a 2x2 table, two-sided: the share of tables of
    the same margins that are as likely or less. Neighbouring tables differ by a
    short ratio, whose logs are summed from the given table outwards; a side ends
    where its tables, ever less likely, count for nothing."""
    lo, hi = max(0.0, a - d), min(a + b, a + c)
    top, kept, rest = 0.0, 1.0, 0.0  # sums are multiples of exp(top)
    for up in (True, False):
        at, x = 0.0, a
        while x < hi if up else x > lo:
            k = np.arange(x, min(x + TABLES, hi)) if up else np.arange(x - 1, max(x - 1 - TABLES, lo - 1), -1)
            ratio = np.log((a + b - k) / (k + 1)) + np.log((a + c - k) / (d - a + k + 1))
            rel = at + np.cumsum(ratio if up else -ratio)
            if rel.max() > top:
                kept, rest = kept * math.exp(top - rel.max()), rest * math.exp(top - rel.max())
                top = float(rel.max())
            p, likely = np.exp(rel - top), rel > 1e-9
            kept, rest = kept + p[~likely].sum(), rest + p[likely].sum()
            at, x = float(rel[-1]), x + len(k) if up else x - len(k)
            if at - top < NOTHING:
                break
    return float(min(1.0, kept / (kept + rest)))


def p_value(test, *columns: Column | str) -> Column:
    """A column of p-values by one of the functions above."""

    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else test(*map(float, row)) for row in zip(*parts)], dtype="float64")

    fixed = {
        1: lambda: F.pandas_udf(lambda a: run(a), "double", F.PandasUDFType.SCALAR),
        2: lambda: F.pandas_udf(lambda a, b: run(a, b), "double", F.PandasUDFType.SCALAR),
        3: lambda: F.pandas_udf(lambda a, b, c: run(a, b, c), "double", F.PandasUDFType.SCALAR),
        4: lambda: F.pandas_udf(lambda a, b, c, d: run(a, b, c, d), "double", F.PandasUDFType.SCALAR),
    }
    return fixed[len(columns)]()(*columns)
