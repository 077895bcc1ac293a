"""Two-sided p-values of the Mann-Whitney and Kolmogorov-Smirnov tests from their statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Up to this size a side makes the Mann-Whitney test exact, if there are no ties.
SMALL = 8
#: Up to this size of the other side; beyond it the normal approximation is used all the same.
EXACT_MWU = 100_000
#: Up to this size of the larger side the Kolmogorov-Smirnov test counts paths exactly.
EXACT_KS = 10_000


def mwu_normal(u: float, n: int, m: int, ties: float) -> float:
    """Normal approximation with tie and continuity correction; ties is the sum of t^3 - t."""
    total = n + m
    var = n * m / 12 * (total + 1 - ties / (total * (total - 1))) if total > 1 else 0.0
    if var <= 0:
        return 1.0
    z = (max(u, n * m - u) - n * m / 2 - 0.5) / math.sqrt(var)
    return min(1.0, max(0.0, math.erfc(z / math.sqrt(2))))


def mwu_exact(u: float, n: int, m: int) -> float:
    """Exact p-value without ties: ways to reach each U are the coefficients of a Gaussian binomial."""
    n, m = min(n, m), max(n, m)
    ways = np.zeros(n * m + 1)
    ways[0] = 1.0
    for i in range(1, n + 1):  # times (1 - x^(m+i)) / (1 - x^i), scaled to stay finite
        k = m + i
        if k <= n * m:
            ways[k:] = ways[k:] - ways[:-k]
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])
        ways /= ways.sum()
    high = max(u, n * m - u)
    return min(1.0, 2.0 * float(ways[int(math.ceil(high)) :].sum()))


def mwu_p(u: float, n: int, m: int, ties: float) -> float:
    if n < 1 or m < 1:
        return float("nan")
    if min(n, m) <= SMALL and ties == 0 and max(n, m) <= EXACT_MWU:
        return mwu_exact(u, n, m)
    return mwu_normal(u, n, m, ties)


def ks_exact(d: float, n: int, m: int) -> float:
    """Share of lattice paths from (0, 0) to (n, m) that somewhere leave the band |i/n - j/m| < d."""
    if n > m:
        n, m = m, n
    lim = d * n * m * (1 - 1e-12)
    i = np.arange(n + 1)
    inside = np.zeros(n + 1)  # share of the paths to (i, s - i) that stayed within the band
    inside[0] = 1.0
    for s in range(1, n + m + 1):
        j = s - i
        up = inside * np.maximum(j, 0) / s
        up[1:] += inside[:-1] * i[1:] / s
        inside = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < lim), up, 0.0)
    return min(1.0, max(0.0, 1.0 - float(inside[n])))


def ks_limit(d: float, n: int, m: int) -> float:
    """The limiting distribution with the usual correction for finite samples."""
    e = math.sqrt(n * m / (n + m))
    t = (e + 0.12 + 0.11 / e) * d
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def ks_p(d: float, n: int, m: int) -> float:
    if n < 1 or m < 1:
        return float("nan")
    if d <= 0:
        return 1.0
    return ks_exact(d, n, m) if max(n, m) <= EXACT_KS else ks_limit(d, n, m)


@F.pandas_udf(DoubleType())
def mwu_p_value(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mwu_p(*x) for x in zip(u.astype(float), n.astype(int), m.astype(int), ties.astype(float))], dtype=float)


@F.pandas_udf(DoubleType())
def ks_p_value(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([ks_p(*x) for x in zip(d.astype(float), n.astype(int), m.astype(int))], dtype=float)


def significant(z: Column) -> Column:
    """Whether a two-sided normal test rejects at 0.05, without the error function."""
    return F.abs(z) > 1.959963984540054
