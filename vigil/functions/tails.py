"""Tail probabilities that Spark has no function for: normal, chi-square and Fisher's exact test.

These are the library's only Python functions; they run on Arrow batches of already aggregated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a z value."""
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def chi_square_tail(x: float, df: float) -> float | None:
    """P(X >= x) for a whole number of degrees of freedom, as a finite sum.

    Even df: e^-t times the sum of t^i / i! for i < df / 2. Odd df: erfc(sqrt t) and e^-t times the sum of
    t^(i + 1/2) / Gamma(i + 3/2) for i < (df - 1) / 2, with t = x / 2.
    """
    if pd.isna(x) or pd.isna(df) or df <= 0:
        return None
    if x <= 0:
        return 1.0
    t, shift = x / 2, 0.5 if df % 2 else 0.0
    logs = [(i + shift) * math.log(t) - t - math.lgamma(i + shift + 1) for i in range(int(df // 2))]
    return min(1.0, (math.erfc(math.sqrt(t)) if shift else 0.0) + math.fsum(map(math.exp, logs)))


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """T14"""
    return pd.Series([chi_square_tail(a, b) for a, b in zip(x, df, strict=True)], dtype="float64")


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: the sum of all tables no likelier than the observed one (to 1 part in 1e9).

    Probabilities fall on both sides of the mode. From the observed table the sum runs outward; on the other
    side it starts where a bisection finds the first table that is no likelier. Both stop when terms no
    longer count, so margins of millions take a few thousand steps at most.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    const = sum(math.lgamma(x + 1) for x in (row, col, n - row, n - col)) - math.lgamma(n + 1)
    log_p = lambda x: const - sum(math.lgamma(v + 1) for v in (x, row - x, col - x, n - row - col + x))
    mode = min(hi, max(lo, (row + 1) * (col + 1) // (n + 2)))
    limit = log_p(a) + 1e-9

    def outward(x: int, step: int) -> float:
        total = 0.0
        while lo <= x <= hi:
            term = math.exp(log_p(x) - limit)
            total += term
            if term < total * 1e-17:
                break
            x += step
        return total

    def first_beyond(step: int) -> int:
        """The table nearest the mode, on the side of `step`, that is no likelier than the observed."""
        near, far = (mode, hi + 1) if step > 0 else (mode, lo - 1)
        while abs(far - near) > 1:
            mid = (near + far) // 2
            near, far = (near, mid) if log_p(mid) <= limit else (mid, far)
        return far

    if log_p(mode) <= limit:
        return 1.0
    side = 1 if a > mode else -1
    return min(1.0, math.exp(limit) * (outward(first_beyond(side), side) + outward(first_beyond(-side), -side)))


@F.pandas_udf(T.DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, below: pd.Series) -> pd.Series:
    cells = np.stack([a, b, c, d], axis=1)
    return pd.Series(
        [fisher_exact(*map(int, x)) if 0 <= min(x) < m else None for x, m in zip(cells, below, strict=True)], dtype="float64"
    )


def fisher_p(a: Column, b: Column, c: Column, d: Column, below: int = 10) -> Column:
    """Fisher's p where the least cell is below the limit, else null."""
    return _fisher(*(x.cast("long") for x in (a, b, c, d)), F.lit(below))


def screen_p(a: Column, b: Column, c: Column, d: Column, chi2: Column) -> Column:
    """Fisher's p where computed, else the chi-square tail with one degree of freedom."""
    return F.coalesce(fisher_p(a, b, c, d), chi_square_p(chi2, F.lit(1.0)))
