"""Closed-form drift statistics as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PSI_EPS = 1e-6
PSI_BINS = 10
KS_EXACT_TO = 10_000  # values of either side: above, the limiting series


def psi_of(ref_shares: Column, cur_counts: Column, cur_total: Column) -> Column:
    """Population stability index of bin counts (array) against the baseline's bin shares (array).
    Entries past the baseline's bins are ignored; null when there is no current value."""
    def term(r: Column, c: Column) -> Column:
        rs = r + F.lit(PSI_EPS)
        cs = F.when(cur_total > 0, c / cur_total) + F.lit(PSI_EPS)
        return (cs - rs) * F.log(cs / rs)

    used = F.slice(cur_counts, F.lit(1), F.size(ref_shares))
    return F.aggregate(F.zip_with(ref_shares, used, term), F.lit(0.0), lambda acc, t: acc + t)


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Two-sided two-sample Kolmogorov-Smirnov p-value: the limiting series with Stephens'
    small-sample correction."""
    en = F.sqrt(n.cast("double") * m.cast("double") / (n + m).cast("double"))
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0)
        * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_exact_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) of two samples of n and m values without ties, from the lattice paths that stay within the band |i/n - j/m| < d: the
    chance of standing at (i, j) after s = i + j steps, step by step over the diagonal."""
    share = math.gcd(n, m)
    a, b = m // share, n // share
    reach = round(d * (n * m // share))
    if reach <= 0:
        return 1.0
    at, index = np.zeros(n + 2), np.arange(-1.0, n + 1)  # chances of standing at i = -1 .. n, 0 outside the band
    at[1] = 1.0
    low = 0
    for s in range(1, n + m + 1):
        # |i * a - (s - i) * b| < reach, with i up to n and s - i up to m
        first = max(0, s - m, (s * b - reach) // (a + b) + 1)
        last = min(n, s, -((-(s * b + reach)) // (a + b)) - 1)
        if first > last:
            return 1.0
        i = index[first + 1:last + 2]
        moved = at[first:last + 1] * i
        moved += at[first + 1:last + 2] * (s - i)
        moved /= s
        at[low + 1:first + 1] = 0.0  # what the band leaves behind; above it nothing has been yet
        at[first + 1:last + 2] = moved
        at[last + 2:last + 3] = 0.0
        low = first
    return float(min(1.0, max(0.0, 1.0 - at[n + 1])))


@F.pandas_udf(DoubleType())
def ks_exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact two-sided p-values, null where a side is missing or has more than `KS_EXACT_TO` values. One row a batch and segment."""
    def one(d, n, m):
        if pd.isna(d) or pd.isna(n) or pd.isna(m) or max(n, m) > KS_EXACT_TO or min(n, m) < 1:
            return None
        return ks_exact_tail(float(d), int(n), int(m))
    return pd.Series([one(*row) for row in zip(d, n, m, strict=True)], dtype="float64")
