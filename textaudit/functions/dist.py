"""Distribution functions for the significance tests.

They run on one row per model pair (a handful of rows), wrapped as Arrow-batched pandas
UDFs; no per-document work goes through Python.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_sf_1df(x: float) -> float:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    if x is None or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    return math.erfc(math.sqrt(x / 2.0))


def binom_two_sided_half(k: int, n: int) -> float:
    """min(1, 2 * P[X <= k]) for X ~ Binomial(n, 1/2)."""
    if n <= 0:
        return 1.0
    k = min(int(k), n)
    # log-space sum keeps large n finite
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2.0)
            for i in range(0, k + 1)]
    m = max(logs)
    cdf = math.exp(m) * sum(math.exp(v - m) for v in logs)
    return min(1.0, 2.0 * cdf)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its hypergeometric series
    x^a (1-x)^b / (a B(a, b)) * sum_n x^n (a+b)_n / (a+1)_n, all of whose terms are positive;
    beyond the mean of the distribution by symmetry, where the series is the shorter one."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x * (a + b + 2.0) > a + 1.0:
        return 1.0 - betainc(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) - math.log(a)
    total, term, n = 0.0, 1.0, 0
    while term > total * 1e-17:
        total += term
        term *= x * (a + b + n) / (a + 1.0 + n)
        n += 1
    return math.exp(log_front) * total


def t_sf(t: float, df: float) -> float:
    """Upper tail P[T > t] of Student's t."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t):
        return float("nan")
    return min(1.0, 2.0 * t_sf(abs(t), df))


def t_ppf(q: float, df: float) -> float:
    """Quantile of Student's t by bisection on the distribution function."""
    if df <= 0 or not 0.0 < q < 1.0:
        return float("nan")
    if q == 0.5:
        return 0.0
    target_upper = 1.0 - q
    lo, hi = -1e6, 1e6
    for _ in range(400):
        mid = (lo + hi) / 2.0
        if t_sf(mid, df) > target_upper:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, abs(mid)):
            break
    return (lo + hi) / 2.0


def mcnemar(b: int, c: int, exact_below: int = 25) -> dict:
    """Contingency-count McNemar test: exact binomial below ``exact_below`` discordant
    pairs, otherwise chi-square with continuity correction."""
    n = b + c
    exact = n < exact_below
    if exact:
        stat = float(min(b, c))
        p = binom_two_sided_half(min(b, c), n)
    else:
        stat = (abs(b - c) - 1.0) ** 2 / n
        p = chi2_sf_1df(stat)
    return {"exact": exact, "statistic": stat, "p_value": p}


# --- Arrow-batched wrappers (one row per model pair) -----------------------------------

@F.pandas_udf(T.DoubleType())
def mcnemar_p_udf(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar(int(x), int(y))["p_value"] for x, y in zip(b, c)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    out = []
    for tv, dv in zip(t, df):
        if pd.isna(tv) or pd.isna(dv):
            out.append(None)
        else:
            out.append(t_two_sided_p(float(tv), float(dv)))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    out = []
    for qv, dv in zip(q, df):
        if pd.isna(qv) or pd.isna(dv) or dv <= 0:
            out.append(None)
        else:
            out.append(t_ppf(float(qv), float(dv)))
    return pd.Series(out, dtype="float64")
