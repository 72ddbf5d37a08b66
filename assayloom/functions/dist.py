"""Tails of the normal, t, F and chi-squared distributions without scipy, and pandas UDFs over them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def norm_ppf(p: np.ndarray) -> np.ndarray:
    def one(v: float) -> float:
        return _NORMAL.inv_cdf(v) if 0 < v < 1 else -math.inf if v <= 0 else math.inf

    return np.vectorize(one, otypes=[float])(p)


_lgamma = np.vectorize(math.lgamma, otypes=[float])
TINY = 1e-300


def _nonzero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) > TINY, x, TINY)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method, for all values at once."""
    c, d = np.ones_like(x), 1 / _nonzero(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / _nonzero(1 + num * d), _nonzero(1 + num / c)
            out = out * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return out


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, value by value."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    fraction = _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, inner, 1 - inner))
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, front * fraction / a, 1 - front * fraction / b)))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function, value by value: a series for small x, else a continued fraction."""
    a, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, x)))
    inner = np.maximum(x, TINY)
    front = np.exp(a * np.log(inner) - inner - _lgamma(a))
    small = inner < a + 1
    at = np.where(small, inner, 0.0)
    term = total = 1 / a
    for n in range(1, 10_000):
        term = term * at / (a + n)
        total = total + term
        if (np.abs(term) <= np.abs(total) * 1e-16).all():
            break
    b = np.where(small, a + 2, inner) + 1 - a
    c, d = np.full_like(b, 1e300), 1 / b
    out = d.copy()
    for i in range(1, 1000):
        num, b = -i * (i - a), b + 2
        d, c = 1 / _nonzero(num * d + b), _nonzero(b + num / c)
        out = out * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return np.where(x <= 0, 1.0, np.where(small, 1 - front * total, front * out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    fine = np.isfinite(t) & (df > 0)
    size, n = np.where(fine, t, 0.0), np.where(fine, df, 1.0)
    return np.where(fine, beta_inc(n / 2, 0.5, n / (n + size * size)), np.where(np.isinf(t), 0.0, np.nan))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    at = np.maximum(f, 0)
    return np.where(f > 0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * at)), 1.0)


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def _lift(f, *columns: str | Column) -> Column:
    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        table = np.array([v.to_numpy(float, na_value=np.nan) for v in series])
        there = ~np.isnan(table).any(axis=0)
        out = np.full(len(series[0]), np.nan)
        out[there] = f(*table[:, there])
        return pd.Series(out).where(there, None).astype("float64")

    return run(*columns)


def p_of_t(t: str | Column, df: str | Column) -> Column:
    """Two-sided p-value of a t statistic; null for nulls."""
    return _lift(t_two_sided, t, df)


def p_of_f(f: str | Column, d1: str | Column, d2: str | Column) -> Column:
    return _lift(f_upper, f, d1, d2)


def p_of_chi2(x: str | Column, df: str | Column) -> Column:
    return _lift(chi2_upper, x, df)


def noncentral_t_power(effect: float, n: float, alpha: float) -> float:
    """Power of the two-sided two-sample t-test with n in each group, by integrating over the chi distribution."""
    df, shift = 2 * n - 2, effect * math.sqrt(n / 2)
    low, high = 0.0, 200.0
    for _ in range(200):  # the critical value
        mid = (low + high) / 2
        low, high = (mid, high) if float(t_two_sided(mid, df)) > alpha else (low, mid)
    crit, centre, spread = (low + high) / 2, math.sqrt(df), 1 / math.sqrt(2)
    s = np.linspace(max(1e-9, centre - 12 * spread), centre + 12 * spread, 4001)
    log_density = (df - 1) * np.log(s) - s**2 / 2 - (df / 2 - 1) * math.log(2) - math.lgamma(df / 2)
    density = np.exp(log_density)
    cut = crit * s / math.sqrt(df)
    inside = norm_cdf(cut - shift) - norm_cdf(-cut - shift)
    y = density * (1 - inside)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(s)).sum())


def sample_size(mean1: float = 0.95, mean2: float = 0.9, variance: float = 0.1, alpha: float = 0.05, power: float = 0.95) -> int:
    """Patients in each group that a two-sample t-test needs, to the nearest; the effect is the difference over ``variance``. At least two."""
    effect = abs(mean1 - mean2) / variance
    low, high = 2.0, 4.0
    if noncentral_t_power(effect, low, alpha) >= power:
        return 2
    while noncentral_t_power(effect, high, alpha) < power:
        low, high = high, high * 2
    while high - low > 1e-6:
        mid = (low + high) / 2
        low, high = (mid, high) if noncentral_t_power(effect, mid, alpha) < power else (low, mid)
    return round(high)
