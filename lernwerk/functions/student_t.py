"""Student's t: two-tailed probability and critical value, as Arrow UDFs for the few rows of an aggregate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STEPS, TINY = 300, 1e-300


def _beta(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, all rows at once."""
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    fit = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c = np.ones_like(y)
    d = 1 / fit(1 - (p + q) * y / (p + 1))
    total = d.copy()
    for m in range(1, STEPS):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / fit(1 + even * d), fit(1 + even / c)
        total = total * d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / fit(1 + odd * d), fit(1 + odd / c)
        step = d * c
        total = total * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    part = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * total))
    return np.where(flip, 1 - part, part)


def two_tailed(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Probability of a larger absolute t; NaN for a missing t or fewer than one degree of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & (df > 0)
    safe = np.where(ok, df, 1.0)
    p = _beta(safe / (safe + np.where(ok, t, 0.0) ** 2), safe / 2, 0.5)
    return np.where(ok, p, np.nan)


def critical(df: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """The t that is exceeded with probability alpha in two tails, by bisection."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e4)
    for _ in range(120):
        mid = (lo + hi) / 2
        above = two_tailed(mid, df) > alpha
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(df > 0, (lo + hi) / 2, np.nan)


def _nullable(x: np.ndarray) -> pd.Series:
    return pd.Series(np.where(np.isnan(x), None, x), dtype=object)


@F.pandas_udf(DoubleType())
def t_two_tailed_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Null for a null t or a df of 0 or less."""
    return _nullable(two_tailed(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """Two-tailed critical value at .05."""
    return _nullable(critical(df.to_numpy(float, na_value=np.nan)))
