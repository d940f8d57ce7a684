"""Student's t distribution: quantiles for thresholds, tails for columns.

Filters need no probability: the threshold on |t| is found once on the driver and
the filter stays a column predicate.  Tails are only computed where a p column is
the result, in Arrow batches, by a continued fraction that keeps small tails exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_gamma(v: np.ndarray) -> np.ndarray:
    """Log gamma, once for each distinct value: a column has few degrees of freedom."""
    distinct, at = np.unique(v, return_inverse=True)
    return np.array([math.lgamma(z) for z in distinct])[at]


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction, for x below the mean."""
    log_front = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))
    c, tiny = np.ones_like(x), 1e-300
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return np.exp(log_front) * h / a


def upper_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) for t >= 0."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    t, df = t.ravel(), df.ravel()
    x = df / (df + t * t)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(x) & (df > 0)
    low = ok & (x < (df / 2 + 1) / (df / 2 + 2.5))
    if low.any():
        out[low] = 0.5 * _incomplete_beta(df[low] / 2, np.full(int(low.sum()), 0.5), x[low])
    high = ok & ~low
    if high.any():
        out[high] = 0.5 * (1 - _incomplete_beta(np.full(int(high.sum()), 0.5), df[high] / 2, 1 - x[high]))
    return out


def t_critical(p: float, df: float, tails: int = 2) -> float:
    """The |t| whose tail probability, over one or two tails, is p."""
    low, high = 0.0, 1.0
    tail = lambda t: float(upper_tail(np.array([t]), np.array([df]))[0]) * tails
    while tail(high) > p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def _tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_by_distinct(upper_tail, t.abs().to_numpy(float), df.to_numpy(float))).where(t.notna().to_numpy() & df.notna().to_numpy())


def t_tail(t: Column, df: Column | float, tails: int = 2) -> Column:
    """Tail probability of |t| over one or two tails; null where t or df is null."""
    df = df if isinstance(df, Column) else F.lit(float(df))
    return _tail(t.cast("double"), df.cast("double")) * tails


def _by_distinct(f, first: np.ndarray, df: np.ndarray) -> np.ndarray:
    """f of two columns, called once with the distinct pairs of values: measured values repeat, and
    a value costs a series while a repeat costs a sort's share."""
    both = np.ascontiguousarray(np.column_stack([first, df])).view(np.complex128).ravel()
    _, at, back = np.unique(both, return_index=True, return_inverse=True)
    return f(first[at], df[at])[back]


def _density(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    log_front = _log_gamma((df + 1) / 2) - _log_gamma(df / 2) - 0.5 * np.log(df * np.pi)
    return np.exp(log_front - (df + 1) / 2 * np.log1p(t * t / df))


def quantiles(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The t >= 0 with P(T > t) = p, for p up to one half: Newton steps on the logarithms of tail and t
    inside a bracket, halved where a step leaves it; only values that still move are carried on."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    out = np.full(p.shape, np.nan)
    with np.errstate(all="ignore"):
        ok = (p > 0) & (p <= 0.5) & (df > 0)
        out[ok & (p == 0.5)] = 0.0
        live = np.flatnonzero(ok & (p < 0.5))
        low, high = np.zeros(len(live)), np.ones(len(live))
        for _ in range(1100):
            short = (upper_tail(high, df[live]) > p[live]) & (high < 1e300)
            if not short.any():
                break
            low, high = np.where(short, high, low), np.where(short, high * 2, high)
        t = (low + high) / 2
        for _ in range(1200):
            if not len(live):
                break
            tail = upper_tail(t, df[live])
            above = tail > p[live]
            low, high = np.where(above, t, low), np.where(above, high, t)
            step = t * np.exp(tail / (t * _density(t, df[live])) * np.log(tail / p[live]))
            inside = (step > low) & (step < high)
            after = np.where(inside, step, (low + high) / 2)
            done = (np.abs(after - t) <= 2e-15 * t) | (tail == p[live]) | ((low + high) / 2 <= low) | ((low + high) / 2 >= high)
            out[live[done]] = np.where(tail == p[live], t, after)[done]
            live, low, high, t = live[~done], low[~done], high[~done], after[~done]
        out[live] = t
    return out


@F.pandas_udf(DoubleType())
def _quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_by_distinct(quantiles, p.to_numpy(float), df.to_numpy(float)))


def t_quantile(p: Column, df: Column | float, tails: int = 2) -> Column:
    """The |t| whose tail probability over one or two tails is p; null where there is none."""
    df = df if isinstance(df, Column) else F.lit(float(df))
    made = _quantile(p.cast("double") / tails, df.cast("double"))
    return F.when(~F.isnan(made), made)
