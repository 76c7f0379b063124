"""Tail probabilities without scipy: regularised incomplete gamma by series and continued fraction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lgamma(a: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in a.ravel()]).reshape(a.shape)


def gamma_p(a, x) -> np.ndarray:
    """P(a, x), the regularised lower incomplete gamma function, for a > 0 and x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(x) & (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 0.0
    low, high = ok & (x > 0) & (x < a + 1), ok & (x >= a + 1)
    for part, f in ((low, _series), (high, lambda p, q: 1 - _fraction(p, q))):
        if part.any():
            out[part] = f(a[part], x[part])
    return out


def _front(a, x):
    return np.exp(-x + a * np.log(x) - _lgamma(a))


def _series(a, x):
    term = total = 1 / a
    for n in range(1, 10_000):
        term = term * x / (a + n)
        total = total + term
        if (np.abs(term) < np.abs(total) * 1e-16).all():
            break
    return total * _front(a, x)


def _fraction(a, x):
    tiny = 1e-300
    b, c = x + 1 - a, np.full_like(x, 1 / tiny)
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return _front(a, x) * h


def poisson_sf(observed, expected) -> np.ndarray:
    """P(X >= observed) for X ~ Poisson(expected); without expectation 0 if anything was seen, else 1."""
    k, lam = np.broadcast_arrays(np.asarray(observed, float), np.asarray(expected, float))
    out = np.where(k <= 0, 1.0, 0.0)
    part = (k > 0) & (lam > 0)
    if part.any():
        out[part] = gamma_p(k[part], lam[part])
    return np.clip(np.where(np.isnan(k) | np.isnan(lam), np.nan, out), 0, 1)


def chi2_sf(x, dof) -> np.ndarray:
    return np.clip(1 - gamma_p(np.asarray(dof, float) / 2, np.asarray(x, float) / 2), 0, 1)


def normal_sf2(z) -> np.ndarray:
    """Two-sided normal tail."""
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


@F.pandas_udf(DoubleType())
def poisson_tail(observed: pd.Series, expected: pd.Series) -> pd.Series:
    """poisson_sf as a vectorised column function."""
    return pd.Series(poisson_sf(observed, expected))
