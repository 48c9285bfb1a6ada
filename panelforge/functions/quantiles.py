"""Student t and chi-square quantiles for Arrow batches of degrees of freedom.

Incomplete gamma and beta functions by their standard series and continued
fractions, inverted by bisection; used on distinct degrees of freedom only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TINY = 1e-300


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    r = 1 / x
    series = r / 12 - r**3 / 360 + r**5 / 1260 - r**7 / 1680 + r**9 / 1188
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def _gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma."""
    scale = np.exp(-x + a * np.log(np.maximum(x, _TINY)) - _lgamma(a))
    term, total, n = 1 / a, 1 / a, a.copy()
    steps = int(60 + 12 * np.sqrt(a.max()))
    for _ in range(steps):
        n = n + 1
        term = term * x / n
        total = total + term
    series = total * scale
    b = x + 1 - a
    b = np.where(b == 0, _TINY, b)
    c, d = np.full_like(x, 1 / _TINY), 1 / b
    h = d.copy()
    for i in range(1, steps):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
    return np.where(x < a + 1, series, 1 - scale * h)


def _beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta."""
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(np.maximum(x, _TINY)) + b * np.log(np.maximum(1 - x, _TINY)))
    swap = x >= (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
    out = front * h / p
    return np.where(swap, 1 - out, out)


def _bisect(f, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    for _ in range(110):
        mid = (lo + hi) / 2
        below = f(mid)
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def chi2_ppf(p: float, dof: np.ndarray) -> np.ndarray:
    k = np.asarray(dof, dtype=float)
    return _bisect(lambda x: _gamma_p(k / 2, x / 2) < p, np.zeros_like(k), k + 40 * np.sqrt(2 * k) + 60)


def t_ppf(p: float, dof: np.ndarray) -> np.ndarray:
    """Inverts the tail probability of |t| through the incomplete beta function."""
    v = np.asarray(dof, dtype=float)
    tail = 2 * min(p, 1 - p)
    x = _bisect(lambda z: _beta_i(v / 2, np.full_like(v, 0.5), z) < tail, np.zeros_like(v), np.ones_like(v))
    t = np.sqrt(v * (1 - x) / np.maximum(x, _TINY))
    return t if p >= 0.5 else -t


def quantile_table(dof: DataFrame, confidence: float) -> DataFrame:
    """``dof(Dof)`` to its t quantile and the lower and upper chi-square quantiles."""
    lower = (1 - confidence) / 2

    def per_batch(batches):
        for pdf in batches:
            d = pdf["Dof"].to_numpy(dtype=float)
            if len(d):
                yield pd.DataFrame({"Dof": pdf["Dof"], "T": t_ppf(1 - lower, d), "ChiLow": chi2_ppf(lower, d), "ChiHigh": chi2_ppf(1 - lower, d)})

    rows = dof.filter(F.col("Dof") > 0).select(F.col("Dof").cast("long").alias("Dof")).distinct()
    return rows.mapInPandas(per_batch, "Dof long, T double, ChiLow double, ChiHigh double")
