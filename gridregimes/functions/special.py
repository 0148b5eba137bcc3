"""Tail probabilities that Spark lacks, vectorised over batches, and as column functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)
    part = front * _fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, 1 - part, part)))


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return betainc(dof / 2, 0.5, dof / (dof + t * t))


def binomial_upper(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) of a binomial; 1 for k <= 0 (and so for n = 0), 0 for k > n."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    out = betainc(np.maximum(k, 1), np.maximum(n - k + 1, 1), np.broadcast_to(p, k.shape))
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, out))


def _series(f, *inputs: pd.Series) -> pd.Series:
    """f over the rows where all inputs are numbers; null elsewhere."""
    values = [x.astype(float).to_numpy() for x in inputs]
    ok = np.logical_and.reduce([np.isfinite(x) for x in values])
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = f(*(x[ok] for x in values))
    return pd.Series(out)


def _column(f, *inputs: Column) -> Column:
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield _series(f, *(batch if isinstance(batch, tuple) else (batch,)))

    def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    return F.pandas_udf(run_one if len(inputs) == 1 else run, "double")(*(x.cast("double") for x in inputs))


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t; null if t or dof is null or dof is not positive."""
    return _column(t_two_sided, t, F.when(dof > 0, dof))


def binomial_pvalue(k: Column, n: Column, p: float) -> Column:
    return _column(binomial_upper, k, n, F.lit(float(p)))


def erfc(x: Column) -> Column:
    return _column(_erfc, x)


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are there; null if either does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlation_pvalue(r: Column, n: Column) -> Column:
    """p of Pearson's r by t with n - 2 degrees of freedom; 0 where r is 1 or -1."""
    r = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
    exact = F.abs(r) >= 1 - 1e-12
    t = F.try_divide(r * F.sqrt(F.greatest(n - 2, F.lit(0)).cast("double")), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    return F.when(r.isNull() | (n < 3), None).when(exact, 0.0).otherwise(t_pvalue(F.when(~exact, t), n - 2))
