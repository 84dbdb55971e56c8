"""Tail probabilities (H12-H14) as Arrow-batched functions, and closed forms.

Numpy works on whole Arrow batches; every series and continued fraction is
iterated for all rows of a batch at once.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Ship this module with the functions, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def chi2_tail_even(x: Column, df: int) -> Column:
    """Upper chi-square tail for an even df, inside codegen."""
    if df % 2:
        raise ValueError("even degrees of freedom only")
    half = x / 2
    terms = [F.lit(1.0)]
    for k in range(1, df // 2):
        terms.append(F.pow(half, F.lit(float(k))) / F.lit(float(math.factorial(k))))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(-half) * total))


def gamma_upper(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Regularized upper incomplete gamma Q(a, z)."""
    a, z = np.broadcast_arrays(np.asarray(a, float), np.asarray(z, float))
    out = np.ones(z.shape)
    live = z > 0
    low = live & (z < a + 1)
    if low.any():
        aa, zz = a[low], z[low]
        term = 1 / aa
        total = term.copy()
        for n in range(1, 1000):
            term = term * zz / (aa + n)
            total += term
            if (np.abs(term) < 1e-15 * np.abs(total)).all():
                break
        out[low] = 1 - np.exp(-zz + aa * np.log(zz) - _lgamma(aa)) * total
    high = live & ~low
    if high.any():
        aa, zz = a[high], z[high]
        tiny = 1e-300
        b = zz + 1 - aa
        c = np.full(zz.shape, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d[np.abs(d) < tiny] = tiny
            c = b + an / c
            c[np.abs(c) < tiny] = tiny
            d = 1 / d
            step = d * c
            h *= step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = np.exp(-zz + aa * np.log(zz) - _lgamma(aa)) * h
    return np.clip(out, 0, 1)


def beta_lower(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b) by its continued fraction."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    mirrored = x > (a + 1) / (a + b + 2)
    xx = np.where(mirrored, 1 - x, x)
    aa = np.where(mirrored, b, a)
    bb = np.where(mirrored, a, b)
    inside = (xx > 0) & (xx < 1)
    xs = np.where(inside, xx, 0.5)
    tiny = 1e-300
    c = np.ones(xs.shape)
    d = 1 - (aa + bb) * xs / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (bb - m) * xs / ((aa + 2 * m - 1) * (aa + 2 * m))
        odd = -(aa + m) * (aa + bb + m) * xs / ((aa + 2 * m) * (aa + 2 * m + 1))
        change = np.ones(xs.shape)
        for part in (even, odd):
            d = 1 + part * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + part / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = d * c
            h = h * change
        if (np.abs(change - 1) < 1e-14).all():
            break
    front = _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xs) + bb * np.log1p(-xs)
    value = np.where(inside, np.exp(front) * h / aa, np.where(xx <= 0, 0.0, 1.0))
    return np.clip(np.where(mirrored, 1 - value, value), 0, 1)


def t_two_tailed(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(df > 0, beta_lower(df / (df + t * t), np.maximum(df, 1e-9) / 2, 0.5), 1.0)


def f_upper(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    x = np.where(f >= 0, d2 / (d2 + d1 * np.maximum(f, 0)), 1.0)
    return beta_lower(x, d2 / 2, d1 / 2)


def normal_two_tailed(z):
    return np.vectorize(math.erfc, otypes=[float])(np.abs(np.asarray(z, float)) / math.sqrt(2))


def pearson_two_tailed(r, df):
    r, df = np.asarray(r, float), np.asarray(df, float)
    r = np.clip(r, -0.9999999999, 0.9999999999)
    return t_two_tailed(np.abs(r) * np.sqrt(df / (1 - r * r)), df)


def binomial_upper(k, n, p):
    """P(X >= k) for Binomial(n, p) through the incomplete beta."""
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    middle = beta_lower(np.clip(p, 0, 1), np.maximum(k, 1), np.maximum(n - k + 1, 1))
    return np.select([k <= 0, (k > n) | (p <= 0), p >= 1], [1.0, 0.0, 1.0], middle)


def poisson_upper(k, lam):
    """P(X >= k) for Poisson(lam), summed upwards so that tiny tails stay exact."""
    k, lam = np.broadcast_arrays(np.asarray(k, float), np.asarray(lam, float))
    live = (k > 0) & (lam > 0)
    kk, ll = np.where(live, k, 1.0), np.where(live, lam, 1.0)
    small = kk > ll
    out = np.ones(kk.shape)
    if small.any():
        a, b = kk[small], ll[small]
        pmf = np.exp(-b + a * np.log(b) - _lgamma(a + 1))
        total, term, x = pmf.copy(), pmf.copy(), a.copy()
        for _ in range(100000):
            x = x + 1
            term = term * b / x
            total += term
            if (term <= 1e-16 * np.maximum(total, 1e-300)).all():
                break
        out[small] = total
    if (~small).any():
        out[~small] = 1 - gamma_upper(kk[~small], ll[~small])
    return np.where(k <= 0, 1.0, np.where(lam <= 0, 0.0, np.clip(out, 0, 1)))


def _series(values: np.ndarray, *inputs: pd.Series) -> pd.Series:
    missing = np.zeros(len(inputs[0]), dtype=bool)
    for column in inputs:
        missing |= column.isna().to_numpy()
    return pd.Series(values).mask(missing)


def _clean(*inputs: pd.Series) -> list[np.ndarray]:
    return [column.fillna(1.0).to_numpy(dtype=float) for column in inputs]


@pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    xs, dfs = _clean(x, df)
    return _series(gamma_upper(dfs / 2, xs / 2), x, df)


@pandas_udf(T.DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _series(binomial_upper(*_clean(k, n, p)), k, n, p)


@pandas_udf(T.DoubleType())
def poisson_tail(k: pd.Series, lam: pd.Series) -> pd.Series:
    return _series(poisson_upper(*_clean(k, lam)), k, lam)


@pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_tailed(*_clean(t, df)), t, df)


@pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series(f_upper(*_clean(f, d1, d2)), f, d1, d2)


@pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return _series(normal_two_tailed(*_clean(z)), z)


@pandas_udf(T.DoubleType())
def pearson_tail(r: pd.Series, df: pd.Series) -> pd.Series:
    return _series(pearson_two_tailed(*_clean(r, df)), r, df)


KERNELS = {
    "chi2_tail": chi2_tail,
    "binomial_tail": binomial_tail,
    "poisson_tail": poisson_tail,
    "t_tail": t_tail,
    "f_tail": f_tail,
    "normal_tail": normal_tail,
    "pearson_tail": pearson_tail,
}


def register_kernels(spark: SparkSession) -> None:
    """Make the kernels callable from SQL by name."""
    for name, kernel in KERNELS.items():
        spark.udf.register(name, kernel)
