"""Tail probabilities and quantiles as columns (section 7.4), computed for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def lgamma(x) -> np.ndarray:
    """Logarithm of the gamma function for positive arguments: shifted above 12, then Stirling's series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(12):
        low = x < 12
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    q = 1 / (x * x)
    series = (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q * (1 / 1188 - q * 691 / 360360))))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + series


def _lentz(first_d, c, steps, terms: int):
    """Continued fraction by Lentz's scheme for all rows; ``steps(m)`` gives (numerator, denominator) pairs."""
    off = lambda v: np.where(np.abs(v) > TINY, v, TINY)
    d = 1 / off(first_d)
    h = d.copy()
    for m in range(1, terms):
        for num, den in steps(m):
            d = 1 / off(den + num * d)
            c = off(den + num / c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """Regularized incomplete beta function; NaN outside its domain."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    bad = ~((a > 0) & (b > 0)) | np.isnan(x)
    inside = ~bad & (x > 0) & (x < 1)
    a, b, x0 = np.where(inside, a, 1.0), np.where(inside, b, 1.0), np.where(inside, x, 0.5)
    turn = x0 > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x0, x0)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p

    def steps(m):
        yield m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), 1.0
        yield -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)), 1.0

    v = front * _lentz(1 - (p + q) * z / (p + 1), np.ones_like(p), steps, 500)
    v = np.where(turn, 1 - v, v)
    return np.where(bad, np.nan, np.where(inside, v, np.where(x <= 0, 0.0, 1.0)))


def gammaincc(a, x) -> np.ndarray:
    """Regularized upper incomplete gamma function: a series below a + 1, else a continued fraction."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    bad = ~(a > 0) | np.isnan(x)
    inside = ~bad & (x > 0) & np.isfinite(x)
    a, z = np.where(inside, a, 1.0), np.where(inside, x, 1.0)
    head = np.exp(-z + a * np.log(z) - lgamma(a))
    low = z < a + 1
    zs, term = np.where(low, z, 0.0), 1 / a
    total, k = term.copy(), a.copy()
    for _ in range(2000):
        k = k + 1
        term = term * zs / k
        total = total + term
        if (term <= total * 1e-16).all():
            break
    zl = np.where(low, a + 2, z)
    steps = lambda i: [(-i * (i - a), zl + 1 - a + 2 * i)]
    tail = _lentz(zl + 1 - a, np.full_like(a, 1 / TINY), steps, 2000) * head
    v = np.where(low, 1 - total * head, tail)
    return np.where(bad, np.nan, np.where(inside, v, np.where(x <= 0, 1.0, 0.0)))


def t_sf(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return np.where(t > 0, half, 1 - half)


def t_quantile(p, df) -> np.ndarray:
    p, df = (np.array(v, float) for v in np.broadcast_arrays(p, df))
    ok = (p > 0) & (p < 1) & (df > 0)
    q, k = np.where(ok, p, 0.5), np.where(ok, df, 1.0)
    lo, hi = np.full_like(q, -1e6), np.full_like(q, 1e6)
    for _ in range(90):
        mid = (lo + hi) / 2
        below = 1 - t_sf(mid, k) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.where(ok, (lo + hi) / 2, np.nan)


# Coefficients of the rational approximations of the normal quantile (AS 241), constant term first.
CENTRAL = ([3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
           [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610])
MIDDLE = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
          [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
FAR = ([6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
       [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def norm_ppf(p) -> np.ndarray:
    p = np.asarray(p, float)
    ok = (p > 0) & (p < 1)
    p = np.where(ok, p, 0.5)
    q = p - 0.5
    ratio = lambda c, x: np.polyval(c[0][::-1], x) / np.polyval(c[1][::-1], x)
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    tail = np.where(r <= 5, ratio(MIDDLE, r - 1.6), ratio(FAR, r - 5))
    v = np.where(np.abs(q) <= 0.425, q * ratio(CENTRAL, 0.180625 - np.minimum(q * q, 0.180625)), np.sign(q) * tail)
    return np.where(ok, v, np.nan)


def _udf(fn, *cols: Column) -> Column:
    """``fn`` over whole batches; NULL where an argument or the result is missing or NaN."""
    if len(cols) == 1:

        def one(a: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(float)))

        c = F.pandas_udf(one, DoubleType())(*cols)
    elif len(cols) == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(float), b.to_numpy(float)))

        c = F.pandas_udf(two, DoubleType())(*cols)
    else:

        def three(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(float), b.to_numpy(float), d.to_numpy(float)))

        c = F.pandas_udf(three, DoubleType())(*cols)
    return F.when(~F.isnan(c), c)


def normal_two_sided(z: Column) -> Column:
    return _udf(lambda v: gammaincc(0.5, v * v / 2), z.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return _udf(lambda v, d: betainc(d / 2, 0.5, d / (d + v * v)), t.cast("double"), df.cast("double"))


def t_upper(t: Column, df: Column) -> Column:
    return _udf(t_sf, t.cast("double"), df.cast("double"))


def f_upper(f: Column, df1: Column, df2: Column) -> Column:
    def tail(v, a, b):
        p = betainc(b / 2, a / 2, b / (b + a * np.where(v > 0, v, 1.0)))
        return np.where(np.isnan(v) | np.isnan(a) | np.isnan(b), np.nan, np.where(v > 0, p, 1.0))

    return _udf(tail, f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi2_upper(x: Column, df: Column) -> Column:
    return _udf(lambda v, d: gammaincc(d / 2, v / 2), x.cast("double"), df.cast("double"))


def t_critical(p: Column, df: Column) -> Column:
    return _udf(t_quantile, p.cast("double"), df.cast("double"))


def normal_quantile(p: Column) -> Column:
    return _udf(norm_ppf, p.cast("double"))
