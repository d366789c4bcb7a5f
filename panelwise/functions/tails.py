"""Tail probabilities of the F, t, chi-square, normal and Kolmogorov laws.

The column forms of F, t, chi-square and the asymptotic Kolmogorov law are plain expressions: continued fractions
and series of a bounded number of terms in ``aggregate``. The exact two-sample law and the unit-root law run as
Arrow functions on one row per test. The numpy forms are the same laws for the driver and for tests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.fixed import ADF_LARGE, ADF_MAX, ADF_MIN, ADF_SMALL, ADF_STAR

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_sf(x):
    return 0.5 * _erfc(np.asarray(x, dtype=float) / math.sqrt(2.0))


def _beta_fraction(a, b, x, steps: int = 300):
    """Continued fraction of the incomplete beta integral (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for k in (even, odd):
            d = 1.0 + k * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_cdf(a, b, x):
    """Regularised incomplete beta ``I_x(a, b)``."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        part = front * _beta_fraction(aa, bb, xx)
    part = np.where(xx <= 0.0, 0.0, part)
    return np.clip(np.where(flip, 1.0 - part, part), 0.0, 1.0)


def f_sf(f, df1, df2):
    f = np.asarray(f, dtype=float)
    df1, df2 = np.asarray(df1, dtype=float), np.asarray(df2, dtype=float)
    return np.where(f <= 0.0, 1.0, beta_cdf(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * np.maximum(f, 0.0))))


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def gamma_sf(a, x):
    """Regularised upper incomplete gamma ``Q(a, x)``."""
    a, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, x)))
    out = np.ones_like(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - _lgamma(a))
    low = (x > 0) & (x < a + 1.0)
    if low.any():
        al, xl = a[low], x[low]
        term = 1.0 / al
        total = term.copy()
        for k in range(1, 2000):
            term = term * xl / (al + k)
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * 1e-16):
                break
        out[low] = 1.0 - front[low] * total
    high = x >= a + 1.0
    if high.any():
        ah, xh = a[high], x[high]
        tiny = 1e-300
        b = xh + 1.0 - ah
        c = np.full_like(xh, 1.0 / tiny)
        d = 1.0 / b
        h = d.copy()
        for k in range(1, 2000):
            an = -k * (k - ah)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-15):
                break
        out[high] = front[high] * h
    return np.clip(out, 0.0, 1.0)


def chi2_sf(x, df):
    return gamma_sf(np.asarray(df, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


EXACT_LIMIT = 10_000


def _ks_exact(d: float, n: int, m: int) -> float:
    """Exact two-sided tail by walking a random order of both samples.

    ``mass[i]`` is the chance of having drawn i of n (and k - i of m) after k draws
    with the gap still below d; mass that reaches the gap is added to the tail.
    """
    g = math.gcd(n, m)
    h = int(round(d * n * m / g))
    if h == 0:
        return 1.0
    total, tail = n + m, 0.0
    mass = np.zeros(n + 1)
    mass[0] = 1.0
    i = np.arange(n + 1)
    for k in range(1, total + 1):
        j = k - 1 - i
        left = total - k + 1
        stay = np.where((j >= 0) & (j < m), mass * (m - j) / left, 0.0)
        step = np.where(j >= 0, mass * (n - i) / left, 0.0)
        mass = stay
        mass[1:] += step[:-1]
        j = k - i
        out = (np.abs(i * m - j * n) >= h * g) & (mass > 0)
        if out.any():
            tail += float(mass[out].sum())
            mass[out] = 0.0
    return min(1.0, tail)


def kolmogorov_sf(x: float) -> float:
    if x <= 0.0:
        return 1.0
    if x < 1.18:
        k = np.arange(1, 40, 2)
        return float(1.0 - math.sqrt(2 * math.pi) / x * np.exp(-(k**2) * math.pi**2 / (8 * x * x)).sum())
    k = np.arange(1, 101)
    return float(max(0.0, 2.0 * ((-1.0) ** (k - 1) * np.exp(-2.0 * k**2 * x * x)).sum()))


def ks_two_sample_p(d: float, n: int, m: int) -> float:
    """Two-sample p-value: exact up to 10 000 rows per side, asymptotic beyond."""
    if max(n, m) <= EXACT_LIMIT:
        return _ks_exact(d, n, m)
    return kolmogorov_sf(d * math.sqrt(n * m / (n + m)))


def adf_p(t):
    """Approximate unit-root p-value for a regression with a constant."""
    t = np.asarray(t, dtype=float)
    small = sum(c * t**i for i, c in enumerate(ADF_SMALL))
    large = sum(c * t**i for i, c in enumerate(ADF_LARGE))
    p = 1.0 - normal_sf(np.where(t <= ADF_STAR, small, large))
    return np.where(t > ADF_MAX, 1.0, np.where(t < ADF_MIN, 0.0, p))


# ---- column forms ------------------------------------------------------------------


def _guard(values, fn):
    known = np.all([np.isfinite(v) for v in values], axis=0)
    out = np.full(len(values[0]), np.nan)
    if known.any():
        out[known] = fn(*[v[known] for v in values])
    return pd.Series(out).astype(object).where(pd.notna(out), None).astype("float64")


def _args(*series):
    return [pd.to_numeric(s).to_numpy(dtype=float, na_value=np.nan) for s in series]


@F.pandas_udf(T.DoubleType())
def _ks_tail(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    one = np.vectorize(lambda a, b, c: _ks_exact(a, int(b), int(c)), otypes=[float])
    return _guard(_args(d, n, m), one)


@F.pandas_udf(T.DoubleType())
def _adf_tail(t: pd.Series) -> pd.Series:
    return _guard(_args(t), adf_p)


def _clean(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


#: Lanczos coefficients (g = 7) of the log gamma function, fixed values
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
BETA_TERMS, GAMMA_TERMS, KS_TERMS = 600, 1000, 100
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """For x >= 0.5."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(k))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


def _row(**fields: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in fields.items()])


def beta_tail(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta ``I_x(a, b)`` for a, b >= 0.5 (modified Lentz, two terms a step number)."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1.0 - x).otherwise(x)

    def step(acc: Column, n: Column) -> Column:
        p, q, y, m = acc["a"], acc["b"], acc["x"], F.floor(n / 2).cast("double")
        even = m * (q - m) * y / ((p + 2.0 * m - 1.0) * (p + 2.0 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2.0 * m) * (p + 2.0 * m + 1.0))
        k = F.when(n % 2 == 0, even).otherwise(odd)
        d, c = 1.0 / _away(1.0 + k * acc["d"]), _away(1.0 + k / acc["c"])
        return _row(a=p, b=q, x=y, c=c, d=d, h=acc["h"] * d * c)

    first = 1.0 / _away(1.0 - (aa + bb) * xx / (aa + 1.0))
    fraction = F.aggregate(F.sequence(F.lit(2), F.lit(BETA_TERMS)), _row(a=aa, b=bb, x=xx, c=F.lit(1.0), d=first, h=first), step, lambda acc: acc["h"])
    front = F.exp(log_gamma(aa + bb) - log_gamma(aa) - log_gamma(bb) + aa * F.ln(xx) + bb * F.log1p(-xx)) / aa
    part = F.when(xx <= 0.0, 0.0).otherwise(front * fraction)
    return _clip(F.when(flip, 1.0 - part).otherwise(part))


def gamma_tail(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma ``Q(a, x)`` for a >= 0.5: a series below a + 1, a continued fraction from there."""
    front = F.exp(-x + a * F.ln(x) - log_gamma(a))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * acc["x"] / (acc["a"] + k)
        return _row(a=acc["a"], x=acc["x"], term=term, total=acc["total"] + term)

    def step(acc: Column, k: Column) -> Column:
        n = -k.cast("double") * (k - acc["a"])
        b = acc["b"] + 2.0
        d, c = 1.0 / _away(n * acc["d"] + b), _away(b + n / acc["c"])
        return _row(a=acc["a"], b=b, c=c, d=d, h=acc["h"] * d * c)

    terms, base = F.sequence(F.lit(1), F.lit(GAMMA_TERMS)), x + 1.0 - a
    low = F.aggregate(terms, _row(a=a, x=x, term=1.0 / a, total=1.0 / a), add, lambda acc: acc["total"])
    high = F.aggregate(terms, _row(a=a, b=base, c=F.lit(1 / TINY), d=1.0 / _away(base), h=1.0 / _away(base)), step, lambda acc: acc["h"])
    return _clip(F.when(x <= 0.0, 1.0).when(x < a + 1.0, 1.0 - front * low).otherwise(front * high))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f); null where an argument is missing or not finite, or without degrees of freedom."""
    f, df1, df2 = (c.cast("double") for c in (f, df1, df2))
    inner = beta_tail(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * F.greatest(f, F.lit(0.0))))
    return F.when(_finite(f, df1, df2) & (df1 > 0) & (df2 > 0), F.when(f <= 0.0, 1.0).otherwise(inner))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided P(|T| > t)."""
    t, df = t.cast("double"), df.cast("double")
    return F.when(_finite(t, df) & (df > 0), beta_tail(df / 2.0, F.lit(0.5), df / (df + t * t)))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square > x)."""
    x, df = x.cast("double"), df.cast("double")
    return F.when(_finite(x, df) & (df > 0), gamma_tail(df / 2.0, x / 2.0))


def kolmogorov_tail(x: Column) -> Column:
    """Asymptotic two-sided law: one of two series, whichever converges at once."""
    one = lambda k: F.exp(-(2.0 * k - 1.0) * (2.0 * k - 1.0) * F.lit(math.pi**2) / (8.0 * x * x))
    two = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x)
    terms = F.sequence(F.lit(1), F.lit(KS_TERMS))
    total = lambda term: F.aggregate(F.transform(terms, lambda k: term(k.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)
    small = 1.0 - F.lit(math.sqrt(2 * math.pi)) / x * total(one)
    return _clip(F.when(x <= 0.0, 1.0).when(x < 1.18, small).otherwise(2.0 * total(two)))


def ks_method(n: Column, m: Column, method: str = "auto") -> Column:
    """``exact`` or ``asymptotic``; ``auto`` is the usual rule, exact up to ``EXACT_LIMIT`` rows a side."""
    return F.lit(method) if method != "auto" else F.when(F.greatest(n, m) <= EXACT_LIMIT, "exact").otherwise("asymptotic")


def ks_tail(d: Column, n: Column, m: Column, method: str = "auto") -> Column:
    """Two-sample p-value by the method that :func:`ks_method` names."""
    d, n, m = (c.cast("double") for c in (d, n, m))
    known = _finite(d, n, m) & (n > 0) & (m > 0)
    far = F.when(known, kolmogorov_tail(d * F.sqrt(n * m / (n + m))))
    if method == "asymptotic":
        return far
    is_exact = ks_method(n, m, method) == "exact"
    near = _clean(_ks_tail(F.when(is_exact, d), n, m))
    return F.when(is_exact, near).otherwise(far)


def adf_tail(t: Column) -> Column:
    return _clean(_adf_tail(t.cast("double")))
