"""Tail probabilities and quantiles for already aggregated rows.

Small scalar routines wrapped as Arrow UDFs; they see one row per group,
never raw trials.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _bisect(f, target: float, lo: float, hi: float) -> float:
    """Root of an increasing ``f(x) = target`` to double precision."""
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        if f(mid) < target:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def norm_ppf_scalar(p: float) -> float:
    if p <= 0.0 or p >= 1.0:
        return math.copysign(math.inf, p - 0.5)
    return _bisect(norm_cdf, p, -40.0, 40.0)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for k in (even, odd):
            d = 1.0 + k * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + k / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return min(1.0, max(0.0, front * h / a))


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    return _bisect(lambda t: t_cdf(t, df), p, -1e8, 1e8)


def f_ppf(p: float, d1: float, d2: float) -> float:
    return _bisect(lambda f: 1.0 - f_sf(f, d1, d2), p, 0.0, 1e7)


def ncf_sf(f: float, d1: float, d2: float, nc: float) -> float:
    """Upper tail of the noncentral F as a Poisson mixture of beta tails, from the mode outwards."""
    x = d1 * f / (d1 * f + d2)
    half = nc / 2.0
    term = lambda j: (
        math.exp(-half + j * math.log(half) - math.lgamma(j + 1)) if half > 0 else float(j == 0)
    )
    mode = int(half)
    total = 0.0
    for step, start in ((1, mode), (-1, mode - 1)):
        j = start
        while j >= 0:
            w = term(j)
            total += w * (1.0 - betainc(d1 / 2.0 + j, d2 / 2.0, x))
            if w < 1e-16:
                break
            j += step
    return min(1.0, total)


def anova_power(k: float, n: float, effect: float, alpha: float) -> float:
    """Power of a one-way test with k groups of n and Cohen's f = effect."""
    d1, d2 = k - 1.0, k * (n - 1.0)
    if d1 <= 0 or d2 <= 0 or effect <= 0:
        return 0.0
    return ncf_sf(f_ppf(1.0 - alpha, d1, d2), d1, d2, effect * effect * k * n)


def needed_n(k: float, effect: float, alpha: float, goal: float, cap: int = 10_000) -> float:
    """Smallest group size reaching ``goal`` power, at most ``cap``."""
    if effect <= 0 or k < 2:
        return float("nan")
    lo, hi = 2, cap
    while lo < hi:
        mid = (lo + hi) // 2
        if anova_power(k, mid, effect, alpha) >= goal:
            hi = mid
        else:
            lo = mid + 1
    return float(lo)


def srange_sf(q: float, k: float, df: float) -> float:
    """Upper tail of the studentized range by Gauss-Legendre quadrature in both directions."""
    if q <= 0:
        return 1.0
    erf = np.vectorize(math.erf)
    cdf = lambda z: 0.5 * (1.0 + erf(z / math.sqrt(2.0)))
    xs, ws = np.polynomial.legendre.leggauss(64)
    z = 8.0 * xs
    phi = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi) * ws * 8.0
    base = cdf(z)

    def range_cdf(w):
        return float(np.sum(k * phi * (base - cdf(z - w)) ** (k - 1)))

    spread = 8.0 / math.sqrt(2.0 * df)
    lo, hi = max(1e-9, 1.0 - spread), 1.0 + spread
    s = 0.5 * (hi - lo) * xs + 0.5 * (hi + lo)
    log_dens = (df - 1.0) * np.log(s) - df * s * s / 2.0  # the constant cancels below
    dens = np.exp(log_dens - log_dens.max()) * ws
    return float(min(1.0, max(0.0, 1.0 - np.sum(dens * [range_cdf(q * v) for v in s]) / np.sum(dens))))


def signed_rank_p(w_plus: float, n: float, zeros: float, ties: float) -> float:
    """Two-sided signed-rank p: exact for n <= 50 without zeros or ties, else normal with tie term."""
    n = int(n)
    if n == 0:
        return 1.0
    if n <= 50 and zeros == 0 and ties == 0:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        ways /= ways.sum()
        w = int(round(w_plus))
        return float(min(1.0, 2.0 * min(ways[: w + 1].sum(), ways[w:].sum())))
    mean = n * (n + 1) / 4.0
    var = (n * (n + 1) * (2 * n + 1) - 0.5 * ties) / 24.0
    return min(1.0, 2.0 * norm_sf(abs(w_plus - mean) / math.sqrt(var))) if var > 0 else 1.0


def row_udf(fn):
    """An Arrow UDF over double columns; a NULL argument gives NULL."""

    @F.pandas_udf(T.DoubleType())
    def run(*cols: pd.Series) -> pd.Series:
        rows = zip(*[c.astype("float64") for c in cols])
        return pd.Series([None if any(v != v for v in r) else fn(*r) for r in rows], dtype="float64")

    return lambda *cols: run(*[(F.lit(c) if not isinstance(c, Column) else c).cast("double") for c in cols])


F_SF = row_udf(f_sf)
T_PPF = row_udf(t_ppf)
NORM_SF = row_udf(norm_sf)
SRANGE_SF = row_udf(srange_sf)
SIGNED_RANK_P = row_udf(signed_rank_p)
ANOVA_POWER = row_udf(anova_power)
NEEDED_N = row_udf(needed_n)


def norm_ppf(p: Column) -> Column:
    """Normal quantile as a column expression (rational approximation AS 241)."""
    # Published coefficients of AS 241 (PPND16), highest power first.
    a = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
         13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608]
    b = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
         5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]
    c = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
         3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
    d = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
         0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]
    e = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
         0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772]
    f = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
         0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0]

    def poly(coefs, x):
        out = F.lit(coefs[0])
        for k in coefs[1:]:
            out = out * x + F.lit(k)
        return out

    q = p - 0.5
    r0 = 0.180625 - q * q
    tail = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    near, far = tail - 1.6, tail - 5.0
    mid = F.when(tail <= 5.0, poly(c, near) / poly(d, near)).otherwise(poly(e, far) / poly(f, far))
    return F.when(F.abs(q) <= 0.425, q * poly(a, r0) / poly(b, r0)).otherwise(F.when(q < 0, -mid).otherwise(mid))
