"""Tail probabilities of the t, F, chi-square and normal distributions."""

from __future__ import annotations

import math
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_sf(f: float, d1: float, d2: float) -> float:
    if d1 <= 0 or d2 <= 0 or f != f:
        return math.nan
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2) if df > 0 else math.nan


def pearson_p(r: float | None, n: int) -> float | None:
    if r is None or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and its p-value (Royston's approximation, 12 to 5000 values)."""
    x = sorted(values)
    n = len(x)
    normal = NormalDist()
    m = [normal.inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    poly = lambda *c: sum(k * u**p for p, k in enumerate(c))
    last = poly(m[-1] / math.sqrt(mm), 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
    prev = poly(m[-2] / math.sqrt(mm), 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
    a = [v / math.sqrt(phi) for v in m]
    a[-1], a[-2], a[0], a[1] = last, prev, -last, -prev
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    if ss == 0:
        return 1.0, 1.0
    w = min(sum(k * v for k, v in zip(a, x, strict=True)) ** 2 / ss, 1.0)
    ln = math.log(n)
    mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
    sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    if w >= 1:
        return 1.0, 1.0
    return w, 1 - normal.cdf((math.log(1 - w) - mu) / sigma)
