"""Quantiles of the normal, Student t, chi-squared and F distributions.

Driver-side scalars for limits; continued fractions as in the public numerical literature.
"""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x)."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = acc = 1.0 / a
        k = a
        while abs(term) > abs(acc) * 1e-17:
            k += 1
            term *= x / k
            acc += term
        return acc * front
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1 - front * h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    tiny = 1e-300
    c = 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d or tiny)
        c = 1 + even / c or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d or tiny)
        c = 1 + odd / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h / a


def _invert(cdf, p: float, low: float, high: float) -> float:
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def chi2_quantile(p: float, df: float) -> float:
    if df == 2:
        return -2 * math.log1p(-p)
    return _invert(lambda x: gamma_cdf(df / 2, x / 2), p, 0.0, df + 10)


def f_quantile(p: float, d1: float, d2: float) -> float:
    if d1 == 2:
        return d2 / 2 * ((1 - p) ** (-2 / d2) - 1)
    return _invert(lambda x: beta_cdf(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)), p, 0.0, 10.0)


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    return _invert(lambda x: 1 - beta_cdf(df / 2, 0.5, df / (df + x * x)) / 2, p, 0.0, 10.0)
