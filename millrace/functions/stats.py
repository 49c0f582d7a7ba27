"""Tail probabilities for test statistics, on the few rows of a result.

Continued fractions and series for the incomplete gamma and beta functions, as in any numerical handbook.
"""

from __future__ import annotations

import math

import numpy as np


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - scale * total)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def beta_lower(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(statistic: float, df: float) -> float:
    return gamma_upper(df / 2, statistic / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_lower(df / (df + t * t), df / 2, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_lower(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def ks_tail(statistic: float, n: float, m: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov probability."""
    root = math.sqrt(n * m / (n + m))
    x = root * statistic
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function of positive numbers: recurrence up to 10, then its asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (x < 10).any():
        low = x < 10
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
