"""Tail areas of the t and F distributions."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * value / a
    raise ArithmeticError(f"the incomplete beta function of {a}, {b}, {x} does not converge")


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f <= 0:
        return 1.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def t_quantile(p: float, df: float) -> float:
    """Quantile of the t distribution for p > 1/2."""
    lo, hi = 0.0, 1.0

    def upper_tail(t: float) -> float:
        return 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))

    while upper_tail(hi) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if upper_tail(mid) > 1.0 - p else (lo, mid)
    return 0.5 * (lo + hi)
