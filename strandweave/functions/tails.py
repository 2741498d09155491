"""Tail probabilities and quantiles, as scalar functions of one or two counts."""

from __future__ import annotations

import math

_TINY = 1e-300


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Modified Lentz evaluation of 1 / (1 + d1 / (1 + d2 / ...)).
    f, c, d = 1.0, 1.0, 0.0
    for n in range(500):
        m = n // 2
        if n == 0:
            term = 1.0
        elif n % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or _TINY)
        c = (1.0 + term / c) or _TINY
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(df: float, alpha: float = 0.05) -> float:
    """t with two-sided tail probability alpha."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > alpha:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > alpha else (low, mid)
    return (low + high) / 2


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = 1
        while abs(term) > 1e-16 * abs(total):
            term *= x / (a + n)
            total += term
            n += 1
        return 1.0 - scale * total
    b, c = x + 1 - a, 1.0 / _TINY
    d = 1.0 / b
    f = d
    for n in range(1, 1000):
        k = -n * (n - a)
        b += 2
        d = 1.0 / ((b + k * d) or _TINY)
        c = (b + k / c) or _TINY
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return scale * f


def chi_square_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def sign_test(positive: int, negative: int) -> float:
    """Exact two-sided p; ties are dropped beforehand, no pairs give 1."""
    n, least = positive + negative, min(positive, negative)
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(least + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(v - top) for v in logs))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the t approximation."""
    if n < 3:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
