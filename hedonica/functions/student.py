"""Tails of Student's t and of F(1, df), for a handful of scalars.

Up to a million degrees of freedom: regularised incomplete beta by its continued fraction
(Abramowitz & Stegun 26.5.8), evaluated with the modified Lentz recurrence. Beyond: the
normal approximation 26.7.8, whose error falls with the square of the degrees of freedom.
"""

from __future__ import annotations

import math

NORMAL_FROM = 1e6


def log_gamma_half_step(a: float) -> float:
    """log of gamma(a + 1/2) / gamma(a), without cancellation for large a."""
    if a < 1e3:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300

    def safe(v: float) -> float:
        return v if abs(v) > tiny else tiny

    c, d = 1.0, 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 / safe(1.0 + term * d)
            c = safe(1.0 + term / c)
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if t == 0.0:
        return 1.0
    if df >= NORMAL_FROM:
        return math.erfc(abs(t) * (1 - 1 / (4 * df)) / math.sqrt(1 + t * t / (2 * df)) / math.sqrt(2))
    a, b = df / 2.0, 0.5
    x, y = df / (df + t * t), t * t / (df + t * t)
    log_x, log_y = -math.log1p(t * t / df), math.log(y)
    front = math.exp(
        log_gamma_half_step(a) - math.lgamma(0.5) + a * log_x + b * log_y
    )
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - front / b * _beta_fraction(b, a, y)
    return front / a * _beta_fraction(a, b, x)


def f_upper(f: float, df: float) -> float:
    """P(F(1, df) > f)."""
    return t_two_sided(math.sqrt(f), df)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile, p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2.0 * (1.0 - p):
        high *= 2.0
    for _ in range(100):
        mid = (low + high) / 2.0
        if t_two_sided(mid, df) > 2.0 * (1.0 - p):
            low = mid
        else:
            high = mid
    return (low + high) / 2.0
