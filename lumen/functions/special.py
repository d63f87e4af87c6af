"""Tails of distributions and exact tests in plain Python: they run on the driver, over a few aggregated numbers."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by a continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson correlation; None below three rows, 0 at |r| = 1."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


@lru_cache(maxsize=64)
def _u_counts(n1: int, n2: int) -> list[int]:
    """Ways to reach each U of n1 and n2 untied values, by the product of (1 - q^(n2+i)) / (1 - q^i)."""
    size = n1 * n2 + 1
    ways = [1] + [0] * (size - 1)
    for i in range(1, n1 + 1):
        for j in range(size - 1, n2 + i - 1, -1):
            ways[j] -= ways[j - n2 - i]
        for j in range(i, size):
            ways[j] += ways[j - i]
    return ways


def mann_whitney_p(u1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p: exact if the smaller sample has at most 8 values and nothing is tied, else normal with tie and continuity corrections. ties: sum of t^3 - t."""
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and not ties:
        ways = _u_counts(min(n1, n2), max(n1, n2))
        return min(1.0, 2 * sum(ways[int(u) :]) / sum(ways))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, 2 * normal_upper((u - n1 * n2 / 2 - 0.5) / math.sqrt(var)))


def shapiro_wilk(values: list[float]) -> tuple[float, float] | None:
    """W and p by Royston's approximation for 3 to 5000 values; None outside or if all are equal."""
    x = sorted(values)
    n = len(x)
    if n < 3 or n > 5000 or x[0] == x[-1]:
        return None
    inv = NormalDist().inv_cdf
    m = [inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm = sum(v * v for v in m)
    a = [0.0] * n
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        u = 1 / math.sqrt(n)
        poly = lambda c: sum(k * u**i for i, k in enumerate(c))
        last = m[-1] / math.sqrt(mm) + poly([0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056])
        if n > 5:
            second = m[-2] / math.sqrt(mm) + poly([0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633])
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [v / math.sqrt(phi) for v in m]
            a[-1], a[-2], a[0], a[1] = last, second, -last, -second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [v / math.sqrt(phi) for v in m]
            a[-1], a[0] = last, -last
    mean = sum(x) / n
    w = sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    w = min(w, 1.0)
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(g - math.log(1 - w)) if g > math.log(1 - w) else 99.0
        mu, sd = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        k = math.log(n)
        y = math.log(1 - w)
        mu, sd = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return w, normal_upper((y - mu) / sd)
