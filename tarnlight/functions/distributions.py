"""Tails of distributions and normality tests, in plain Python for the few numbers that reach the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a  # continued fraction, by Lentz
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / _nonzero(an * d + b)
        c = _nonzero(b + an / c)
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def _nonzero(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def beta_i(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / _nonzero(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / _nonzero(1 + even * d)
        c = _nonzero(1 + even / c)
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / _nonzero(1 + odd * d)
        c = _nonzero(1 + odd / c)
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson or Spearman coefficient over n rows, by Student's t."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if n == 2 or abs(r) >= 1:
        return 0.0 if n > 2 else 1.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return beta_i(df / (df + t2), df / 2, 0.5)


def normality_k2(n: int, g1: float, g2: float) -> float | None:
    """p of D'Agostino and Pearson's test, from the population skewness and excess kurtosis."""
    if n < 8:
        return None
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    alpha = math.sqrt(2 / (w2 - 1))
    y = y or 1e-300
    z1 = math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(var)
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / skew * (2 / skew + math.sqrt(1 + 4 / skew**2))
    base = 1 + x * math.sqrt(2 / (a - 4))
    root = math.copysign(((1 - 2 / a) / abs(base)) ** (1 / 3), base) if base else 0.0
    z2 = (1 - 2 / (9 * a) - root) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    out = 0.0
    for c in reversed(coefficients):
        out = out * x + c
    return out


def shapiro(values: list[float]) -> tuple[float, float] | None:
    """(W, p) by Royston's approximation (AS R94), for 3 to 5000 values with some spread."""
    x = sorted(values)
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return None
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    norm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    else:
        last = m[-1] / math.sqrt(norm) + _poly((0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), u)
        if n > 5:
            second = m[-2] / math.sqrt(norm) + _poly((0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
            phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = [v / math.sqrt(phi) for v in m]
            a[0], a[1], a[-2], a[-1] = -last, -second, second, last
        else:
            phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = [v / math.sqrt(phi) for v in m]
            a[0], a[-1] = -last, last
    mean = sum(x) / n
    w = min(1.0, sum(c * v for c, v in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        y = math.log(1 - w)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu = _poly((0.5440, -0.39978, 0.025054, -0.0006714), n)
        sigma = math.exp(_poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        y, log = math.log(1 - w), math.log(n)
        mu = _poly((-1.5861, -0.31082, -0.083751, 0.0038915), log)
        sigma = math.exp(_poly((-0.4803, -0.082676, 0.0030302), log))
    return w, 1 - _NORMAL.cdf((y - mu) / sigma)
