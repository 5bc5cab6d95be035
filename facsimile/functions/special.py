"""Special functions.

* ``lgamma_sql``: ln Gamma(a) for a > 0 as a SQL expression (recurrence to
  a + 7, then Stirling's series; absolute error below 1e-13).
* ``gamma_cdf`` / ``gamma_sf`` / ``beta_cdf`` / ``t_cdf``: regularised incomplete
  gamma and beta functions in numpy, from formulas of the NIST Digital Library of
  Mathematical Functions (8.11.4, 8.9.2, 8.17.22); they run on the driver over
  a few thousand grid points, never over data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def lgamma_sql(a: str) -> str:
    z = f"({a} + 7.0)"
    prod = " * ".join(f"({a} + {k}.0)" for k in range(7))
    stirling = (f"(({z} - 0.5) * ln({z}) - {z} + 0.9189385332046728 + 1.0 / (12.0 * {z}) "
                f"- 1.0 / (360.0 * power({z}, 3)) + 1.0 / (1260.0 * power({z}, 5)) "
                f"- 1.0 / (1680.0 * power({z}, 7)))")
    return f"({stirling} - ln({prod}))"


def _continued_fraction(first: np.ndarray, numerator: Callable, denominator: Callable, most: int = 5000) -> np.ndarray:
    """first + n1 / (d1 + n2 / (d2 + ...)), by the ratio of successive convergents.

    With f_k the k-th convergent, C_k = A_k / A_(k-1) and D_k = B_(k-1) / B_k obey
    one-term recurrences and f_k = f_(k-1) C_k D_k."""
    small = 1e-290
    value = np.where(first == 0, small, first)
    ratio_a, ratio_b = value.copy(), np.zeros_like(value)
    for k in range(1, most):
        n, d = numerator(k), denominator(k)
        ratio_b = d + n * ratio_b
        ratio_b = 1.0 / np.where(ratio_b == 0, small, ratio_b)
        ratio_a = d + n / ratio_a
        ratio_a = np.where(ratio_a == 0, small, ratio_a)
        change = ratio_a * ratio_b
        value = value * change
        if np.all(np.abs(change - 1.0) < 3e-16):
            break
    return value


def _lower_series(x: np.ndarray, a: float) -> np.ndarray:
    """P(a, x) = x^a e^-x / Gamma(a+1) sum_n x^n / ((a+1) ... (a+n))   (DLMF 8.11.4)."""
    term, total = np.ones_like(x), np.ones_like(x)
    for n in range(1, 5000):
        term = term * x / (a + n)
        total = total + term
        if np.all(term <= total * 1e-17):
            break
    return total * np.exp(a * np.log(x) - x - math.lgamma(a + 1.0))


def _upper_fraction(x: np.ndarray, a: float) -> np.ndarray:
    """Q(a, x) = x^a e^-x / Gamma(a) / (x+1-a - 1(1-a)/(x+3-a - 2(2-a)/(x+5-a - ...)))   (DLMF 8.9.2)."""
    fraction = _continued_fraction(x + 1.0 - a, lambda k: -k * (k - a), lambda k: x + (2 * k + 1) - a)
    return np.exp(a * np.log(x) - x - math.lgamma(a)) / fraction


def _gamma_pair(x: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, dtype=float)
    p, q = np.zeros_like(x), np.ones_like(x)
    low, high = (x > 0) & (x < a + 1.0), x >= a + 1.0
    if low.any():
        p[low] = _lower_series(x[low], a)
        q[low] = 1.0 - p[low]
    if high.any():
        q[high] = np.where(np.isinf(x[high]), 0.0, _upper_fraction(np.minimum(x[high], 1e300), a))
        p[high] = 1.0 - q[high]
    return np.clip(p, 0.0, 1.0), np.clip(q, 0.0, 1.0)


def gamma_cdf(x: np.ndarray, a: float) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x)."""
    return _gamma_pair(x, a)[0]


def gamma_sf(x: np.ndarray, a: float) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x), exact where P is near 1."""
    return _gamma_pair(x, a)[1]


def _beta_fraction(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """1 + d1/(1 + d2/(1 + ...)) of DLMF 8.17.22; I_x is the prefactor over this."""
    def d(k: int) -> np.ndarray:
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return _continued_fraction(np.ones_like(x), d, lambda k: 1.0)


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    out = np.where(x >= 1.0, 1.0, 0.0)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    # the fraction converges fast below the mean; above it use I_x(a, b) = 1 - I_(1-x)(b, a)
    below = (x > 0) & (x < 1) & (x <= (a + 1.0) / (a + b + 2.0))
    above = (x > 0) & (x < 1) & ~below
    for at, y, p, q in ((below, x, a, b), (above, 1.0 - x, b, a)):
        if at.any():
            y = y[at]
            part = np.exp(log_front + p * np.log(y) + q * np.log1p(-y)) / (p * _beta_fraction(y, p, q))
            out[at] = part if at is below else 1.0 - part
    return np.clip(out, 0.0, 1.0)


def t_cdf(x: np.ndarray, df: float) -> np.ndarray:
    """Student's t: half of I at df / (df + x^2) is the smaller tail."""
    x = np.asarray(x, dtype=float)
    tail = 0.5 * beta_cdf(df / (df + x * x), df / 2.0, 0.5)
    return np.where(x >= 0, 1.0 - tail, tail)
