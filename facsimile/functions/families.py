"""Distribution families in numpy: CDF, survival function, log density and quantiles.

Each family is given for its standardised variable y = (x - loc) / scale.  Both
tails are separate functions, so that a probability near 1 loses no digits.
``tails`` and ``log_density`` also run over Arrow batches of data (``marginals``), where
``GRID_FAMILIES`` are read from a grid of ``tails``, as their CDFs are series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .special import beta_cdf, gamma_cdf, gamma_sf, t_cdf

_erfc = np.vectorize(math.erfc, otypes=[float])
_PI = math.pi
Tail = Callable[[np.ndarray], np.ndarray]


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2.0))


def _exponnorm_part(y: np.ndarray, k: float) -> np.ndarray:
    """exp(1/(2 k^2) - y/k) Phi(y - 1/k), by logarithms where the factors are extreme."""
    w = y - 1.0 / k
    log_phi = np.where(w > -30, np.log(np.maximum(normal_cdf(np.maximum(w, -30)), 1e-300)),
                       -0.5 * w * w - np.log(np.maximum(-w, 1.0)) - 0.5 * math.log(2 * _PI))
    return np.exp(np.minimum(1.0 / (2 * k * k) - y / k + log_phi, 700.0))


def tails(family: str, p1: float | None, p2: float | None) -> tuple[float, float, Tail, Tail]:
    """(lower bound, upper bound, CDF, survival function)."""
    inf = math.inf
    if family == "norm":
        return -inf, inf, normal_cdf, lambda y: normal_cdf(-y)
    if family == "expon":
        return 0.0, inf, lambda y: -np.expm1(-y), lambda y: np.exp(-y)
    if family == "uniform":
        return 0.0, 1.0, lambda y: y, lambda y: 1.0 - y
    if family == "rayleigh":
        return 0.0, inf, lambda y: -np.expm1(-y * y / 2), lambda y: np.exp(-y * y / 2)
    if family == "lognorm":
        return 0.0, inf, lambda y: normal_cdf(np.log(y) / p1), lambda y: normal_cdf(-np.log(y) / p1)
    if family == "cauchy":
        return -inf, inf, lambda y: np.arctan2(1.0, -y) / _PI, lambda y: np.arctan2(1.0, y) / _PI
    if family == "logistic":
        return -inf, inf, lambda y: 1 / (1 + np.exp(np.minimum(-y, 700))), lambda y: 1 / (1 + np.exp(np.minimum(y, 700)))
    if family == "powerlaw":
        return 0.0, 1.0, lambda y: y ** p1, lambda y: -np.expm1(p1 * np.log(y))
    if family == "pareto":
        return 1.0, inf, lambda y: -np.expm1(-p1 * np.log(y)), lambda y: y ** -p1
    if family == "weibull_min":
        return 0.0, inf, lambda y: -np.expm1(-y ** p1), lambda y: np.exp(-y ** p1)
    if family == "weibull_max":
        return -inf, 0.0, lambda y: np.exp(-(-y) ** p1), lambda y: -np.expm1(-(-y) ** p1)
    if family == "dweibull":
        half = lambda y: 0.5 * np.exp(-np.abs(y) ** p1)
        return -inf, inf, lambda y: np.where(y < 0, half(y), 1 - half(y)), lambda y: np.where(y < 0, 1 - half(y), half(y))
    if family == "cosine":
        return -_PI, _PI, lambda y: (_PI + y + np.sin(y)) / (2 * _PI), lambda y: (_PI - y - np.sin(y)) / (2 * _PI)
    if family == "arcsine":
        return 0.0, 1.0, lambda y: 2 / _PI * np.arcsin(np.sqrt(y)), lambda y: 2 / _PI * np.arcsin(np.sqrt(1 - y))
    if family == "loguniform":
        span = math.log(p2) - math.log(p1)
        return p1, p2, lambda y: np.log(y / p1) / span, lambda y: np.log(p2 / y) / span
    if family == "loglaplace":
        up = lambda y: 0.5 * y ** p1
        down = lambda y: 0.5 * y ** -p1
        return 0.0, inf, lambda y: np.where(y < 1, up(np.minimum(y, 1)), 1 - down(np.maximum(y, 1))), \
            lambda y: np.where(y < 1, 1 - up(np.minimum(y, 1)), down(np.maximum(y, 1)))
    if family == "exponnorm":
        return -inf, inf, lambda y: np.maximum(normal_cdf(y) - _exponnorm_part(y, p1), 0.0), \
            lambda y: normal_cdf(-y) + _exponnorm_part(y, p1)
    if family == "genextreme":
        if abs(p1) < 1e-12:
            t = lambda y: np.exp(-y)
            lo, hi = -inf, inf
        else:
            t = lambda y: np.maximum(1 - p1 * y, 0.0) ** (1 / p1)
            lo, hi = (-inf, 1 / p1) if p1 > 0 else (1 / p1, inf)
        return lo, hi, lambda y: np.exp(-t(y)), lambda y: -np.expm1(-t(y))
    if family == "gamma":
        return 0.0, inf, lambda y: gamma_cdf(y, p1), lambda y: gamma_sf(y, p1)
    if family == "chi2":
        return 0.0, inf, lambda y: gamma_cdf(y / 2, p1 / 2), lambda y: gamma_sf(y / 2, p1 / 2)
    if family == "beta":
        return 0.0, 1.0, lambda y: beta_cdf(y, p1, p2), lambda y: beta_cdf(1 - y, p2, p1)
    if family == "t":
        return -inf, inf, lambda y: t_cdf(y, p1), lambda y: t_cdf(-y, p1)
    if family == "exponpow":
        return 0.0, inf, lambda y: -np.expm1(-np.expm1(y ** p1)), lambda y: np.exp(-np.expm1(y ** p1))
    if family == "exponweib":  # without a second shape the inner exponent is 1
        c = 1.0 if p2 is None else p2
        log_in = lambda y: p1 * np.log(-np.expm1(-y ** c))
        return 0.0, inf, lambda y: np.exp(log_in(y)), lambda y: -np.expm1(log_in(y))
    if family == "truncnorm":  # without a second shape there is no upper bound
        hi = inf if p2 is None else p2
        mass = normal_between(p1, hi)
        return p1, hi, lambda y: normal_between(p1, y) / mass, lambda y: normal_between(y, hi) / mass
    raise ValueError(f"unknown family {family!r}")


def normal_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Phi(b) - Phi(a) by the tails on the nearer side."""
    upper = np.asarray(a, float) > 0
    return np.where(upper, normal_cdf(-np.asarray(a, float)) - normal_cdf(-np.asarray(b, float)), normal_cdf(b) - normal_cdf(a))


def log_density(family: str, y: np.ndarray, p1: float | None, p2: float | None) -> np.ndarray:
    """ln of the density of the standardised variable; minus infinity outside the support."""
    root = 0.5 * math.log(2 * _PI)
    inside = np.ones(y.shape, bool)
    if family in ("rayleigh", "lognorm", "powerlaw", "weibull_min", "loglaplace", "gamma", "chi2", "exponpow", "exponweib"):
        inside = y > 0
        if family == "powerlaw":
            inside &= y <= 1
    elif family == "expon":
        inside = y >= 0
    elif family == "uniform":
        inside = (y >= 0) & (y <= 1)
    elif family in ("arcsine", "beta"):
        inside = (y > 0) & (y < 1)
    elif family == "pareto":
        inside = y >= 1
    elif family == "weibull_max":
        inside = y < 0
    elif family == "dweibull":
        inside = y != 0
    elif family == "cosine":
        inside = np.abs(y) <= _PI
    elif family == "loguniform":
        inside = (y >= p1) & (y <= p2)
    elif family == "truncnorm":
        inside = (y >= p1) & (y <= (math.inf if p2 is None else p2))
    elif family == "genextreme":
        inside = 1.0 - p1 * y > 0
    out = np.full(y.shape, -math.inf)
    y = y[inside]
    if family == "norm":
        v = -0.5 * y * y - root
    elif family == "expon":
        v = -y
    elif family == "uniform":
        v = np.zeros(y.shape)
    elif family == "rayleigh":
        v = np.log(y) - 0.5 * y * y
    elif family == "lognorm":
        v = -0.5 * (np.log(y) / p1) ** 2 - np.log(p1 * y) - root
    elif family == "cauchy":
        v = -np.log(_PI * (1.0 + y * y))
    elif family == "logistic":
        v = -np.abs(y) - 2.0 * np.log1p(np.exp(-np.abs(y)))
    elif family == "powerlaw":
        v = math.log(p1) + (p1 - 1.0) * np.log(y)
    elif family == "pareto":
        v = math.log(p1) - (p1 + 1.0) * np.log(y)
    elif family in ("weibull_min", "weibull_max", "dweibull"):
        size = np.abs(y)
        v = math.log(p1 / 2.0 if family == "dweibull" else p1) + (p1 - 1.0) * np.log(size) - size ** p1
    elif family == "cosine":
        v = np.log((1.0 + np.cos(y)) / (2.0 * _PI))
    elif family == "arcsine":
        v = -math.log(_PI) - 0.5 * np.log(y * (1.0 - y))
    elif family == "loguniform":
        v = -np.log(y) - math.log(math.log(p2) - math.log(p1))
    elif family == "loglaplace":
        v = math.log(p1 / 2.0) - np.log(y) - p1 * np.abs(np.log(y))
    elif family == "exponnorm":
        v = np.log(_exponnorm_part(y, p1)) - math.log(p1)
    elif family == "genextreme":
        t = -y if abs(p1) < 1e-12 else np.log1p(-p1 * y) / p1
        v = (1.0 - p1) * t - np.exp(t)
    elif family in ("gamma", "chi2"):
        k, half = (p1, 1.0) if family == "gamma" else (p1 / 2.0, 0.5)
        v = (k - 1.0) * np.log(y) - half * y + k * math.log(half) - math.lgamma(k)
    elif family == "beta":
        v = (p1 - 1.0) * np.log(y) + (p2 - 1.0) * np.log1p(-y) + math.lgamma(p1 + p2) - math.lgamma(p1) - math.lgamma(p2)
    elif family == "t":
        v = math.lgamma((p1 + 1.0) / 2.0) - math.lgamma(p1 / 2.0) - 0.5 * math.log(p1 * _PI) - (p1 + 1.0) / 2.0 * np.log1p(y * y / p1)
    elif family == "exponpow":
        t = y ** p1
        v = math.log(p1) + (p1 - 1.0) * np.log(y) + t - np.expm1(t)
    elif family == "exponweib":
        c = 1.0 if p2 is None else p2
        t = y ** c
        v = math.log(p1 * c) + (p1 - 1.0) * np.log(-np.expm1(-t)) - t + (c - 1.0) * np.log(y)
    elif family == "truncnorm":
        v = -0.5 * y * y - root - math.log(float(normal_between(p1, math.inf if p2 is None else p2)))
    else:
        raise ValueError(f"unknown family {family!r}")
    out[inside] = v
    return out


def quantiles_at_normal(family: str, z: np.ndarray, p1: float | None = None, p2: float | None = None) -> np.ndarray:
    """Standardised quantiles at u = Phi(z), by bisection on the nearer tail."""
    lo, hi, cdf, sf = tails(family, p1, p2)
    z = np.asarray(z, float)
    low = z <= 0
    goal = normal_cdf(-np.abs(z))

    def above(y: np.ndarray) -> np.ndarray:
        """Whether the quantile lies above y."""
        with np.errstate(all="ignore"):
            return np.where(low, cdf(y) < goal, sf(y) > goal)

    a, b = np.full(z.shape, lo), np.full(z.shape, hi)
    for bound, sign in ((a, -1.0), (b, 1.0)):  # an open end is pushed out until it encloses the quantile
        if not np.isfinite(bound).all():
            other = b if sign < 0 else a
            start = np.where(np.isfinite(other), other, 0.0)
            bound[:] = start + sign
            for _ in range(1024):
                short = ~above(bound) if sign < 0 else above(bound)
                if not short.any():
                    break
                bound[short] = start[short] + (bound[short] - start[short]) * 2
    for _ in range(200):
        mid = 0.5 * (a + b)
        up = above(mid)
        a, b = np.where(up, mid, a), np.where(up, b, mid)
        if np.all((b - a) <= 4e-16 * np.maximum(np.abs(a), np.abs(b))):
            break
    return 0.5 * (a + b)
