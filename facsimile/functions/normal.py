"""Standard normal CDF and quantile as SQL expressions.

Neither Spark nor DuckDB has ``erf``; both evaluate these rational
approximations natively (whole-stage codegen in Spark).

* CDF: Hart's double-precision algorithm 5666 in the form published by
  G. West, "Better approximations to cumulative normal functions" (2005);
  relative error about 1e-14 for |x| < 7, 1e-8 further out.
* Quantile: P. J. Acklam's rational approximation (abs. error < 1e-8) with one
  Halley correction step using the CDF above.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Coefficients of the published approximations.
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
            33.912866078383, 112.079291497871, 221.213596169931,
            220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207,
            86.7807322029461, 296.564248779674, 637.333633378831,
            793.826512519948, 440.413735824752]
ACKLAM_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
ACKLAM_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01]
ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00]
ACKLAM_LOW = 0.02425


def _horner(coefs: list[float], t: str, one_last: bool = False) -> str:
    expr = repr(coefs[0])
    for c in coefs[1:]:
        expr = f"({expr} * {t} + {c!r})"
    if one_last:
        expr = f"({expr} * {t} + 1.0)"
    return expr


def lower_tail_sql(x: str) -> str:
    """Phi(-|x|), the smaller tail probability, for a column/alias ``x``."""
    a = f"abs({x})"
    body = (f"(exp(-0.5 * {a} * {a}) * {_horner(HART_NUM, a)} / {_horner(HART_DEN, a)})")
    far = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k}.0 / {far})"
    far = f"(exp(-0.5 * {a} * {a}) / {far} / 2.506628274631)"
    return (f"(CASE WHEN {a} > 37.0 THEN 0.0 WHEN {a} < 7.07106781186547 "
            f"THEN {body} ELSE {far} END)")


def phi_sql(x: str) -> str:
    """Standard normal CDF of ``x``."""
    tail = lower_tail_sql(x)
    return f"(CASE WHEN {x} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def log_phi_sql(x: str) -> str:
    """ln Phi(x) for any x: ln(1 - tail) above 0, and below -7.07 the logarithm of the
    continued fraction, which neither cancels nor underflows."""
    a = f"abs({x})"
    far = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({a} + {k}.0 / {far})"
    log_far = f"(-0.5 * {a} * {a} - ln({far}) - 0.9189385332046728)"
    body = f"(exp(-0.5 * {a} * {a}) * {_horner(HART_NUM, a)} / {_horner(HART_DEN, a)})"
    return (f"(CASE WHEN {x} > 0 THEN ln(1.0 - {lower_tail_sql(x)}) "
            f"WHEN {a} < 7.07106781186547 THEN ln({body}) ELSE {log_far} END)")


def _tail_values(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Phi(-a), ln Phi(-a)) of a >= 0, as ``lower_tail_sql`` and ``log_phi_sql`` have them."""
    num, den = (np.polyval(c, a) for c in (HART_NUM, HART_DEN))
    tail = np.exp(-0.5 * a * a) * num / den
    log_tail = np.log(tail)
    beyond = np.flatnonzero(~(a < 7.07106781186547))
    if len(beyond):
        b = a[beyond]
        far = b + 0.65
        for k in (4, 3, 2, 1):
            far = b + k / far
        tail[beyond] = np.where(b > 37.0, 0.0, np.exp(-0.5 * b * b) / far / 2.506628274631)
        log_tail[beyond] = -0.5 * b * b - np.log(far) - 0.9189385332046728
    return tail, log_tail


def phi(x: np.ndarray) -> np.ndarray:
    """``phi_sql`` on arrays."""
    with np.errstate(all="ignore"):
        tail, _ = _tail_values(np.abs(x))
    return np.where(x > 0, 1.0 - tail, tail)


def log_phis(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``log_phi_sql`` of x and of -x, on arrays."""
    with np.errstate(all="ignore"):
        tail, low = _tail_values(np.abs(x))
        high = np.log(1.0 - tail)
    return np.where(x > 0, high, low), np.where(x < 0, high, low)


def probit_initial_sql(p: str) -> str:
    """Acklam's approximation of Phi^-1(p) for p in (0,1)."""
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    central = f"({_horner(ACKLAM_A, r)} * {q} / {_horner(ACKLAM_B, r, one_last=True)})"
    ql = f"sqrt(-2.0 * ln({p}))"
    lower = f"({_horner(ACKLAM_C, ql)} / {_horner(ACKLAM_D, ql, one_last=True)})"
    qu = f"sqrt(-2.0 * ln(1.0 - {p}))"
    upper = f"(-{_horner(ACKLAM_C, qu)} / {_horner(ACKLAM_D, qu, one_last=True)})"
    return (f"(CASE WHEN {p} < {ACKLAM_LOW} THEN {lower} "
            f"WHEN {p} <= {1 - ACKLAM_LOW!r} THEN {central} ELSE {upper} END)")


def probit_refine_sql(x0: str, p: str) -> str:
    """One Halley step: x0 - u / (1 + x0 u / 2), u = (Phi(x0)-p) sqrt(2pi) e^{x0^2/2}."""
    e = f"({phi_sql(x0)} - {p})"
    u = f"({e} * 2.5066282746310002 * exp(0.5 * {x0} * {x0}))"
    return f"({x0} - {u} / (1.0 + {x0} * {u} / 2.0))"


def with_probit(df: DataFrame, p: str, out: str) -> DataFrame:
    """Add ``out = Phi^-1(p)``; p must lie strictly inside (0, 1)."""
    tmp = f"__x0_{out}"
    return (df.withColumn(tmp, F.expr(probit_initial_sql(p)))
              .withColumn(out, F.expr(probit_refine_sql(tmp, p)))
              .drop(tmp))
