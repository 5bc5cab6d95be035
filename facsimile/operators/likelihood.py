"""Maximum likelihood for the families that have no closed-form estimator.

exponpow (p1 = b) and exponweib (p1 = a, p2 = c) are fitted by damped Newton steps.
With l = ln(x - loc0) and w = shape * l - offset both likelihoods are sums of functions of
w, so that a step needs a handful of sums over the distinct-value scan.  All columns and
both families share one small aggregate for each step; the mapper combines it, and one row for
each column and task is shuffled.  l is standardised, so that steps are of one size for all columns.

truncnorm (p1, p2 = the standardised bounds) is truncated at the extremes, their
likelihood estimate.  Inside them it is an exponential family of x and x^2, for which the
column's mean and variance suffice: no further pass.

A column has no fit (nulls) where the likelihood has no inner maximum: the search does not end
within ``MOST_STEPS``, or the truncated normal's second parameter is not negative (a column
flatter than a uniform or steeper than an exponential).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import normal_between
from ..session import discard, materialize
from .joins import bounded_broadcast

LIKELIHOOD_FAMILIES = ["exponpow", "exponweib", "truncnorm"]
#: Scans of a search; it takes 10 to 20 where there is a maximum.
MOST_STEPS = 40
#: A search ends once the gain that a step promises is below this for each row.
LEAST_GAIN = 1e-13
#: Rounding of sums: a step may lose this much of the likelihood for each row.
ROUNDING = 1e-12

State = tuple[float, np.ndarray, np.ndarray]  # value, gradient and second derivatives, each for one row

# --- sums of a step ---------------------------------------------------------------
# Columns: l, c (count), and for each family its shape and offset.
_G1, _G2 = "(1.0 + pt - pt * exp(pt))", "(pt - pt * exp(pt) * (1.0 + pt))"
# r = t / (e^t - 1) is the derivative of u = ln(1 - e^-t) by w; both have limits at t = 0
_R = "(CASE WHEN wt < 1e-12 THEN 1.0 - wt / 2.0 ELSE wt / expm1(wt) END)"
_U = "(CASE WHEN wt < 1e-12 THEN ww ELSE ln(-expm1(-wt)) END)"
_Q = f"({_R} * (1.0 - wt - {_R}))"
SUMS: dict[str, list[str]] = {
    "exponpow": ["(pw + pt - exp(pt))", _G1, f"{_G1} * l", _G2, f"{_G2} * l", f"{_G2} * l * l"],
    "exponweib": [_U, _R, f"{_R} * l", "wt", "wt * l", "wt * l * l", _Q, f"{_Q} * l", f"{_Q} * l * l", "ww"],
}


def _exponpow(theta: np.ndarray, sums: Sequence[float], mean_l: float) -> State:
    """theta = (shape, offset); ln f = ln shape + w + e^w - exp(e^w), which is concave."""
    b = theta[0]
    g, g1, g1l, g2, g2l, g2ll = sums
    return (math.log(b) + g, np.array([1 / b + g1l, -g1]),
            np.array([[-1 / b ** 2 + g2ll, -g2l], [-g2l, g2]]))


def _exponweib(theta: np.ndarray, sums: Sequence[float], mean_l: float) -> State:
    """theta = (ln a, ln shape, offset); ln f = ln a + ln shape + (a - 1) u - t + w."""
    a, c = math.exp(theta[0]), math.exp(theta[1])
    u, r, rl, t, tl, tll, q, ql, qll, w = sums
    h1, h1l = (a - 1) * r - t + 1, (a - 1) * rl - tl + mean_l
    h2, h2l, h2ll = (a - 1) * q - t, (a - 1) * ql - tl, (a - 1) * qll - tll
    grad = np.array([1 + a * u, 1 + c * h1l, -h1])
    second = np.array([[a * u, a * c * rl, -a * r],
                       [a * c * rl, c * h1l + c * c * h2ll, -c * h2l],
                       [-a * r, -c * h2l, h2]])
    return theta[0] + theta[1] + (a - 1) * u - t + w, grad, second


STATES: dict[str, Callable] = {"exponpow": _exponpow, "exponweib": _exponweib}


@dataclass
class _Search:
    """Damped Newton steps of one column and family; ``trial`` is what the next scan evaluates."""
    column: str
    family: str
    trial: np.ndarray
    theta: np.ndarray | None = None
    state: State | None = None
    damping: float = 1e-3
    found: bool = False
    given_up: bool = False

    def line(self) -> tuple[float, float]:
        """(shape, offset) of w."""
        shape, offset = (math.exp(self.trial[1]), self.trial[2]) if self.family == "exponweib" else self.trial
        return float(shape), float(offset)

    def take(self, sums: Sequence[float | None], mean_l: float) -> None:
        known = all(v is not None and math.isfinite(v) for v in sums)
        state = STATES[self.family](self.trial, sums, mean_l) if known else None
        if state is not None and (self.state is None or state[0] >= self.state[0] - ROUNDING):
            self.theta, self.state, self.damping = self.trial, state, self.damping / 10
        elif self.state is None:
            self.given_up = True
            return
        else:
            self.damping = max(self.damping, 1e-6) * 10
        self._step()

    def _step(self) -> None:
        _, grad, second = self.state
        while self.damping < 1e12:
            m = -second + self.damping * np.diag(np.abs(np.diag(second)) + 1e-12)
            step = np.linalg.solve(m, grad) if np.linalg.eigvalsh(m)[0] > 0 else None
            if step is not None and np.abs(step).max() < 10:
                trial = self.theta + step
                if self.family == "exponweib" or trial[0] > 0:
                    self.found = 0.5 * float(grad @ step) < LEAST_GAIN and self.damping <= 1e-2
                    self.trial = trial
                    return
            self.damping = max(self.damping, 1e-6) * 10
        self.given_up = True


def likelihood_params(stats: DataFrame, cum: DataFrame, families: Sequence[str]) -> DataFrame:
    """(column_name, family, p1, p2, loc, scale, n) for families of ``LIKELIHOOD_FAMILIES``.

    ``stats`` and ``cum`` are those of ``marginals.column_stats``: one row for each column is
    read to the driver."""
    cols = {r["column_name"]: r for r in stats.select("column_name", "n", "mean", "var", "xmin", "xmax", "loc0", "mln", "vln").collect()}
    fit = {k: r for k, r in cols.items() if r["n"] >= 3 and r["xmax"] > r["xmin"] and r["var"] > 0 and r["vln"] > 0}
    out = {(k, f): (None, None, None, None) for k in cols for f in families}
    if "truncnorm" in families:
        for k, r in fit.items():
            out[k, "truncnorm"] = truncated_normal(r["mean"], r["var"], r["xmin"], r["xmax"])
    for s in _searches(cum, fit, [f for f in families if f in STATES]):
        if s.found:
            r = fit[s.column]
            line, offset = s.line()
            shape = line / math.sqrt(r["vln"])
            log_scale = r["mln"] + offset / shape
            if abs(log_scale) < 700:
                p = (shape, None) if s.family == "exponpow" else (math.exp(s.theta[0]), shape)
                out[s.column, s.family] = (*p, r["loc0"], math.exp(log_scale))
    rows = [(k, f, *(None if v is None else float(v) for v in p), cols[k]["n"]) for (k, f), p in out.items()]
    return stats.sparkSession.createDataFrame(rows, "column_name string, family string, p1 double, p2 double, loc double, scale double, n long")


def _searches(cum: DataFrame, fit: dict, families: Sequence[str]) -> list[_Search]:
    if not fit or not families:
        return []
    spark = cum.sparkSession
    place = spark.createDataFrame([(k, r["loc0"], r["mln"], math.sqrt(r["vln"])) for k, r in fit.items()],
                                  "column_name string, loc0 double, mln double, sln double")
    logs = cum.join(bounded_broadcast(place, len(fit)), "column_name").select(
        "column_name", ((F.log(F.col("x") - F.col("loc0")) - F.col("mln")) / F.col("sln")).alias("l"), F.col("c").cast("double").alias("c"))
    logs = materialize(logs, "marginal-logs")
    open_ = []
    for k, r in fit.items():
        top = (math.log(r["xmax"] - r["loc0"]) - r["mln"]) / math.sqrt(r["vln"])
        weibull = math.pi / math.sqrt(6.0)  # shape of a Weibull variable whose logarithm has variance 1
        start = {"exponpow": np.array([min(weibull, 1.5 / top), 0.0]), "exponweib": np.array([0.0, math.log(weibull), 0.5772156649015329])}
        open_ += [_Search(k, f, start[f]) for f in families]
    searches = list(open_)
    for _ in range(MOST_STEPS):
        if not open_:
            break
        sums = _sums(logs, open_)
        for s in open_:
            mean_l, own = sums[s.column, s.family]
            s.take(own, mean_l)
        open_ = [s for s in open_ if not s.found and not s.given_up]
    discard(logs)
    return searches


def _sums(logs: DataFrame, searches: Sequence[_Search]) -> dict[tuple[str, str], tuple[float, list[float | None]]]:
    """Means over the rows of each column, one scan for all searches."""
    lines: dict[str, dict[str, tuple[float, float]]] = {}
    for s in searches:
        lines.setdefault(s.column, {})[s.family] = s.line()
    # an Arrow table of this size is part of the plan, so that it takes no tasks
    place = [("ps", "exponpow", 0), ("po", "exponpow", 1), ("ws", "exponweib", 0), ("wo", "exponweib", 1)]
    trial = logs.sparkSession.createDataFrame(pa.table(
        {"column_name": pa.array(list(lines), pa.string())}
        | {n: pa.array([v[f][i] if f in v else None for v in lines.values()], pa.float64()) for n, f, i in place}))
    d = logs.join(bounded_broadcast(trial, len(lines)), "column_name")
    d = d.withColumns({"pw": F.expr("ps * l - po"), "ww": F.expr("ws * l - wo")}).withColumns({"pt": F.exp("pw"), "wt": F.exp("ww")})
    used = [f for f in SUMS if any(s.family == f for s in searches)]
    aggs = [(F.expr(f"sum(c * {e})") / F.sum("c")).alias(f"{f}_{i}") for f in used for i, e in enumerate(SUMS[f])]
    got = d.groupBy("column_name").agg((F.sum(F.col("c") * F.col("l")) / F.sum("c")).alias("mean_l"), *aggs).collect()
    return {(r["column_name"], f): (r["mean_l"], [r[f"{f}_{i}"] for i in range(len(SUMS[f]))]) for r in got for f in used}


# --- truncated normal ----------------------------------------------------------------

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def _tilted_moments(t1: float, t2: float) -> tuple[float, np.ndarray]:
    """(ln of the integral, moments 1 to 4) of exp(t1 z + t2 z^2) over [0, 1].

    The integral runs over the part that lies within 60 of the exponent's maximum."""
    z = -t1 / (2 * t2) if t2 < 0 else float(t1 + t2 > 0)
    z = min(max(z, 0.0), 1.0)
    top = t1 * z + t2 * z * z
    lo, hi = 0.0, 1.0
    if t2 < 0:  # t2 z^2 + t1 z = top - 60
        root = math.sqrt(t1 * t1 + 4 * t2 * (top - 60.0))
        lo, hi = max(0.0, (-t1 + root) / (2 * t2)), min(1.0, (-t1 - root) / (2 * t2))
    elif t2 == 0 and abs(t1) > 60:
        lo, hi = (1.0 - 60.0 / t1, 1.0) if t1 > 0 else (0.0, -60.0 / t1)
    edges = np.linspace(lo, hi, 65)
    half = (edges[1:] - edges[:-1]) / 2
    at = ((edges[1:] + edges[:-1]) / 2)[:, None] + half[:, None] * _NODES
    w = half[:, None] * _WEIGHTS * np.exp(t1 * at + t2 * at * at - top)
    mass = w.sum()
    return top + math.log(mass), np.array([(w * at ** k).sum() / mass for k in range(1, 5)])


def _exponential_square(m1: float) -> float:
    """Second moment of the exponential (rising or falling) on [0, 1] with mean m1.

    The likelihood is concave in both parameters, so the second one is negative at its
    maximum if and only if the data's second moment is below this."""
    lo, hi = -2.0 / m1 - 10.0, 2.0 / (1.0 - m1) + 10.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _tilted_moments(mid, 0.0)[1][0] < m1 else (lo, mid)
    return float(_tilted_moments((lo + hi) / 2, 0.0)[1][1])


def truncated_normal(mean: float, var: float, lo: float, hi: float) -> tuple[float | None, ...]:
    """(p1, p2, loc, scale): the normal, cut at lo and hi, that has this mean and variance."""
    width = hi - lo
    m1 = (mean - lo) / width
    goal = np.array([m1, var / width ** 2 + m1 * m1])
    v = var / width ** 2
    if goal[1] >= _exponential_square(m1):
        return None, None, None, None
    theta = np.array([m1 / v, -0.5 / v])
    log_z, m = _tilted_moments(*theta)
    value = float(theta @ goal) - log_z
    for _ in range(200):
        grad = goal - m[:2]
        spread = np.array([[m[1] - m[0] ** 2, m[2] - m[0] * m[1]], [m[2] - m[0] * m[1], m[3] - m[1] ** 2]])
        try:
            step = np.linalg.solve(spread, grad)
        except np.linalg.LinAlgError:
            return None, None, None, None
        size = 1.0
        while size > 1e-12:
            new = theta + size * step
            if new[1] < 0:
                new_z, new_m = _tilted_moments(*new)
                # near the maximum the value no longer tells steps apart, the moments do
                if float(new @ goal) - new_z > value or size == 1.0 and np.abs(goal - new_m[:2]).max() < np.abs(grad).max() < 1e-6:
                    break
            size /= 2
        else:
            break
        theta, m, value = new, new_m, float(new @ goal) - new_z
    if np.abs(goal - m[:2]).max() > 1e-7:
        return None, None, None, None
    sigma = math.sqrt(-0.5 / theta[1])
    a, b = (0.0 - theta[0] * sigma ** 2) / sigma, (1.0 - theta[0] * sigma ** 2) / sigma
    if not float(normal_between(a, b)) > 0:  # the bounds lie beyond all that doubles can tell apart
        return None, None, None, None
    return a, b, lo + theta[0] * sigma ** 2 * width, sigma * width
