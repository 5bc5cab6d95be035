"""Fit distribution families to numeric columns and rank the fits.

Passes over the data (all columns at once, numbers written once):
  A. one Arrow pass: n, mean, population variance, skewness, kurtosis, min, max;
  R. a skew-safe running count over the distinct values of each column
     (``scan.running_sums``): gives exact quantiles, L-moments and the
     empirical CDF needed by the one-sample KS test;
  B. one Arrow pass for the log-moments around support bounds derived from A/R.
The parameters of most families are then closed-form SQL expressions of one stats
row per column (so DuckDB evaluates the very same formulas).  Estimators
(documented per family below) are:

  norm, logistic, cosine, t         moments (t: df from excess kurtosis)
  expon, uniform, arcsine, loguniform, powerlaw   support bounds (+ log mean)
  rayleigh, lognorm, gamma (Ye-Chen 2017), chi2, weibull_min/max, pareto
                                    log-moments about loc0 = min - range/n
  beta                              moments of x scaled to the support
  cauchy                            median and half the inter-quartile range
  dweibull                          log-moments of |x - median|
  exponnorm                         moments + skewness
  genextreme                        L-moments (Hosking 1985)
  exponpow, exponweib, truncnorm    maximum likelihood by Newton steps (``likelihood``)

KS statistics and likelihoods of all families come from one Arrow pass over the
distinct-value scan.  The CDFs of gamma, chi2, beta and t are interpolated there on a
grid computed from the fitted parameters (numpy on a few thousand points per column);
the others are closed forms.  Not built: gaussian_kde (see the empirical marginal of
the group copula).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import log_phi_sql, phi_sql
from ..functions.families import log_density, tails
from ..functions.special import lgamma_sql
from ..session import materialize
from .evaluate import cells, kolmogorov_sf_sql
from .joins import bounded_broadcast
from .likelihood import LIKELIHOOD_FAMILIES, likelihood_params
from .profile import is_missing
from .scan import running_sums

# The family lists of the reference's two searches (the second
# list repeats some names; duplicates are fitted once).
FAMILIES_SHORT = ["cauchy", "chi2", "expon", "exponpow", "gamma", "lognorm", "norm",
                  "powerlaw", "rayleigh", "uniform", "beta", "truncnorm"]
FAMILIES_WIDE = ["arcsine", "cosine", "expon", "weibull_max", "weibull_min", "dweibull", "t",
                 "pareto", "exponnorm", "lognorm", "beta", "norm", "exponweib", "weibull_max",
                 "weibull_min", "pareto", "genextreme", "cauchy", "truncnorm", "logistic",
                 "loglaplace", "lognorm", "loguniform", "uniform", "gamma", "gaussian_kde"]
NOT_BUILT = {"gaussian_kde"}
GRID_FAMILIES = {"gamma", "chi2", "beta", "t"}
EULER = 0.5772156649015329
GRID_POINTS = 4097
LOG_ZERO = -743.7  # ln of the least positive double, about 1e-323

# --- parameters ---------------------------------------------------------------
# SQL over one stats row per column.  Columns available: n, mean, var, sd,
# g1, g2, xmin, xmax, loc0, hiloc, q1, med, q3, l2, l3, mln, vln, mylny,
# mln_hi, vln_hi, mln_par, mln_abs, vln_abs.
_SCALE_BETA = "(hiloc - loc0)"
PARAMS: dict[str, tuple[str, str, str, str]] = {
    # family: (shape1, shape2, loc, scale)
    "norm": ("NULL", "NULL", "mean", "sd"),
    "expon": ("NULL", "NULL", "xmin", "(mean - xmin)"),
    "uniform": ("NULL", "NULL", "xmin", "(xmax - xmin)"),
    "rayleigh": ("NULL", "NULL", "loc0", "sqrt(((mean - loc0) * (mean - loc0) + var) / 2.0)"),
    "lognorm": ("sqrt(vln)", "NULL", "loc0", "exp(mln)"),
    "gamma": ("((mean - loc0) / (mylny - mln * (mean - loc0)))", "NULL", "loc0",
              "(mylny - mln * (mean - loc0))"),
    "chi2": ("(2.0 * (mean - loc0) * (mean - loc0) / var)", "NULL", "loc0", "(var / (2.0 * (mean - loc0)))"),
    "beta": (f"(((mean - loc0) / {_SCALE_BETA}) * ((((mean - loc0) / {_SCALE_BETA}) * (1.0 - (mean - loc0) / {_SCALE_BETA})) / (var / ({_SCALE_BETA} * {_SCALE_BETA})) - 1.0))",
             f"((1.0 - (mean - loc0) / {_SCALE_BETA}) * ((((mean - loc0) / {_SCALE_BETA}) * (1.0 - (mean - loc0) / {_SCALE_BETA})) / (var / ({_SCALE_BETA} * {_SCALE_BETA})) - 1.0))",
             "loc0", _SCALE_BETA),
    "powerlaw": ("(-1.0 / (mln - ln(xmax - loc0)))", "NULL", "loc0", "(xmax - loc0)"),
    "cauchy": ("NULL", "NULL", "med", "((q3 - q1) / 2.0)"),
    "logistic": ("NULL", "NULL", "mean", "(sd * sqrt(3.0) / pi())"),
    "pareto": ("(1.0 / (mln_par - ln(xmin - (loc0 - (xmax - xmin)))))", "NULL", "(loc0 - (xmax - xmin))",
               "(xmin - (loc0 - (xmax - xmin)))"),
    "weibull_min": ("(pi() / (sqrt(vln) * sqrt(6.0)))", "NULL", "loc0",
                    f"exp(mln + {EULER!r} * sqrt(vln) * sqrt(6.0) / pi())"),
    "weibull_max": ("(pi() / (sqrt(vln_hi) * sqrt(6.0)))", "NULL", "hiloc",
                    f"exp(mln_hi + {EULER!r} * sqrt(vln_hi) * sqrt(6.0) / pi())"),
    "dweibull": ("(pi() / (sqrt(vln_abs) * sqrt(6.0)))", "NULL", "med",
                 f"exp(mln_abs + {EULER!r} * sqrt(vln_abs) * sqrt(6.0) / pi())"),
    "t": ("(CASE WHEN g2 > 0 THEN 4.0 + 6.0 / g2 ELSE 1000000.0 END)", "NULL", "mean",
          "(sd * sqrt(((CASE WHEN g2 > 0 THEN 4.0 + 6.0 / g2 ELSE 1000000.0 END) - 2.0) / "
          "(CASE WHEN g2 > 0 THEN 4.0 + 6.0 / g2 ELSE 1000000.0 END)))"),
    "cosine": ("NULL", "NULL", "mean", "(sd / sqrt(pi() * pi() / 3.0 - 2.0))"),
    "arcsine": ("NULL", "NULL", "loc0", "(hiloc - loc0)"),
    "loguniform": ("(xmin - loc0)", "(xmax - loc0)", "loc0", "1.0"),
    "loglaplace": ("(1.0 / mabs_lnr)", "NULL", "loc0", "exp(med_ln)"),
    # its skewness lies between 0 and 2; other columns have no estimate
    "exponnorm": ("(CASE WHEN g1 > 0 AND g1 < 2 THEN sqrt(power(g1 / 2.0, 2.0 / 3.0) / (1.0 - power(g1 / 2.0, 2.0 / 3.0))) END)",
                  "NULL", "NULL", "NULL"),
    "genextreme": ("NULL", "NULL", "NULL", "NULL"),
}


def _exponnorm_rest() -> tuple[str, str]:
    k = PARAMS["exponnorm"][0]
    sigma = f"(sd / sqrt(1.0 + {k} * {k}))"
    return f"(mean - {k} * {sigma})", sigma


def _genextreme() -> tuple[str, str, str]:
    z = "(2.0 / (3.0 + l3 / l2) - ln(2.0) / ln(3.0))"
    c = f"(7.859 * {z} + 2.9554 * {z} * {z})"
    g = f"exp({lgamma_sql(f'(1.0 + {c})')})"
    scale = f"(l2 * {c} / ((1.0 - power(2.0, -{c})) * {g}))"
    loc = f"(mean - {scale} * (1.0 - {g}) / {c})"
    return c, loc, scale


def family_params_sql(family: str) -> tuple[str, str, str, str]:
    if family == "exponnorm":
        loc, scale = _exponnorm_rest()
        return PARAMS["exponnorm"][0], "NULL", loc, scale
    if family == "genextreme":
        c, loc, scale = _genextreme()
        return c, "NULL", loc, scale
    return PARAMS[family]


def fitted_families(families: Sequence[str]) -> list[str]:
    return [f for f in dict.fromkeys(families) if f not in NOT_BUILT]


def closed_families(families: Sequence[str]) -> list[str]:
    """The families whose parameters are SQL expressions of the stats."""
    return [f for f in fitted_families(families) if f not in LIKELIHOOD_FAMILIES]


# --- CDF and pdf ----------------------------------------------------------------

def _y(x: str) -> str:
    return f"(({x} - loc) / scale)"


def _pos_ln(v: str) -> str:
    return f"ln(CASE WHEN {v} > 0 THEN {v} ELSE 1.0 END)"


def cdf_sql(family: str, x: str = "x") -> str | None:
    """Closed-form CDF with columns p1, p2, loc, scale; None for grid families.

    Null where the family has no fit: ``greatest`` and ``least`` skip nulls, so a body of
    its own would give 1."""
    body = _cdf_body(family, x)
    return None if body is None else f"(CASE WHEN scale IS NULL THEN NULL ELSE {body} END)"


def _cdf_body(family: str, x: str) -> str | None:
    y = _y(x)
    if family == "norm":
        return phi_sql(y)
    if family == "expon":
        return f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE 1.0 - exp(-{y}) END)"
    if family == "uniform":
        return f"greatest(0.0, least(1.0, {y}))"
    if family == "rayleigh":
        return f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE 1.0 - exp(-{y} * {y} / 2.0) END)"
    if family == "lognorm":
        return f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE {phi_sql(f'({_pos_ln(y)} / p1)')} END)"
    if family == "cauchy":
        return f"(0.5 + atan({y}) / pi())"
    if family == "logistic":
        return f"(1.0 / (1.0 + exp(-{y})))"
    if family == "powerlaw":
        return f"(CASE WHEN {y} <= 0 THEN 0.0 WHEN {y} >= 1 THEN 1.0 ELSE exp(p1 * {_pos_ln(y)}) END)"
    if family == "pareto":
        return f"(CASE WHEN {y} <= 1 THEN 0.0 ELSE 1.0 - exp(-p1 * {_pos_ln(y)}) END)"
    if family == "weibull_min":
        return f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE 1.0 - exp(-exp(p1 * {_pos_ln(y)})) END)"
    if family == "weibull_max":
        return f"(CASE WHEN {y} >= 0 THEN 1.0 ELSE exp(-exp(p1 * {_pos_ln(f'(-{y})')})) END)"
    if family == "dweibull":
        return (f"(CASE WHEN {y} = 0 THEN 0.5 WHEN {y} > 0 THEN 1.0 - 0.5 * exp(-exp(p1 * {_pos_ln(y)})) "
                f"ELSE 0.5 * exp(-exp(p1 * {_pos_ln(f'(-{y})')})) END)")
    if family == "cosine":
        return (f"(CASE WHEN {y} <= -pi() THEN 0.0 WHEN {y} >= pi() THEN 1.0 "
                f"ELSE (pi() + {y} + sin({y})) / (2.0 * pi()) END)")
    if family == "arcsine":
        return (f"(CASE WHEN {y} <= 0 THEN 0.0 WHEN {y} >= 1 THEN 1.0 "
                f"ELSE 2.0 / pi() * asin(sqrt({y})) END)")
    if family == "loguniform":
        return (f"(CASE WHEN {y} <= p1 THEN 0.0 WHEN {y} >= p2 THEN 1.0 "
                f"ELSE (ln({y}) - ln(p1)) / (ln(p2) - ln(p1)) END)")
    if family == "loglaplace":
        return (f"(CASE WHEN {y} <= 0 THEN 0.0 WHEN {y} < 1 THEN 0.5 * exp(p1 * {_pos_ln(y)}) "
                f"ELSE 1.0 - 0.5 * exp(-p1 * {_pos_ln(y)}) END)")
    if family == "exponnorm":
        tail = f"exp(1.0 / (2.0 * p1 * p1) - {y} / p1 + {log_phi_sql(f'({y} - 1.0 / p1)')})"
        return f"greatest(0.0, least(1.0, {phi_sql(y)} - {tail}))"
    if family == "genextreme":
        t = f"(1.0 - p1 * {y})"
        return (f"(CASE WHEN abs(p1) < 1e-12 THEN exp(-exp(-{y})) WHEN {t} <= 0 THEN "
                f"(CASE WHEN p1 > 0 THEN 1.0 ELSE 0.0 END) ELSE exp(-exp({_pos_ln(t)} / p1)) END)")
    if family == "exponpow":
        return f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE 1.0 - exp(1.0 - exp(exp(p1 * {_pos_ln(y)}))) END)"
    if family == "exponweib":
        return f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE power(1.0 - exp(-exp(p2 * {_pos_ln(y)})), p1) END)"
    if family == "truncnorm":
        return (f"(CASE WHEN {y} <= p1 THEN 0.0 WHEN {y} >= p2 THEN 1.0 "
                f"ELSE {_between('p1', y)} / {_between('p1', 'p2')} END)")
    return None


def _between(a: str, b: str) -> str:
    """Phi(b) - Phi(a) by the tails on the nearer side."""
    return f"(CASE WHEN {a} > 0 THEN {phi_sql(f'(-{a})')} - {phi_sql(f'(-({b}))')} ELSE {phi_sql(b)} - {phi_sql(a)} END)"


def pdf_sql(family: str, x: str = "x") -> str:
    """Density at ``x`` (columns p1, p2, loc, scale)."""
    y = _y(x)
    lny = _pos_ln(y)
    if family == "norm":
        body = f"exp(-0.5 * {y} * {y}) / sqrt(2.0 * pi())"
    elif family == "expon":
        body = f"(CASE WHEN {y} < 0 THEN 0.0 ELSE exp(-{y}) END)"
    elif family == "uniform":
        body = f"(CASE WHEN {y} >= 0 AND {y} <= 1 THEN 1.0 ELSE 0.0 END)"
    elif family == "rayleigh":
        body = f"(CASE WHEN {y} < 0 THEN 0.0 ELSE {y} * exp(-{y} * {y} / 2.0) END)"
    elif family == "lognorm":
        body = (f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE exp(-0.5 * ({lny} / p1) * ({lny} / p1)) "
                f"/ (p1 * {y} * sqrt(2.0 * pi())) END)")
    elif family == "cauchy":
        body = f"(1.0 / (pi() * (1.0 + {y} * {y})))"
    elif family == "logistic":
        body = f"(exp(-{y}) / ((1.0 + exp(-{y})) * (1.0 + exp(-{y}))))"
    elif family == "powerlaw":
        body = f"(CASE WHEN {y} <= 0 OR {y} > 1 THEN 0.0 ELSE p1 * exp((p1 - 1.0) * {lny}) END)"
    elif family == "pareto":
        body = f"(CASE WHEN {y} < 1 THEN 0.0 ELSE p1 * exp(-(p1 + 1.0) * {lny}) END)"
    elif family == "weibull_min":
        body = f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE p1 * exp((p1 - 1.0) * {lny} - exp(p1 * {lny})) END)"
    elif family == "weibull_max":
        lm = _pos_ln(f"(-{y})")
        body = f"(CASE WHEN {y} >= 0 THEN 0.0 ELSE p1 * exp((p1 - 1.0) * {lm} - exp(p1 * {lm})) END)"
    elif family == "dweibull":
        la = _pos_ln(f"abs({y})")
        body = f"(CASE WHEN {y} = 0 THEN 0.0 ELSE p1 / 2.0 * exp((p1 - 1.0) * {la} - exp(p1 * {la})) END)"
    elif family == "cosine":
        body = f"(CASE WHEN abs({y}) > pi() THEN 0.0 ELSE (1.0 + cos({y})) / (2.0 * pi()) END)"
    elif family == "arcsine":
        body = f"(CASE WHEN {y} <= 0 OR {y} >= 1 THEN 0.0 ELSE 1.0 / (pi() * sqrt({y} * (1.0 - {y}))) END)"
    elif family == "loguniform":
        body = f"(CASE WHEN {y} < p1 OR {y} > p2 THEN 0.0 ELSE 1.0 / ({y} * (ln(p2) - ln(p1))) END)"
    elif family == "loglaplace":
        body = (f"(CASE WHEN {y} <= 0 THEN 0.0 WHEN {y} < 1 THEN p1 / 2.0 * exp((p1 - 1.0) * {lny}) "
                f"ELSE p1 / 2.0 * exp((-p1 - 1.0) * {lny}) END)")
    elif family == "exponnorm":
        body = (f"exp(1.0 / (2.0 * p1 * p1) - {y} / p1 + {log_phi_sql(f'({y} - 1.0 / p1)')}) / p1")
    elif family == "genextreme":
        t = f"(1.0 - p1 * {y})"
        body = (f"(CASE WHEN {t} <= 0 THEN 0.0 ELSE exp((1.0 / p1 - 1.0) * {_pos_ln(t)} "
                f"- exp({_pos_ln(t)} / p1)) END)")
    elif family == "gamma":
        body = (f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE exp((p1 - 1.0) * {lny} - {y} - {lgamma_sql('p1')}) END)")
    elif family == "chi2":
        k = "(p1 / 2.0)"
        body = (f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE exp(({k} - 1.0) * {lny} - {y} / 2.0 - {k} * ln(2.0) "
                f"- {lgamma_sql(k)}) END)")
    elif family == "beta":
        l1 = _pos_ln(f"(1.0 - {y})")
        body = (f"(CASE WHEN {y} <= 0 OR {y} >= 1 THEN 0.0 ELSE exp((p1 - 1.0) * {lny} + (p2 - 1.0) * {l1} "
                f"+ {lgamma_sql('(p1 + p2)')} - {lgamma_sql('p1')} - {lgamma_sql('p2')}) END)")
    elif family == "t":
        body = (f"exp({lgamma_sql('((p1 + 1.0) / 2.0)')} - {lgamma_sql('(p1 / 2.0)')} - 0.5 * ln(p1 * pi()) "
                f"- (p1 + 1.0) / 2.0 * ln(1.0 + {y} * {y} / p1))")
    elif family == "exponpow":
        t = f"exp(p1 * {lny})"
        body = f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE p1 * exp((p1 - 1.0) * {lny} + 1.0 + {t} - exp({t})) END)"
    elif family == "exponweib":
        t = f"exp(p2 * {lny})"
        body = (f"(CASE WHEN {y} <= 0 THEN 0.0 ELSE p1 * p2 * exp((p1 - 1.0) * {_pos_ln(f'(1.0 - exp(-{t}))')} "
                f"- {t} + (p2 - 1.0) * {lny}) END)")
    elif family == "truncnorm":
        body = (f"(CASE WHEN {y} < p1 OR {y} > p2 THEN 0.0 ELSE exp(-0.5 * {y} * {y}) / sqrt(2.0 * pi()) "
                f"/ {_between('p1', 'p2')} END)")
    else:
        raise ValueError(family)
    return f"({body} / scale)"


# --- passes -----------------------------------------------------------------------

PROBS = {"q1": 0.25, "med": 0.5, "q3": 0.75}


def column_stats(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(stats, cum): one stats row per column and the written distinct-value scan."""
    wide = materialize(df.select(*[F.when(~is_missing(df, c), F.col(c).cast("double")).alias(c) for c in cols]), "marginal-cells")
    a = _moments(wide, cols).withColumns(_support())
    counts = cells(wide, cols).groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("c"))
    cum = running_sums(counts, ["column_name"], ["x"], {"cum": "c"}, tag="marginal-cum", next_of="x")
    a = materialize(a, "marginal-a")
    nb = bounded_broadcast(a.select("column_name", "n"), len(cols))
    rk = cum.join(nb, "column_name")
    # exact quantiles: value at 0-based position h = (n-1) p, linear interpolation
    qs = []
    for name, p in PROBS.items():
        lo = F.floor((F.col("n") - 1) * p)
        frac = (F.col("n") - 1) * p - lo
        hit = (F.col("cum") - F.col("c") <= lo) & (lo < F.col("cum"))
        nxt = F.when(lo + 1 < F.col("cum"), F.col("x")).otherwise(F.coalesce(F.col("__next_x"), F.col("x")))
        qs.append(F.max(F.when(hit, F.col("x") + frac * (nxt - F.col("x")))).alias(name))
    # L-moment sums over ranks: a tie block holds the 0-based ranks k .. cum-1.  The closed
    # sums of j and of j (j - 1) over it are taken in doubles and divided by n, n-1, n-2 as
    # they arise, so no product of counts can overflow and nothing cancels.
    m, k, cd, nd = F.col("cum").cast("double"), (F.col("cum") - F.col("c")).cast("double"), F.col("c").cast("double"), F.col("n").cast("double")
    w1 = F.when(nd > 1, cd / nd * ((m + k - 1) / 2.0) / (nd - 1))
    w2 = F.when(nd > 2, cd / nd * ((m * m + m * k + k * k - 3 * (m + k) + 2) / 3.0) / ((nd - 1) * (nd - 2)))
    lm = [F.sum(F.col("x") * w1).alias("__b1"), F.sum(F.col("x") * w2).alias("__b2")]
    r = rk.groupBy("column_name").agg(*qs, *lm)
    stats = a.join(bounded_broadcast(r, len(cols)), "column_name")
    stats = stats.withColumns({
        "l2": 2 * F.col("__b1") - F.col("mean"),
        "l3": 6 * F.col("__b2") - 6 * F.col("__b1") + F.col("mean"),
    }).drop("__b1", "__b2")
    stats = materialize(stats, "marginal-ar")
    # pass B: log-moments about the support bounds, one pass for all of them
    # loglaplace: median of ln(y) is ln of the median of y; scale of |ln y - that|
    stats = stats.withColumn("med_ln", F.log(F.col("med") - F.col("loc0")))
    logs = _log_moments(wide, cols, stats)
    return materialize(stats.join(bounded_broadcast(logs, len(cols)), "column_name"), "marginal-stats"), cum


#: Families whose estimators need quantiles or L-moments, that is the distinct-value scan.
SCAN_FAMILIES = {"cauchy", "dweibull", "genextreme", "loglaplace", *LIKELIHOOD_FAMILIES}


def moment_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns of ``column_stats`` that need no order statistics, by two light passes.

    Enough for every family outside ``SCAN_FAMILIES``.  Rows are combined where they lie, so
    nothing is shuffled but one row for each column and task."""
    wide = df.select(*[F.when(~is_missing(df, c), F.col(c).cast("double")).alias(c) for c in cols])
    a = materialize(_moments(wide, cols).withColumns(_support()), "moments")
    return a.join(bounded_broadcast(_log_moments(wide, cols, a), len(cols)), "column_name")


def _means(names: Sequence[str], found: dict[tuple[int, str], list[float]]) -> Iterator[pa.RecordBatch]:
    """A task's (column_name, item, n, mean, m2, m3, m4): central moment sums of what it saw."""
    keys = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i, _ in keys], pa.string()), pa.array([item for _, item in keys], pa.string()), pa.array([int(found[k][0]) for k in keys], pa.int64()),
         *[pa.array([float(found[k][j]) for k in keys], pa.float64()) for j in range(1, 5)]], ["column_name", "item", "n", "mean", "m2", "m3", "m4"])


def _add_means(found: dict[tuple[int, str], list[float]], key: tuple[int, str], x: np.ndarray) -> None:
    """Central moment sums of what was seen and ``x`` (pairwise formulas of Chan and of Pebay)."""
    if not len(x):
        return
    nb, mb = len(x), float(x.mean())
    dev = x - mb
    mb, dev = mb + float(dev.mean()), dev - dev.mean()
    square = dev * dev
    b2, b3, b4 = float(square.sum()), float((square * dev).sum()), float((square * square).sum())
    na, ma, a2, a3, a4 = found.get(key, (0, 0.0, 0.0, 0.0, 0.0))
    if na == 0:
        found[key] = [nb, mb, b2, b3, b4]
        return
    n, t = na + nb, mb - ma
    wa, wb = na / n, nb / n
    found[key] = [n, ma + t * wb, a2 + b2 + t * t * na * wb,
                  a3 + b3 + t ** 3 * na * wb * (wa - wb) + 3 * t * (wa * b2 - wb * a2),
                  a4 + b4 + t ** 4 * na * wb * (wa * wa - wa * wb + wb * wb) + 6 * t * t * (wa * wa * b2 + wb * wb * a2) + 4 * t * (wa * b3 - wb * a3)]


_MEANS = "column_name string, item string, n long, mean double, m2 double, m3 double, m4 double"


def _joined_means(parts: DataFrame) -> DataFrame:
    """(column_name, item, n, mean, m2, m3, m4) of all tasks: their sums, moved to the common mean."""
    own = Window.partitionBy("column_name", "item")  # one row for each task
    w = F.col("n").cast("double")
    t = F.col("t")
    moved = parts.withColumn("t", F.col("mean") - F.sum(w * F.col("mean")).over(own) / F.sum(w).over(own))
    return moved.groupBy("column_name", "item").agg(
        (F.sum(w * (F.col("mean") - t)) / F.sum(w)).alias("at"), (F.sum(w * t) / F.sum(w)).alias("rest"), F.sum("n").alias("n"),
        F.sum(F.col("m2") + w * t * t).alias("m2"), F.sum(F.col("m3") + 3 * t * F.col("m2") + w * t * t * t).alias("m3"),
        F.sum(F.col("m4") + 4 * t * F.col("m3") + 6 * t * t * F.col("m2") + w * t * t * t * t).alias("m4")).withColumn("mean", F.col("at") + F.col("rest"))


def _moments(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n, mean, var, g1, g2, xmin, xmax) by one pass over the columns ``cols``, doubles without NaN."""
    names = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            for i, column in enumerate(b.columns):
                x = column.drop_null().to_numpy()
                with np.errstate(all="ignore"):
                    _add_means(found, (i, "x"), x)
                if len(x):
                    for item, v in (("lo", x.min()), ("hi", x.max())):
                        old = found.get((i, item))
                        found[i, item] = [1, float(v if old is None else min(old[1], v) if item == "lo" else max(old[1], v)), 0.0, 0.0, 0.0]
        yield from _means(names, found)

    parts = wide.select(*names).mapInArrow(run, _MEANS)
    parts = materialize(parts, "moment-parts")  # one row for each task, column and item
    m = _joined_means(parts.where("item = 'x'"))
    ends = parts.groupBy("column_name").agg(F.min(F.when(F.col("item") == "lo", F.col("mean"))).alias("xmin"), F.max(F.when(F.col("item") == "hi", F.col("mean"))).alias("xmax"))
    n = F.col("n").cast("double")
    # a column without any spread has neither skewness nor kurtosis
    g1, g2 = F.sqrt(n) * F.col("m3") / F.sqrt(F.col("m2") * F.col("m2") * F.col("m2")), n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3.0
    spread = F.col("m2") != 0.0
    return m.join(bounded_broadcast(ends, len(names)), "column_name").select(
        "column_name", "n", "mean", (F.col("m2") / n).alias("var"), F.when(spread, g1).alias("g1"), F.when(spread, g2).alias("g2"), "xmin", "xmax")


def _log_moments(wide: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    """Moments of logarithms about the support bounds, and about the median where ``stats`` has it.

    A value whose logarithm is not defined takes no part, as nulls in SQL."""
    names, places = list(cols), {r["column_name"]: r.asDict() for r in stats.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            for i, column in enumerate(b.columns):
                x, at = column.drop_null().to_numpy(), places.get(names[i])
                if not len(x) or at is None:
                    continue
                with np.errstate(all="ignore"):
                    y = x - at["loc0"]
                    ln_y = _ln(y)
                    items = {"ln": ln_y, "yln": y * ln_y, "ln_hi": _ln(at["hiloc"] - x), "ln_par": _ln(x - (at["loc0"] - (at["xmax"] - at["xmin"])))}
                    if at.get("med") is not None:
                        items["ln_abs"] = _ln(np.abs(x - at["med"]))
                        if at["med_ln"] is not None:
                            items["abs_lnr"] = np.abs(ln_y - at["med_ln"])
                    for item, v in items.items():
                        _add_means(found, (i, item), v[~np.isnan(v)])
        yield from _means(names, found)

    m = _joined_means(materialize(wide.select(*names).mapInArrow(run, _MEANS), "log-parts"))
    mean = lambda item: F.max(F.when(F.col("item") == item, F.col("mean")))
    var = lambda item: F.max(F.when(F.col("item") == item, F.col("m2") / F.col("n")))
    out = [mean("ln").alias("mln"), var("ln").alias("vln"), mean("yln").alias("mylny"), mean("ln_hi").alias("mln_hi"), var("ln_hi").alias("vln_hi"), mean("ln_par").alias("mln_par")]
    if "med" in stats.columns:
        out += [mean("ln_abs").alias("mln_abs"), var("ln_abs").alias("vln_abs"), mean("abs_lnr").alias("mabs_lnr")]
    return m.groupBy("column_name").agg(*out)


def _ln(x: np.ndarray) -> np.ndarray:
    """SQL's logarithm: none (NaN) where x is not positive."""
    return np.log(np.where(x > 0, x, np.nan))


def _support() -> dict[str, F.Column]:
    """Spread and support bounds, a step outside the extremes."""
    return {
        "sd": F.sqrt("var"),
        "loc0": F.expr("CASE WHEN xmax > xmin THEN xmin - (xmax - xmin) / n ELSE xmin - 1.0 END"),
        "hiloc": F.expr("CASE WHEN xmax > xmin THEN xmax + (xmax - xmin) / n ELSE xmax + 1.0 END"),
    }


#: Families whose parameters one projection gives; more make its generated method too large.
FAMILIES_AT_ONCE = 4
#: A family is fitted to columns of at least three values that are not all equal.
FITTABLE = "(n >= 3 AND xmax > xmin AND var > 0)"


def fit_params(stats: DataFrame, families: Sequence[str], cum: DataFrame | None = None) -> DataFrame:
    """(column_name, family, p1, p2, loc, scale, n).

    ``cum``, the distinct-value scan of ``column_stats``, is needed by ``LIKELIHOOD_FAMILIES``;
    without it they are left out.  Where a family can't be fitted (a constant or nearly empty
    column, a spread of zero such as the quartiles of a column that is mostly one value, a shape
    of zero, a likelihood without an inner maximum) all four parameters are null, and so are the
    statistics that later build on them."""
    # spreads that are divided by; zero has no fit
    st = stats.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in ("vln", "vln_hi", "vln_abs", "mabs_lnr")
                            if c in stats.columns})
    names = ("p1", "p2", "loc", "scale")
    closed = closed_families(families)
    fits = (F.col("scale") > 0) & (F.col("scale") < float("inf")) & (F.col("p1").isNull() | (F.col("p1") != 0))
    parts = []
    for i in range(0, len(closed), FAMILIES_AT_ONCE):
        rows = [F.struct(F.lit(fam).alias("family"), *[F.expr(f"CASE WHEN {FITTABLE} THEN CAST({v} AS DOUBLE) END").alias(n)
                                                       for n, v in zip(names, family_params_sql(fam))]) for fam in closed[i:i + FAMILIES_AT_ONCE]]
        parts.append(st.select("column_name", "n", F.inline(F.array(*rows)))
                     .select("column_name", "family", *[F.when(fits, F.col(n)).alias(n) for n in names], "n"))
    mle = [f for f in fitted_families(families) if f in LIKELIHOOD_FAMILIES]
    if mle and cum is not None:
        parts.append(likelihood_params(stats, cum, mle))
    if not parts:
        raise ValueError(f"no family of {list(families)} can be fitted here")
    return reduce(lambda x, y: x.unionByName(y), parts)


def grid_values(family: str, p1, p2) -> tuple[float, float, list[float]] | None:
    """(lo_y, hi_y, CDF values) on a grid of the standardised variable.

    The grid is even in the root of y - lo_y, so it is dense where y^a is steep; for beta
    it is y = sin^2 t with even t, which is dense at both ends."""
    ok = lambda v: v is not None and math.isfinite(v)
    if not ok(p1) or p1 <= 0 or (family == "beta" and (not ok(p2) or p2 <= 0)):
        return None
    lo_y, hi_y = {"beta": (0.0, 1.0), "gamma": (0.0, p1 + 40.0 * math.sqrt(p1) + 40.0),
                  "chi2": (0.0, p1 + 60.0 * math.sqrt(p1) + 80.0), "t": (-60.0, 60.0)}[family]
    t = np.linspace(0.0, 1.0, GRID_POINTS)
    y = np.sin(t * math.pi / 2) ** 2 if family == "beta" else lo_y + (hi_y - lo_y) * t ** 2
    _, _, cdf, _ = tails(family, p1, p2)
    return lo_y, hi_y, [float(v) for v in cdf(y)]


def cubic_at(a: F.Column, pos: F.Column, points: int) -> F.Column:
    """The cubic through the four values of the array around ``pos``."""
    i = F.greatest(F.lit(1), F.least(F.floor(pos), F.lit(points - 3))).cast("int")
    t = pos - i
    y0, y1, y2, y3 = (F.element_at(a, i + k) for k in range(4))
    return (-y0 * t * (t - 1) * (t - 2) / 6 + y1 * (t + 1) * (t - 1) * (t - 2) / 2
            - y2 * (t + 1) * t * (t - 2) / 2 + y3 * (t + 1) * t * (t - 1) / 6)


def _per_family(base: DataFrame, params: DataFrame, n_cols: int, fams: Sequence[str],
                expr_for) -> DataFrame:
    """Union of one small projection per family over a single broadcast join.

    Every branch filters the same joined plan (the broadcast is reused), and
    each family's expression stays small enough for whole-stage codegen.
    """
    p = params.drop("n") if "n" in base.columns else params
    joined = base.join(bounded_broadcast(p, n_cols * max(1, len(fams))), "column_name")
    parts = [joined.where(F.col("family") == fam).withColumn("__v", expr_for(fam)) for fam in fams]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _families(params: DataFrame) -> list[str]:
    return sorted(r["family"] for r in params.select("family").distinct().collect())


def _cubic(a: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``cubic_at`` on arrays; ``pos`` counts from 0."""
    i = np.clip(np.floor(pos), 1, len(a) - 3).astype(np.int64)
    t = pos - i
    y0, y1, y2, y3 = (a[i + k] for k in (-1, 0, 1, 2))
    return (-y0 * t * (t - 1) * (t - 2) / 6 + y1 * (t + 1) * (t - 1) * (t - 2) / 2
            - y2 * (t + 1) * t * (t - 2) / 2 + y3 * (t + 1) * t * (t - 1) / 6)


class Fit(NamedTuple):
    """A fitted family; ``grid`` is that of ``grid_values``."""
    family: str
    p1: float | None
    p2: float | None
    loc: float
    scale: float
    grid: tuple[float, float, np.ndarray] | None

    def cdf(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.loc) / self.scale
        if self.grid is not None:
            lo, hi, values = self.grid
            root = np.sqrt(np.clip((y - lo) / (hi - lo), 0.0, 1.0))
            t = np.arcsin(root) * (2 / math.pi) if self.family == "beta" else root
            return _cubic(values, t * (GRID_POINTS - 1))
        if self.family in GRID_FAMILIES:  # its shapes give no distribution
            return np.full(x.shape, np.nan)
        lo, hi, cdf, _ = tails(self.family, self.p1, self.p2)
        out = np.where(y <= lo, 0.0, 1.0)
        inside = (y > lo) & (y < hi)
        out[inside] = cdf(y[inside])
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """ln of the density, at least ln 1e-323."""
        if self.family in GRID_FAMILIES and self.grid is None:
            return np.full(x.shape, np.nan)
        return np.maximum(log_density(self.family, (x - self.loc) / self.scale, self.p1, self.p2) - math.log(self.scale), LOG_ZERO)


def _fits(rows: Sequence) -> dict[str, list[Fit]]:
    """By column: the families with a fit.  A few numbers for each, and four grids of 4,097."""
    out: dict[str, list[Fit]] = {}
    for r in rows:
        if r["scale"] is not None:
            grid = grid_values(r["family"], r["p1"], r["p2"]) if r["family"] in GRID_FAMILIES else None
            out.setdefault(r["column_name"], []).append(
                Fit(r["family"], r["p1"], r["p2"], r["loc"], r["scale"], grid and (grid[0], grid[1], np.array(grid[2]))))
    return out


def _ks_loglik(cum: DataFrame, params: DataFrame, with_loglik: bool) -> DataFrame:
    """One pass over the distinct-value scan for all families: KS statistic (and log-likelihood).

    D = max over distinct values of max(F_n(v) - F(v), F(v) - F_n(v-));
    loglik = sum over distinct values of c * ln f(v) (densities below 1e-323 count as that).
    A batch is scored under every family of its columns, and a task gives one row for each
    column and family, so nothing else is shuffled and no expression grows with the families."""
    rows = params.select("column_name", "family", "p1", "p2", "loc", "scale", "n").collect()
    fits, total = _fits(rows), {r["column_name"]: r["n"] for r in rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], tuple[float, float]] = {}
        for b in batches:
            names = b.column("column_name").dictionary_encode()
            code = names.indices.to_numpy()
            x, c, at = (b.column(k).to_numpy() for k in ("x", "c", "cum"))
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = code == k
                v, w, top = x[own], c[own].astype(float), at[own] / total.get(name, 1)
                low = top - w / total.get(name, 1)
                for fit in fits.get(name, ()):
                    with np.errstate(all="ignore"):
                        f = fit.cdf(v)
                        gap = float(np.maximum(top - f, f - low).max())  # an unknown CDF makes the gap NaN
                        log_f = float((w * fit.log_density(v)).sum()) if with_loglik else 0.0
                    old = best.get((name, fit.family), (0.0, 0.0))
                    best[name, fit.family] = float(np.maximum(old[0], gap)), old[1] + log_f
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in best]), pa.array([k[1] for k in best]),
                 pa.array([g for g, _ in best.values()], pa.float64()), pa.array([v for _, v in best.values()], pa.float64())],
                ["column_name", "family", "gap", "log_f"])

    found = cum.select("column_name", "x", "c", "cum").mapInArrow(run, "column_name string, family string, gap double, log_f double")
    # an unknown density (no distribution) leaves no likelihood
    found = found.groupBy("column_name", "family").agg(F.max("gap").alias("ks"), F.nanvl(F.sum("log_f"), F.lit(None)).alias("loglik"))
    # families without a fit keep a row of nulls
    d = params.select("column_name", "family", "n").join(bounded_broadcast(found, max(1, len(rows))), ["column_name", "family"], "left")
    d = (d.withColumn("__lam", F.sqrt(F.col("n").cast("double")) * F.col("ks"))
         .withColumn("pvalue", F.expr(kolmogorov_sf_sql("__lam"))))
    return d.select("column_name", "family", "ks", "pvalue", *(["loglik"] if with_loglik else []))


def ks_one_sample(cum: DataFrame, params: DataFrame) -> DataFrame:
    """D3 + D4: (column_name, family, ks, pvalue) over the distinct-value scan."""
    return _ks_loglik(cum, params, with_loglik=False)


def histogram_sse(cum: DataFrame, cols: Sequence[str], params: DataFrame, stats: DataFrame,
                  bins: int = 100) -> DataFrame:
    """Sum of squared differences between the density histogram and the pdf
    at the bin mid-points (bins over [min, max], empty bins included).

    Bin counts come from the distinct-value scan (sum of counts per bin), so
    the raw cells are not read again.
    """
    st = stats.select("column_name", "n", "xmin", "xmax")
    width = f"(CASE WHEN xmax > xmin THEN (xmax - xmin) / {bins} ELSE 1.0 END)"
    b = cum.join(bounded_broadcast(st, len(cols)), "column_name").withColumn(
        "bin", F.expr(f"CAST(CASE WHEN xmax > xmin THEN greatest(0, least(floor((x - xmin) / (xmax - xmin) * {bins}), "
                      f"{bins - 1})) ELSE 0 END AS INT)"))
    hist = b.groupBy("column_name", "bin").agg(F.sum("c").alias("cnt"))
    grid = st.select("column_name", "n", "xmin", "xmax",
                     F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.withColumn("x", F.col("xmin") + (F.col("bin") + 0.5) * F.expr(width))
    full = grid.join(hist, ["column_name", "bin"], "left").fillna(0, ["cnt"])
    full = full.withColumn("density", F.col("cnt") / (F.col("n") * F.expr(width)))
    j = _per_family(full, params, len(cols), _families(params), lambda fam: F.expr(pdf_sql(fam)))
    # where the family has no fit there is no error either
    err = F.col("density") - F.coalesce(F.col("__v"), F.lit(0.0))
    return j.groupBy("column_name", "family").agg(
        F.when(F.count("scale") > 0, F.sum(err * err)).alias("sse"))


def fit_summary(df: DataFrame, cols: Sequence[str], families: Sequence[str] = FAMILIES_WIDE) -> DataFrame:
    """(column_name, family, p1, p2, loc, scale, n, ks, pvalue, loglik, sse, aic, bic)."""
    stats, cum = column_stats(df, cols)
    params = materialize(fit_params(stats, families, cum), "marginal-params")
    ks = _ks_loglik(cum, params, with_loglik=True)
    sse = histogram_sse(cum, cols, params, stats)
    k = F.expr("CASE WHEN family IN ('norm','expon','uniform','cauchy','logistic','cosine','arcsine','rayleigh') "
               "THEN 2 WHEN family IN ('beta', 'loguniform', 'exponweib', 'truncnorm') THEN 4 ELSE 3 END")
    out = params.join(ks, ["column_name", "family"]).join(sse, ["column_name", "family"])
    return out.withColumns({"aic": 2 * k - 2 * F.col("loglik"),
                            "bic": k * F.log(F.col("n")) - 2 * F.col("loglik")})


def best_family(summary: DataFrame, compat: bool = False) -> DataFrame:
    """One family per column.

    Default: the smallest KS statistic.  ``compat=True`` reproduces the
    reference rule (sort by p-value ascending, take the first row), which
    picks the worst fit.
    """
    order = ["pvalue", "family"] if compat else ["ks", "family"]
    fitted = F.col("ks").isNotNull() & ~F.isnan("ks")
    # min_by skips rows whose order is null; a column that no family fits keeps a row of nulls
    best = summary.groupBy("column_name").agg(F.min_by(F.struct("family", "ks", "pvalue"),
                                                       F.when(fitted, F.struct(*order))).alias("__b"))
    return best.select("column_name", "__b.family", "__b.ks", "__b.pvalue",
                       F.format_string("%.4f", F.col("__b.pvalue")).alias("pvalue_text"))
