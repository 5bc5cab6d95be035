"""Families without a closed-form estimator, and the one-pass KS statistics and likelihoods."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.functions.families import log_density, quantiles_at_normal, tails
from facsimile.operators import likelihood, marginals, parametric

FAMILIES = marginals.fitted_families([*marginals.FAMILIES_SHORT, *marginals.FAMILIES_WIDE])
SHAPES = {"loguniform": (1.0, 9.0), "genextreme": (0.2, None), "beta": (2.5, 9.0), "exponweib": (2.5, 0.8), "truncnorm": (-1.0, 2.5), "exponpow": (1.4, None)}


def simulate(family, n, seed, loc=0.0, scale=1.0):
    rng = np.random.default_rng(seed)
    y = quantiles_at_normal(family, rng.normal(size=n), *SHAPES[family])
    return loc + scale * y


@pytest.mark.parametrize("family", FAMILIES)
def test_log_density_is_the_slope_of_the_distribution(family):
    p1, p2 = SHAPES.get(family, (2.5, None))
    y = quantiles_at_normal(family, np.linspace(-2.5, 2.5, 41), p1, p2)
    _, _, cdf, _ = tails(family, p1, p2)
    h = 1e-5 * np.maximum(np.abs(y), 1e-2)
    with np.errstate(all="ignore"):
        slope = (cdf(y + h) - cdf(y - h)) / (2 * h)
    assert np.allclose(np.exp(log_density(family, y, p1, p2)), slope, rtol=2e-3, atol=1e-6)


@pytest.mark.parametrize("family", FAMILIES)
def test_sql_and_numpy_give_the_same(spark, family):
    p1, p2 = SHAPES.get(family, (2.5, None))
    x = (3.0 + 2.0 * np.concatenate((quantiles_at_normal(family, np.linspace(-3, 3, 25), p1, p2), [-50.0, 0.0, 0.5, 50.0]))).tolist()
    fit = marginals._fits([{"column_name": "x", "family": family, "p1": p1, "p2": p2, "loc": 3.0, "scale": 2.0}])["x"][0]
    shapes = ", ".join(f"CAST({'NULL' if p is None else repr(p)} AS DOUBLE) AS {n}" for p, n in ((p1, "p1"), (p2, "p2"), (3.0, "loc"), (2.0, "scale")))
    df = spark.sql(f"SELECT CAST(x AS DOUBLE) AS x, {shapes} FROM VALUES {', '.join(f'({float(v)!r}D)' for v in x)} AS v(x)")
    pdf = [r.v for r in df.select(F.expr(marginals.pdf_sql(family)).alias("v")).collect()]
    with np.errstate(all="ignore"):
        assert np.allclose(np.exp(fit.log_density(np.array(x))), pdf, rtol=1e-7, atol=1e-12)
    if marginals.cdf_sql(family) is not None:
        cdf = [r.v for r in df.select(F.expr(marginals.cdf_sql(family)).alias("v")).collect()]
        with np.errstate(all="ignore"):
            assert np.allclose(fit.cdf(np.array(x)), cdf, rtol=1e-9, atol=1e-9)


@pytest.fixture(scope="module")
def simulated(spark):
    """A column of each family, fitted together."""
    cols = {"a": ("exponpow", 20.0, 4.0), "b": ("exponweib", 0.0, 3.0), "c": ("truncnorm", 7.0, 2.0)}
    data = {k: simulate(f, 40_000, i + 1, loc, scale) for i, (k, (f, loc, scale)) in enumerate(cols.items())}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()])), "a double, b double, c double")
    stats, cum = marginals.column_stats(df, list(data))
    return data, df, stats, cum, {(r.column_name, r.family): r for r in likelihood.likelihood_params(stats, cum, marginals.LIKELIHOOD_FAMILIES).collect()}


def test_parameters_are_recovered(simulated):
    _, _, _, _, p = simulated
    a, b, c = p["a", "exponpow"], p["b", "exponweib"], p["c", "truncnorm"]
    assert (a.p1, a.scale, a.loc) == pytest.approx((1.4, 4.0, 20.0), rel=0.02)
    # the two shapes of exponweib trade off against each other: their sampling error is larger than that of the curve
    assert (b.p1, b.p2, b.scale) == pytest.approx((2.5, 0.8, 3.0), rel=0.12)
    assert (c.loc, c.scale) == pytest.approx((7.0, 2.0), rel=0.02)
    assert c.loc + c.p1 * c.scale == pytest.approx(5.0, abs=1e-2) and c.loc + c.p2 * c.scale == pytest.approx(12.0, abs=1e-2)


def test_no_neighbour_is_likelier(simulated):
    data, _, _, _, p = simulated
    for (k, family), r in p.items():
        if r.scale is None or family == "truncnorm":
            continue
        def value(p1, p2, scale):
            return float((log_density(family, (data[k] - r.loc) / scale, p1, p2) - math.log(scale)).mean())
        best = value(r.p1, r.p2, r.scale)
        for e in (1e-3, -1e-3):
            near = [value(r.p1 * (1 + e), r.p2, r.scale), value(r.p1, r.p2, r.scale * (1 + e))]
            near += [value(r.p1, r.p2 * (1 + e), r.scale)] if r.p2 is not None else []
            assert max(near) < best
    r, x = p["c", "truncnorm"], data["c"]
    def cut(loc, scale):
        return float((log_density("truncnorm", (x - loc) / scale, (x.min() - loc) / scale - 1e-12, (x.max() - loc) / scale + 1e-12) - math.log(scale)).mean())
    for e in (1e-3, -1e-3):
        assert max(cut(r.loc * (1 + e), r.scale), cut(r.loc, r.scale * (1 + e))) < cut(r.loc, r.scale)


def test_one_scan_gives_all_statistics(simulated):
    data, _, stats, cum, _ = simulated
    params = marginals.materialize(marginals.fit_params(stats, marginals.FAMILIES_WIDE + ["exponpow"], cum), "test-params")
    assert params.select("family").distinct().count() == 22
    got = marginals._ks_loglik(cum, params, with_loglik=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    by = {(r.column_name, r.family): r for r in got.collect()}
    fits = marginals._fits(params.collect())
    for k, x in data.items():
        x = np.sort(x)
        n = len(x)
        for fit in fits[k]:
            with np.errstate(all="ignore"):
                f, log_f = fit.cdf(x), fit.log_density(x).sum()
            gap = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
            r = by[k, fit.family]
            if math.isnan(gap):
                assert math.isnan(r.ks)
                continue
            assert r.ks == pytest.approx(gap, abs=1e-12) and r.loglik == pytest.approx(log_f, rel=1e-9)
    assert by["a", "exponpow"].pvalue > 0.01 and by["b", "exponweib"].pvalue > 0.01 and by["c", "truncnorm"].pvalue > 0.01


def test_ties_and_columns_without_a_fit(spark):
    rows = [(float(i % 6), 3.0, None, float(i == 3), [0.5, 1.0, 1.0, 2.5, 4.0][i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "u double, constant double, empty double, mostly_zero double, tied double")
    stats, cum = marginals.column_stats(df, df.columns)
    p = {(r.column_name, r.family): r for r in marginals.fit_params(stats, marginals.LIKELIHOOD_FAMILIES, cum).collect()}
    assert all(p["constant", f].scale is None for f in marginals.LIKELIHOOD_FAMILIES)
    assert not [k for k in p if k[0] == "empty"]  # a column without values has no row of stats
    assert p["u", "truncnorm"].scale is None and p["mostly_zero", "truncnorm"].scale is None  # flatter than a uniform, two points
    assert p["tied", "exponpow"].scale > 0 and p["tied", "exponpow"].n == 300
    empty = spark.createDataFrame([], "x double")
    stats, cum = marginals.column_stats(empty, ["x"])
    assert marginals.fit_params(stats, ["truncnorm", "exponweib"], cum).count() == 0


def test_likelihood_family_as_a_marginal_of_the_copula(spark, simulated):
    _, df, _, _, _ = simulated
    model = parametric.fit_parametric_copula(df, ["a", "c"], {"a": "exponpow", "c": "truncnorm"})
    s = parametric.sample_parametric_copula(model, 20_000)
    real, synth = (d.agg(F.avg("a"), F.stddev("a"), F.avg("c"), F.stddev("c")).first() for d in (df, s))
    assert tuple(synth) == pytest.approx(tuple(real), rel=0.03)


@pytest.mark.parametrize("a,b", [(-0.5, 0.7), (-6.0, 9.0), (3.0, 5.0), (-30.0, -28.0), (-1.0, 300.0)])
def test_truncated_normal_has_the_moments(a, b):
    """Moments by brute force on a fine grid lead back to the same bounds."""
    y = np.linspace(a, min(b, a + 40), 2_000_001)
    w = np.exp(log_density("truncnorm", y, a, b))
    mean = float(np.trapezoid(w * y, y) / np.trapezoid(w, y))
    var = float(np.trapezoid(w * (y - mean) ** 2, y) / np.trapezoid(w, y))
    p1, p2, loc, scale = likelihood.truncated_normal(10 + 3 * mean, 9 * var, 10 + 3 * a, 10 + 3 * b)
    assert (p1, p2, loc, scale) == pytest.approx((a, b, 10.0, 3.0), rel=2e-3)
    # twice the variance of a uniform, and a steeper fall than any exponential, have none
    assert likelihood.truncated_normal(0.5, 1 / 6, 0.0, 1.0)[3] is None and likelihood.truncated_normal(0.01, 0.001, 0.0, 1.0)[3] is None
