"""Passes over Arrow batches: they agree with the SQL formulas, and nothing of them is a generated method of one row."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from facsimile.functions.normal import log_phi_sql, log_phis, phi, phi_sql
from facsimile.functions.rng import key_text, text_uniforms, with_uniforms
from facsimile.operators import copula, evaluate


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_uniforms_are_those_of_sql(spark):
    rows = [(None, 1), ("", 22), ("a" * 40, 333), ("é" * 30, 4), ("b" * 130, 5), ("c", None)]
    df = spark.createDataFrame(rows, "s string, k long")
    names = [f"u{i}" for i in range(23)]  # blocks of two digits as well
    want = with_uniforms(df, 453, "copula", ["s", "k"], names).select(*names).collect()
    texts = pa.array([r[0] for r in df.select(key_text(["s", "k"])).collect()])
    got = text_uniforms(453, "copula", pa.concat_arrays([pa.array(["x"]), texts]).slice(1), 23)
    assert got.T.tolist() == [list(r) for r in want]


def test_normal_values_are_those_of_sql(spark):
    x = [-40.0, -37.5, -30.0, -8.0, -7.08, -7.07, -1.0, 0.0, 0.3, 2.0, 7.06, 7.08, 9.0, 40.0]
    rows = spark.createDataFrame([(v, -v) for v in x], "x double, m double").select(F.expr(phi_sql("x")), F.expr(log_phi_sql("x")), F.expr(log_phi_sql("m"))).collect()
    up, down = log_phis(np.array(x))
    for got, i in ((phi(np.array(x)), 0), (up, 1), (down, 2)):
        np.testing.assert_allclose(got, [r[i] for r in rows], rtol=1e-12, atol=1e-300)


def test_sample_and_correlations_are_no_generated_row_formulas(spark):
    """The draws, normal CDFs and cross products ran as generated methods too long to be compiled."""
    df = spark.createDataFrame([(g, float(i), float(i * i % 7)) for g in "ab" for i in range(30)], "g string, x double, y double")
    m = copula.fit_group_copula(df, ["g"], ["x", "y"])
    plan = _plan(copula.sample_group_copula(m))
    assert "MapInArrow" in plan and "md5(" not in plan
    assert "(x" not in _plan(copula.correlation_stats(df, ["g"], ["x", "y"]).select("n"))  # no pass over values is left behind the parts


def test_parts_of_a_group_meet(spark, monkeypatch):
    monkeypatch.setattr(copula, "PART_ROWS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rng = np.random.default_rng(3)
        x, y = 1e9 + rng.normal(size=60), rng.normal(size=60)
        rows = [(None if i % 3 else "a", float(x[i]), float(y[i])) for i in range(60)]
        got = {r.g: r for r in copula.correlation_stats(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], ["x", "y"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, own in ((None, np.arange(60) % 3 > 0), ("a", np.arange(60) % 3 == 0)):
        assert got[g].n == own.sum()
        np.testing.assert_allclose([got[g].mean_0, got[g].var_1, got[g].r_0_1], [x[own].mean(), y[own].var(ddof=1), np.corrcoef(x[own], y[own])[0, 1]], rtol=1e-9, atol=1e-12)


def test_parts_of_a_column_meet(spark, monkeypatch):
    """KS and Anderson-Darling over parts placed on a few rows, with ties that span batches."""
    monkeypatch.setattr(evaluate, "RANGE_ROWS", 60)
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(size=500), 1), np.round(rng.gamma(2.0, size=400), 1)
    real, synth = (spark.createDataFrame([(float(v), None) for v in s], "x double, empty double").repartition(7) for s in (a, b))
    ks = {r.column_name: r for r in evaluate.ks_two_sample(real, synth, ["x", "empty"]).collect()}
    at = np.unique(np.concatenate((a, b)))
    gap = np.abs(np.searchsorted(np.sort(a), at, "right") / 500 - np.searchsorted(np.sort(b), at, "right") / 400).max()
    assert abs(ks["x"].statistic - gap) < 1e-12 and list(ks) == ["x"]
    ad = {r.side: r for r in evaluate.anderson_comparison(real, synth, ["x", "empty"]).collect()}
    for side, v in (("real", a), ("synthetic", b)):
        w, j, n = np.sort((v - v.mean()) / v.std(ddof=1)), np.arange(1, len(v) + 1), len(v)
        up, down = log_phis(w)
        assert abs(ad[side].statistic - (-n - ((2 * j - 1) * up + (2 * n - 2 * j + 1) * down).sum() / n)) < 1e-8
    plan = _plan(evaluate.anderson_comparison(real, synth, ["x"]))
    assert "rangepartitioning" not in plan


def test_pair_counts_of_missing_values_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "PART_ROWS", 3)
    rows = [(None, "a"), (1.0, None), (1.0, "a"), (float("nan"), "b"), (2.0, "b")]
    df = spark.createDataFrame(rows * 3, "x double, c string")
    other = spark.createDataFrame([(1.0, "a"), (5.0, "z")], "x double, c string")
    assert abs(evaluate.contingency_similarity(df, df, ["x"], ["c"]).first().score - 1.0) < 1e-12
    # of the pairs (bin, c) only (lowest, a) is shared: 1/5 and 1/2
    assert abs(evaluate.contingency_similarity(df, other, ["x"], ["c"]).first().score - 0.2) < 1e-12


def test_moments_of_parts_meet(spark):
    """moments and log-moments from parts of few rows, columns without values, spread or an even part."""
    from facsimile.operators import marginals

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        x = 1e6 + np.random.default_rng(4).gamma(2.0, size=300)
        rows = [(float(v), 3.0, None, None if i % 5 else float(i)) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "x double, same double, empty double, some double").repartition(5)
        got = {r.column_name: r for r in marginals.column_stats(df, df.columns)[0].collect()}
        light = {r.column_name: r for r in marginals.moment_stats(df, df.columns).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(light) == ["same", "some", "x"]
    assert (got["same"].var, got["same"].g1, got["same"].g2, got["same"].xmin) == (0.0, None, None, 3.0)
    for name, v in (("x", x), ("some", np.arange(0.0, 300, 5))):
        r, dev, n = got[name], v - v.mean(), len(v)
        y = v - (v.min() - np.ptp(v) / n)
        par, hi, apart = v - (r.loc0 - np.ptp(v)), r.hiloc - v, np.abs(v - np.median(v))
        want = {"n": n, "mean": v.mean(), "var": v.var(), "g1": (dev ** 3).mean() / v.std() ** 3, "g2": (dev ** 4).mean() / v.var() ** 2 - 3, "xmin": v.min(), "xmax": v.max(),
                "mln": np.log(y).mean(), "vln": np.log(y).var(), "mylny": (y * np.log(y)).mean(), "mln_hi": np.log(hi).mean(), "vln_hi": np.log(hi).var(), "mln_par": np.log(par).mean()}
        more = {"mln_abs": np.log(apart[apart > 0]).mean(), "vln_abs": np.log(apart[apart > 0]).var(), "mabs_lnr": np.abs(np.log(y) - r.med_ln).mean()}
        for k, value in want.items():
            np.testing.assert_allclose([r[k], light[name][k]], value, rtol=1e-7, atol=1e-9, err_msg=k)
        for k, value in more.items():
            np.testing.assert_allclose(r[k], value, rtol=1e-7, err_msg=k)


def test_marginals_pass_no_unpivoted_cells(spark, monkeypatch):
    """every value was written as a row of its own, and read again by four aggregations."""
    from facsimile.operators import marginals

    written, keep = {}, marginals.materialize
    monkeypatch.setattr(marginals, "materialize", lambda df, tag="stage": written.setdefault(tag, keep(df, tag)))
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(50)], "x double, y double")
    marginals.column_stats(df, ["x", "y"])
    assert written["marginal-cells"].columns == ["x", "y"] and written["marginal-cells"].count() == 50
