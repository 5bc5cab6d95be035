"""Property and edge-case tests on small fixtures, checked by brute force."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from facsimile.functions.normal import phi_sql, with_probit
from facsimile.functions.rng import hash_u
from facsimile.operators import constraints, copula, evaluate, profile
from facsimile.operators.scan import ordinal, running_sums
from facsimile.sources import load
from facsimile.sources.contracts import FEATURES, GROUP_KEYS, contracts


def _skewed(spark, n=3000):
    """One key holds ~1/3 of all rows (the hot-group case)."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", float((i * 7919) % 1000), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, x double, id long")


def test_ordinal_matches_row_number_on_hot_group(spark):
    df = _skewed(spark)
    got = ordinal(df, ["g"], ["x", "id"], "o", partitions=7).select("id", "o").toPandas()
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")) - 1)
    ref = ref.select("id", "r").toPandas()
    m = got.merge(ref, on="id")
    assert len(m) == 3000 and (m.o == m.r).all()


def test_global_ordinal_is_dense(spark):
    df = _skewed(spark)
    o = ordinal(df, [], ["id"], "o", partitions=5).select("o").toPandas().o
    assert sorted(o) == list(range(3000))


def test_running_sums_and_next_value(spark):
    df = _skewed(spark)
    out = running_sums(df, ["g"], ["x", "id"], {"cx": "x"}, partitions=6, next_of="x").toPandas()
    pdf = df.toPandas().sort_values(["g", "x", "id"])
    pdf["cx"] = pdf.groupby("g").x.cumsum()
    pdf["nx"] = pdf.groupby("g").x.shift(-1)
    m = out.merge(pdf, on="id", suffixes=("", "_ref"))
    assert np.allclose(m.cx, m.cx_ref)
    assert ((m.__next_x.isna() & m.nx.isna()) | np.isclose(m.__next_x, m.nx)).all()


def test_hash_uniforms_are_in_unit_interval_and_stable(spark):
    df = spark.range(20000).withColumn("u", hash_u(1, "s", "id"))
    a = df.toPandas().u
    b = df.repartition(7).toPandas().sort_values("id").u.reset_index(drop=True)
    assert a.between(0, 1, inclusive="neither").all()
    assert (a.values == b.values).all()
    assert abs(a.mean() - 0.5) < 0.01


def test_normal_cdf_and_quantile(spark):
    xs = np.linspace(-8, 8, 161)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").withColumn("p", F.expr(phi_sql("x")))
    got = df.toPandas()
    ref = [0.5 * math.erfc(-x / math.sqrt(2)) for x in got.x]
    assert np.allclose(got.p, ref, rtol=1e-12, atol=1e-15)
    ps = [1e-9, 1e-4, 0.01, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    q = with_probit(spark.createDataFrame([(p,) for p in ps], "p double"), "p", "z").toPandas()
    nd = statistics.NormalDist()
    assert np.allclose(q.z, [nd.inv_cdf(p) for p in q.p], atol=1e-8)


def test_unknown_source_tag_raises(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        load.tag_source(df, "Somewhere")
    assert "PD_status" not in load.tag_source(df, "Somewhere", strict=False).columns


def test_missing_counts_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = dict(profile.missing_counts(df).toPandas().values)
    assert got == {"x": 2, "s": 1}


def test_correlation_constant_and_single_row_groups(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.0, 5.0), ("a", 3.0, 5.0), ("b", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    st = {r["g"]: r for r in copula.correlation_stats(df, ["g"], ["x", "y"]).collect()}
    # np.corrcoef semantics: undefined -> 0 including the diagonal
    assert st["a"]["r_0_0"] == 1.0 and st["a"]["r_1_1"] == 0.0 and st["a"]["r_0_1"] == 0.0
    assert st["b"]["r_0_0"] == 0.0 and st["b"]["n"] == 1


def test_group_copula_properties(spark):
    c = contracts(spark, SF_SMALL)
    model = copula.fit_group_copula(c, GROUP_KEYS, FEATURES)
    s = copula.sample_group_copula(model, 453).toPandas()
    real = c.toPandas()
    # same number of rows per group
    rc = real.groupby(GROUP_KEYS).size()
    sc = s.groupby(GROUP_KEYS).size()
    assert rc.sort_index().equals(sc.sort_index())
    # values inside the group's real range
    lo = real.groupby(GROUP_KEYS)[FEATURES].min()
    hi = real.groupby(GROUP_KEYS)[FEATURES].max()
    j = s.join(lo, on=GROUP_KEYS, rsuffix="_lo").join(hi, on=GROUP_KEYS, rsuffix="_hi")
    for f in FEATURES:
        assert (j[f] >= j[f + "_lo"] - 1e-9).all() and (j[f] <= j[f + "_hi"] + 1e-9).all()
    # repartition invariance: same seed, different layout -> same rows
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        s2 = copula.sample_group_copula(copula.fit_group_copula(c.repartition(5), GROUP_KEYS, FEATURES), 453)
        s2 = s2.toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = GROUP_KEYS + ["k"]
    a = s.sort_values(key).reset_index(drop=True)
    b = s2.sort_values(key).reset_index(drop=True)
    assert np.allclose(a[FEATURES].values, b[FEATURES].values)


def test_empirical_quantile_matches_numpy(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([("g", v) for v in vals], "__g string, x double")
    ranks = copula.rank_table(df, "__g", ["x"])
    us = [0.0, 0.1, 0.5, 0.77, 1.0]
    cells = spark.createDataFrame([("g", i, len(vals), 0, u) for i, u in enumerate(us)],
                                  "__g string, k long, n long, f tinyint, u double")
    got = copula.empirical_quantile(cells, ranks).orderBy("k").toPandas().value
    assert np.allclose(got, np.quantile(vals, us))


def test_ks_two_sample_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300).round(2), rng.normal(0.3, 1.2, size=500).round(2)
    ra = spark.createDataFrame([(float(v),) for v in a], "x double")
    sb = spark.createDataFrame([(float(v),) for v in b], "x double")
    d = evaluate.ks_two_sample(ra, sb, ["x"]).first()["statistic"]
    grid = np.union1d(a, b)
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert abs(d - np.max(np.abs(fa - fb))) < 1e-12


def test_anderson_darling_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.sort(rng.gamma(2.0, size=400))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = evaluate.anderson_normal(df, ["x"]).first()["statistic"]
    w = (x - x.mean()) / x.std(ddof=1)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in w])
    i = np.arange(1, len(x) + 1)
    a2 = -len(x) - np.sum((2 * i - 1) / len(x) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    assert abs(got - a2) < 1e-8


def test_anderson_darling_of_both_sides(spark):
    """Each side as if alone: ties, a constant column, nulls and an empty second table."""
    rng = np.random.default_rng(4)
    schema = "x double, c double"
    real = spark.createDataFrame([(float(round(v, 1)), 1.0) for v in rng.normal(size=300)] + [(None, None)], schema)
    synth = spark.createDataFrame([(float(v), 2.0) for v in rng.gamma(2.0, size=200)], schema)
    got = {(r.side, r.column_name): (r.n, r.statistic, r.crit_5) for r in evaluate.anderson_comparison(real, synth, ["x", "c"]).collect()}
    for side, df in (("real", real), ("synthetic", synth)):
        for r in evaluate.anderson_normal(df, ["x", "c"]).collect():
            n, statistic, crit = got.pop((side, r.column_name))
            assert (n, crit) == (r.n, r.crit_5)
            assert (statistic is None) == (r.statistic is None) and (statistic is None or abs(statistic - r.statistic) < 1e-8)
    assert not got
    alone = evaluate.anderson_comparison(real, synth.limit(0), ["x"]).collect()
    assert [r.side for r in alone] == ["real"]


def test_quality_report_identity_is_one(spark):
    c = contracts(spark, SF_SMALL).select(*FEATURES)
    q = dict(evaluate.quality_report(c, c, FEATURES).toPandas().values)
    assert abs(q["Overall"] - 1.0) < 1e-12


def test_ordinal_join_unequal_lengths(spark):
    left = spark.range(10).withColumnRenamed("id", "a")
    right = spark.range(4).withColumnRenamed("id", "b")
    out = constraints.ordinal_join(left, right, ["a"], ["b"]).toPandas()
    assert len(out) == 10 and out.b.isna().sum() == 6


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=1000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    m = evaluate.moments(df, ["x"]).first()
    s = pd.Series(x)
    assert np.isclose(m["mean"], s.mean()) and np.isclose(m["variance"], s.var())
    assert np.isclose(m["skewness"], s.skew()) and np.isclose(m["kurtosis"], s.kurt())


def test_group_sample_is_counted_without_a_sort(spark):
    df = spark.range(60).select(F.when(F.col("id") > 50, F.lit(None)).otherwise(F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("a"))
    m = copula.fit_group_copula(df, ["g"], ["a"])
    s = copula.with_position(copula.sample_group_copula(m), m)
    got = [(r.g, r.k) for r in s.orderBy("position").collect()]
    assert got == [(r.g, r.k) for r in s.orderBy("g", "k").collect()]
    assert [r.position for r in s.orderBy("position").collect()] == list(range(60))
