"""Inputs that broke earlier versions: large counts and values, ties, constant and empty columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from facsimile.functions.families import normal_cdf, quantiles_at_normal, tails
from facsimile.functions.normal import log_phi_sql
from facsimile.functions.rng import hash_u
from facsimile.operators import copula, drivers, evaluate, marginals, parametric, project
from facsimile.operators.joins import bounded_broadcast, sized_broadcast
from facsimile.operators.scan import ordinal, running_sums
from facsimile.sources.contracts import contract_sources


def l_moments(x):
    x = np.sort(np.asarray(x, float))
    n, j = len(x), np.arange(len(x))
    b0, b1, b2 = x.mean(), (x * j).sum() / (n * (n - 1)), (x * j * (j - 1)).sum() / (n * (n - 1) * (n - 2))
    return 2 * b1 - b0, 6 * b2 - 6 * b1 + b0


def test_l_moments_match_numpy(spark):
    x = np.round(np.random.default_rng(1).gamma(2.0, 3.0, 5000), 1)  # many ties
    stats, _ = marginals.column_stats(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"])
    r = stats.first()
    assert (r.l2, r.l3) == pytest.approx(l_moments(x), rel=1e-9)


def test_fit_of_three_million_rows(spark):
    df = spark.range(0, 3_000_000, 1, 8).select((F.col("id") % 1000).cast("double").alias("x"))
    stats, _ = marginals.column_stats(df, ["x"])
    r = stats.first()
    assert r.n == 3_000_000 and r.l2 == pytest.approx(l_moments(np.repeat(np.arange(1000.0), 3000))[0], rel=1e-9)
    assert marginals.fit_params(stats, marginals.FAMILIES_WIDE).where("scale is not null").count() > 10


def test_correlation_of_large_values(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=2000)
    rows = [("a" if i % 2 else "b", 1e9 + float(v), float(v), 5.0) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "g string, x double, y double, c double")
    (r,) = copula.correlation_stats(df, [], ["x", "y", "c"]).collect()
    assert r.r_0_1 == pytest.approx(1.0, abs=1e-9) and r.var_0 == pytest.approx(z.var(ddof=1), rel=1e-6)
    assert r.r_2_2 == 0.0 and r.r_0_2 == 0.0
    for r in copula.correlation_stats(df, ["g"], ["x", "y", "c"]).collect():
        assert r.r_0_1 == pytest.approx(1.0, abs=1e-9)


def test_factor_raises_the_ridge_where_it_must():
    a = np.array([[1.0, 1.2], [1.2, 1.0]])
    factor, ridge = copula._factor(a, 1e-6)
    assert np.allclose(factor @ factor.T, a + np.eye(2) * (ridge - 1e-6), atol=1e-9) and ridge > 0.1
    assert copula._factor(np.eye(3), 1e-6)[1] == 1e-6


def test_ties_spread_and_one_shuffle(spark):
    df = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("x"), "id")
    out = ordinal(df, [], ["x", "id"], "o", partitions=16)
    assert sorted(r.o for r in out.select("o").collect()) == list(range(20_000))
    layout = df.repartitionByRange(16, "x", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert layout.count() == 16 and layout.agg(F.max("count")).first()[0] < 20_000 / 7
    plan = df.repartitionByRange(16, "x").sortWithinPartitions("x").mapInArrow(lambda it: it, df.schema)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_running_sums_with_null_keys_and_single_rows(spark):
    rows = [(None, 1.0, 1), (None, 2.0, 2), ("a", 5.0, 3), ("b", -1.0, 4), ("b", None, 5)]
    df = spark.createDataFrame(rows, "g string, x double, id long")
    got = {
        r["id"]: (r["s"], r["__next_id"]) for r in running_sums(df, ["g"], ["id"], {"s": "x"}, partitions=3, next_of="id").collect()}
    assert got == {1: (1.0, 2), 2: (3.0, None), 3: (5.0, None), 4: (-1.0, 5), 5: (-1.0, None)}


def test_group_sample_reaches_every_order_statistic(spark):
    # u is not put on a grid: distinct probabilities give distinct values
    df = spark.range(5000).select(F.lit("g").alias("g"), hash_u(1, "x", "id").alias("a"), hash_u(2, "y", "id").alias("b"))
    s = copula.group_copula(df, ["g"], ["a", "b"])
    assert s.count() == 5000 and s.select("a").distinct().count() == 5000


@pytest.mark.parametrize("family,p1,p2", [("gamma", 2.0, None), ("t", 5.0, None), ("beta", 2.0, 3.0), ("lognorm", 1.0, None), ("genextreme", -0.2, None)])
def test_tables_are_fine_in_the_tails(spark, family, p1, p2):
    m = {"inv": quantiles_at_normal(family, np.linspace(-parametric.Z_MOST, parametric.Z_MOST, parametric.Z_POINTS), p1, p2), "loc": 0.0, "scale": 1.0}
    z = [-4.7534, -2.0, -0.001, 0.0, 1.2345, 3.0902, 4.2649, 4.7534]  # the last is u = 1 - 1e-6
    got = [r.x for r in spark.createDataFrame([(v,) for v in z], "z double").select(parametric._column_inverse(m, F.col("z")).alias("x")).collect()]
    assert got == pytest.approx(quantiles_at_normal(family, np.array(z), p1, p2).tolist(), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("family", [f for f in marginals.fitted_families([*marginals.FAMILIES_SHORT, *marginals.FAMILIES_WIDE])])
def test_quantiles_invert_the_distribution(family):
    p1 = {"loguniform": 1.0, "genextreme": 0.2}.get(family, 2.5)
    p2 = 9.0 if family in ("beta", "loguniform") else None
    z = np.linspace(-6, 6, 49)
    y = quantiles_at_normal(family, z, p1, p2)
    _, _, cdf, sf = tails(family, p1, p2)
    assert (np.diff(y) >= 0).all()
    low = z <= 0
    with np.errstate(all="ignore"):
        assert np.allclose(cdf(y)[low], normal_cdf(z)[low], rtol=1e-4, atol=1e-7) and np.allclose(sf(y)[~low], normal_cdf(-z)[~low], rtol=1e-4, atol=1e-7)


def test_decimals_have_no_limit(spark):
    values = {1234567890.25: 2, 0.123456789: 9, 5.0: 0, 1.25e-7: 9, 1e20: 0, -0.5: 1, 0.0: 0, 1e7: 0}
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert {r.x: r.d for r in df.select("x", parametric.decimals_of(F.col("x")).alias("d")).collect()} == values


def test_best_family_feeds_the_copula(spark):
    df = spark.range(1500).select((hash_u(3, "a", "id") * 90 + 10).alias("a"), (-F.log(hash_u(4, "b", "id")) * 3).alias("b"))
    best = marginals.best_family(marginals.fit_summary(df, ["a", "b"], ["uniform", "expon", "logistic", "weibull_min"]))
    families = {r.column_name: r.family for r in best.collect()}
    assert families["a"] == "uniform" and families["b"] in ("expon", "weibull_min")
    model = parametric.fit_parametric_copula(df, ["a", "b"], families)
    s = parametric.sample_parametric_copula(model, 4000)
    lo, hi, mean = s.agg(F.min("a"), F.max("a"), F.avg("b")).first()
    assert 10 <= lo < 11 and 99 < hi <= 100 and mean == pytest.approx(3.0, rel=0.1)


def degenerate(spark):
    rows = [(float(i % 50), 7.0, None, float(i == 3)) for i in range(200)]
    return spark.createDataFrame(rows, "x double, constant double, empty double, mostly_zero double")


def test_constant_column_has_no_fit(spark):
    df = degenerate(spark)
    s = marginals.fit_summary(df, ["x", "constant", "mostly_zero"])
    by = {(r.column_name, r.family): r for r in s.collect()}
    assert by["constant", "norm"].ks is None and by["constant", "norm"].sse is None and by["x", "norm"].ks > 0
    assert by["mostly_zero", "cauchy"].scale is None  # both quartiles are 0
    best = {r.column_name: r for r in marginals.best_family(s).collect()}
    assert best["x"].ks is not None and best["constant"].family is None
    with pytest.raises(ValueError, match="no beta fit"):
        parametric.fit_parametric_copula(df.select("x", "constant"), ["x", "constant"])


def test_two_rows_have_no_fit(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert marginals.fit_summary(df, ["x"], ["norm", "genextreme"]).where("ks is not null").count() == 0


def test_null_statistic_never_wins(spark):
    s = spark.createDataFrame([("c", "norm", None, None), ("c", "expon", 0.1, 0.5), ("c", "t", float("nan"), 0.1)],
                              "column_name string, family string, ks double, pvalue double")
    for compat in (False, True):
        assert marginals.best_family(s, compat).first().family == "expon"


def test_anderson_darling_of_constants_and_outliers(spark):
    rows = [(float(i % 11), 3.0, 0.0 if i else 1e6) for i in range(5000)]
    got = {r.column_name: r for r in evaluate.anderson_normal(spark.createDataFrame(rows, "x double, constant double, outlier double"), ["x", "constant", "outlier"]).collect()}
    assert got["constant"].statistic is None and got["x"].statistic > 0
    assert got["outlier"].statistic > 1000  # a value 70 deviations out is not skipped


def test_log_of_the_normal_tail(spark):
    x = [-300.0, -70.0, -40.0, -10.0, -7.2, -3.0, 0.0, 2.0, 40.0]
    got = [r.v for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.expr(log_phi_sql("x")).alias("v")).collect()]

    def exact(v):
        if v > -30:
            return math.log(0.5 * math.erfc(-v / math.sqrt(2)))
        s = sum((-1) ** k * math.prod(range(1, 2 * k, 2)) / v ** (2 * k) for k in range(6))
        return -0.5 * v * v - math.log(-v) - 0.5 * math.log(2 * math.pi) + math.log(s)
    assert got == pytest.approx([exact(v) for v in x], rel=1e-7, abs=1e-12)


def driver_rows(spark, n=600):
    rows = [(i, float(i % 17), float((i * 7) % 5), None, (1.0 if i % 17 > 8 else 0.0) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(rows, "contract_number long, driver double, noise double, empty double, pd_status_score double")


def test_forest_leaves_out_empty_columns_and_null_labels(spark):
    m = drivers.fit_drivers(driver_rows(spark), ["driver", "noise", "empty", "contract_number"], id_cols=["contract_number"])
    assert m.empty == ["empty"] and m.n_unlabelled == 12 and m.features == ["driver", "noise"]
    assert drivers.feature_importances(m).first().feature == "driver"
    by = {r.feature: r for r in drivers.permutation_importance(m).collect()}
    assert by["driver"].increase > 0.2 and abs(by["noise"].increase) < 0.05
    shap = {r.feature: r for r in drivers.shapley_summary(m).collect()}
    assert shap["driver"].rank == 1 and shap["noise"].mean_abs_contribution < 0.1 * shap["driver"].mean_abs_contribution


def test_reports_of_a_table_against_itself(spark):
    rows = [(float(i % 13), "ab"[i % 2], f"s{i % 5}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, g string, s string, k long")
    for r in evaluate.quality_report(df, df, ["x"], ["g", "s"]).collect() + evaluate.diagnostic_report(df, df, ["x"], ["g", "s"], ["k"]).collect():
        assert r.score == pytest.approx(1.0)
    other = df.withColumn("g", F.lit("a"))
    pairs = {(r.column_1, r.column_2): r.score for r in evaluate.column_pair_trends(df, other, ["x"], ["g", "s"]).collect()}
    assert pairs["x", "s"] == pytest.approx(1.0) and pairs["g", "s"] == pytest.approx(0.5) and set(pairs) == {("x", "g"), ("x", "s"), ("g", "s")}
    twice = df.union(df.where("k < 100"))
    assert evaluate.key_uniqueness(twice, ["k"]).first().score == pytest.approx(300 / 500)


def test_metadata_validation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, g string")
    meta = project.detect_metadata(df)
    assert project.validate_metadata(meta, ["row_id", "g"]).first().valid
    assert not project.validate_metadata(meta, ["row_id", "g", "other"]).first().valid


def test_broadcast_size_counts_arrays(spark):
    wide = spark.range(200).select("id", F.array_repeat(F.lit(1.0), 4097).alias("grid"))
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(sized_broadcast(wide)) and not hint(sized_broadcast(wide, 1_000_000))
    assert hint(bounded_broadcast(wide, 200, array_length=4097)) and not hint(bounded_broadcast(wide, 5000, array_length=4097))


def test_key_texts_do_not_collide(spark):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "x"), ("x", None)], "p string, q string")
    assert df.select(hash_u(1, "s", "p", "q").alias("u")).distinct().count() == 4


def test_null_flag_counts_as_performing(spark, tmp_path):
    import shutil
    for name in ("orders", "customer", "nation", "part"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path)
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").limit(500)
    lines.withColumn("l_returnflag", F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_returnflag"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    sources = contract_sources(spark, str(tmp_path))
    assert sum(df.count() for df in sources.values()) == 500


def test_ranks_of_one_value_are_dealt_to_several_tasks(spark):
    # 200,000 rows of one value, 500 rows of others: no task writes most of the ranks
    df = spark.range(200_500).select(F.lit("g").alias("__g"), F.when(F.col("id") < 200_000, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    ranks = copula.rank_table(df, "__g", ["x"])
    rows = [r["count"] for r in ranks.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(rows) == 200_500 and max(rows) < 0.7 * sum(rows)
    r = ranks.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.sum((F.col("x_lo") == 7).cast("int")),
                  F.sum((F.col("x_hi") == 7).cast("int")), F.max(F.when(F.col("rank") == 199_999, F.col("x_hi")))).first()
    assert tuple(r) == (200_500, 0, 200_499, 200_000, 199_999, 200_000.0)


@pytest.mark.parametrize("most", [0, 12, 2_000_000])
def test_group_sample_is_the_same_by_lookup_and_by_join(spark, most):
    # b has 4 values, a many; a null group, a group of one row and one of one value
    df = spark.range(400).select(F.when(F.col("id") < 5, F.lit(None)).when(F.col("id") == 5, "one").when(F.col("id") < 40, "flat").otherwise("g").alias("g"),
                                 F.when(F.col("id") < 40, 2.0).otherwise(hash_u(1, "x", "id")).alias("a"), (F.col("id") % 4).alias("b"))
    m = copula.fit_group_copula(df, ["g"], ["a", "b"])
    got = sorted(copula.sample_group_copula(m, steps_most=most).collect(), key=str)
    u = copula.correlated_uniforms(m.skeleton(), m.params, ["g"], 2, 453).collect()
    real = df.toPandas()
    want = []
    for r in u:
        own = real[real.g.isna()] if r.g is None else real[real.g == r.g]
        want.append((r.g, r.k, *[float(np.quantile(own[c], r[f"u_{i}"])) for i, c in enumerate("ab")]))
    want = sorted(want, key=lambda r: str((r[0], r[1])))
    got = sorted(got, key=lambda r: str((r[0], r[1])))
    assert len(got) == 400 and [tuple(r)[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([tuple(r)[2:] for r in got], [r[2:] for r in want], atol=1e-12)


def test_group_sample_of_few_values_shuffles_no_cells(spark):
    df = spark.range(400).select((F.col("id") % 3).alias("g"), hash_u(1, "x", "id").alias("a"), (F.col("id") % 4).alias("b"))
    plan = copula.sample_group_copula(copula.fit_group_copula(df, ["g"], ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
