"""Mixed-type copula, stored models, Shapley values and the bootstrap on small fixtures."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.operators import constraints, drivers, evaluate, latent, marginals, parametric, store


def mixed_rows(n=3000):
    """Two numbers, a date, two categories and a tied pair; y, the second category and the gaps follow x."""
    r = np.random.default_rng(4)
    x = r.gamma(2.0, 10.0, n)
    y = x + r.normal(0, 3.0, n)
    rows = []
    for i in range(n):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=int(r.integers(0, 1000)))
        kind = "high" if x[i] > 25 else "low"
        gap = x[i] > 30 and r.random() < 0.8
        rows.append((float(round(x[i], 2)), None if gap else float(y[i]), None if gap else int(x[i]), day, kind, None if r.random() < 0.1 else f"c{min(int(r.exponential(1.5)), 6)}",
                     i % 7 // 3, f"name{i % 7 // 3}", float(x[i] + r.normal(0, 3.0))))
    return rows


SCHEMA = "x double, y double, k int, day date, kind string, code string, tied_id int, tied_name string, w double"


@pytest.fixture(scope="module")
def mixed(spark):
    real = spark.createDataFrame(mixed_rows(), SCHEMA)
    fams = {"x": "gamma", "y": "norm", "k": "gamma", "w": "norm"}
    m = parametric.fit_parametric_copula(real, real.columns, fams, combinations=[["tied_id", "tied_name"]])
    return real.toPandas(), m, parametric.sample_parametric_copula(m, 20000)


def test_types_shares_and_ties(spark, mixed):
    real, m, s = mixed
    assert s.columns == ["id", *SCHEMA.replace(",", "").split()[0::2]]
    assert [t for _, t in s.dtypes][1:] == [t for t in SCHEMA.replace(",", "").split()[1::2]]
    got = s.toPandas()
    assert len(got) == 20000
    for c in ("kind", "code", "tied_id"):
        a, b = real[c].value_counts(normalize=True, dropna=False), got[c].value_counts(normalize=True, dropna=False)
        assert set(map(str, a.index)) == set(map(str, b.index))
        assert np.allclose(a.sort_index().values, b.sort_index().values, atol=0.015)
    assert set(zip(got.tied_id, got.tied_name)) == set(zip(real.tied_id, real.tied_name))
    assert got.day.min() >= real.day.min() and got.day.max() <= real.day.max()
    assert np.allclose(got.x, got.x.round(2))


def test_missing_shares_and_their_dependence(mixed):
    real, m, s = mixed
    got = s.toPandas()
    assert set(m.nullable) == {"y", "k"}
    for c in ("y", "k"):
        assert abs(got[c].isna().mean() - real[c].isna().mean()) < 0.01
    # gaps come together, and with large x
    both = lambda d: (d.y.isna() & d.k.isna()).mean() / d.y.isna().mean()
    assert both(real) == 1.0 and both(got) > 0.9
    assert got.x[got.y.isna()].mean() > 1.5 * got.x[~got.y.isna()].mean()


def test_dependence_between_kinds(mixed):
    real, _, s = mixed
    got = s.toPandas()
    assert abs(got[["x", "w"]].corr(method="spearman").iloc[0, 1] - real[["x", "w"]].corr(method="spearman").iloc[0, 1]) < 0.08
    high = lambda d: d.x[d.kind == "high"].mean() / d.x[d.kind == "low"].mean()
    assert abs(math.log(high(got) / high(real))) < 0.25


def test_sample_does_not_depend_on_partitions(spark, mixed):
    _, m, _ = mixed
    a, b = (parametric.sample_parametric_copula(m, 700, num_partitions=p).orderBy("id").toPandas() for p in (1, 5))
    assert a.equals(b)


def test_latent_correlation_inverts_the_scores():
    """Scores of simulated normals, cut into categories, give back the normals' correlation."""
    r = np.random.default_rng(0)
    n = 400_000
    cuts = [np.array([-math.inf, -0.3, 0.9, math.inf]), np.array([-math.inf, 0.7, math.inf])]
    nd = [[0.5 * math.erfc(-c / math.sqrt(2)) for c in cut] for cut in cuts]
    dens = lambda z: 0.0 if math.isinf(z) else math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    for rho in (-0.8, 0.3, 0.9):
        e = r.normal(size=(2, n))
        z = [e[0], rho * e[0] + math.sqrt(1 - rho * rho) * e[1]]
        score, moments = [], []
        for zz, cut, p in zip(z, cuts, nd, strict=True):
            mean = np.array([(dens(a) - dens(b)) / (q - w) for a, b, w, q in zip(cut, cut[1:], p, p[1:])])
            score.append(mean[np.searchsorted(cut[1:-1], zz)])
            c = latent._hermite_sums(mean, cut[:-1], cut[1:])
            c[latent.TERMS] = np.sum(mean ** 2 * np.diff(p))
            moments.append(c)
        assert abs(latent.latent_correlation(np.corrcoef(score)[0, 1], *moments) - rho) < 0.01
        assert abs(latent.latent_correlation(np.corrcoef(score[0], z[1])[0, 1], moments[0], latent.continuous_moments()) - rho) < 0.01


def test_interval_lookup_finds_every_category(spark):
    """One category holds most of the line, hundreds share a corner of it."""
    rows = [("hot",)] * 5000 + [(f"r{i}",) for i in range(300)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "c string")
    t = latent.category_intervals(df, ["c"], len(rows))
    u = spark.range(0, 5303).select(((F.col("id") + 0.5) / 5303.0).alias("u"), "id")
    got = latent.interval_lookup(u, "u", t, ["c"]).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {"hot": 5000, None: 3} | {f"r{i}": 1 for i in range(300)}


def test_columns_without_values_and_small_tables(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, None, None), (4.0, None, "a"), (None, None, "b")], "x double, none double, c string")
    m = parametric.fit_parametric_copula(df, df.columns, {"x": "norm"})
    s = parametric.sample_parametric_copula(m, 200).toPandas()
    assert s.none.isna().all() and set(s.c.dropna()) == {"a", "b"} and s.x.isna().any()
    cats = parametric.fit_parametric_copula(df, ["c"])
    assert parametric.sample_parametric_copula(cats, 50).count() == 50


def test_combination_weights_follow_the_rows(spark):
    real = spark.createDataFrame([("a", 1)] * 90 + [("b", 2)] * 10, "p string, q int")
    s = constraints.sample_combinations(spark.range(4000), real, ["p", "q"], "id", 3).groupBy("p", "q").count().collect()
    assert {(r.p, r.q) for r in s} == {("a", 1), ("b", 2)}
    assert abs(next(r["count"] for r in s if r.p == "a") / 4000 - 0.9) < 0.02


def test_store_keeps_versions_and_samples(spark, mixed, tmp_path):
    _, m, _ = mixed
    path = f"file://{tmp_path}/models"
    assert store.versions(spark, path) == []
    assert store.save_model(m, path) == 1 and store.save_model(m, path) == 2
    (tmp_path / "models" / "v00007").mkdir()  # an interrupted version
    assert store.versions(spark, path) == [1, 2] and store.save_model(m, path) == 8
    a = parametric.sample_parametric_copula(m, 500).orderBy("id").collect()
    assert parametric.sample_parametric_copula(store.load_model(spark, path, 1), 500).orderBy("id").collect() == a
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, path, 7)


def test_long_keys_stay_whole(spark):
    k = constraints.dense_keys(spark.createDataFrame([(5,), (10 ** 13,), (10 ** 13 + 1,)], "n long"), "n")
    assert [r.contract_number for r in k.orderBy("n").collect()] == ["SYN-000000000005", "SYN-10000000000000", "SYN-10000000000001"]


def test_no_family_has_a_statistic_without_a_fit(spark):
    df = spark.createDataFrame([(float(i % 5), 3.0) for i in range(50)], "x double, constant double")
    got = marginals.fit_summary(df, ["x", "constant"]).where("column_name = 'constant'").collect()
    assert len(got) == len(marginals.fitted_families(marginals.FAMILIES_WIDE))
    assert all(r.ks is None and r.pvalue is None and r.loglik is None and r.sse is None for r in got)


def test_bootstrap_keeps_shapes_and_loses_ties(spark, mixed):
    real, _, _ = mixed
    df = spark.createDataFrame(mixed_rows(), SCHEMA)
    b = parametric.independent_bootstrap(df, ["x", "y"], 6000).toPandas()
    assert set(b.x.dropna()) <= set(real.x) and abs(b.y.isna().mean() - real.y.isna().mean()) < 0.03
    assert abs(b[["x", "y"]].corr().iloc[0, 1]) < 0.05 and abs(b.x.mean() / real.x.mean() - 1) < 0.05


def test_candidates_are_ranked(spark):
    real = spark.createDataFrame([(float(i), float(2 * i)) for i in range(60)], "a double, b double")
    out = evaluate.compare_candidates(real, {"same": real, "shifted": real.select((F.col("a") + 40).alias("a"), (-F.col("b")).alias("b"))}, ["a", "b"]).collect()
    assert {(r["method"], r["rank"]) for r in out} == {("same", 1), ("shifted", 2)} and len(out) == 6


# --- Shapley values -------------------------------------------------------------------

class Formula:
    """Stands in for a fitted pipeline: a prediction from a SQL expression."""

    def __init__(self, sql):
        self.sql = sql

    def transform(self, df):
        return df.withColumn("prediction", F.expr(self.sql))


def shapley_model(spark, sql, n=24):
    r = np.random.default_rng(8)
    rows = [(f"r{i:02d}", *[float(v) for v in r.normal(size=3).round(3)]) for i in range(n)]
    schema = T.StructType([T.StructField("contract_number", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in "abc"])
    test = spark.createDataFrame(rows, schema)
    return drivers.DriverModel(list("abc"), Formula(sql), test, test, "label", [], 0)


def test_shapley_equals_enumeration(spark):
    """All orders of three features, against the sum over subsets with the same backgrounds."""
    sql = "CASE WHEN a > 0 THEN b * c ELSE 2 * b END + a * a"
    f = lambda a, b, c: (b * c if a > 0 else 2 * b) + a * a
    m = shapley_model(spark, sql)
    orders = list(itertools.permutations(range(3)))
    got = {(r.contract_number, r.feature): r for r in drivers.shapley_values(m, orders=orders).collect()}
    from facsimile.functions.rng import hash_u
    rows = m.test.withColumn("h", hash_u(11, "perm", "contract_number")).orderBy("h", "contract_number").collect()
    n, stride = len(rows), max(1, len(rows) // 7)
    for pos, r in enumerate(rows):
        phi, base = np.zeros(3), []
        for t, order in enumerate(orders):
            back = rows[(pos + 1 + t * stride) % n]
            base.append(f(back.a, back.b, back.c))
            for o in (order, order[::-1]):
                x = [back.a, back.b, back.c]
                for i in o:
                    before = f(*x)
                    x[i] = r["abc"[i]]
                    phi[i] += (f(*x) - before) / (2 * len(orders))
        for i, c in enumerate("abc"):
            g = got[r.contract_number, c]
            assert abs(g.value - phi[i]) < 1e-9
            assert abs(g.prediction - f(r.a, r.b, r.c)) < 1e-9 and abs(g.base - np.mean(base)) < 1e-9
        assert abs(phi.sum() - (f(r.a, r.b, r.c) - np.mean(base))) < 1e-9


def test_shapley_of_a_linear_model_needs_no_luck(spark):
    m = shapley_model(spark, "3 * a - 2 * b + 0 * c")
    got = {r.feature: r for r in drivers.shapley_summary(m, pairs=3).collect()}
    assert got["c"].mean_abs_contribution < 1e-12 and got["c"]["rank"] == 3
    assert all(got[c].standard_error > 0 for c in "ab")


def test_shapley_values_meet_in_one_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = drivers.shapley_values(shapley_model(spark, "2 * a + b", 60), pairs=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # rows and backgrounds by position; nothing behind the predictions
    assert plan.count("Exchange hashpartitioning(__pos") == 2 and plan.count("Exchange") == 2
