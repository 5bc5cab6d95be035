"""Draws on arrays, decimals without text, identifiers and tuples that are counted once."""

import hashlib

import numpy as np
import pytest
from facsimile.functions.rng import id_uniforms, with_uniforms
from facsimile.operators import constraints, parametric
from pyspark.sql import functions as F


def test_array_draws_are_the_digests(spark):
    ids = [0, 9, 10, 99, 100, 12345, 10 ** 9, 2 ** 40, 10 ** 18, 2 ** 63 - 1]
    got = id_uniforms(453, "parametric", np.array(ids), 5)
    for j, i in enumerate(ids):
        for k in range(5):
            text = hashlib.md5(f"453:parametric:{k // 2}:{len(str(i))}={i}".encode()).hexdigest()
            assert got[k, j] == (int(text[16 * (k % 2):][:13], 16) + 0.5) / 2 ** 52
    names = [f"u{i}" for i in range(5)]
    rows = with_uniforms(spark.createDataFrame([(i,) for i in ids], "id long"), 453, "parametric", ["id"], names).collect()
    assert [[r[n] for n in names] for r in rows] == got.T.tolist()
    with pytest.raises(ValueError):
        id_uniforms(1, "x" * 60, np.array([1]), 1)


def test_decimals_are_those_of_the_text(spark):
    rng = np.random.default_rng(3)
    whole = rng.integers(-10 ** 9, 10 ** 9, 4000)
    values = [0.0, -0.0, 1e22, 2.0 ** 52, 2.0 ** 53 + 2, 4503599627370495.5, 0.1 + 0.2, 1.25e-7, 1 / 3, *(whole[:3000] / 10.0 ** (np.arange(3000) % 6)), *(whole[3000:] / 7.0)]
    want = []
    for v in values:
        mantissa, _, power = repr(abs(float(v))).partition("e")
        want.append(max(0, len(mantissa.partition(".")[2].rstrip("0")) - int(power or 0)))
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, x double")
    assert [r[0] for r in rows.orderBy("i").select(parametric.decimals_of(F.col("x"))).collect()] == want


def test_sample_from_a_later_row(spark):
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), F.concat(F.lit("c"), F.col("id") % 3).alias("b"))
    m = parametric.fit_parametric_copula(rows, ["a", "b"], {"a": "norm"})
    whole = sorted(parametric.sample_parametric_copula(m, 300).collect())
    parts = [parametric.sample_parametric_copula(m, 100), parametric.sample_parametric_copula(m, 200, first_id=100)]
    assert sorted(parts[0].unionByName(parts[1]).collect()) == whole


def test_identifiers_are_hashed_behind_the_join(spark):
    ids = spark.createDataFrame([(2, "b", "x"), (1, "a", None)], "n long, m string, o string")
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "id long, v double")
    sha = lambda v: None if v is None else hashlib.sha256(str(v).encode()).hexdigest()
    got = constraints.reattach_ids(rows, ids, ["id"], ["n"], ["m", "o"], position="id").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, sha("a"), None), (1, 2.0, sha("b"), sha("x")), (2, 3.0, None, None)]
    # the sort and the join see the identifiers, not their digests
    plan = constraints.reattach_ids(rows, ids, ["id"], ["n"], ["m", "o"], position="id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("Join")


def test_tuples_with_counts_are_checked_once(spark):
    real = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    s = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), (None, 1, 4)], "k string, v long, n long")
    bad = constraints.fixed_combinations_check(s, real, ["k", "v"], ["n"])
    assert bad.agg(F.sum("n")).first()[0] == 7
    assert constraints.fixed_combinations_check(s, real, ["k", "v"]).columns == ["k", "v"]
