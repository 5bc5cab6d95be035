"""Values shuffled as runs: what they hold, groups that meet in one task, and what is left on disk."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facsimile.functions import packs
from facsimile.functions.rng import hash_u
from facsimile.operators import copula, evaluate
from facsimile.session import materialize


@pytest.mark.parametrize("x", [[], [3.0], [-np.inf, -1e300, -1.5, 0.0, 5e-324, 1.5, np.inf], list(np.round(np.random.default_rng(1).normal(0, 50, 3000), 2) + 0.0)])
def test_runs_hold_every_value_and_count(x, monkeypatch):
    monkeypatch.setattr(packs, "RUN_VALUES", 7)
    x = np.array(x * 3 + x[:1] * 300)
    code = np.arange(len(x)) % 4
    want = packs.distinct(code, x)
    found = [(np.repeat(g, packs.values(c)[0]), *packs.values([v.slice(0) for v in c])[1:]) for g, c in packs.runs(*want)]
    got = packs.distinct(*[np.concatenate([r[i] for r in found]) if found else np.zeros(0) for i in range(3)])
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert want[2].sum() == len(x)


def _grouped(spark):
    # a has as many values as rows, b four; a null group, one of a single row and one of a single value
    return spark.range(600).select(F.when(F.col("id") < 5, F.lit(None)).when(F.col("id") == 5, "öne").when(F.col("id") < 40, "flat").when(F.col("id") < 200, "g").otherwise("h").alias("g"),
                                   F.when(F.col("id") < 40, -0.0).otherwise(hash_u(1, "x", "id") - 0.5).alias("a"), (F.col("id") % 4).alias("b"))


def _sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r[:3])))


@pytest.mark.parametrize("most", [0, 100, 200])
def test_groups_in_one_task_and_by_ranks_are_the_same(spark, monkeypatch, most):
    """groups of more rows than a task takes go through the rank join."""
    monkeypatch.setattr(packs, "SORT_ROWS", 50)
    monkeypatch.setattr(packs, "RUN_VALUES", 8)
    m = copula.fit_group_copula(_grouped(spark), ["g"], ["a", "b"])
    for make in (lambda most: copula.sample_group_copula(m, steps_most=0, group_most=most), lambda most: copula.group_quantiles(m, 453, "c6", most)):
        want, got = _sorted(make(10_000)), _sorted(make(most))
        assert len(want) == len(got) and [r[:2] for r in got] == [r[:2] for r in want]
        assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want], abs=1e-12)
    steps, ranks = copula.step_ranks(m.steps, "__g"), m.ranks
    assert _sorted(ranks.select(steps.columns)) == _sorted(steps) and ranks.count() == 1200


def test_quantiles_of_cells_are_those_of_numpy(spark):
    m = copula.fit_group_copula(_grouped(spark), ["g"], ["a", "b"])
    got = copula.group_quantiles(m, 453, "c6").withColumn("u", hash_u(453, "c6", "g", "k", "feature")).collect()
    real = _grouped(spark).toPandas()
    own = {g: real[real.g.isna() if g is None else real.g == g] for g in {r.g for r in got}}
    assert len(got) == 1200 and np.allclose([r.value for r in got], [np.quantile(own[r.g][r.feature], r.u) for r in got], atol=1e-12)


def test_sample_of_many_values_shuffles_no_cells(spark):
    """features with many values were joined to the rank table cell by cell."""
    m = copula.fit_group_copula(_grouped(spark), ["g"], ["a", "b"])
    for df in (copula.sample_group_copula(m, steps_most=0), copula.group_quantiles(m, 453, "c6")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "md5(" not in plan


def test_statistics_shuffle_runs(spark, monkeypatch):
    """every value of both tables was a row of its own in the shuffle."""
    monkeypatch.setattr(evaluate, "RANGE_VALUES", 300)
    a = spark.range(2000).select(hash_u(1, "x", "id").alias("x"))
    b = spark.range(1500).select(F.pow(hash_u(2, "x", "id"), 2).alias("x"))
    ranged, owner = evaluate._ranged([a, b], [0, 0], 3500)
    assert len(owner) > 8 and ranged.count() < 300 and sum(r["size"] for r in ranged.collect()) == 3500
    u, v = (np.sort([r.x for r in df.collect()]) for df in (a, b))
    every = np.concatenate((u, v))
    want = np.abs(np.searchsorted(u, every, side="right") / 2000 - np.searchsorted(v, every, side="right") / 1500).max()
    assert evaluate.ks_two_sample(a, b, ["x"]).first().statistic == pytest.approx(want, abs=1e-12)


def test_a_written_table_leaves_no_shuffle_files(spark):
    """What was shuffled for a written table stayed on disk beside all that followed."""
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    df = materialize(spark.range(1000).repartition(3, "id"), "left")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and df.count() == 1000


@pytest.mark.parametrize("few", [1, 250, 2_000_000])
def test_bootstrap_draws_ranks_of_the_sorted_values(spark, monkeypatch, few):
    """every cell of the bootstrap was joined to a table of all ranks and met its row in a third shuffle."""
    from facsimile.operators import parametric

    monkeypatch.setattr(parametric, "STEPS_MOST", few)
    monkeypatch.setattr(parametric, "BLOCK_ROWS", 170)
    monkeypatch.setattr(evaluate, "RANGE_VALUES", 100)
    df = spark.range(1000).select(F.when(F.col("id") % 7 > 0, hash_u(1, "x", "id")).alias("x"), (F.col("id") % 4).alias("y"), F.lit(None).cast("double").alias("z"),
                                  F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.round(hash_u(2, "y", "id"), 2)).alias("w"))
    out = parametric.independent_bootstrap(df, ["x", "y", "z", "w"], 900)
    got = {r.id: r for r in out.withColumns({f"u{f}": hash_u(77, "bootstrap", "id", f"CAST({f} AS TINYINT)") for f in range(4)}).collect()}
    assert sorted(got) == list(range(900)) and "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    real = df.toPandas()
    for f, c in enumerate("xyzw"):
        known = np.sort(real[c].dropna().to_numpy(float))
        for r in got.values():
            rank = int(r[f"u{f}"] * 1000)
            assert r[c] == (known[rank] if rank < len(known) else None)


def test_candidates_do_not_lie_beside_each_other(spark, monkeypatch):
    """all candidates were written before the first report."""
    written, gone = [], []
    keep, drop = evaluate.materialize, evaluate.discard
    monkeypatch.setattr(evaluate, "materialize", lambda df, tag="stage": written.append((tag, len(gone))) or keep(df, tag))
    monkeypatch.setattr(evaluate, "discard", lambda df: gone.append(1) or drop(df))
    real = spark.createDataFrame([(float(i), float(2 * i)) for i in range(60)], "a double, b double")
    out = evaluate.compare_candidates(real, {"same": real, "half": real.select(F.col("a") / 2, F.col("b") / 2).toDF("a", "b"), "also": real}, ["a", "b"])
    assert [n for tag, n in written if tag == "candidate"] == [0, 1, 2] and len(gone) == 3
    assert {(r["method"], r["rank"]) for r in out.collect()} == {("also", 1), ("same", 2), ("half", 3)}


def test_few_categories_are_looked_up_where_the_draws_lie(spark, monkeypatch):
    """F8: three joins of every row, and the normal CDF as a generated method."""
    from facsimile.operators import parametric

    df = spark.range(500).select(hash_u(1, "x", "id").alias("x"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("s"),
                                 (F.col("id") % 2 == 0).alias("b"), F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id") % 7).alias("t"))
    m = parametric.fit_parametric_copula(df, df.columns, categorical=["k"], combinations=[["s", "t"]])
    got = parametric.sample_parametric_copula(m, 3000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    monkeypatch.setattr(parametric, "INTERVALS_MOST", 0)
    want = parametric.sample_parametric_copula(m, 3000)
    assert got.dtypes == want.dtypes and got.orderBy("id").collect() == want.orderBy("id").collect()


def test_intervals_leave_no_second_table(spark):
    """the ranked tuples stayed on disk beside their intervals."""
    import os

    from facsimile.operators import latent
    from facsimile.session import checkpoint_root

    root = checkpoint_root(spark).removeprefix("file:") + "/facsimile"
    latent.category_intervals(spark.range(50).select((F.col("id") % 9).alias("c")), ["c"], 50, "only-intervals")
    assert sum(n.startswith("only-intervals") for n in os.listdir(root)) == 1


def test_rows_are_drawn_beside_their_identifiers(spark):
    """rows and identifiers met in a join of whole rows."""
    from facsimile.operators import constraints, parametric

    df = spark.range(300).select(hash_u(1, "x", "id").alias("x"), F.concat(F.lit("s"), F.col("id") % 3).alias("s"))
    ids = spark.range(300).select(F.when(F.col("id") > 4, F.col("id") % 50).alias("a"), F.concat(F.lit("c"), F.col("id")).alias("b"))
    m = parametric.fit_parametric_copula(df, df.columns)
    got = constraints.reattach_ids(lambda at: parametric.sample_parametric_copula(m, 300, ids=at), ids, ["id"], ["a", "b"], ["a", "b"], position="id")
    want = constraints.reattach_ids(parametric.sample_parametric_copula(m, 300), ids, ["id"], ["a", "b"], ["a", "b"], position="id")
    assert got.dtypes == want.dtypes and got.orderBy("id").collect() == want.orderBy("id").collect()
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().split("old_b")[0] and "FullOuter" not in got._jdf.queryExecution().executedPlan().toString()
