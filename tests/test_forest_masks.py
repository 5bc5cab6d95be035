"""Shapley values of a forest from masks of open leaves, against predictions of every hybrid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.functions.rng import hash_u
from facsimile.operators import drivers


def _model(spark, features, repeated=0, **kinds):
    # missing and repeated values, a constant, an identifier of several rows
    df = spark.range(400).select(F.when(F.col("id") < repeated, "same").otherwise(F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 7 > 0, hash_u(1, "x", "id")).alias("x"),
                                 (F.col("id") % 4).cast("double").alias("y"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.round(hash_u(2, "y", "id"), 1)).alias("w"), F.lit(3.0).alias("c"),
                                 (hash_u(3, "y", "id") + F.col("id") % 4 > 1.5).cast("double").alias("label"))
    return drivers.fit_drivers(df, features, "label", ["id"], **kinds)


def _rows(df):
    return sorted(((r.id, r.feature, r.value, r.sampling_error, r.prediction, r.base) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("features,repeated,pairs", [("xywc", 0, 4), ("xyw", 30, 2), ("y", 0, 1)])
def test_masks_give_the_values_of_predictions(spark, monkeypatch, features, repeated, pairs):
    m = _model(spark, list(features), repeated, num_trees=5)
    assert drivers._forest(m) is not None
    monkeypatch.setattr(drivers, "MASK_ROWS", 30)
    got = _rows(drivers.shapley_values(m, id_col="id", pairs=pairs))
    plan = drivers.shapley_values(m, id_col="id", pairs=pairs)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(drivers, "_forest", lambda m: None)
    want = _rows(drivers.shapley_values(m, id_col="id", pairs=pairs))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 50
    for i in (2, 3, 4, 5):
        assert [r[i] is None for r in got] == [r[i] is None for r in want]
        np.testing.assert_allclose([r[i] or 0.0 for r in got], [r[i] or 0.0 for r in want], atol=1e-12)
    assert "MapInArrow" in plan and "UDF" not in plan


def test_trees_of_many_leaves_predict(spark, monkeypatch):
    m = _model(spark, ["x", "y", "w"], num_trees=2)
    monkeypatch.setattr(drivers, "MASK_BITS", 2)
    assert drivers._forest(m) is None
