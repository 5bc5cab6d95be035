"""M1-M4: which columns drive default, as one Spark ML pipeline.

* M1 mean imputation (``ml.feature.Imputer``); features without any value in the
  training part can't be imputed: they are left out and reported in ``empty``;
* M2 random-forest regression on the 0/1 label with the label and the
  identifiers excluded from the features (the reference had both among them),
  split by a stable hash (W7) and scored on the held-out part (RMSE, AUC); rows
  without a label can't be learnt from: they are left out and counted in
  ``n_unlabelled``;
* M3 impurity importances, ranked (W4);
* M4 permutation importance on the held-out rows: each row's donor is the next row
  in a seeded hash order (one ordinal scan, one equi-join for all features); every
  (row, feature) hybrid is scored in one pass, and the RMSE increase is reported;
* M4 Shapley values: Monte Carlo over feature orders (each also backwards, which cancels
  much of the noise) and backgrounds from the held-out rows, averaged for each row
  before any absolute value is taken, with standard errors.  This replaces the
  tree-SHAP summary (a per-model algorithm).  A forest's predictions on the way from a
  background to a row are those of the pipeline, read off bit masks of the leaves that a
  feature's value leaves open (``_Forest``); other models predict every hybrid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.rng import hash_u
from ..session import materialize, shuffle_partitions
from .profile import train_test_split
from .scan import ordinal


#: Backgrounds and pairs of feature orders of a row's Shapley values.
PAIRS = 4
#: Held-out rows of one partition of Shapley values: their sums stay in memory.
ROWS_PER_PARTITION = 25_000


@dataclass
class DriverModel:
    features: list[str]
    model: PipelineModel
    train: DataFrame
    test: DataFrame
    label: str
    empty: list[str]
    n_unlabelled: int


def fit_drivers(df: DataFrame, features: Sequence[str], label: str = "pd_status_score",
                id_cols: Sequence[str] = ("contract_number",), seed: int = 0,
                num_trees: int = 20, max_depth: int = 5) -> DriverModel:
    """M1 + M2: impute, assemble, fit the forest on the 75% hash split."""
    features = [f for f in features if f != label and f not in id_cols]
    data = df.select(*id_cols, label, *[F.col(f).cast("double").alias(f) for f in features])
    data = train_test_split(data, list(id_cols), seed=seed)
    data = materialize(data, "drivers-input")
    unlabelled = data.where(F.col(label).isNull()).count()
    data = data.where(F.col(label).isNotNull())
    train = data.where("is_train").drop("is_train")
    test = data.where(~F.col("is_train")).drop("is_train")
    present = train.agg(*[F.count(F.when(~F.isnan(f), F.col(f))).alias(f) for f in features]).first()
    empty = [f for f in features if not present[f]]
    features = [f for f in features if present[f]]
    if not features:
        raise ValueError("no feature has any value in the training part")
    imputed = [f"{f}__imp" for f in features]
    pipe = Pipeline(stages=[
        Imputer(strategy="mean", inputCols=list(features), outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="__features", handleInvalid="keep"),
        RandomForestRegressor(featuresCol="__features", labelCol=label, predictionCol="prediction",
                              numTrees=num_trees, maxDepth=max_depth, seed=seed),
    ])
    model = pipe.fit(train)
    return DriverModel(list(features), model, train, test, label, empty, unlabelled)


def evaluate_drivers(m: DriverModel) -> DataFrame:
    """M2 scores on the held-out rows: (n_train, n_test, rmse, auc)."""
    pred = m.model.transform(m.test)
    rmse = RegressionEvaluator(labelCol=m.label, predictionCol="prediction", metricName="rmse").evaluate(pred)
    auc = BinaryClassificationEvaluator(labelCol=m.label, rawPredictionCol="prediction",
                                        metricName="areaUnderROC").evaluate(pred)
    spark = m.test.sparkSession
    return spark.createDataFrame([(m.train.count(), m.test.count(), float(rmse), float(auc))],
                                 "n_train bigint, n_test bigint, rmse double, auc double")


def feature_importances(m: DriverModel) -> DataFrame:
    """(feature, importance, rank) with rank 1 the most important."""
    rf = m.model.stages[-1]
    imp = rf.featureImportances.toArray()
    rows = sorted(zip(m.features, [float(v) for v in imp]), key=lambda t: (-t[1], t[0]))
    spark = m.test.sparkSession
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def _with_donor(m: DriverModel, seed: int, id_col: str) -> tuple[DataFrame, int]:
    """Held-out rows with ``d_<feature>``: the values of the next row in hash order."""
    test = m.test.withColumn("__h", hash_u(seed, "perm", id_col))
    test = materialize(ordinal(test, [], ["__h", id_col], "__pos"), "perm-order")
    n = test.count()
    donor = test.select(((F.col("__pos") + n - 1) % F.lit(n)).alias("__pos"), *[F.col(f).alias(f"d_{f}") for f in m.features])
    return test.join(donor, "__pos"), n


def _predict(m: DriverModel, df: DataFrame, values: dict, out: str) -> DataFrame:
    """Add the model's prediction for the given feature values; all columns stay."""
    keep = df.columns
    scored = m.model.transform(df.withColumns({f"__own_{f}": F.col(f) for f in m.features}).withColumns(values))
    return scored.select(*[F.col(f"__own_{c}").alias(c) if c in m.features else F.col(c) for c in keep], F.col("prediction").alias(out))


def permutation_importance(m: DriverModel, seed: int = 7, id_col: str = "contract_number") -> DataFrame:
    """M4: (feature, rmse_base, rmse_permuted, increase)."""
    rows, _ = _with_donor(m, seed, id_col)
    rows = _predict(m, rows, {}, "__base")
    cells = rows.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in m.features])))
    hybrid = {f: F.when(F.col("feature") == f, F.col(f"d_{f}")).otherwise(F.col(f)) for f in m.features}
    scored = _predict(m, cells, hybrid, "__permuted")
    err = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col(m.label), 2)))
    out = scored.groupBy("feature").agg(err("__base").alias("rmse_base"), err("__permuted").alias("rmse_permuted"))
    return out.withColumn("increase", F.col("rmse_permuted") - F.col("rmse_base"))


#: Leaves of a tree at most, and draws whose masks are held at once.
MASK_BITS = 32
MASK_ROWS = 2_000
#: A power of two times this has its exponent in the top five bits, by ``_PLACE``.
_SPREAD = np.uint32(0x077CB531)
_PLACE = np.zeros(32, np.int64)
_PLACE[[(0x077CB531 << i & 0xFFFFFFFF) >> 27 for i in range(32)]] = np.arange(32)


@dataclass(frozen=True)
class _Forest:
    """A regression forest as masks: which leaves of each tree a feature's value leaves open.

    The leaf that a row reaches is the only one that all of its features leave open."""
    fill: np.ndarray                   # what the imputer puts for missing values
    at: list[np.ndarray]               # by feature: the thresholds, rising
    open: list[np.ndarray]             # by feature: masks, values between two thresholds x trees
    leaves: np.ndarray                 # predictions, trees x places of ``_SPREAD`` products

    def masks(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """Features x rows x trees."""
        out = []
        for i, c in enumerate(columns):
            x = c.to_numpy(zero_copy_only=False).astype(float)
            x = np.where(np.isnan(x), self.fill[i], x)
            out.append(self.open[i][np.searchsorted(self.at[i], x, side="left")])  # a value at a threshold goes left
        return np.stack(out)

    def predict(self, mask: np.ndarray) -> np.ndarray:
        """Predictions of rows x trees; trees are summed in their order."""
        place = (mask * _SPREAD) >> np.uint32(27)
        total = np.zeros(len(mask))
        for t, leaves in enumerate(self.leaves):
            total += leaves[place[:, t]]
        return total / len(self.leaves)

    def values(self, own: np.ndarray, other: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shapley values of the masks ``own`` against ``other`` on one order forwards and backwards (features x rows), and both predictions."""
        d, n, _ = own.shape
        rows = np.arange(n)
        none = np.full(own.shape[1:], 0xFFFFFFFF, np.uint32)

        def met(masks: np.ndarray, places: Sequence[int]) -> list[np.ndarray]:
            out = [none]
            for j in places:
                out.append(out[-1] & masks[order[:, j], rows])
            return out

        # what the first and the last features of the order leave open
        own_first, other_first = met(own, range(d)), met(other, range(d))
        own_last, other_last = met(own, range(d)[::-1]), met(other, range(d)[::-1])
        p = [self.predict(own_first[s] & other_last[d - s]) for s in range(d + 1)]
        by_place = np.zeros((d, n))
        for s in range(d + 1):
            if s in (0, d):
                half = p[s] * (0.5 if s else -0.5)
                if d == 1:
                    half = half + half
                for j in {0, d - 1}:
                    by_place[j] += half
            else:
                by_place[s - 1] += 0.5 * p[s]
                by_place[s] += -0.5 * p[s]
        for s in range(1, d):
            q = self.predict(own_last[s] & other_first[d - s])
            by_place[d - s] += 0.5 * q
            by_place[d - s - 1] += -0.5 * q
        out = np.empty((d, n))
        for j in range(d):
            out[order[:, j], rows] = by_place[j]
        return out, p[d], p[0]


def _forest(m: DriverModel) -> _Forest | None:
    """The masks of the pipeline of ``fit_drivers``; none for other models and for trees of more than ``MASK_BITS`` leaves."""
    stages = getattr(m.model, "stages", [])
    if [type(s).__name__ for s in stages] != ["ImputerModel", "VectorAssembler", "RandomForestRegressionModel"]:
        return None
    paths: list[list[tuple[float, list[tuple[int, float, bool]]]]] = []

    def walk(node, way: list[tuple[int, float, bool]]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            paths[-1].append((node.prediction(), way))
            return
        split = node.split()
        f, threshold = split.featureIndex(), split.threshold()
        walk(node.leftChild(), [*way, (f, threshold, True)])
        walk(node.rightChild(), [*way, (f, threshold, False)])

    for tree in stages[2].trees:
        paths.append([])
        walk(tree._call_java("rootNode"), [])
    if max(map(len, paths)) > MASK_BITS:
        return None
    at = [np.unique([x for tree in paths for _, way in tree for g, x, _ in way if g == f]) for f in range(len(m.features))]
    masks = [np.full((len(v) + 1, len(paths)), 0xFFFFFFFF, np.uint32) for v in at]
    leaves = np.zeros((len(paths), 32))
    for t, tree in enumerate(paths):
        for bit, (value, way) in enumerate(tree):
            leaves[t, bit] = value
            for f, x, left in way:
                k = int(np.searchsorted(at[f], x))
                closed = slice(k + 1, None) if left else slice(0, k + 1)
                masks[f][closed, t] &= np.uint32(0xFFFFFFFF ^ 1 << bit)
        for f in range(len(at)):
            masks[f][:, t] &= np.uint32((1 << len(tree)) - 1)
        leaves[t] = leaves[t][_PLACE]
    if not masks:
        return None
    fill = stages[0].surrogateDF.first()
    return _Forest(np.array([fill[f] for f in m.features], float), at, masks, leaves)


def _forest_draws(forest: _Forest, draws: DataFrame, feats: Sequence[str], id_col: str) -> DataFrame:
    """(id, __pos, __t, v_i, __own, __other) of each draw: a row, one of its backgrounds and an order ``__o``.

    The draws of a row, which lie in one partition, follow each other."""
    d = len(feats)
    sent = draws.sortWithinPartitions("__pos", "__t").select(id_col, "__pos", "__t", "__o", *feats, *[f"d_{f}" for f in feats])
    schema = StructType([*sent.schema.fields[:3], *[StructField(c, DoubleType()) for c in [*[f"v_{i}" for i in range(d)], "__own", "__other"]]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, MASK_ROWS):
                b = whole.slice(first, MASK_ROWS)
                order = b.column(3).flatten().to_numpy().reshape(b.num_rows, d)
                v, own, other = forest.values(forest.masks(b.columns[4:4 + d]), forest.masks(b.columns[4 + d:]), order)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, v), pa.array(own), pa.array(other)], names)

    return sent.mapInArrow(run, schema)


def _predicted_draws(m: DriverModel, draws: DataFrame, id_col: str, key: str) -> DataFrame:
    """(key, __t, __id, v_i, __own, __other) of any model: every hybrid on the way is predicted."""
    d, feats = len(m.features), m.features
    # both directions share their ends: step 0 is the background, step d the row itself
    way = draws.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(2 * d - 1))))
    forward = F.col("__s") <= d
    own = F.when(forward, F.slice("__o", 1, F.col("__s"))).otherwise(F.slice("__o", F.lit(2 * d + 1) - F.col("__s"), F.col("__s") - d))
    way = way.withColumn("__own", own)
    hybrid = {f: F.when(F.array_contains("__own", i), F.col(f)).otherwise(F.col(f"d_{f}")) for i, f in enumerate(feats)}
    scored = _predict(m, way, hybrid, "__p")
    # a prediction is added for the feature that came last and taken off for the one that comes next;
    # at the ends, the background and the row itself, it counts for both directions
    step, o, size, p = F.col("__s"), F.col("__o"), F.size("__own"), F.col("__p")
    at = lambda k: F.try_element_at(o, k.cast("int"))
    ends = (step == 0) | (step == d)
    scored = scored.select(id_col, "__pos", "__t", "__p", "__s", F.when(step == 0, -0.5).otherwise(0.5).alias("__c1"), F.when(step == d, 0.5).otherwise(-0.5).alias("__c2"),
                           F.when(ends, at(F.lit(1))).when(forward, at(size)).otherwise(at(d - size + 1)).alias("__f1"),
                           F.when(ends, at(F.lit(d))).when(forward, at(size + 1)).otherwise(at(d - size)).alias("__f2"))
    share = lambda i, k: F.when(F.col(f"__f{k}") == i, F.col(f"__c{k}") * p).otherwise(0.0)
    return scored.groupBy(key, "__t").agg(F.first(id_col).alias("__id"), *[F.sum(share(i, 1) + share(i, 2)).alias(f"v_{i}") for i in range(d)],
                                         F.sum(F.when(step == d, p)).alias("__own"), F.sum(F.when(step == 0, p)).alias("__other"))


def _row_means(drawn: DataFrame, d: int) -> DataFrame:
    """(__id, a_i, e_i, prediction, base) of rows whose draws follow each other: means and standard errors over them."""
    schema = StructType([StructField("__id", drawn.schema[0].dataType), *[StructField(c, DoubleType()) for c in [*[f"{k}_{i}" for k in "ae" for i in range(d)], "prediction", "base"]]])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            pos = b.column(1).to_numpy()
            last = int(np.flatnonzero(pos == pos[-1])[0])  # more draws of the last row may follow
            held = b.slice(last)
            if last:
                yield means(b.slice(0, last))
        if held is not None:
            yield means(held)

    def means(b: pa.RecordBatch) -> pa.RecordBatch:
        start = np.flatnonzero(np.diff(b.column(1).to_numpy(), prepend=-1))
        n = np.diff(np.append(start, b.num_rows))
        columns = [c.to_numpy() for c in b.columns[3:]]
        mean = [np.add.reduceat(c, start) / n for c in columns]
        with np.errstate(all="ignore"):
            error = [np.sqrt(np.add.reduceat((c - np.repeat(m, n)) ** 2, start) / (n - 1)) / np.sqrt(n) for c, m in zip(columns[:d], mean, strict=False)]
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(start)), *map(pa.array, mean[:d]), *[pa.array(e, mask=n < 2) for e in error], *map(pa.array, mean[d:])], names)

    return drawn.mapInArrow(run, schema)


def _named_values(rows: DataFrame, feats: Sequence[str], id_col: str) -> DataFrame:
    """(id, feature, value, sampling_error, prediction, base) of rows with a_i, e_i."""
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a_{i}").alias("value"), F.col(f"e_{i}").alias("sampling_error")) for i, f in enumerate(feats)]))
    # rows without an identifier give none
    return rows.where("__id is not null").select(F.col("__id").alias(id_col), "prediction", "base", cells).select(id_col, "feature", "value", "sampling_error", "prediction", "base")


def shapley_values(m: DriverModel, seed: int = 11, id_col: str = "contract_number", pairs: int = PAIRS,
                   orders: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """M4: (id, feature, value, sampling_error, prediction, base), one row for each held-out row and feature.

    A row has ``pairs`` backgrounds (held-out rows at even distances in a seeded hash order)
    and as many feature orders, each gone through forwards and backwards.  On the way
    from the background to the row its features are swapped in one by one; a feature's value
    is the mean change of the prediction at its turn, signs kept.  Steps cancel along an
    order, so a row's values add up to its ``prediction`` less ``base``, the mean prediction of its
    backgrounds.  ``sampling_error`` is the standard error over the pairs (null for one pair).
    ``orders`` (permutations of the features' numbers) replaces the sampled ones: with all of them
    the values are exact for the backgrounds.  All predictions are made in one pass."""
    d, feats = len(m.features), m.features
    test = m.test.withColumn("__h", hash_u(seed, "perm", id_col))
    test = materialize(ordinal(test, [], ["__h", id_col], "__pos"), "shap-order")
    n = test.count()
    count = len(orders) if orders is not None else pairs
    stride = max(1, n // (count + 1))
    # a background knows the rows that it serves, so rows and backgrounds meet in one shuffle by position
    donors = test.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("__t"), "__pos", *[F.col(f).alias(f"d_{f}") for f in feats])
    donors = donors.withColumn("__pos", F.pmod(F.col("__pos") - 1 - F.col("__t") * stride, F.lit(n)))
    parts = max(shuffle_partitions(test.sparkSession), -(-n // ROWS_PER_PARTITION))
    draws = test.select(id_col, "__pos", *feats).repartition(parts, "__pos").join(donors.repartition(parts, "__pos"), "__pos")
    # what follows stays where the rows lie, but for identifiers that repeat: those are one
    single = test.select(id_col).distinct().count() == n
    if orders is None:
        turns = [F.struct(F.xxhash64(F.lit(seed), F.col("__t"), F.lit(f), F.col(id_col).cast("string")).alias("h"), F.lit(i).alias("i"))
                 for i, f in enumerate(feats)]
        order = F.transform(F.array_sort(F.array(*turns)), lambda x: x["i"])
    else:
        order = F.element_at(F.array(*[F.array(*[F.lit(int(i)) for i in o]) for o in orders]), F.col("__t") + 1)
    draws, key = draws.withColumn("__o", order), "__pos" if single else id_col
    forest = _forest(m)
    if forest is not None:
        drawn = _forest_draws(forest, draws, feats, id_col)
        if single:  # a row's draws lie together
            return _named_values(_row_means(drawn, d), feats, id_col)
        drawn = drawn.groupBy(key, "__t")
        one = drawn.agg(F.first(id_col).alias("__id"), *[F.sum(f"v_{i}").alias(f"v_{i}") for i in range(d)], F.sum("__own").alias("__own"), F.sum("__other").alias("__other"))
    else:
        one = _predicted_draws(m, draws, id_col, key)
    error = lambda v: F.stddev_samp(v) / F.sqrt(F.count(F.lit(1))) if count > 1 else F.lit(None).cast("double")
    rows = one.groupBy(key).agg(F.first("__id").alias("__id"), *[x for i in range(d) for x in (F.avg(f"v_{i}").alias(f"a_{i}"), error(f"v_{i}").alias(f"e_{i}"))],
                                F.avg("__own").alias("prediction"), F.avg("__other").alias("base"))
    return _named_values(rows, feats, id_col)


def shapley_summary(m: DriverModel, seed: int = 11, id_col: str = "contract_number", pairs: int = PAIRS) -> DataFrame:
    """M4: (feature, mean_abs_contribution, mean_contribution, standard_error, sampling_error, rank).

    Each row's draws are averaged before the absolute value is taken.  ``standard_error`` is that
    of the mean over rows, ``sampling_error`` the mean error of a row's value."""
    out = shapley_values(m, seed, id_col, pairs).groupBy("feature").agg(
        F.avg(F.abs("value")).alias("mean_abs_contribution"), F.avg("value").alias("mean_contribution"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp(F.abs("value")) / F.sqrt(F.count(F.lit(1)))).alias("standard_error"), F.avg("sampling_error").alias("sampling_error"))
    place = Window.orderBy(F.desc("mean_abs_contribution"), "feature")  # one row for each feature
    return out.withColumn("rank", F.row_number().over(place))
