"""Correlation statistics and the group-wise empirical
Gaussian copula.

Fit (per group of ``keys``)
    * group means, then one ``groupBy.agg`` of counts, bounds and the sums and
      cross products of the values less their group's mean (partial aggregation
      on every mapper, so a hot group never lands whole in a task; nothing
      cancels however large the values are) -> Pearson correlation with
      undefined -> 0 on every entry including the diagonal of constant columns
      (A6), plus a ridge of 1e-6 on the diagonal (C2), then the Cholesky factor
      (C3).  A matrix without a factor gets ten times the ridge until it has
      one; the ridge used is in the parameter table;
    * the empirical marginals as runs (``functions.packs``): each task sorts and counts the
      values of some rows by group and feature, and writes them in few bytes.

Sample
    * one synthetic row per real row of the group (numbers 0..n-1);
    * d correlated normals ``z = L e`` from hash draws (C4), ``u = Phi(z)``
      (C5), and the empirical quantile ``np.quantile`` style with
      ``h = (n-1) u``;
    * groups of up to ``GROUP_MOST`` rows are drawn where their values meet: the runs of a group and
      its parameters (J3) go to one task, which sorts each feature and looks the draws up.  This
      is the only shuffle, and no cell of a synthetic row is in it;
    * larger groups never meet in one task.  Their values are ranked as steps (group, feature, x,
      next x, count, running count) with the skew-safe scan (``scan.running_sums``).  Features whose
      steps are few (``STEPS_MOST`` in all, counted first) are looked up where the draws lie;
      the other features' cells go through an equi-join on (group, feature,
      floor(h)) (C6, J4) with the rank table (group, feature, rank, x_lo, x_hi) and are pivoted back
      to one row per synthetic record (C7).  Draws depend on keys only, so those of the features looked up
      are drawn behind the pivot.  Between these steps a group is a number and a feature another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import packs
from ..functions.normal import phi
from ..functions.rng import hash_u, key_text, normal_pairs, text_uniforms
from ..session import discard, materialize, shuffle_partitions
from .joins import join_null_safe, sized_broadcast
from .profile import is_missing
from .scan import running_sums

#: Ranks of a value that one row is expanded to at most.
RANK_BLOCK = 10_000
#: A value with no more ranks than this is expanded where it lies.
FEW_RANKS = 8
#: Steps (distinct values of a group's feature) that are sent to every task, 16 bytes each.
STEPS_MOST = 2_000_000
#: Rows of a group whose values meet in one task, 16 bytes for each distinct value of a feature.
GROUP_MOST = 3_000_000
#: Groups of fewer rows are taken together up to so many, and no more rows are drawn at once.
DRAWN_ROWS = 50_000
#: Synthetic rows of one partition.
ROWS_PER_PARTITION = 500_000
EPSILON = 1e-6
#: Rows whose cross products are summed at once.
PART_ROWS = 100_000


def pair_index(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with every feature present (the copula uses complete rows only)."""
    cond = None
    for f in features:
        c = ~is_missing(df, f)
        cond = c if cond is None else cond & c
    return df.where(cond)


def _part_moments(x: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    """(keys, __n, __p_i mean, __s_i and __q_i_j sums and cross products about it, __lo_i, __hi_i) of parts of each group.

    A part is what ``PART_ROWS`` neighbouring rows hold of a group, so a hot group is many parts.
    The sums over dozens of pairs are too long for one generated method: numpy takes them."""
    pairs = pair_index(d)

    def summed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        code = np.zeros(t.num_rows, np.int64)
        for k in range(len(keys)):
            c = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * max(1, len(c.dictionary)) + c.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        start = np.flatnonzero(np.diff(code[order], prepend=-1))
        n = np.diff(np.append(start, len(order)))
        v = [t.column(len(keys) + i).to_numpy()[order] for i in range(d)]
        with np.errstate(all="ignore"):
            mean = [np.add.reduceat(c, start) / n for c in v]
            dev = [c - np.repeat(m, n) for c, m in zip(v, mean, strict=True)]
            rest = [np.add.reduceat(c, start) for c in dev]  # what rounding left of the means
            cross = [np.add.reduceat(dev[i] * dev[j], start) for i, j in pairs]
        sums = [n.astype(np.int64), *mean, *rest, *[np.minimum.reduceat(c, start) for c in v], *[np.maximum.reduceat(c, start) for c in v], *cross]
        return pa.RecordBatch.from_arrays([*[t.column(k).combine_chunks().take(pa.array(order[start])) for k in range(len(keys))], *map(pa.array, sums)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= PART_ROWS:
                yield summed(held)
                held, rows = [], 0
        if held:
            yield summed(held)

    doubles = [*[f"__{c}{i}" for c in ("p", "s", "lo", "hi") for i in range(d)], *[f"__q{i}_{j}" for i, j in pairs]]
    schema = StructType([*x.schema.fields[:len(keys)], StructField("__n", LongType()), *[StructField(c, DoubleType()) for c in doubles]])
    names = schema.fieldNames()
    return x.mapInArrow(run, schema)


def correlation_stats(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """A5 + A6: per group ``n``, ``mean_i``, ``var_i`` and Pearson ``r_i_j`` (i <= j) of complete rows.

    One pass sums the cross products of each part of a group (``_part_moments``) about the
    part's own mean; the parts then meet about the group's mean, so sums stay as small as the spread is.
    ``np.corrcoef`` semantics with undefined -> 0: a column whose values are all
    equal has coefficient 0, the diagonal included; values are clipped to [-1, 1].
    """
    d, keys = len(features), list(keys)
    x = complete_rows(df, features).select(*keys, *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)])
    parts = materialize(_part_moments(x, keys, d), "part-moments")
    w = F.col("__n").cast("double")
    means = [F.try_divide(F.sum(w * F.col(f"__p{i}")), F.sum(w)).alias(f"__m{i}") for i in range(d)]
    if keys:
        parts = join_null_safe(parts, sized_broadcast(parts.groupBy(*keys).agg(*means)), keys)
    else:
        row = parts.agg(*means).first()
        parts = parts.withColumns({f"__m{i}": F.lit(row[f"__m{i}"]).cast("double") for i in range(d)})
    dx = [F.col(f"__p{i}") - F.col(f"__m{i}") for i in range(d)]
    items = [F.coalesce(F.sum("__n"), F.lit(0)).alias("n")]
    for i in range(d):
        items += [F.max(f"__m{i}").alias(f"m_{i}"), F.sum(F.col(f"__s{i}") + w * dx[i]).alias(f"s_{i}"), (F.max(f"__hi{i}") > F.min(f"__lo{i}")).alias(f"ok_{i}")]
    items += [F.sum(F.col(f"__q{i}_{j}") + F.col(f"__s{i}") * dx[j] + F.col(f"__s{j}") * dx[i] + w * dx[i] * dx[j]).alias(f"q_{i}_{j}") for i, j in pair_index(d)]
    stats = parts.groupBy(*keys).agg(*items)
    n = F.col("n").cast("double")

    def cov(i, j):
        return F.when(n > 1, (F.col(f"q_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / n) / (n - 1))

    stats = stats.withColumns({f"mean_{i}": F.when(n > 0, F.col(f"m_{i}") + F.col(f"s_{i}") / n) for i in range(d)}
                              | {f"var_{i}": F.greatest(cov(i, i), F.lit(0.0)) for i in range(d)})
    r = {}
    for i, j in pair_index(d):
        value = F.lit(1.0) if i == j else F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov(i, j) / (F.sqrt(f"var_{i}") * F.sqrt(f"var_{j}"))))
        defined = F.col(f"ok_{i}") & F.col(f"ok_{j}") & (F.col(f"var_{i}") > 0) & (F.col(f"var_{j}") > 0)
        r[f"r_{i}_{j}"] = F.when(defined, value).otherwise(F.lit(0.0))
    return stats.withColumns(r).select(*keys, "n", *[f"mean_{i}" for i in range(d)], *[f"var_{i}" for i in range(d)], *r)


def correlation_long(stats: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Correlation matrix as (keys..., row_feature, col_feature, rho), both triangles."""
    d = len(features)
    cells = []
    for i in range(d):
        for j in range(d):
            a, b = min(i, j), max(i, j)
            cells.append(F.struct(F.lit(features[i]).alias("row_feature"),
                                  F.lit(features[j]).alias("col_feature"),
                                  F.col(f"r_{a}_{b}").alias("rho")))
    return stats.select(*keys, F.explode(F.array(*cells)).alias("__c")).select(*keys, "__c.*")


def regularize(stats: DataFrame, d: int, eps: float = EPSILON) -> DataFrame:
    """``a_i_j`` = ``r_i_j`` plus ``eps`` on the diagonal."""
    return stats.withColumns({f"a_{i}_{j}": F.col(f"r_{i}_{j}") + (eps if i == j else 0.0) for i, j in pair_index(d)})


def _factor(a, eps: float):
    """Cholesky factor of a matrix that holds the ridge ``eps``, and the ridge it took.

    An indefinite matrix (e.g. of coefficients rounded elsewhere) gets ten times
    the ridge until it has a factor."""
    ridge = eps
    while True:
        try:
            return np.linalg.cholesky(a), ridge
        except np.linalg.LinAlgError:
            a = a + np.eye(len(a)) * 9 * ridge
            ridge *= 10


def cholesky(df: DataFrame, d: int, eps: float = EPSILON) -> DataFrame:
    """Add ``L_i_j`` (i >= j) and ``ridge`` for every row (one small matrix per group)."""
    pairs = pair_index(d)

    def run(batches):
        for pdf in batches:
            a = np.zeros((len(pdf), d, d))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = pdf[f"a_{i}_{j}"].to_numpy(dtype="float64")
            found = [_factor(x, eps) for x in a]
            for i, j in pairs:
                pdf[f"L_{j}_{i}"] = [f[j, i] for f, _ in found]
            pdf["ridge"] = [r for _, r in found]
            yield pdf[names]

    new = [*factor_columns(d), "ridge"]
    schema = StructType([f for f in df.schema.fields if f.name not in new] + [StructField(c, DoubleType()) for c in new])
    names = schema.fieldNames()
    return df.mapInPandas(run, schema)


def factor_columns(d: int) -> list[str]:
    return [f"L_{i}_{j}" for i in range(d) for j in range(i + 1)]


def cast_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features})


def rank_steps(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """(group, f, x, __next_x, c, cum), f = the feature's number: the distinct values in order, with running counts."""
    cells = cast_features(df, features).select(group, F.posexplode(F.array(*features)).alias("f", "x")).withColumn("f", F.col("f").cast("tinyint")).where(F.col("x").isNotNull())
    return _counted_steps(cells.groupBy(group, "f", "x").agg(F.count(F.lit(1)).alias("c")), group)


def _counted_steps(counts: DataFrame, group: str) -> DataFrame:
    return running_sums(counts, [group, "f"], ["x"], {"cum": "c"}, tag="copula-scan", next_of="x")


def value_runs(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """(group, f, runs): the values of each group and feature, sorted and counted by ``packs.SORT_ROWS`` rows where they lie."""
    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        own, code = np.unique(t.column(0).to_numpy(), return_inverse=True)
        for f in range(len(features)):
            for at, columns in packs.runs(*packs.distinct(code, t.column(1 + f).to_numpy() + 0.0)):  # no negative zero: it is the same value
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.full(len(at), f, np.int8)), *columns], names)

    names = [group, "f", *packs.RUN_COLUMNS]
    return cast_features(df, features).select(group, *features).mapInArrow(in_blocks(packed, packs.SORT_ROWS), f"{group} long, f byte, {packs.RUN_SCHEMA}")


def in_blocks(block: Callable[[list[pa.RecordBatch]], Iterable[pa.RecordBatch]], most: int):
    """mapInArrow body: ``block`` of the batches of about ``most`` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= most:
                yield from block(held)
                held, rows = [], 0
        if held:
            yield from block(held)
    return run


def rank_table(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """J4 support: (group, f, rank, x_lo, x_hi), f = the feature's number, x_hi = next order statistic."""
    return step_ranks(rank_steps(df, group, features), group)


def step_ranks(cum: DataFrame, group: str) -> DataFrame:
    """The rank table of ``rank_steps``."""
    # a value that occurs c times holds c ranks: they are written out in blocks, and
    # blocks of repeated values are dealt anew before, so that no value is one task's
    wide = cum.select(group, "f", "x", "__next_x", "cum", "c", (F.col("cum") - F.col("c")).alias("first"))
    blocks = wide.where(F.col("c") > FEW_RANKS).withColumn("first", F.explode(F.sequence("first", F.col("cum") - 1, F.lit(RANK_BLOCK).cast("long"))))
    blocks = blocks.repartition(shuffle_partitions(cum.sparkSession), group, "f", "first")
    spread = wide.where(F.col("c") <= FEW_RANKS).unionByName(blocks)
    last = F.least(F.col("first") + (RANK_BLOCK - 1), F.col("cum") - 1)
    ranked = spread.select(group, "f", "x", "__next_x", "cum", F.explode(F.sequence("first", last)).alias("rank"))
    return ranked.select(group, "f", "rank", F.col("x").alias("x_lo"),
                         F.when(F.col("rank") < F.col("cum") - 1, F.col("x")).otherwise(F.col("__next_x")).alias("x_hi"))


@dataclass
class GroupCopulaModel:
    keys: list[str]
    features: list[str]
    params: DataFrame      # keys, __g, n, mean_i, var_i, r_i_j, a_i_j, L_i_j, ridge
    values: DataFrame      # __g, f, and the columns of a run

    @property
    def steps(self) -> DataFrame:
        """(__g, f, x, __next_x, c, cum)."""
        return self._steps_of(self.values)

    def _steps_of(self, values: DataFrame) -> DataFrame:
        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 64):
                    part = b.slice(i, 64)
                    sizes, x, c = packs.values(part.columns[2:])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(k).to_numpy(), sizes)) for k in range(2)] + [pa.array(x), pa.array(c)], ["__g", "f", "x", "c"])

        cells = values.mapInArrow(unpacked, "__g long, f byte, x double, c long")
        return _counted_steps(cells.groupBy("__g", "f", "x").agg(F.sum("c").alias("c")), "__g")

    def parted(self, most: int) -> tuple[GroupCopulaModel | None, GroupCopulaModel | None]:
        """The model of the groups of up to ``most`` rows and that of the larger ones."""
        large = [r["__g"] for r in self.params.where(F.col("n") > most).select("__g").collect()]
        if not large:
            return self, None
        parts = [GroupCopulaModel(self.keys, self.features, *[t.where(cond) for t in (self.params, self.values)])
                 for cond in (~F.col("__g").isin(large), F.col("__g").isin(large))]
        return parts[0] if parts[0].params.count() else None, parts[1]

    @property
    def ranks(self) -> DataFrame:
        """(__g, f, rank, x_lo, x_hi)."""
        small, large = self.parted(GROUP_MOST)
        tables = [] if large is None else [step_ranks(large.steps, "__g")]
        return reduce(DataFrame.unionByName, tables if small is None else [_few_ranks(small), *tables])

    def skeleton(self) -> DataFrame:
        """(__g, k): one row for each real row of a group."""
        total = self.params.agg(F.sum("n")).first()[0] or 0
        parts = max(shuffle_partitions(self.params.sparkSession), -(-total // ROWS_PER_PARTITION))
        # groups are dealt in blocks, so that none is one task's
        blocks = self.params.select("__g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RANK_BLOCK).cast("long"))).alias("first"))
        blocks = blocks.repartition(parts, "__g", "first")
        return blocks.select("__g", F.explode(F.sequence("first", F.least(F.col("first") + (RANK_BLOCK - 1), F.col("n") - 1))).alias("k"))

    def named_ranks(self) -> DataFrame:
        """The rank table under the group's keys and the feature's name."""
        names = F.array(*[F.lit(f) for f in self.features])
        groups = sized_broadcast(self.params.select(*self.keys, "__g"))
        return self.ranks.join(groups, "__g").select(*self.keys, F.element_at(names, F.col("f") + 1).alias("feature"), "rank", "x_lo", "x_hi")


def fit_group_copula(df: DataFrame, keys: Sequence[str], features: Sequence[str], written: bool = False) -> GroupCopulaModel:
    """C1 fit: parameters and empirical marginals, both written once.

    ``written`` says that ``df`` is a written table that stays: it needs no second copy, nor do its values as runs."""
    keys, features = list(keys), list(features)
    d = len(features)
    # the source (often a multi-way join) is read once; three passes follow
    data = complete_rows(df, features).select(*keys, *features)
    data = data if written else materialize(data, "copula-input")
    params = cholesky(regularize(correlation_stats(data, keys, features), d), d)
    # a number stands for the keys of a group from here on: cells stay narrow in every shuffle
    params = materialize(params.withColumn("__g", F.monotonically_increasing_id()), "copula-params")
    coded = join_null_safe(data, sized_broadcast(params.select(*keys, "__g")), keys).select("__g", *features)
    values = value_runs(coded, "__g", features)
    if not written:
        values = materialize(values, "copula-values")
        discard(data)
    return GroupCopulaModel(keys, features, params, values)


def _normals(seed: int, texts: pa.Array, low: np.ndarray, d: int) -> np.ndarray:
    """C4: ``z = L e`` for the key texts of some rows and the columns of their factors (or of one for all)."""
    e = normal_pairs(text_uniforms(seed, "copula", texts, d + d % 2))
    z = np.zeros((d, len(texts)))
    for i in range(d):
        for m in range(i + 1):  # terms in the order of SQL
            z[i] += low[i * (i + 1) // 2 + m] * e[m]
    return z


def _drawn(skeleton: DataFrame, params: DataFrame, keys: Sequence[str], d: int, seed: int, carry: Sequence[str], names: Sequence[str],
           made: Callable[[pa.RecordBatch, np.ndarray], Iterable[np.ndarray]]) -> DataFrame:
    """(keys, __g, k, n), the carried columns and what ``made`` gives for the correlated normals ``z`` of a batch.

    The factor joins the rows (J3).  Draws and what follows are a chain of formulas too long for one
    generated method: numpy does it on Arrow batches.  The uniforms are those of ``with_uniforms``."""
    factor = params.select(*keys, "__g", "n", F.array(*factor_columns(d)).alias("__l"))
    joined = skeleton.join(sized_broadcast(factor), "__g").select(*keys, "__g", "k", "n", *carry, key_text([*keys, "k"]).alias("__t"), "__l")
    kept = len(keys) + 3 + len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            low = np.ascontiguousarray(b.column(kept + 1).flatten().to_numpy().reshape(b.num_rows, -1).T)
            z = _normals(seed, b.column(kept), low, d)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *[pa.array(v) for v in made(b, z)]], out_names)

    schema = StructType([*joined.schema.fields[:kept], *[StructField(c, DoubleType()) for c in names]])
    out_names = schema.fieldNames()
    return joined.mapInArrow(run, schema)


def correlated_normals(skeleton: DataFrame, params: DataFrame, keys: Sequence[str], d: int, seed: int, carry: Sequence[str] = ()) -> DataFrame:
    """C4: join the factor (J3) to (__g, k) rows and draw ``z = L e``: (keys, __g, k, n, z_i) and the carried columns."""
    return _drawn(skeleton, params, keys, d, seed, carry, [f"z_{i}" for i in range(d)], lambda b, z: z).select(
        *keys, "__g", "k", "n", *carry, *[f"z_{i}" for i in range(d)])


def correlated_uniforms(skeleton: DataFrame, params: DataFrame, keys: Sequence[str], d: int, seed: int, carry: Sequence[str] = ()) -> DataFrame:
    """C4 + C5: correlated draws mapped to ``u = Phi(z)``: (keys, __g, k, n, u_i) and the carried columns."""
    return _drawn(skeleton, params, keys, d, seed, carry, [f"u_{i}" for i in range(d)], lambda b, z: phi(z.ravel()).reshape(z.shape)).select(
        *keys, "__g", "k", "n", *carry, *[f"u_{i}" for i in range(d)])


def empirical_quantile(cells: DataFrame, ranks: DataFrame, value: str = "value") -> DataFrame:
    """``np.quantile``-style linear interpolation via the rank join.

    ``cells`` has __g, f, n, u and is returned with ``value``.
    """
    h = (F.col("n") - 1).cast("double") * F.col("u")
    pos = cells.withColumn("__h", h).withColumn("rank", F.floor("__h").cast("bigint"))
    pos = pos.withColumn("__frac", F.col("__h") - F.col("rank"))
    v = F.col("x_lo") + F.col("__frac") * (F.coalesce(F.col("x_hi"), F.col("x_lo")) - F.col("x_lo"))
    return pos.join(ranks, ["__g", "f", "rank"]).withColumn(value, v).drop("__h", "__frac", "x_lo", "x_hi")


def group_quantiles(model: GroupCopulaModel, seed: int, stream: str, group_most: int = GROUP_MOST) -> DataFrame:
    """C6 over whole groups: (keys, k, feature, value), each cell of ``skeleton`` x features at a draw of its own.

    The uniforms are ``hash_u(seed, stream, keys, k, feature)``.  Groups that meet in one task draw and look up
    there, the others go through the rank join of ``empirical_quantile``."""
    keys, feats = model.keys, model.features
    small, large = model.parted(group_most)
    tables = []
    if small is not None:
        def made(m: _Meeting) -> Iterator[list]:
            for own, k in m.rows():
                texts, at = m.texts(own, k), pa.array(own)
                named = [c.take(at) for c in m.keys]
                for f, s in zip(feats, m.steps, strict=True):
                    u = text_uniforms(seed, stream, pc.binary_join_element_wise(texts, f"{len(f)}={f}", ":"), 1, numbered=False)[0]
                    yield [*named, k, pa.repeat(f, len(k)), s.quantile(m.group[own], m.n[own], u)]

        fields = [model.params.schema[c] for c in keys]
        tables.append(_by_group(small, made, StructType([*fields, StructField("k", LongType()), StructField("feature", StringType()), StructField("value", DoubleType())])))
    if large is not None:
        base = large.skeleton().join(sized_broadcast(large.params.select(*keys, "__g", "n")), "__g")
        cells = base.select("*", F.posexplode(F.array(*[F.lit(f) for f in feats])).alias("f", "feature")).withColumn("f", F.col("f").cast("tinyint"))
        cells = cells.withColumn("u", hash_u(seed, stream, *keys, "k", "feature"))
        tables.append(empirical_quantile(cells, step_ranks(large.steps, "__g")).select(*keys, "k", "feature", "value"))
    return reduce(DataFrame.unionByName, tables)


@dataclass(frozen=True)
class _Steps:
    """One feature's steps of all groups, group after group; ``end`` counts through."""
    group: np.ndarray    # the groups' numbers, rising
    first: np.ndarray    # by group: rows before it
    last: np.ndarray     # by group: its last step
    x: np.ndarray
    end: np.ndarray

    def quantile(self, g: np.ndarray, n: np.ndarray, u: np.ndarray) -> np.ndarray:
        """``empirical_quantile`` of draws."""
        h = (n - 1).astype(float) * u
        rank = np.floor(h).astype(np.int64)
        low, high = self.neighbours(np.searchsorted(self.group, g), rank)
        return low + (h - rank) * (high - low)

    def neighbours(self, own: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order statistics at ``rank`` of the groups at ``own``, and the next ones (the last is its own)."""
        at = self.first[own] + rank
        i = at if len(self.end) == self.end[-1] else np.searchsorted(self.end, at, side="right")
        low = self.x[i]
        return low, np.where(at + 1 < self.end[i], low, self.x[np.minimum(i + 1, self.last[own])])


def _steps_of_runs(group: np.ndarray, x: np.ndarray, c: np.ndarray) -> _Steps:
    """The steps of one feature from its values in runs."""
    one = len(group) and group[0] == group[-1] and (group == group[0]).all()
    code, x, c = packs.distinct(None if one else group, x, c)
    code = group[:1].repeat(len(x)) if code is None else code
    own, start = np.unique(code, return_index=True)
    end = np.cumsum(c)
    return _Steps(own, np.concatenate(([0], end))[start], np.append(start[1:], len(x)) - 1, x, end)


@dataclass(frozen=True)
class _Meeting:
    """Some whole groups in one task: what the parameters hold of them, and their marginals."""
    group: np.ndarray              # the groups' numbers, rising
    n: np.ndarray                  # their rows
    low: np.ndarray                # their factors, a column each
    text: pa.Array                 # the texts of their keys
    keys: list[pa.Array]
    steps: list[_Steps]            # by feature

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(group's place, k) of the rows, some at a time."""
        end = np.cumsum(self.n)
        for first in range(0, int(end[-1]), DRAWN_ROWS):
            at = np.arange(first, min(first + DRAWN_ROWS, int(end[-1])))
            own = np.searchsorted(end, at, side="right")
            yield own, at - (end - self.n)[own]

    def texts(self, own: np.ndarray, k: np.ndarray) -> pa.Array:
        """``key_text`` of the keys and k."""
        k = pa.array(k).cast(pa.string())
        return pc.binary_join_element_wise(self.text.take(pa.array(own)), pc.binary_join_element_wise(pc.utf8_length(k).cast(pa.string()), k, "="), ":")


def _by_group(model: GroupCopulaModel, made: Callable[[_Meeting], Iterable[list]], schema: StructType) -> DataFrame:
    """What ``made`` gives for all groups: the runs of a group and its parameters go to one task."""
    keys, d = model.keys, len(model.features)
    heads = model.params.select("__g", F.lit(-1).cast("byte").alias("f"), F.col("n").alias("__n"), F.array(*factor_columns(d)).alias("__l"), key_text(keys).alias("__t"), *keys)
    runs = model.values.unionByName(heads, allowMissingColumns=True).select("__g", "f", *packs.RUN_COLUMNS, "__n", "__l", "__t", *keys)
    total = model.params.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(model.params.sparkSession), -(-total // ROWS_PER_PARTITION))
    names = schema.fieldNames()

    def met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = [b.column(1).to_numpy() for b in held]
        heads = pa.Table.from_batches([b.filter(pa.array(v < 0)) for b, v in zip(held, f, strict=True)]).combine_chunks()
        steps = []
        for i in range(d):
            found = [(b.column(0).to_numpy()[v == i], *packs.values(b.filter(pa.array(v == i)).columns[2:6])) for b, v in zip(held, f, strict=True)]
            steps.append(_steps_of_runs(np.concatenate([np.repeat(g, sizes) for g, sizes, _, _ in found]), *[np.concatenate([r[k] for r in found]) for k in (2, 3)]))
        column = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in heads.columns]
        low = np.ascontiguousarray(column[7].flatten().to_numpy().reshape(heads.num_rows, -1).T)
        for out in made(_Meeting(column[0].to_numpy(), column[6].to_numpy(), low, column[8], column[9:], steps)):
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            at = np.flatnonzero(b.column(1).to_numpy() < 0)
            sizes, first = b.column(6).take(pa.array(at)).to_numpy().tolist(), 0
            for i, n in zip(at.tolist(), sizes, strict=True):
                if rows and rows + n > DRAWN_ROWS:  # a head is its group's first row
                    yield from met([*held, b.slice(first, i - first)])
                    held, rows, first = [], 0, i
                rows += n
            held.append(b.slice(first))
        if rows:
            yield from met(held)

    return runs.repartition(parts, "__g").sortWithinPartitions("__g", "f").mapInArrow(run, schema)


def _few_ranks(model: GroupCopulaModel) -> DataFrame:
    """The rank table of groups that meet in one task."""
    def made(m: _Meeting) -> Iterator[list]:
        for own, k in m.rows():
            g = m.group[own]
            for f, s in enumerate(m.steps):
                low, high = s.neighbours(own, k)
                yield [g, np.full(len(g), f, np.int8), k, low, pa.array(high, mask=k == m.n[own] - 1)]

    return _by_group(model, made, StructType([StructField("__g", LongType()), StructField("f", ByteType()), StructField("rank", LongType()),
                                              StructField("x_lo", DoubleType()), StructField("x_hi", DoubleType())]))


def _few_steps(steps: DataFrame, most: int) -> dict[int, _Steps]:
    """The features with the fewest steps, together at most ``most``, by number."""
    sizes = sorted((r["count"], r["f"]) for r in steps.groupBy("f").count().collect())
    chosen, total = [], 0
    for size, f in sizes:
        total += size
        if total <= most:
            chosen.append(f)
    out = {}
    if not chosen:
        return out
    table = steps.where(F.col("f").isin(chosen)).select("f", "__g", "x", "cum").toArrow()
    own = table.column("f").to_numpy()
    for f in chosen:
        g, x, cum = (table.column(c).to_numpy()[own == f] for c in ("__g", "x", "cum"))
        order = np.lexsort((cum, g))
        g, x, cum = g[order], x[order], cum[order]
        group, start = np.unique(g, return_index=True)
        last = np.append(start[1:], len(g)) - 1
        first = np.concatenate(([0], np.cumsum(cum[last])))[:-1]
        out[f] = _Steps(group, first, last, x, cum + np.repeat(first, last - start + 1))
    return out


def sample_group_copula(model: GroupCopulaModel, seed: int = 453, steps_most: int = STEPS_MOST, group_most: int = GROUP_MOST) -> DataFrame:
    """C1 sample: as many synthetic rows per group as real ones (C7 layout)."""
    small, large = model.parted(group_most)
    if small is None:
        return _sample_by_ranks(large, seed, steps_most)
    d = len(model.features)

    def made(m: _Meeting) -> Iterator[list]:
        for own, k in m.rows():
            z = _normals(seed, m.texts(own, k), m.low if len(m.group) == 1 else m.low[:, own], d)
            at = pa.array(own)
            yield [*[c.take(at) for c in m.keys], k, *[s.quantile(m.group[own], m.n[own], phi(z[i])) for i, s in enumerate(m.steps)]]

    fields = [model.params.schema[c] for c in model.keys]
    met = _by_group(small, made, StructType([*fields, StructField("k", LongType()), *[StructField(f, DoubleType()) for f in model.features]]))
    return met if large is None else met.unionByName(_sample_by_ranks(large, seed, steps_most))


def _sample_by_ranks(model: GroupCopulaModel, seed: int, steps_most: int) -> DataFrame:
    """The sample of groups of any size, by lookups of steps and a join of cells with the rank table."""
    keys, feats, d = model.keys, model.features, len(model.features)
    steps = model.steps
    few = _few_steps(steps, steps_most)
    many = [i for i in range(d) if i not in few]
    rows, names = model.skeleton(), [f"__v{i}" for i in many]
    if many:
        u = correlated_uniforms(rows, model.params, keys, d, seed)
        cells = u.select("__g", "k", "n", F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("f"), F.col(f"u_{i}").alias("u")) for i in many])).alias("c")).select("__g", "k", "n", "c.*")
        valued = empirical_quantile(cells, step_ranks(steps, "__g"))
        rows = valued.groupBy("__g", "k").agg(*[F.max(F.when(F.col("f") == i, F.col("value"))).alias(v) for i, v in zip(many, names, strict=True)])
    if not few:
        wide = rows.join(sized_broadcast(model.params.select(*keys, "__g")), "__g")
        return wide.select(*keys, "k", *[F.col(f"__v{i}").alias(f) for i, f in enumerate(feats)])
    shared, at = model.params.sparkSession.sparkContext.broadcast(few), len(keys)

    def looked_up(b: pa.RecordBatch, z: np.ndarray) -> list[np.ndarray]:
        g, n = b.column(at).to_numpy(), b.column(at + 2).to_numpy()
        return [steps.quantile(g, n, phi(z[i])) for i, steps in shared.value.items()]

    wide = _drawn(rows, model.params, keys, d, seed, names, [f"__v{i}" for i in few], looked_up)
    return wide.select(*keys, "k", *[F.col(f"__v{i}").alias(f) for i, f in enumerate(feats)])


def with_position(sample: DataFrame, model: GroupCopulaModel, name: str = "position") -> DataFrame:
    """A sample's rows counted through in the order of (keys, k): the rows of the groups before, and k."""
    starts = running_sums(model.params.select(*model.keys, "n"), [], model.keys, {"__cum": "n"}, tag="group-starts")
    starts = sized_broadcast(starts.select(*model.keys, (F.col("__cum") - F.col("n")).alias("__start")))
    return join_null_safe(sample, starts, model.keys).withColumn(name, F.col("__start") + F.col("k")).drop("__start")


def group_copula(df: DataFrame, keys: Sequence[str], features: Sequence[str],
                 seed: int = 453) -> DataFrame:
    """Fit + sample in one call."""
    return sample_group_copula(fit_group_copula(df, keys, features), seed)


def frobenius_distance(corr_a: DataFrame, corr_b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """sqrt(sum((a - b)^2)) of two long correlation tables (per group if keys)."""
    on = list(keys) + ["row_feature", "col_feature"]
    a = corr_a.withColumnRenamed("rho", "__a")
    b = corr_b.withColumnRenamed("rho", "__b")
    j = a.join(b, on, "full_outer")
    diff = F.coalesce(F.col("__a"), F.lit(0.0)) - F.coalesce(F.col("__b"), F.lit(0.0))
    return j.groupBy(*keys).agg(F.sqrt(F.sum(diff * diff)).alias("frobenius"))
