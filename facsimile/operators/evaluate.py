"""Compare a real and a synthetic table.

Every statistic is computed from an unpivoted (column_name, side, x) cell table
so all columns share one scan and one shuffle.  Order statistics (KS, AD) spread a
column's values over ranges (``_ranged``): a column with billions of distinct
values is never sorted in one task.

Definitions (documented where they are ours):
* KS two-sample: D = max |F_real - F_synth| over the pooled distinct values;
  p-value from the Kolmogorov limit Q(lambda), lambda = sqrt(n m / (n + m)) D.
* Anderson-Darling vs normal: standardise with mean and sample std,
  A2 = -N - 1/N sum_j [(2j-1) ln Phi(w_j) + (2N-2j+1) ln Phi(-w_j)], with
  the usual critical values scaled by 1 + 4/N - 25/N^2.
* Moments: mean, sample variance, bias-corrected skewness G1 and excess
  kurtosis G2 (the pandas / DuckDB conventions).
* Quality report: Column Shapes = 1 - KS D (numeric) or 1 - total variation
  (categorical); Column Pair Trends = 1 - |rho_real - rho_synth| / 2 for two
  numeric columns, else 1 - total variation of the pair's joint shares, a numeric
  column being cut into ``PAIR_BINS`` bins of the real range; overall = mean of
  the two property averages.
* Diagnostic: boundary adherence (numeric), category adherence (categorical),
  key uniqueness (of the synthetic key, if one is named) and table structure
  (columns shared by name and type); overall = mean of the validity and
  structure properties.

A constant column has no Anderson-Darling statistic (null).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.normal import log_phis
from ..session import discard, materialize, shuffle_partitions
from .copula import PART_ROWS, correlation_long, correlation_stats, in_blocks
from .joins import bounded_broadcast
from .profile import is_missing

# Anderson-Darling critical values for the normal case at the
# 15%, 10%, 5%, 2.5%, 1% levels (before the small-sample factor).
AD_LEVELS = [15.0, 10.0, 5.0, 2.5, 1.0]
AD_CRITICAL = [0.576, 0.656, 0.787, 0.918, 1.092]
KS_TERMS = 20


def cells(df: DataFrame, cols: Sequence[str], side: int | None = None) -> DataFrame:
    """(column_name, x[, side]) for the non-missing numeric cells of ``cols``."""
    wide = df.select(*[F.when(~is_missing(df, c), F.col(c).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "column_name", "x").where(F.col("x").isNotNull())
    return long if side is None else long.withColumn("side", F.lit(side))


def kolmogorov_sf_sql(lam: str, terms: int = KS_TERMS) -> str:
    """Q(lambda) = 2 sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), clipped to [0, 1]; null for null."""
    series = " + ".join(f"{'-' if k % 2 == 0 else ''}exp(-2.0 * {k * k}.0 * {lam} * {lam})"
                        for k in range(1, terms + 1))
    return (f"(CASE WHEN {lam} IS NULL THEN NULL WHEN {lam} < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * ({series}))) END)")


def ks_two_sample(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E5: (column_name, statistic, pvalue, n_real, n_synth)."""
    stat = _ks_gaps(real, synth, cols)
    lam = F.sqrt(F.col("n_r").cast("double") * F.col("n_s") / (F.col("n_r") + F.col("n_s"))) * F.col("statistic")
    return (stat.withColumn("__lam", lam)
            .withColumn("pvalue", F.expr(kolmogorov_sf_sql("__lam")))
            .select("column_name", "statistic", "pvalue",
                    F.col("n_r").cast("bigint").alias("n_real"),
                    F.col("n_s").cast("bigint").alias("n_synth")))


#: Rows of all tables that are read to place the ranges of ``_ranged``.
RANGE_ROWS = 40_000
#: Values of a range, about; they are sorted in one task.
RANGE_VALUES = 2_000_000


def _ranged(sides: Sequence[DataFrame], places: Sequence[int], n_rows: int) -> tuple[DataFrame, list[int]]:
    """``range_runs`` with a part's values in one task, by one shuffle."""
    both, owner = range_runs(sides, places, n_rows)
    return both.repartitionById(len(owner), "part"), owner


def range_runs(sides: Sequence[DataFrame], places: Sequence[int], n_rows: int) -> tuple[DataFrame, list[int]]:
    """(part, side, run), and the number of each part's column.

    Column i of ``sides[s]`` is column ``places[s]`` + i.  Values are sorted and counted where they lie as
    runs (``functions.packs``) of parts, ranges of a column's values placed on some rows of it:
    where they are placed decides the parts' sizes only."""
    spark, most = sides[0].sparkSession, max(p + len(df.columns) for p, df in zip(places, sides, strict=True))
    seen: list[list[np.ndarray]] = [[] for _ in range(most)]
    for place, df in zip(places, sides, strict=True):
        some = (df.sample(RANGE_ROWS / n_rows, 7) if n_rows > RANGE_ROWS else df).toArrow()
        for i, column in enumerate(some.columns):
            seen[place + i].append(column.drop_null().to_numpy() + 0.0)
    known = [np.unique(np.concatenate(v)) for v in seen]
    every = [np.sort(np.concatenate(v)) for v in seen]
    total = max(1, sum(map(len, known)))
    values = n_rows * sum(len(k) / len(e) for k, e in zip(known, every, strict=True) if len(e))
    parts = max(shuffle_partitions(spark), -(-int(values) // RANGE_VALUES))
    bounds, owner = [], []
    for f in range(most):
        k = max(1, round(parts * len(known[f]) / total))
        at = np.unique(every[f][np.arange(1, k) * len(every[f]) // k]) if k > 1 else np.empty(0)
        bounds.append((len(owner), at))
        owner += [f] * (len(at) + 1)

    def counted(side: int, place: int):
        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, column in enumerate(pa.Table.from_batches(held).columns):
                # no negative zero: it is the same value
                _, x, c = packs.distinct(None, column.drop_null().to_numpy() + 0.0)
                first, at = bounds[place + i]
                for part, columns in packs.runs(first + np.searchsorted(at, x, side="right"), x, c):
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), side, np.int8)), *columns], ["part", "side", *packs.RUN_COLUMNS])
        return in_blocks(block, packs.SORT_ROWS)

    both = reduce(lambda a, b: a.unionByName(b), [df.mapInArrow(counted(s, place), f"part int, side byte, {packs.RUN_SCHEMA}")
                                                  for s, (df, place) in enumerate(zip(sides, places, strict=True))])
    return both, owner


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, values, their counts by side) of the parts of a task: side 0 a column, the others another."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for b in batches:
        part, side = b.column(0).to_numpy(), b.column(1).to_numpy()
        for k in np.unique(part).tolist():
            own = part == k
            sizes, x, c = packs.values(b.filter(pa.array(own)).columns[2:])
            found.setdefault(k, []).append((x, c, np.repeat(side[own] > 0, sizes)))
    while found:
        k, rows = found.popitem()
        x, c, other = (np.concatenate(v) for v in zip(*rows, strict=True))
        order = np.argsort(x, kind="stable")
        x, c, other = x[order], c[order], other[order]
        start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        yield k, x[start], np.add.reduceat(np.where(other, 0, c), start), np.add.reduceat(np.where(other, c, 0), start)


def _numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.when(~is_missing(df, c), F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(cols)])


def _ks_gaps(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_r, n_s, statistic) by one shuffle of ``_ranged`` values.

    A part gives one row: its counts and the least and the greatest difference of the shares up to
    a value inside it.  The difference before the part, known from the counts, shifts both, so the
    sorted values are not written."""
    sides = [_numbers(df, cols) for df in (real, synth)]
    totals = [df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns]).first() for df in sides]
    n_r, n_s = (np.array(t[1:], float) for t in totals)
    ranged, owner = _ranged(sides, [0, 0], sum(t[0] for t in totals))

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for k, _, of_r, of_s in _parts(batches):
            r, s = np.cumsum(of_r), np.cumsum(of_s)
            with np.errstate(all="ignore"):
                d = r / n_r[owner[k]] - s / n_s[owner[k]]
            rows.append((owner[k], k, int(r[-1]), int(s[-1]), float(d.min()), float(d.max())))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["f", "part", "r", "s", "low", "high"])

    chunks = ranged.mapInArrow(gaps, "f int, part int, r long, s long, low double, high double")
    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    names = real.sparkSession.createDataFrame([(i, c, int(n_r[i]), int(n_s[i])) for i, c in enumerate(cols)], "f int, column_name string, n_r long, n_s long")
    shift = F.try_divide(F.coalesce(F.sum("r").over(before), F.lit(0)), "n_r") - F.try_divide(F.coalesce(F.sum("s").over(before), F.lit(0)), "n_s")
    # there is no difference where a side has no value at all
    inside = chunks.join(bounded_broadcast(names, len(cols)), "f").withColumn("shift", shift).where(F.col("low") <= F.col("high"))
    gap = F.greatest(F.abs(F.col("shift") + F.col("low")), F.abs(F.col("shift") + F.col("high")))
    return names.where("n_r + n_s > 0").drop("f").join(inside.groupBy("column_name").agg(F.max(gap).alias("statistic")), "column_name", "left")


def moments(df: DataFrame, cols: Sequence[str], side: str | None = None) -> DataFrame:
    """A9 for one table: (column_name, n, mean, variance, skewness G1, kurtosis G2)."""
    c = cells(df, cols)
    g = c.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"),
        F.skewness("x").alias("__g1"), F.kurtosis("x").alias("__g2"))
    n = F.col("n").cast("double")
    g1 = F.when(n > 2, F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, ((n + 1) * F.col("__g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    out = g.select("column_name", F.col("n").cast("bigint").alias("n"), "mean", "variance",
                   g1.alias("skewness"), g2.alias("kurtosis"))
    return out if side is None else out.withColumn("side", F.lit(side))


def moment_comparison(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (column_name, statistic, real, synthetic)."""
    both = moments(real, cols, "real").unionByName(moments(synth, cols, "synthetic"))
    long = both.unpivot(["column_name", "side"], ["mean", "variance", "skewness", "kurtosis"],
                        "statistic", "value")
    return long.groupBy("column_name", "statistic").agg(
        F.max(F.when(F.col("side") == "real", F.col("value"))).alias("real"),
        F.max(F.when(F.col("side") == "synthetic", F.col("value"))).alias("synthetic"))


def anderson_normal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n, statistic, crit_15, crit_10, crit_5, crit_2_5, crit_1)."""
    return _anderson({None: df}, cols).drop("side")


def anderson_comparison(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E6 for both tables: ``anderson_normal`` by (side, column_name), side 'real' or 'synthetic'.

    The values of both tables go through one shuffle."""
    return _anderson({"real": real, "synthetic": synth}, cols)


def _anderson(tables: Mapping[str | None, DataFrame], cols: Sequence[str]) -> DataFrame:
    """(side, column_name, n, statistic, crit_...): Anderson-Darling statistics against the normal.

    A value's term is linear in its rank.  A part of ``_ranged`` values therefore sums its terms by ranks inside
    it, and what one rank more would add; the ranks before it, known from the counts, complete the
    sums, so the sorted values are not written."""
    spark, d = next(iter(tables.values())).sparkSession, len(cols)
    long = reduce(lambda a, b: a.unionByName(b), [cells(df, cols, s) for s, df in enumerate(tables.values())])
    stats = {(r["side"], r["column_name"]): r for r in long.groupBy("side", "column_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd")).collect()}
    normal = {s * d + i: (r["n"], r["mu"], r["sd"] or np.nan) for s in range(len(tables)) for i, c in enumerate(cols) if (r := stats.get((s, c)))}
    ranged, owner = _ranged([_numbers(df, cols) for df in tables.values()], [s * d for s in range(len(tables))],
                            sum(max([stats[s, c]["n"] for c in cols if (s, c) in stats], default=0) for s in range(len(tables))))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for k, x, *counts in _parts(batches):
            n, mu, sd = normal[owner[k]]
            count = counts[0] + counts[1]  # a part is of one side
            j = np.cumsum(count)
            with np.errstate(all="ignore"):
                up, down = log_phis((x - mu) / sd)
                # over the block j - c + 1 .. j: sum (2i - 1) = c (2j - c) and sum (2n - 2i + 1) = c (2n - 2j + c)
                terms = float((count * ((2.0 * j - count) / n * up + (2.0 * n - 2.0 * j + count) / n * down)).sum())
                slope = float((2.0 * count / n * (up - down)).sum())
            rows.append((owner[k], k, int(j[-1]), terms, slope))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["f", "part", "rows", "terms", "slope"])

    before = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    chunks = ranged.mapInArrow(summed, "f int, part int, rows long, terms double, slope double").withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    sums = chunks.groupBy("f").agg(F.sum(F.col("terms") + F.col("before") * F.col("slope")).alias("__s"))
    names = spark.createDataFrame([(s * d + i, side, c, stats[s, c]["n"], stats[s, c]["sd"] or None) for s, side in enumerate(tables)
                                   for i, c in enumerate(cols) if (s, c) in stats], "f int, side string, column_name string, n long, sd double")
    n = F.col("n").cast("double")
    statistic = F.when(F.col("sd").isNotNull(), -n - F.col("__s")).alias("statistic")  # a constant column has none
    out = names.join(bounded_broadcast(sums, len(tables) * d), "f").select("side", "column_name", "n", statistic)
    factor = 1.0 + 4.0 / n - 25.0 / (n * n)
    names = ["crit_15", "crit_10", "crit_5", "crit_2_5", "crit_1"]
    return out.withColumns({nm: F.round(F.lit(v) / factor, 3) for nm, v in zip(names, AD_CRITICAL)})


def total_variation(real: DataFrame, synth: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Categorical column shape: (column_name, score = 1 - TV distance)."""
    def shares(df, side):
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
            [], list(cols), "column_name", "value")
        return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias(f"c_{side}"))
    j = shares(real, "r").join(shares(synth, "s"), ["column_name", "value"], "full_outer").fillna(0)
    tot = j.groupBy("column_name").agg(F.sum("c_r").alias("n_r"), F.sum("c_s").alias("n_s"))
    j = j.join(bounded_broadcast(tot, len(cols)), "column_name")
    diff = F.abs(F.col("c_r") / F.col("n_r") - F.col("c_s") / F.col("n_s"))
    return j.groupBy("column_name").agg((1 - 0.5 * F.sum(diff)).alias("score"))


def column_shapes(real: DataFrame, synth: DataFrame, numeric: Sequence[str],
                  categorical: Sequence[str] = ()) -> DataFrame:
    """(column_name, metric, score)."""
    parts = []
    if numeric:
        ks = ks_two_sample(real, synth, numeric)
        parts.append(ks.select("column_name", F.lit("KSComplement").alias("metric"),
                               (1 - F.col("statistic")).alias("score")))
    if categorical:
        tv = total_variation(real, synth, categorical)
        parts.append(tv.select("column_name", F.lit("TVComplement").alias("metric"), "score"))
    return reduce(lambda a, b: a.unionByName(b), parts)


PAIR_BINS = 10


def _numeric_pair_trends(real: DataFrame, synth: DataFrame, numeric: Sequence[str]) -> DataFrame:
    def corr(df):
        return correlation_long(correlation_stats(df, [], numeric), [], numeric)
    r = corr(real).withColumnRenamed("rho", "real_correlation")
    s = corr(synth).withColumnRenamed("rho", "synthetic_correlation")
    order = {c: i for i, c in enumerate(numeric)}
    idx = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    j = r.join(s, ["row_feature", "col_feature"]).where(idx[F.col("row_feature")] < idx[F.col("col_feature")])
    return j.select(F.col("row_feature").alias("column_1"), F.col("col_feature").alias("column_2"),
                    "real_correlation", "synthetic_correlation",
                    (1 - F.abs(F.col("real_correlation") - F.col("synthetic_correlation")) / 2).alias("score"))


def _pair_counts(pairs: Sequence[tuple[int, int]]):
    """mapInArrow body: (pair, v1, v2, c) of the columns of each pair, by ``PART_ROWS`` rows."""
    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        coded = [c.combine_chunks().dictionary_encode(null_encoding="encode") for c in t.columns]
        code, words = [c.indices.to_numpy().astype(np.int64) for c in coded], [c.dictionary.cast(pa.string()) for c in coded]
        for k, (i, j) in enumerate(pairs):
            width = max(1, len(words[j]))
            both = code[i] * width + code[j]
            if len(words[i]) * width <= t.num_rows:
                every = np.bincount(both)
                at = np.flatnonzero(every)
                c = every[at]
            else:
                at, c = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), words[i].take(pa.array(at // width)), words[j].take(pa.array(at % width)),
                                              pa.array(c.astype(np.int64))], ["pair", "v1", "v2", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= PART_ROWS:
                yield from counted(held)
                held, rows = [], 0
        if held:
            yield from counted(held)

    return run


def contingency_similarity(real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                           bins: int = PAIR_BINS) -> DataFrame:
    """(column_1, column_2, score) for the pairs with a categorical column: 1 - TV of the joint shares.

    Pairs are counted in blocks of rows where they lie, so a shuffle holds a block's distinct value
    pairs only.  Missing values are a category."""
    bounds = {}
    if numeric:
        row = real.agg(*[f(F.when(~is_missing(real, c), F.col(c).cast("double"))).alias(f"{n}_{i}")
                         for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        bounds = {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(numeric)}

    def value(df, c):
        if c not in bounds:
            return F.col(c).cast("string")
        lo, hi = bounds[c]
        if lo is None:
            return F.lit(None).cast("int")
        return F.when(~is_missing(df, c), _bin(F.col(c).cast("double"), F.lit(lo), F.lit(hi), bins))

    columns = [*numeric, *categorical]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns)) if columns[j] in categorical]

    def counts(df, side):
        return df.select(*[value(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(
            _pair_counts(pairs), "pair int, v1 string, v2 string, c long").withColumn("side", F.lit(side))
    both = counts(real, 0).unionByName(counts(synth, 1)).groupBy("pair", "v1", "v2").agg(
        F.sum(F.when(F.col("side") == 0, F.col("c")).otherwise(0)).alias("c_r"), F.sum(F.when(F.col("side") == 1, F.col("c")).otherwise(0)).alias("c_s"))
    names = real.sparkSession.createDataFrame([(k, columns[i], columns[j]) for k, (i, j) in enumerate(pairs)], "pair int, column_1 string, column_2 string")
    both = both.join(bounded_broadcast(names, len(pairs)), "pair")
    tot = both.groupBy("column_1", "column_2").agg(F.sum("c_r").alias("n_r"), F.sum("c_s").alias("n_s"))
    j = both.join(bounded_broadcast(tot, len(pairs)), ["column_1", "column_2"])
    gap = F.abs(F.try_divide("c_r", "n_r") - F.try_divide("c_s", "n_s"))
    return j.groupBy("column_1", "column_2").agg((1 - 0.5 * F.sum(gap)).alias("score"))


def column_pair_trends(real: DataFrame, synth: DataFrame, numeric: Sequence[str],
                       categorical: Sequence[str] = ()) -> DataFrame:
    """(column_1, column_2, real_correlation, synthetic_correlation, score) for every pair.

    Correlations are null for pairs with a categorical column."""
    parts = []
    if len(numeric) > 1:
        parts.append(_numeric_pair_trends(real, synth, numeric))
    if categorical and len(numeric) + len(categorical) > 1:
        none = F.lit(None).cast("double")
        parts.append(contingency_similarity(real, synth, numeric, categorical).select(
            "column_1", "column_2", none.alias("real_correlation"), none.alias("synthetic_correlation"), "score"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def quality_report(real: DataFrame, synth: DataFrame, numeric: Sequence[str],
                   categorical: Sequence[str] = ()) -> DataFrame:
    """(property, score) rows for Column Shapes, Column Pair Trends and Overall."""
    shapes = column_shapes(real, synth, numeric, categorical).agg(F.avg("score").alias("score")) \
        .select(F.lit("Column Shapes").alias("property"), "score")
    pairs = column_pair_trends(real, synth, numeric, categorical).agg(F.avg("score").alias("score")) \
        .select(F.lit("Column Pair Trends").alias("property"), "score")
    return _with_overall(shapes.unionByName(pairs))


def compare_candidates(real: DataFrame, candidates: Mapping[str, DataFrame], numeric: Sequence[str],
                       categorical: Sequence[str] = ()) -> DataFrame:
    """(method, property, score, rank) of any candidates, ranked by their overall score (ties by name)."""
    parts = []
    for name, s in candidates.items():
        # a candidate is written for its report's passes and goes before the next one comes
        table = materialize(s, "candidate")
        parts.append(materialize(quality_report(real, table, numeric, categorical).withColumn("method", F.lit(name)), "report"))
        discard(table)
    scores = reduce(lambda a, b: a.unionByName(b), parts)
    place = Window.orderBy(F.col("score").desc_nulls_last(), "method")  # one row for each candidate
    ranked = scores.where(F.col("property") == "Overall").select("method", F.row_number().over(place).alias("rank"))
    return scores.join(bounded_broadcast(ranked, len(candidates)), "method").select("method", "property", "score", "rank")


def _with_overall(properties: DataFrame) -> DataFrame:
    """The properties and their mean, with each property computed once."""
    return properties.groupBy().agg(F.collect_list(F.struct("property", "score")).alias("p"), F.avg("score").alias("overall")).select(
        F.explode(F.concat("p", F.array(F.struct(F.lit("Overall").alias("property"), F.col("overall").alias("score"))))).alias("x")).select("x.*")


def boundary_adherence(real: DataFrame, synth: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """E1 part: share of synthetic values inside the real [min, max]."""
    bounds = cells(real, numeric).groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = cells(synth, numeric).join(bounded_broadcast(bounds, len(numeric)), "column_name")
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    return s.groupBy("column_name").agg(F.avg(inside.cast("double")).alias("score")) \
        .select("column_name", F.lit("BoundaryAdherence").alias("metric"), "score")


def category_adherence(real: DataFrame, synth: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """E1 part: share of synthetic categories seen in the real data."""
    def long(df):
        return df.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
            [], list(categorical), "column_name", "value")
    seen = long(real).distinct().withColumn("__seen", F.lit(1))
    s = long(synth).join(seen, ["column_name", "value"], "left")
    return s.groupBy("column_name").agg(F.avg(F.col("__seen").isNotNull().cast("double")).alias("score")) \
        .select("column_name", F.lit("CategoryAdherence").alias("metric"), "score")


def key_uniqueness(synth: DataFrame, key: Sequence[str]) -> DataFrame:
    """E1 part: share of synthetic rows whose key is no other row's."""
    per_key = synth.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    single = F.sum(F.when(F.col("n") == 1, 1.0).otherwise(0.0))
    return per_key.agg(F.try_divide(single, F.sum("n")).alias("score")).select(
        F.lit(",".join(key)).alias("column_name"), F.lit("KeyUniqueness").alias("metric"), "score")


def diagnostic_report(real: DataFrame, synth: DataFrame, numeric: Sequence[str],
                      categorical: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """(property, score): Data Validity, Data Structure, Overall.

    ``key`` names the synthetic table's key; key columns that the real table lacks
    are helpers and no part of the structure."""
    parts = [boundary_adherence(real, synth, numeric)] if numeric else []
    if categorical:
        parts.append(category_adherence(real, synth, categorical))
    if key:
        parts.append(key_uniqueness(synth, key))
    validity = reduce(lambda a, b: a.unionByName(b), parts).agg(F.avg("score").alias("score")) \
        .select(F.lit("Data Validity").alias("property"), "score")
    rc = set(real.dtypes)
    sc = {(n, t) for n, t in synth.dtypes if n not in key or n in real.columns}
    structure = real.sparkSession.range(1).select(
        F.lit("Data Structure").alias("property"), F.lit(len(rc & sc) / max(1, len(rc | sc))).alias("score"))
    return _with_overall(validity.unionByName(structure))


def _bin(x: Column, lo: Column, hi: Column, k: int) -> Column:
    """width_bucket-like bin 0..k-1 (the maximum goes to the last bin)."""
    raw = F.floor((x - lo) / (hi - lo) * k)
    return F.when(hi > lo, F.greatest(F.lit(0), F.least(raw, F.lit(k - 1)))).otherwise(F.lit(0)).cast("int")


def column_distributions(real: DataFrame, synth: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """(column_name, bin, lo, hi, real_share, synthetic_share) with shared edges."""
    both = cells(real, cols, 0).unionByName(cells(synth, cols, 1))
    rng = both.groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = both.join(bounded_broadcast(rng, len(cols)), "column_name").withColumn(
        "bin", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins))
    counts = b.groupBy("column_name", "bin", "lo", "hi").agg(
        F.count_if(F.col("side") == 0).alias("c_r"), F.count_if(F.col("side") == 1).alias("c_s"))
    tot = counts.groupBy("column_name").agg(F.sum("c_r").alias("n_r"), F.sum("c_s").alias("n_s"))
    c = counts.join(bounded_broadcast(tot, len(cols)), "column_name")
    width = (F.col("hi") - F.col("lo")) / bins
    return c.select("column_name", "bin",
                    (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    (F.col("c_r") / F.col("n_r")).alias("real_share"),
                    (F.col("c_s") / F.col("n_s")).alias("synthetic_share"))


def column_pair_bins(real: DataFrame, synth: DataFrame, col_x: str, col_y: str, bins: int = 10) -> DataFrame:
    """2-D binned shares (bin_x, bin_y, real_share, synthetic_share)."""
    def pts(df, side):
        return df.select(F.col(col_x).cast("double").alias("x"), F.col(col_y).cast("double").alias("y")) \
            .dropna().withColumn("side", F.lit(side))
    both = pts(real, 0).unionByName(pts(synth, 1))
    # the shared edges are four numbers: fetch them once and inline them
    r = both.agg(F.min("x").alias("lx"), F.max("x").alias("hx"),
                 F.min("y").alias("ly"), F.max("y").alias("hy")).first()
    b = both.select(_bin(F.col("x"), F.lit(r["lx"]), F.lit(r["hx"]), bins).alias("bin_x"),
                    _bin(F.col("y"), F.lit(r["ly"]), F.lit(r["hy"]), bins).alias("bin_y"), "side")
    counts = b.groupBy("bin_x", "bin_y").agg(
        F.count_if(F.col("side") == 0).alias("c_r"), F.count_if(F.col("side") == 1).alias("c_s"))
    # windows over the aggregated grid (at most bins^2 rows)
    tot_r = F.sum("c_r").over(Window.partitionBy())
    tot_s = F.sum("c_s").over(Window.partitionBy())
    return counts.select("bin_x", "bin_y", (F.col("c_r") / tot_r).alias("real_share"),
                         (F.col("c_s") / tot_s).alias("synthetic_share"))


def side_by_side(real: DataFrame, synth: DataFrame, column: str, value, real_column: str | None = None) -> DataFrame:
    """One entity looked up in both tables, tagged by source."""
    rc = real_column or column
    r = real.where(F.col(rc) == F.lit(value)).withColumn("source", F.lit("real"))
    s = synth.where(F.col(column) == F.lit(value)).withColumn("source", F.lit("synthetic"))
    return r.unionByName(s, allowMissingColumns=True)
