"""Profiling, class shares, per-group stats, sorts, splits.

All aggregations are single ``agg`` calls (map-side partial aggregation), so a
hot group is combined on every mapper before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.rng import hash_u
from .scan import ordinal


def is_missing(df: DataFrame, c: str) -> Column:
    """null, or NaN for floating columns (``isnan`` only where defined)."""
    dt = df.schema[c].dataType
    if isinstance(dt, (DoubleType, FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A1: (column_name, null_count) in one pass over the data."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(is_missing(df, c)).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def class_shares(df: DataFrame, column: str = "PD_status") -> DataFrame:
    """A2: normalized value counts (value, share, n)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the already-aggregated (tiny) table
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(F.col(column), (F.col("n") / total).alias("share"),
                         F.col("n").cast("bigint").alias("n"))


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A3."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def group_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               name: str = "ordinal") -> DataFrame:
    """Each row tagged with its 0-based position inside its group.

    The rows stay distributed as (group, ordinal) records; nothing is
    collected per group.
    """
    return ordinal(df, keys, order, name)


def group_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A5: per-group mean of each feature (each listed once)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 *[F.avg(c).alias(f"mean_{c}") for c in cols])


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A10: the first row of each group under ``order`` (deterministic).

    ``min`` over a struct led by the order columns is a partial aggregate,
    so a hot group is reduced on the map side.
    """
    payload = [c for c in df.columns if c not in group]
    best = F.min(F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)],
                          *[F.col(c) for c in payload])).alias("__best")
    return df.groupBy(*group).agg(best).select(*group, *[F.col(f"__best.{c}").alias(c) for c in payload])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A11."""
    return df.select(column).distinct()


def row_count(df: DataFrame) -> DataFrame:
    """A12 as a one-row frame."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A13 statistics: mean of each column over non-missing values."""
    return df.agg(*[F.avg(F.when(~is_missing(df, c), F.col(c))).alias(c) for c in cols])


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace null/NaN by the column mean.

    The means are one row of len(cols) numbers (model-sized), fetched once
    and inlined as literals.  Columns with no value at all stay missing and
    are reported by ``missing_counts``.
    """
    means = column_means(df, cols).first().asDict()
    fills = {}
    for c in cols:
        m = means[c]
        if m is None:
            continue
        fills[c] = F.when(is_missing(df, c), F.lit(m)).otherwise(F.col(c).cast("double"))
    return df.withColumns(fills)


def sort_rows(df: DataFrame, keys: Sequence[str], ascending: bool = True,
              nulls_last: bool = True) -> DataFrame:
    """Multi-key sort with pandas' NaN-last convention by default."""
    cols = []
    for k in dict.fromkeys(keys):
        c = F.col(k)
        if ascending:
            cols.append(c.asc_nulls_last() if nulls_last else c.asc_nulls_first())
        else:
            cols.append(c.desc_nulls_last() if nulls_last else c.desc_nulls_first())
    return df.orderBy(*cols)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Ordered top-n (per-partition top-n, then a merge of n rows each)."""
    return df.orderBy(*order).limit(n)


def shuffle_within_group(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str],
                         seed: int, name: str = "shuffled_ordinal") -> DataFrame:
    """A seeded random permutation inside each group (as an ordinal)."""
    tmp = df.withColumn("__shuffle_u", hash_u(seed, "shuffle", *id_cols))
    out = ordinal(tmp, keys, ["__shuffle_u", *id_cols], name)
    return out.drop("__shuffle_u")


def train_test_split(df: DataFrame, id_cols: Sequence[str], seed: int = 0,
                     train_share: float = 0.75, name: str = "is_train") -> DataFrame:
    """Stable hash split, independent of partitioning (unlike randomSplit)."""
    return df.withColumn(name, hash_u(seed, "split", *id_cols) < F.lit(train_share))
