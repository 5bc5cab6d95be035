"""J2/J3 helpers: size-checked broadcast and null-safe equi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

# Largest side we are willing to ship to every executor.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def _row_bytes(df: DataFrame) -> int:
    width = 16  # row header
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType):
            width += 8
        elif isinstance(f.dataType, StringType):
            width += 48
        else:
            width += 64
    return width


def _array_cells(df: DataFrame) -> int:
    """Total number of array elements, where the schema has arrays."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    if not arrays:
        return 0
    sizes = [F.coalesce(F.sum(F.greatest(F.size(a), F.lit(0))), F.lit(0)) for a in arrays]
    return int(sum(df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sizes)]).first()))


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only after measuring it; otherwise leave it to a shuffle join.

    The frames passed here are model/parameter tables (one row per group,
    per chunk or per grid point); the count makes that bound explicit instead
    of assumed.
    """
    rows = df.count()
    if rows * _row_bytes(df) + 8 * _array_cells(df) <= max_bytes:
        return F.broadcast(df)
    return df


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_MAX_BYTES, array_length: int = 0) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction.

    E.g. one row per input column name: the bound is known on the driver, so
    no counting job is needed; above the byte limit it is left to a shuffle.
    ``array_length`` bounds the elements of each array column.
    """
    arrays = sum(isinstance(f.dataType, ArrayType) for f in df.schema.fields)
    if max_rows * (_row_bytes(df) + 8 * arrays * array_length) <= max_bytes:
        return F.broadcast(df)
    return df


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (``<=>``)."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_null_safe needs at least one key")
    renamed = right.select(*[F.col(k).alias(f"__rk_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b,
                  [left[k].eqNullSafe(renamed[f"__rk_{k}"]) for k in keys])
    out = left.join(renamed, cond, how)
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        out = out.withColumns({k: F.coalesce(left[k], renamed[f"__rk_{k}"]) for k in keys})
    return out.drop(*[f"__rk_{k}" for k in keys])


def semi_join_values(df: DataFrame, values: DataFrame, column: str,
                     value_column: str | None = None, null_matches: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``column`` occurs in ``values``.

    The value set is de-duplicated first (map-side partial aggregation), and a
    null in the set matches null rows when ``null_matches`` (pandas ``isin``
    treats NaN that way).
    """
    value_column = value_column or column
    dist = values.select(F.col(value_column).alias("__v")).distinct()
    cond = df[column].eqNullSafe(dist["__v"]) if null_matches else df[column] == dist["__v"]
    return df.join(dist, cond, "left_semi")
