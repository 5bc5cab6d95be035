"""Predicates.  Plain ``where`` so Catalyst pushes them into the scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import semi_join_values
from .profile import is_missing


def where_equal(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """conjunction of equalities."""
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in values.items()])
    return df.where(cond)


def point_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """F2."""
    return df.where(F.col(column) == F.lit(value))


def member_of(df: DataFrame, column: str, values: DataFrame | None = None,
              value_column: str | None = None) -> DataFrame:
    """Rows whose value is in a distinct set (null-safe, like pandas isin).

    With ``values`` omitted the set is the column's own values, which keeps
    every row - the reference's usage.
    """
    return semi_join_values(df, values if values is not None else df, column, value_column)


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    """F4."""
    return df.where(is_missing(df, column))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """``dropna`` on one column."""
    return df.where(~is_missing(df, column))
