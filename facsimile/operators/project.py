"""Projection, labels, casts, renames, type selection, metadata.

P10 infers a semantic type per column (numerical / categorical / id /
boolean / datetime) from one pass of statistics: distinct and null counts are
computed on an unpivoted (column, value) table so every column's distinct
count shares one partially-aggregated shuffle instead of one job per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, FractionalType, IntegralType,
                               NumericType, TimestampType)

from .profile import is_missing

STATUS_SCORES = {"performing": 0, "defaulted": 1}


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P1."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Duplicates in the list and names not present are tolerated."""
    present = set(df.columns)
    return df.drop(*[c for c in dict.fromkeys(cols) if c in present])


def label_score(df: DataFrame, source: str = "PD_status", target: str = "pd_status_score",
                mapping: Mapping[str, int] = STATUS_SCORES) -> DataFrame:
    """Map labels to integers; unknown labels become null.

    P4 in the reference mixed an integer with a string in one CASE (which
    fails under ANSI casts); both forms are built as this typed mapping.
    """
    expr: Column | None = None
    for label, score in mapping.items():
        cond = F.col(source) == label
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    return df.withColumn(target, expr.otherwise(F.lit(None)).cast("integer"))


def bulk_cast(df: DataFrame, types: Mapping[str, str], safe: bool = True) -> DataFrame:
    """P5: cast many columns at once; ``safe`` turns bad input into null."""
    if safe:
        return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in types.items()})
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P6."""
    return df.withColumnsRenamed(dict(mapping))


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """Names of numeric columns (float and integer) in schema order."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType) or (include_bool and isinstance(f.dataType, BooleanType)):
            out.append(f.name)
    return out


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """P9."""
    return df.withColumn(name, F.lit(value))


def type_kind(dt) -> str:
    if isinstance(dt, BooleanType):
        return "boolean"
    if isinstance(dt, IntegralType):
        return "integer"
    if isinstance(dt, FractionalType) or isinstance(dt, NumericType):
        return "float"
    if isinstance(dt, (DateType, TimestampType)):
        return "datetime"
    return "string"


ID_HINTS = ("_id", "_number", "_key", "id")


def detect_metadata(df: DataFrame, id_hints: Sequence[str] = ID_HINTS) -> DataFrame:
    """P10: one row per column with kind, counts and the inferred sdtype.

    Rule: boolean -> boolean, date/time -> datetime; a column whose name ends
    with an id hint and whose non-null values are all distinct with no nulls
    -> id; other numbers -> numerical; other strings -> categorical.
    """
    kinds = {f.name: type_kind(f.dataType) for f in df.schema.fields}
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.col(c).cast("string").alias("value"),
                 is_missing(df, c).alias("missing"))
        for c in df.columns])).alias("cell")).select("cell.*")
    per_value = (cells.groupBy("column_name", "value")
                 .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("missing").cast("int")).alias("m")))
    stats = per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("m") == 1, F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.col("m") == 0, 1).otherwise(0)).alias("n_distinct"))
    kind_map = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])
    hint = None
    for h in id_hints:
        cond = F.lower(F.col("column_name")).endswith(h)
        hint = cond if hint is None else hint | cond
    kind = kind_map[F.col("column_name")]
    sdtype = (F.when(kind == "boolean", "boolean")
              .when(kind == "datetime", "datetime")
              .when(hint & (F.col("n_missing") == 0) & (F.col("n_distinct") == F.col("n_rows")), "id")
              .when(kind.isin("integer", "float"), "numerical")
              .otherwise("categorical"))
    return stats.select(
        "column_name", kind.alias("kind"), sdtype.alias("sdtype"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_missing").cast("bigint").alias("n_missing"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"))


def validate_metadata(meta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P10 validate: every column described once, at most one primary key.

    Returns one row (n_columns, n_described, n_ids, valid).
    """
    described = meta.where(F.col("column_name").isin(list(columns)))
    return described.agg(
        F.lit(len(columns)).cast("bigint").alias("n_columns"),
        F.countDistinct("column_name").cast("bigint").alias("n_described"),
        F.sum(F.when(F.col("sdtype") == "id", 1).otherwise(0)).cast("bigint").alias("n_ids"),
    ).withColumn("valid", (F.col("n_described") == F.col("n_columns")) & (F.col("n_ids") <= 1))
