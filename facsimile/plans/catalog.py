"""All registered queries (imports populate the registry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (basic_queries, copula_queries, eval_queries, marginal_queries,  # noqa: F401
               synth_queries)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["c1_group_copula"](spark, sf_dir)
