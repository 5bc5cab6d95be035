"""The contract table (FIXTURES §2) derived from the TPC-H-style driver tables.

One row per line item: ``lineitem`` joined to ``orders`` (orderkey),
``customer`` (custkey), ``nation`` (nationkey) and ``part`` (partkey).  Every
join keeps every line.  Only the columns the contract table needs are read,
so each Parquet scan prunes to a handful of columns; dimension joins are left
to Catalyst/AQE (small dimensions become broadcast joins by their measured
size, large ones shuffle on their key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import hash_u

# The contract schema the reference works with.
DOUBLE_FEATURES = ["cur_bal_member_lender", "total_gross_orig_receivable_amt",
                   "annualized_scheduled_payments", "contract_balance"]
COUNT_FEATURES = ["number_of_lenders", "cnt_0130_dpd", "cnt_3160_dpd",
                  "cnt_6190_dpd", "cnt_over90_dpd"]
FEATURES = ["cur_bal_member_lender", "total_gross_orig_receivable_amt",
            "annualized_scheduled_payments", "number_of_lenders", "cnt_0130_dpd",
            "cnt_3160_dpd", "cnt_6190_dpd", "cnt_over90_dpd", "contract_balance"]
GROUP_KEYS = ["industry_segment", "state", "PD_status"]
ID_COLUMNS = ["customer_number", "customer_name", "contract_number", "PD_status"]
START_DATE = "contract_start_date"
SOURCE_TAGS = {"Performing": "performing", "PreviouslyDefaulted": "defaulted"}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-partitioned scan over the shuffle parallelism.

    A small table stored as one unsplittable Parquet row group is read by a
    single task, and every broadcast join streaming it stays single-task.
    Large inputs already have many splits and are returned unchanged (no
    shuffle).  Round-robin repartitioning sorts first by default, so retries
    see the same rows in each partition.
    """
    target = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))
    orders = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    ord_cust = orders.join(cust, orders.o_custkey == cust.c_custkey)
    lines = li.join(ord_cust, li.l_orderkey == ord_cust.o_orderkey)
    return lines.join(part, lines.l_partkey == part.p_partkey)


def _contract_columns(include_status: bool) -> list:
    cols = [
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cur_bal_member_lender"),
        F.col("l_extendedprice").alias("total_gross_orig_receivable_amt"),
        F.col("o_totalprice").alias("annualized_scheduled_payments"),
        F.col("l_linenumber").cast("bigint").alias("number_of_lenders"),
        F.col("l_quantity").cast("bigint").alias("cnt_0130_dpd"),
        F.col("p_size").cast("bigint").alias("cnt_3160_dpd"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("cnt_6190_dpd"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("cnt_over90_dpd"),
        F.col("c_acctbal").alias("contract_balance"),
        F.col("c_mktsegment").alias("industry_segment"),
        F.col("n_name").alias("state"),
    ]
    if include_status:
        cols.append(F.when(F.col("l_returnflag") == "R", "defaulted")
                    .otherwise("performing").alias("PD_status"))
    cols += [
        F.col("c_custkey").alias("customer_number"),
        F.col("c_name").alias("customer_name"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
        .alias("contract_number"),
    ]
    return cols


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled contract table in one pass over the joined tables."""
    return _joined_lines(spark, sf_dir).select(*_contract_columns(include_status=True))


def dated_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract table with the day on which a contract began."""
    return _joined_lines(spark, sf_dir).select(*_contract_columns(include_status=True), F.to_date("o_orderdate").alias(START_DATE))


def contract_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The two untagged sources (``Performing`` / ``PreviouslyDefaulted``)."""
    lines = _joined_lines(spark, sf_dir)
    base = lines.select(*_contract_columns(include_status=False), "l_returnflag")
    return {
        "Performing": base.where(~F.col("l_returnflag").eqNullSafe("R")).drop("l_returnflag"),
        "PreviouslyDefaulted": base.where(F.col("l_returnflag") == "R").drop("l_returnflag"),
    }


def with_missing(df: DataFrame, seed: int = 7, null_rate: float = 0.03,
                 nan_rate: float = 0.02, columns: list[str] | None = None) -> DataFrame:
    """Deterministically blank out cells (null everywhere, NaN in doubles).

    Which cells go missing is a hash of (seed, column, contract_number), so
    every row is kept and DuckDB can reproduce the same table.
    """
    columns = columns or FEATURES
    out = {}
    for c in columns:
        cell = F.col(c)
        if c in DOUBLE_FEATURES:
            cell = F.when(hash_u(seed, f"nan:{c}", "contract_number") < nan_rate,
                          F.lit(float("nan"))).otherwise(cell)
        out[c] = F.when(hash_u(seed, f"null:{c}", "contract_number") < null_rate,
                        F.lit(None).cast(df.schema[c].dataType)).otherwise(cell)
    return df.withColumns(out)
