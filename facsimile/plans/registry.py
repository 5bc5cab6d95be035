"""Query registry: ``queries()[name](spark, sf_dir) -> DataFrame`` and the
matching DuckDB oracle SQL.  Oracle SQL runs over the driver's views
(lineitem, orders, customer, nation, part, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.rng import hex_hash, uniform_from_hex
from ..sources.contracts import DOUBLE_FEATURES, FEATURES

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


CONTRACTS_SQL = """
SELECT l.l_extendedprice * (1 - l.l_discount) AS cur_bal_member_lender,
       l.l_extendedprice AS total_gross_orig_receivable_amt,
       o.o_totalprice AS annualized_scheduled_payments,
       CAST(l.l_linenumber AS BIGINT) AS number_of_lenders,
       CAST(trunc(l.l_quantity) AS BIGINT) AS cnt_0130_dpd,
       CAST(p.p_size AS BIGINT) AS cnt_3160_dpd,
       CAST(round(l.l_discount * 100) AS BIGINT) AS cnt_6190_dpd,
       CAST(round(l.l_tax * 100) AS BIGINT) AS cnt_over90_dpd,
       c.c_acctbal AS contract_balance,
       c.c_mktsegment AS industry_segment,
       n.n_name AS state,
       CASE WHEN l.l_returnflag = 'R' THEN 'defaulted' ELSE 'performing' END AS PD_status,
       c.c_custkey AS customer_number,
       c.c_name AS customer_name,
       concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
                 CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR)) AS contract_number
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
"""


def dirty_contracts_sql(seed: int = 7, null_rate: float = 0.03, nan_rate: float = 0.02) -> str:
    """DuckDB twin of ``sources.contracts.with_missing``."""
    items = []
    for c in FEATURES:
        u_null = uniform_from_hex(hex_hash(seed, f"null:{c}", ["contract_number"], "duckdb"), 0, "duckdb")
        cell = c
        if c in DOUBLE_FEATURES:
            u_nan = uniform_from_hex(hex_hash(seed, f"nan:{c}", ["contract_number"], "duckdb"), 0, "duckdb")
            cell = f"(CASE WHEN {u_nan} < {nan_rate!r} THEN CAST('NaN' AS DOUBLE) ELSE {c} END)"
        items.append(f"CASE WHEN {u_null} < {null_rate!r} THEN NULL ELSE {cell} END AS {c}")
    rest = "industry_segment, state, PD_status, customer_number, customer_name, contract_number"
    return f"SELECT {', '.join(items)}, {rest} FROM ({CONTRACTS_SQL}) AS base"


def with_contracts(body: str, dirty: bool = False) -> str:
    ctes = f"WITH contracts AS ({CONTRACTS_SQL})"
    if dirty:
        ctes += f", dirty AS ({dirty_contracts_sql()})"
    return f"{ctes}\n{body}"
