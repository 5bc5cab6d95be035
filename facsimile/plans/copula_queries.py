"""Catalogue part 2: correlation statistics and the group-wise copula."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import copula
from ..operators.joins import sized_broadcast
from ..sources.contracts import FEATURES, GROUP_KEYS, contracts
from ..functions.scalars import composite_key
from . import copula_sql as cs
from .registry import query

SEED = 453
D = len(FEATURES)
KEYS = ", ".join(GROUP_KEYS)


def fitted(spark, sf):
    return copula.fit_group_copula(contracts(spark, sf), GROUP_KEYS, FEATURES)


def published(df, columns=FEATURES):
    """Sampled values at the decimals to which engines agree."""
    return df.withColumns({c: F.round(c, cs.VALUE_DECIMALS) + 0.0 for c in columns})  # no negative zero


def _long(stats, keys):
    return copula.correlation_long(stats, keys, FEATURES).withColumn("rho", F.round("rho", 6) + 0.0)  # no negative zero


@query("a6_group_correlation", cs.with_ctes(cs.correlation_long_select("corr", GROUP_KEYS)))
def a6_group_correlation(spark, sf):
    from ..session import materialize
    # means and products are two passes: the joined source is written once, and narrow
    data = materialize(copula.complete_rows(contracts(spark, sf), FEATURES).select(*GROUP_KEYS, *FEATURES), "a6-input")
    return _long(copula.correlation_stats(data, GROUP_KEYS, FEATURES), GROUP_KEYS)


def _corr_select(where: str) -> str:
    """``WITH contracts, corr`` over the (optionally filtered) contracts."""
    from .registry import CONTRACTS_SQL
    return ("WITH " + ",\n".join([f"contracts AS ({CONTRACTS_SQL})"]
                                  + cs.corr_ctes("corr", "contracts", where)) + "\n")


@query("a7_global_correlation", _corr_select("") + cs.correlation_long_select("corr", []))
def a7_global_correlation(spark, sf):
    return _long(copula.correlation_stats(contracts(spark, sf), [], FEATURES), [])


def _a8_sql() -> str:
    from .registry import CONTRACTS_SQL
    ctes = ([f"contracts AS ({CONTRACTS_SQL})"]
            + cs.corr_ctes("corr_p", "contracts", "PD_status = 'performing'")
            + cs.corr_ctes("corr_d", "contracts", "PD_status = 'defaulted'"))
    long_p = cs.correlation_long_select("corr_p", []).replace("round(r_", "(r_").replace(", 6) + 0.0 AS rho", ") AS rho")
    long_d = cs.correlation_long_select("corr_d", []).replace("round(r_", "(r_").replace(", 6) + 0.0 AS rho", ") AS rho")
    return ("WITH " + ",\n".join(ctes) + "\n"
            f"SELECT round(sqrt(sum(power(a.rho - b.rho, 2))), 6) AS frobenius FROM ({long_p}) a "
            f"JOIN ({long_d}) b USING (row_feature, col_feature)")


@query("a8_frobenius_distance", _a8_sql())
def a8_frobenius_distance(spark, sf):
    c = contracts(spark, sf)
    a = copula.correlation_long(copula.correlation_stats(c.where(F.col("PD_status") == "performing"), [], FEATURES), [], FEATURES)
    b = copula.correlation_long(copula.correlation_stats(c.where(F.col("PD_status") == "defaulted"), [], FEATURES), [], FEATURES)
    return copula.frobenius_distance(a, b).select(F.round("frobenius", 6).alias("frobenius"))


def _params_long(prefix: str, lower: bool, digits: int = 6) -> str:
    parts = []
    for i in range(D):
        for j in range(D):
            if lower and j > i:
                continue
            if not lower and j < i:
                continue
            parts.append(f"SELECT {KEYS}, {i} AS i, {j} AS j, round({prefix}_{i}_{j}, {digits}) + 0.0 AS value FROM params")
    return " UNION ALL ".join(parts)


def _spark_params_long(params, prefix: str, lower: bool, digits: int = 6):
    cells = []
    for i in range(D):
        for j in range(D):
            if (lower and j > i) or (not lower and j < i):
                continue
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"),
                                  (F.round(F.col(f"{prefix}_{i}_{j}"), digits) + 0.0).alias("value")))
    return params.select(*GROUP_KEYS, F.explode(F.array(*cells)).alias("__c")).select(*GROUP_KEYS, "__c.*")


@query("c2_regularized_corr", cs.with_ctes(_params_long("a", lower=False, digits=7)))
def c2_regularized_corr(spark, sf):
    return _spark_params_long(fitted(spark, sf).params, "a", lower=False, digits=7)


@query("c3_cholesky_factor", cs.with_ctes(_params_long("L", lower=True, digits=5)))
def c3_cholesky_factor(spark, sf):
    return _spark_params_long(fitted(spark, sf).params, "L", lower=True, digits=5)


@query("j3_group_param_join", cs.with_ctes(
    f"SELECT s.{', s.'.join(GROUP_KEYS)}, s.k, p.n, round(p.mean_0, 6) AS mean_0 FROM "
    f"(SELECT {KEYS}, rank AS k FROM ranked WHERE feature = '{FEATURES[0]}') s JOIN params p USING ({KEYS})"))
def j3_group_param_join(spark, sf):
    m = fitted(spark, sf)
    params = m.params.select(*GROUP_KEYS, "__g", "n", F.round("mean_0", 6).alias("mean_0"))
    return m.skeleton().join(sized_broadcast(params), "__g").drop("__g")


@query("c4_correlated_draws", cs.with_ctes(
    f"SELECT {KEYS}, k, " + ", ".join(f"round(__z{i}, 4) + 0.0 AS z_{i}" for i in range(D)) + " FROM zed",
    cs.draws_ctes(SEED)))
def c4_correlated_draws(spark, sf):
    m = fitted(spark, sf)
    z = copula.correlated_normals(m.skeleton(), m.params, GROUP_KEYS, D, SEED)
    return z.select(*GROUP_KEYS, "k", *[(F.round(f"z_{i}", 4) + 0.0).alias(f"z_{i}") for i in range(D)])


@query("c5_normal_to_uniform", cs.with_ctes(
    f"SELECT {KEYS}, k, " + ", ".join(f"round(u_{i}, 4) AS u_{i}" for i in range(D)) + " FROM unis", cs.draws_ctes(SEED)))
def c5_normal_to_uniform(spark, sf):
    m = fitted(spark, sf)
    u = copula.correlated_uniforms(m.skeleton(), m.params, GROUP_KEYS, D, SEED)
    return u.select(*GROUP_KEYS, "k", *[F.round(f"u_{i}", 4).alias(f"u_{i}") for i in range(D)])


def _c6_sql() -> str:
    from ..functions.rng import hex_hash, uniform_from_hex
    u = uniform_from_hex(hex_hash(SEED, "c6", GROUP_KEYS + ["k", "feature"], "duckdb"), 0, "duckdb")
    cells = (f"cells AS (SELECT s.{', s.'.join(GROUP_KEYS)}, s.k, p.n, f.feature, "
             f"{u} AS u FROM "
             f"(SELECT {KEYS}, rank AS k FROM ranked WHERE feature = '{FEATURES[0]}') s "
             f"JOIN params p USING ({KEYS}) CROSS JOIN (SELECT DISTINCT feature FROM ranked) f)")
    return cs.with_ctes(f"SELECT {KEYS}, k, feature, round(value, {cs.VALUE_DECIMALS}) + 0.0 AS value FROM valued",
                        [cells] + cs.quantile_ctes("cells"))


@query("c6_empirical_quantile", _c6_sql())
def c6_empirical_quantile(spark, sf):
    return published(copula.group_quantiles(fitted(spark, sf), SEED, "c6"), ["value"])


def synth_table(spark, sf):
    """The group-copula sample, written once for the queries that read it several times."""
    from ..session import materialize
    return materialize(copula.sample_group_copula(fitted(spark, sf), SEED), "synth")


@query("c1_group_copula", cs.copula_rows_sql(SEED))
def c1_group_copula(spark, sf):
    return published(copula.sample_group_copula(fitted(spark, sf), SEED))


def _c7_sql() -> str:
    sql = cs.copula_rows_sql(SEED)
    head, _, tail = sql.rpartition("SELECT ")
    return (head + "SELECT concat_ws(chr(9), " + KEYS + ") AS group_key, k, "
            + tail.split(", k, ", 1)[1])


@query("c7_row_assembly", _c7_sql())
def c7_row_assembly(spark, sf):
    rows = published(copula.sample_group_copula(fitted(spark, sf), SEED))
    return rows.select(composite_key(GROUP_KEYS).alias("group_key"), "k", *FEATURES)


@query("j4_rank_lookup", cs.with_ctes(
    f"SELECT {KEYS}, feature, rank, x AS x_lo FROM ranked"))
def j4_rank_lookup(spark, sf):
    return fitted(spark, sf).named_ranks().drop("x_hi")
