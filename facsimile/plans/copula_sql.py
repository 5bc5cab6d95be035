"""DuckDB oracle SQL for the group copula stages.

Correlations come from DuckDB's own ``corr`` and moments from its aggregates; only
the hash draws, the normal CDF and the order of Cholesky's steps are shared text."""

from __future__ import annotations

from ..functions.normal import phi_sql
from ..functions.rng import normals_sql
from ..operators.copula import EPSILON, factor_columns, pair_index
from ..sources.contracts import DOUBLE_FEATURES, FEATURES, GROUP_KEYS
from .registry import CONTRACTS_SQL

D = len(FEATURES)
KEYS = ", ".join(GROUP_KEYS)


def _not_missing(c: str) -> str:
    return f"NOT ({c} IS NULL OR isnan({c}))" if c in DOUBLE_FEATURES else f"{c} IS NOT NULL"


def corr_items() -> str:
    """n, means, variances and coefficients of a group; undefined coefficients are 0."""
    items = ["count(*) AS n"]
    items += [f"avg({f}) AS mean_{i}" for i, f in enumerate(FEATURES)]
    items += [f"var_samp({f}) AS var_{i}" for i, f in enumerate(FEATURES)]
    for i, j in pair_index(D):
        a, b = FEATURES[i], FEATURES[j]
        value = "1.0" if i == j else f"greatest(-1.0, least(1.0, corr({a}, {b})))"
        items.append(f"CASE WHEN max({a}) > min({a}) AND max({b}) > min({b}) THEN {value} ELSE 0.0 END AS r_{i}_{j}")
    return ", ".join(items)


def cholesky_steps(d: int) -> list[dict[str, str]]:
    """New columns L_i_j (i >= j) by pivot column; each step uses earlier ones only."""
    steps = []
    for j in range(d):
        pivot = f"a_{j}_{j}" + "".join(f" - L_{j}_{k} * L_{j}_{k}" for k in range(j))
        steps.append({f"L_{j}_{j}": f"sqrt({pivot})"})
        below = {f"L_{i}_{j}": f"((a_{j}_{i}" + "".join(f" - L_{i}_{k} * L_{j}_{k}" for k in range(j)) + f") / L_{j}_{j})" for i in range(j + 1, d)}
        if below:
            steps.append(below)
    return steps


def ctes(keys: list[str] = GROUP_KEYS, source: str = "contracts") -> list[str]:
    """CTE list: base, stats, params (corr + ridge + Cholesky), ranked."""
    kl = ", ".join(keys)
    kcomma = kl + ", " if keys else ""
    where = " AND ".join(_not_missing(c) for c in FEATURES)
    out = [f"contracts AS ({CONTRACTS_SQL})",
           f"base AS (SELECT {kcomma}" + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
           + f" FROM {source} WHERE {where})"]
    group = f" GROUP BY {kl}" if keys else ""
    out.append(f"corr AS (SELECT {kcomma}{corr_items()} FROM base{group})")
    a = [f"(r_{i}_{j} + {EPSILON if i == j else 0.0!r}) AS a_{i}_{j}" for i, j in pair_index(D)]
    out.append(f"chol0 AS (SELECT *, {', '.join(a)} FROM corr)")
    for s, step in enumerate(cholesky_steps(D)):
        items = ", ".join(f"{v} AS {k}" for k, v in step.items())
        out.append(f"chol{s + 1} AS (SELECT *, {items} FROM chol{s})")
    out.append(f"params AS (SELECT * FROM chol{len(cholesky_steps(D))})")
    unp = " UNION ALL ".join(f"SELECT {kcomma}'{f}' AS feature, {f} AS x FROM base" for f in FEATURES)
    part = f"PARTITION BY {kcomma}feature"
    out.append(f"ranked AS (SELECT {kcomma}feature, x, row_number() OVER ({part} ORDER BY x) - 1 "
               f"AS rank FROM ({unp}))")
    return out


def corr_ctes(name: str, source: str, where: str = "", keys: list[str] | None = None) -> list[str]:
    """CTEs ``<name>_in`` and ``<name>`` (wide r_i_j)."""
    keys = keys or []
    kcomma = ", ".join(keys) + ", " if keys else ""
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    cast = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    return [f"{name}_in AS (SELECT {kcomma}{cast} FROM {source}{(' WHERE ' + where) if where else ''})",
            f"{name} AS (SELECT {kcomma}{corr_items()} FROM {name}_in{group})"]


def with_ctes(body: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join(ctes() + (extra or [])) + "\n" + body


def correlation_long_select(table: str, keys: list[str]) -> str:
    kcomma = ", ".join(keys) + ", " if keys else ""
    parts = []
    for i in range(D):
        for j in range(D):
            a, b = min(i, j), max(i, j)
            parts.append(f"SELECT {kcomma}'{FEATURES[i]}' AS row_feature, '{FEATURES[j]}' AS col_feature, "
                         f"round(r_{a}_{b}, 6) + 0.0 AS rho FROM {table}")
    return " UNION ALL ".join(parts)


def draws_ctes(seed: int) -> list[str]:
    """skeleton -> uniforms -> normals -> z -> u."""
    inner, outer = normals_sql(seed, "copula", GROUP_KEYS + ["k"], D, "duckdb")
    fac = ", ".join(f"p.{c}" for c in factor_columns(D))
    out = [f"skeleton AS (SELECT {KEYS}, rank AS k FROM ranked WHERE feature = '{FEATURES[0]}')",
           f"joined AS (SELECT s.{', s.'.join(GROUP_KEYS)}, s.k, p.n, {fac} FROM skeleton s "
           f"JOIN params p USING ({KEYS}))",
           f"unif AS (SELECT *, {', '.join(inner)} FROM joined)",
           "normals AS (SELECT *, " + ", ".join(f"{e} AS __e{i}" for i, e in enumerate(outer)) + " FROM unif)"]
    zs = []
    for i in range(D):
        expr = "0.0"
        for m in range(i + 1):
            expr = f"({expr} + L_{i}_{m} * __e{m})"
        zs.append(f"{expr} AS __z{i}")
    out.append(f"zed AS (SELECT *, {', '.join(zs)} FROM normals)")
    us = [f"{phi_sql(f'__z{i}')} AS u_{i}" for i in range(D)]
    out.append(f"unis AS (SELECT *, {', '.join(us)} FROM zed)")
    return out


def quantile_ctes(cells_table: str) -> list[str]:
    """cells (keys, k, n, feature, u) -> valued (keys, k, feature, value)."""
    return [
        f"pos AS (SELECT *, CAST(n - 1 AS DOUBLE) * u AS __h FROM {cells_table})",
        "pos2 AS (SELECT *, CAST(floor(__h) AS BIGINT) AS lo, __h - floor(__h) AS frac FROM pos)",
        f"valued AS (SELECT p.{', p.'.join(GROUP_KEYS)}, p.k, p.feature, r1.x + p.frac * "
        f"(coalesce(r2.x, r1.x) - r1.x) AS value FROM pos2 p "
        f"JOIN ranked r1 ON {' AND '.join(f'r1.{k} = p.{k}' for k in GROUP_KEYS)} "
        f"AND r1.feature = p.feature AND r1.rank = p.lo "
        f"LEFT JOIN ranked r2 ON {' AND '.join(f'r2.{k} = p.{k}' for k in GROUP_KEYS)} "
        f"AND r2.feature = p.feature AND r2.rank = p.lo + 1)",
    ]


#: Decimals at which sampled values are published: engines agree to about 1e-10.
VALUE_DECIMALS = 2


def synth_ctes(seed: int) -> list[str]:
    """All CTEs up to ``synth`` (the group copula rows)."""
    cells = " UNION ALL ".join(f"SELECT {KEYS}, k, n, '{f}' AS feature, u_{i} AS u FROM unis"
                               for i, f in enumerate(FEATURES))
    pivot = ", ".join(f"max(CASE WHEN feature = '{f}' THEN value END) AS {f}" for f in FEATURES)
    return (ctes() + draws_ctes(seed) + [f"cells AS ({cells})"] + quantile_ctes("cells")
            + [f"synth AS (SELECT {KEYS}, k, {pivot} FROM valued GROUP BY {KEYS}, k)"])


def copula_rows_sql(seed: int) -> str:
    cells = " UNION ALL ".join(f"SELECT {KEYS}, k, n, '{f}' AS feature, u_{i} AS u FROM unis"
                               for i, f in enumerate(FEATURES))
    extra = draws_ctes(seed) + [f"cells AS ({cells})"] + quantile_ctes("cells")
    pivot = ", ".join(f"round(max(CASE WHEN feature = '{f}' THEN value END), {VALUE_DECIMALS}) + 0.0 AS {f}" for f in FEATURES)
    return with_ctes(f"SELECT {KEYS}, k, {pivot} FROM valued GROUP BY {KEYS}, k", extra)


__all__ = ["with_ctes", "correlation_long_select", "draws_ctes", "quantile_ctes",
           "copula_rows_sql", "VALUE_DECIMALS"]
