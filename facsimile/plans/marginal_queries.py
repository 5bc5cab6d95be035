"""Catalogue part 4: marginal distribution fitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import sig_round, sig_round_sql
from ..operators import marginals as mg
from ..operators.scan import ordinal
from ..sources.contracts import DOUBLE_FEATURES, FEATURES, contracts
from .registry import CONTRACTS_SQL, query

#: Families whose estimators SQL can state.
SHORT = mg.closed_families(mg.FAMILIES_SHORT)


def _stats(spark, sf):
    return mg.column_stats(contracts(spark, sf), FEATURES)


def _params(spark, sf, families):
    stats, cum = _stats(spark, sf)
    return mg.fit_params(stats, families, cum)


def _cells_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS column_name, CAST({f} AS DOUBLE) AS x FROM contracts "
        f"WHERE NOT ({f} IS NULL{' OR isnan(' + f + ')' if f in DOUBLE_FEATURES else ''})" for f in FEATURES)


def _base_ctes() -> list[str]:
    params = " UNION ALL ".join(
        "SELECT column_name, '{fam}' AS family, CAST({p1} AS DOUBLE) AS p1, CAST({p2} AS DOUBLE) AS p2, "
        "CAST({loc} AS DOUBLE) AS loc, CAST({scale} AS DOUBLE) AS scale, n FROM stats".format(
            fam=fam, **dict(zip(["p1", "p2", "loc", "scale"], mg.family_params_sql(fam)))) for fam in SHORT)
    return [
        f"contracts AS ({CONTRACTS_SQL})",
        f"c AS ({_cells_sql()})",
        "a AS (SELECT column_name, count(*) AS n, avg(x) AS mean, var_pop(x) AS var, min(x) AS xmin, "
        "max(x) AS xmax, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, "
        "quantile_cont(x, 0.75) AS q3 FROM c GROUP BY column_name)",
        "a2 AS (SELECT *, sqrt(var) AS sd, CASE WHEN xmax > xmin THEN xmin - (xmax - xmin) / n "
        "ELSE xmin - 1.0 END AS loc0, CASE WHEN xmax > xmin THEN xmax + (xmax - xmin) / n "
        "ELSE xmax + 1.0 END AS hiloc FROM a)",
        "b AS (SELECT c.column_name, avg(ln(c.x - a2.loc0)) AS mln, var_pop(ln(c.x - a2.loc0)) AS vln, "
        "avg((c.x - a2.loc0) * ln(c.x - a2.loc0)) AS mylny FROM c JOIN a2 USING (column_name) "
        "GROUP BY c.column_name)",
        "stats AS (SELECT * FROM a2 JOIN b USING (column_name))",
        f"params AS ({params})",
    ]


def _sql(body: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join(_base_ctes() + (extra or [])) + "\n" + body


def _sig(c: str) -> str:
    return sig_round_sql(c, 9)


@query("d1_fit_params", _sql(
    "SELECT column_name, family, " + ", ".join(f"{_sig(c)} AS {c}" for c in ["p1", "p2", "loc", "scale"])
    + " FROM params"))
def d1_fit_params(spark, sf):
    p = _params(spark, sf, SHORT)
    return p.select("column_name", "family", *[sig_round(c).alias(c) for c in ["p1", "p2", "loc", "scale"]])


@query("d1_fit_likelihood")
def d1_fit_likelihood(spark, sf):
    """The families of both lists that have no closed-form estimator."""
    return _params(spark, sf, mg.LIKELIHOOD_FAMILIES).drop("n")


@query("d2_fit_wide")
def d2_fit_wide(spark, sf):
    return _params(spark, sf, mg.FAMILIES_WIDE).drop("n")


def _gamma_p(a: str, x: str, terms: int = 240) -> str:
    """P(a, x) = sum_n x^(a+n) e^-x / Gamma(a+n+1), by DuckDB's lgamma."""
    return (f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > {a} + 40 * sqrt({a}) + 60 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range({terms}), "
            f"lambda k: exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1))))) END")


def _beta_part(a: str, b: str, x: str, terms: int = 240) -> str:
    """I_x(a, b) below its mean: x^a (1-x)^b / (a B(a, b)) sum_n x^n (a+b)_n / (a+1)_n."""
    return (f"list_sum(list_transform(range({terms}), lambda k: exp(({a} + k) * ln({x}) + {b} * ln(1 - {x}) "
            f"+ lgamma({a} + {b} + k) - lgamma({b}) - lgamma({a} + 1 + k))))")


def _exact_cdf(family: str) -> str:
    """CDF of a family without closed form, independent of the operator's tables."""
    y = "((x - loc) / scale)"
    if family == "gamma":
        return _gamma_p("p1", y)
    if family == "chi2":
        return _gamma_p("(p1 / 2)", f"({y} / 2)")
    return (f"CASE WHEN {y} <= 0 THEN 0.0 WHEN {y} >= 1 THEN 1.0 WHEN {y} <= (p1 + 1) / (p1 + p2 + 2) THEN {_beta_part('p1', 'p2', y)} "
            f"ELSE 1 - {_beta_part('p2', 'p1', f'(1 - {y})')} END")


def _ks_ctes() -> list[str]:
    case = "CASE family " + " ".join(
        f"WHEN '{f}' THEN {_exact_cdf(f) if f in mg.GRID_FAMILIES else mg.cdf_sql(f)}" for f in SHORT) + " END"
    return [
        "cnt AS (SELECT column_name, x, count(*) AS c FROM c GROUP BY column_name, x)",
        "cum AS (SELECT *, sum(c) OVER (PARTITION BY column_name ORDER BY x ROWS BETWEEN UNBOUNDED "
        "PRECEDING AND CURRENT ROW) AS cum FROM cnt)",
        "j AS (SELECT cum.*, p.family, p.p1, p.p2, p.loc, p.scale, p.n FROM cum JOIN params p USING (column_name))",
        f"v AS (SELECT *, {case} AS __v FROM j)",
        "ks AS (SELECT column_name, family, n, max(greatest(cum / n - __v, __v - (cum - c) / n)) AS ks "
        "FROM v GROUP BY column_name, family, n)",
        "ksp AS (SELECT *, sqrt(CAST(n AS DOUBLE)) * ks AS __lam FROM ks)",
    ]


def _ks_spark(spark, sf):
    stats, cum = _stats(spark, sf)
    return mg.ks_one_sample(cum, mg.fit_params(stats, SHORT))


@query("d3_ks_one_sample", _sql("SELECT column_name, family, round(ks, 4) AS ks FROM ksp", _ks_ctes()))
def d3_ks_one_sample(spark, sf):
    return _ks_spark(spark, sf).select("column_name", "family", F.round("ks", 4).alias("ks"))


@query("d4_ks_pvalue", _sql(
    f"SELECT column_name, family, round({mg.kolmogorov_sf_sql('__lam')}, 5) AS pvalue FROM ksp", _ks_ctes()))
def d4_ks_pvalue(spark, sf):
    return _ks_spark(spark, sf).select("column_name", "family", F.round("pvalue", 5).alias("pvalue"))


def _sse_ctes(bins: int = 100) -> list[str]:
    width = f"(CASE WHEN xmax > xmin THEN (xmax - xmin) / {bins} ELSE 1.0 END)"
    case = "CASE family " + " ".join(f"WHEN '{f}' THEN {mg.pdf_sql(f)}" for f in SHORT) + " END"
    return [
        "st AS (SELECT column_name, n, xmin, xmax FROM stats)",
        f"hb AS (SELECT c.column_name, CAST(CASE WHEN xmax > xmin THEN greatest(0, least(floor((x - xmin) / "
        f"(xmax - xmin) * {bins}), {bins - 1})) ELSE 0 END AS INTEGER) AS bin FROM c JOIN st USING (column_name))",
        "hist AS (SELECT column_name, bin, count(*) AS cnt FROM hb GROUP BY column_name, bin)",
        f"grid AS (SELECT st.*, CAST(g.range AS INTEGER) AS bin FROM st CROSS JOIN range({bins}) g)",
        f"fullg AS (SELECT grid.*, coalesce(hist.cnt, 0) AS cnt, xmin + (grid.bin + 0.5) * {width} AS x, "
        f"coalesce(hist.cnt, 0) / (n * {width}) AS density FROM grid LEFT JOIN hist USING (column_name, bin))",
        "jj AS (SELECT fullg.column_name, fullg.bin, fullg.x, fullg.density, p.family, p.p1, p.p2, p.loc, p.scale "
        "FROM fullg JOIN params p USING (column_name))",
        f"pv AS (SELECT *, {case} AS __v FROM jj)",
    ]


@query("d5_histogram_sse", _sql(
    f"SELECT column_name, family, {_sig('sum(power(density - coalesce(__v, 0.0), 2))')} AS sse "
    "FROM pv GROUP BY column_name, family", _sse_ctes()))
def d5_histogram_sse(spark, sf):
    stats, cum = _stats(spark, sf)
    params = mg.fit_params(stats, SHORT)
    sse = mg.histogram_sse(cum, FEATURES, params, stats)
    return sse.select("column_name", "family", sig_round("sse").alias("sse"))


def _summary(spark, sf):
    return mg.fit_summary(contracts(spark, sf), FEATURES, mg.FAMILIES_WIDE)


@query("d6_fit_summary")
def d6_fit_summary(spark, sf):
    return _summary(spark, sf)


@query("d7_best_family")
def d7_best_family(spark, sf):
    return mg.best_family(_summary(spark, sf))


@query("d7_best_family_compat")
def d7_best_family_compat(spark, sf):
    return mg.best_family(_summary(spark, sf), compat=True)


@query("w3_sort_pvalue")
def w3_sort_pvalue(spark, sf):
    """The fit table ordered by p-value ascending (position = rank)."""
    s = _summary(spark, sf).select("column_name", "family", "ks", "pvalue")
    return ordinal(s, [], [F.col("pvalue").asc_nulls_last(), "column_name", "family"], "position")
