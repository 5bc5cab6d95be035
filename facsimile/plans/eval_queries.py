"""Catalogue part 3: real (contracts) vs synthetic (group copula) evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import log_phi_sql
from ..functions.scalars import sig_round, sig_round_sql
from ..operators import copula, evaluate
from ..session import materialize
from ..sources.contracts import FEATURES, GROUP_KEYS, contracts
from . import copula_sql as cs
from .copula_queries import SEED
from .registry import query

D = len(FEATURES)


def _real(spark, sf):
    """The real table with the sample's types (features are doubles)."""
    return copula.cast_features(copula.complete_rows(contracts(spark, sf), FEATURES).select(*GROUP_KEYS, *FEATURES), FEATURES)


def _both(spark, sf):
    """The real and the synthetic table, each joined or drawn and written once."""
    real = materialize(_real(spark, sf), "eval-real")
    fitted = copula.fit_group_copula(real, GROUP_KEYS, FEATURES, written=True)
    return real, materialize(copula.sample_group_copula(fitted, SEED), "synth")


def _with_synth(body: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join(cs.synth_ctes(SEED) + (extra or [])) + "\n" + body


def _cells_sql(table: str, side: int | None = None) -> str:
    s = f", {side} AS side" if side is not None else ""
    return " UNION ALL ".join(
        f"SELECT '{f}' AS column_name, CAST({f} AS DOUBLE) AS x{s} FROM {table} WHERE {f} IS NOT NULL"
        for f in FEATURES)


def _ks_ctes() -> list[str]:
    return [
        f"allc AS ({_cells_sql('base', 0)} UNION ALL {_cells_sql('synth', 1)})",
        "cnt AS (SELECT column_name, x, count(*) FILTER (WHERE side = 0) AS c_r, "
        "count(*) FILTER (WHERE side = 1) AS c_s FROM allc GROUP BY column_name, x)",
        "cum AS (SELECT *, sum(c_r) OVER w AS cr, sum(c_s) OVER w AS cs, "
        "sum(c_r) OVER (PARTITION BY column_name) AS n_r, sum(c_s) OVER (PARTITION BY column_name) AS n_s "
        "FROM cnt WINDOW w AS (PARTITION BY column_name ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        "st AS (SELECT column_name, n_r, n_s, max(abs(cr / n_r - cs / n_s)) AS statistic FROM cum "
        "GROUP BY column_name, n_r, n_s)",
        "ks AS (SELECT *, sqrt(CAST(n_r AS DOUBLE) * n_s / (n_r + n_s)) * statistic AS __lam FROM st)",
    ]


@query("e5_ks_two_sample", _with_synth(
    f"SELECT column_name, round(statistic, 6) AS statistic, round({evaluate.kolmogorov_sf_sql('__lam')}, 6) "
    "AS pvalue, CAST(n_r AS BIGINT) AS n_real, CAST(n_s AS BIGINT) AS n_synth FROM ks", _ks_ctes()))
def e5_ks_two_sample(spark, sf):
    ks = evaluate.ks_two_sample(*_both(spark, sf), FEATURES)
    return ks.withColumns({"statistic": F.round("statistic", 6), "pvalue": F.round("pvalue", 6)})


def _ad_sql(cells: str, keys: str = "column_name") -> str:
    crit = ", ".join(
        f"round({v!r} / (1.0 + 4.0 / n - 25.0 / (CAST(n AS DOUBLE) * n)), 3) AS {nm}"
        for nm, v in zip(["crit_15", "crit_10", "crit_5", "crit_2_5", "crit_1"], evaluate.AD_CRITICAL))
    term = (f"(2 * j - 1) * {log_phi_sql('__w')} + (2 * CAST(n AS DOUBLE) - 2 * j + 1) * {log_phi_sql('__mw')}")
    return (f"c AS ({cells}), "
            f"st AS (SELECT {keys}, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd FROM c GROUP BY {keys}), "
            f"r AS (SELECT c.*, row_number() OVER (PARTITION BY {keys} ORDER BY c.x) AS j, "
            f"st.n, st.mu, st.sd FROM c JOIN st USING ({keys})), "
            "w AS (SELECT *, (x - mu) / nullif(sd, 0) AS __w, -((x - mu) / nullif(sd, 0)) AS __mw FROM r), "
            f"a2 AS (SELECT {keys}, n, -CAST(n AS DOUBLE) - sum({term}) / CAST(n AS DOUBLE) AS statistic "
            f"FROM w GROUP BY {keys}, n) "
            f"SELECT {keys}, CAST(n AS BIGINT) AS n, round(statistic, 6) AS statistic, {crit} FROM a2")


@query("e6_anderson_darling", cs.with_ctes("SELECT 1").replace("\nSELECT 1", ", " + _ad_sql(_cells_sql("base"))))
def e6_anderson_darling(spark, sf):
    ad = evaluate.anderson_normal(_real(spark, sf), FEATURES)
    return ad.withColumn("statistic", F.round("statistic", 6))


@query("e6_anderson_comparison", "WITH " + ",\n".join(cs.synth_ctes(SEED)) + ",\n" + _ad_sql(
    f"SELECT 'real' AS side, * FROM ({_cells_sql('base')}) UNION ALL SELECT 'synthetic' AS side, * FROM ({_cells_sql('synth')})",
    "side, column_name"))
def e6_anderson_comparison(spark, sf):
    ad = evaluate.anderson_comparison(*_both(spark, sf), FEATURES)
    return ad.withColumn("statistic", F.round("statistic", 6))


def _moments_select(table: str, side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS column_name, '{side}' AS side, count({f}) AS n, avg({f}) AS mean, "
        f"var_samp({f}) AS variance, CASE WHEN count({f}) > 2 THEN skewness({f}) END AS skewness, "
        f"CASE WHEN count({f}) > 3 THEN kurtosis({f}) END AS kurtosis FROM {table}" for f in FEATURES)


def _sig(c: str) -> str:
    return sig_round_sql(c, 9)


@query("a9_moments", cs.with_ctes(
    "SELECT column_name, CAST(n AS BIGINT) AS n, " + ", ".join(f"{_sig(s)} AS {s}" for s in
                                                                ["mean", "variance", "skewness", "kurtosis"])
    + f" FROM ({_moments_select('base', 'real')})"))
def a9_moments(spark, sf):
    m = evaluate.moments(_real(spark, sf), FEATURES)
    return m.select("column_name", "n", *[sig_round(s).alias(s) for s in ["mean", "variance", "skewness", "kurtosis"]])


@query("e8_moment_comparison", _with_synth(
    "SELECT column_name, statistic, " + _sig("max(CASE WHEN side = 'real' THEN value END)") + " AS real, "
    + _sig("max(CASE WHEN side = 'synthetic' THEN value END)") + " AS synthetic FROM ("
    + " UNION ALL ".join(f"SELECT column_name, side, '{s}' AS statistic, {s} AS value FROM m"
                         for s in ["mean", "variance", "skewness", "kurtosis"])
    + ") GROUP BY column_name, statistic",
    [f"m AS ({_moments_select('base', 'real')} UNION ALL {_moments_select('synth', 'synthetic')})"]))
def e8_moment_comparison(spark, sf):
    m = evaluate.moment_comparison(*_both(spark, sf), FEATURES)
    return m.select("column_name", "statistic", sig_round("real").alias("real"),
                    sig_round("synthetic").alias("synthetic"))


def _joint_sql(a: str, b: str, va: str, vb: str, extra: str = "") -> str:
    """1 - total variation of the joint shares of two columns."""
    def side(table):
        return (f"SELECT {va} AS v1, {vb} AS v2, count(*)::DOUBLE / sum(count(*)) OVER () AS p "
                f"FROM {table}{extra} GROUP BY 1, 2")
    return (f"SELECT '{a}' AS column_1, '{b}' AS column_2, 1 - 0.5 * sum(abs(coalesce(r.p, 0) - coalesce(s.p, 0))) AS score "
            f"FROM ({side('base')}) r FULL JOIN ({side('synth')}) s ON r.v1 IS NOT DISTINCT FROM s.v1 AND r.v2 IS NOT DISTINCT FROM s.v2")


def _shapes_sql() -> str:
    cats = " UNION ALL ".join(
        f"SELECT column_1 AS column_name, 'TVComplement' AS metric, score FROM ({_joint_sql(k, k, k, '1')})" for k in GROUP_KEYS)
    return f"SELECT column_name, 'KSComplement' AS metric, 1 - statistic AS score FROM st UNION ALL {cats}"


@query("e3_column_shapes", _with_synth(
    f"SELECT column_name, metric, round(score, 6) AS score FROM ({_shapes_sql()})", _ks_ctes()))
def e3_column_shapes(spark, sf):
    s = evaluate.column_shapes(*_both(spark, sf), FEATURES, GROUP_KEYS)
    return s.withColumn("score", F.round("score", 6))


def _corr_ctes(table: str, name: str) -> list[str]:
    cond = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
    parts = []
    for i in range(D):
        for j in range(i + 1, D):
            parts.append(f"SELECT '{FEATURES[i]}' AS column_1, '{FEATURES[j]}' AS column_2, "
                         f"r_{i}_{j} AS rho FROM {name}_w")
    return cs.corr_ctes(f"{name}_w", table, cond) + [f"{name} AS ({' UNION ALL '.join(parts)})"]


def _mixed_pairs_sql(bins: int = evaluate.PAIR_BINS) -> str:
    """Pairs with a group key: features are cut into bins of the real range."""
    parts = [_joint_sql(a, b, a, b) for i, a in enumerate(GROUP_KEYS) for b in GROUP_KEYS[i + 1:]]
    for f in FEATURES:
        at = (f"CASE WHEN b_hi > b_lo THEN greatest(0, least(floor(({f} - b_lo) / (b_hi - b_lo) * {bins}), {bins - 1})) ELSE 0 END")
        bounds = f", (SELECT min({f}) AS b_lo, max({f}) AS b_hi FROM base)"
        parts += [_joint_sql(f, k, at, k, bounds) for k in GROUP_KEYS]
    return " UNION ALL ".join(f"SELECT column_1, column_2, NULL::DOUBLE AS real_correlation, NULL::DOUBLE AS synthetic_correlation, score FROM ({x})" for x in parts)


_PAIRS = ("SELECT r.column_1, r.column_2, r.rho AS real_correlation, s.rho AS synthetic_correlation, "
          "1 - abs(r.rho - s.rho) / 2 AS score FROM rc r JOIN sc s USING (column_1, column_2) UNION ALL "
          + _mixed_pairs_sql())


@query("e4_column_pair_trends", _with_synth(
    "SELECT column_1, column_2, round(real_correlation, 6) AS real_correlation, "
    "round(synthetic_correlation, 6) AS synthetic_correlation, round(score, 6) AS score FROM (" + _PAIRS + ")",
    _corr_ctes("base", "rc") + _corr_ctes("synth", "sc")))
def e4_column_pair_trends(spark, sf):
    t = evaluate.column_pair_trends(*_both(spark, sf), FEATURES, GROUP_KEYS)
    return t.select("column_1", "column_2", *[F.round(c, 6).alias(c) for c in
                                              ["real_correlation", "synthetic_correlation", "score"]])


@query("e2_quality_report", _with_synth(
    "SELECT property, round(score, 6) AS score FROM (SELECT 'Column Shapes' AS property, avg(score) AS score "
    f"FROM ({_shapes_sql()}) UNION ALL SELECT 'Column Pair Trends', avg(score) FROM ({_PAIRS}) "
    f"UNION ALL SELECT 'Overall', ((SELECT avg(score) FROM ({_shapes_sql()})) + (SELECT avg(score) FROM ({_PAIRS}))) / 2)",
    _ks_ctes() + _corr_ctes("base", "rc") + _corr_ctes("synth", "sc")))
def e2_quality_report(spark, sf):
    q = evaluate.quality_report(*_both(spark, sf), FEATURES, GROUP_KEYS)
    return q.withColumn("score", F.round("score", 6))


def _diag_sql() -> str:
    bounds = " UNION ALL ".join(
        f"SELECT '{f}' AS column_name, avg(CASE WHEN s.{f} >= b.lo AND s.{f} <= b.hi THEN 1.0 ELSE 0.0 END) AS score "
        f"FROM synth s, (SELECT min({f}) AS lo, max({f}) AS hi FROM base) b WHERE s.{f} IS NOT NULL" for f in FEATURES)
    cats = " UNION ALL ".join(
        f"SELECT '{k}' AS column_name, avg(CASE WHEN s.{k} IN (SELECT {k} FROM base) THEN 1.0 ELSE 0.0 END) AS score "
        f"FROM synth s" for k in GROUP_KEYS)
    key = ", ".join([*GROUP_KEYS, "k"])
    keys = (f"SELECT 'key' AS column_name, sum(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) / sum(n) AS score FROM "
            f"(SELECT count(*) AS n FROM synth GROUP BY {key})")
    # names shared by both tables over all names, the key's helper column aside
    structure = ("(SELECT count(*) FILTER (WHERE sides = 2)::DOUBLE / count(*) FROM (SELECT name, count(*) AS sides FROM ("
                 "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM base) UNION ALL "
                 "SELECT column_name FROM (DESCRIBE SELECT * EXCLUDE (k) FROM synth)) GROUP BY name))")
    return (f"SELECT property, round(score, 6) AS score FROM ("
            f"SELECT 'Data Validity' AS property, avg(score) AS score FROM ({bounds} UNION ALL {cats} UNION ALL {keys}) "
            f"UNION ALL SELECT 'Data Structure', {structure} "
            f"UNION ALL SELECT 'Overall', ((SELECT avg(score) FROM ({bounds} UNION ALL {cats} UNION ALL {keys})) + {structure}) / 2)")


@query("e1_diagnostic_report", _with_synth(_diag_sql()))
def e1_diagnostic_report(spark, sf):
    d = evaluate.diagnostic_report(*_both(spark, sf), FEATURES, GROUP_KEYS, [*GROUP_KEYS, "k"])
    return d.withColumn("score", F.round("score", 6))


@query("e7_correlation_comparison", _with_synth(
    "SELECT round(sqrt(2 * sum(power(r.rho - s.rho, 2))), 6) AS frobenius FROM rc r JOIN sc s USING (column_1, column_2)",
    _corr_ctes("base", "rc") + _corr_ctes("synth", "sc")))
def e7_correlation_comparison(spark, sf):
    def long(df):
        return copula.correlation_long(copula.correlation_stats(df, [], FEATURES), [], FEATURES)
    dist = copula.frobenius_distance(*[long(df) for df in _both(spark, sf)])
    return dist.select(F.round("frobenius", 6).alias("frobenius"))


def _bins_sql(bins: int = 20) -> str:
    return (f"SELECT column_name, bin, round(lo + bin * ((hi - lo) / {bins}), 6) AS bin_lo, "
            f"round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, "
            "round(c_r / sum(c_r) OVER (PARTITION BY column_name), 6) AS real_share, "
            "round(c_s / sum(c_s) OVER (PARTITION BY column_name), 6) AS synthetic_share FROM ("
            "SELECT column_name, bin, lo, hi, count(*) FILTER (WHERE side = 0) AS c_r, "
            "count(*) FILTER (WHERE side = 1) AS c_s FROM ("
            f"SELECT a.column_name, a.side, b.lo, b.hi, CAST(CASE WHEN b.hi > b.lo THEN greatest(0, least("
            f"floor((a.x - b.lo) / (b.hi - b.lo) * {bins}), {bins - 1})) ELSE 0 END AS INTEGER) AS bin "
            "FROM allc a JOIN (SELECT column_name, min(x) AS lo, max(x) AS hi FROM allc GROUP BY column_name) b "
            "USING (column_name)) GROUP BY column_name, bin, lo, hi)")


@query("e9_column_distributions", _with_synth(
    _bins_sql(), [f"allc AS ({_cells_sql('base', 0)} UNION ALL {_cells_sql('synth', 1)})"]))
def e9_column_distributions(spark, sf):
    d = evaluate.column_distributions(*_both(spark, sf), FEATURES, bins=20)
    return d.select("column_name", "bin", *[F.round(c, 6).alias(c) for c in
                                            ["bin_lo", "bin_hi", "real_share", "synthetic_share"]])


_PX, _PY = "total_gross_orig_receivable_amt", "contract_balance"


def _pair_bins_sql(bins: int = 10) -> str:
    def b(c, lo, hi):
        return (f"CAST(CASE WHEN {hi} > {lo} THEN greatest(0, least(floor(({c} - {lo}) / ({hi} - {lo}) * {bins}), "
                f"{bins - 1})) ELSE 0 END AS INTEGER)")
    pts = (f"SELECT CAST({_PX} AS DOUBLE) AS x, CAST({_PY} AS DOUBLE) AS y, 0 AS side FROM base "
           f"UNION ALL SELECT {_PX}, {_PY}, 1 FROM synth")
    return (f"SELECT bin_x, bin_y, round(c_r / sum(c_r) OVER (), 6) AS real_share, "
            f"round(c_s / sum(c_s) OVER (), 6) AS synthetic_share FROM (SELECT {b('x', 'lx', 'hx')} AS bin_x, "
            f"{b('y', 'ly', 'hy')} AS bin_y, count(*) FILTER (WHERE side = 0) AS c_r, "
            f"count(*) FILTER (WHERE side = 1) AS c_s FROM pts, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, "
            f"max(y) AS hy FROM pts) GROUP BY ALL)"), pts


@query("e10_column_pair_bins", _with_synth(_pair_bins_sql()[0], [f"pts AS ({_pair_bins_sql()[1]})"]))
def e10_column_pair_bins(spark, sf):
    p = evaluate.column_pair_bins(*_both(spark, sf), _PX, _PY, bins=10)
    return p.select("bin_x", "bin_y", F.round("real_share", 6).alias("real_share"),
                    F.round("synthetic_share", 6).alias("synthetic_share"))
