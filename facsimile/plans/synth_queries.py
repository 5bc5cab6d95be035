"""Catalogue part 5: parametric copula, identifiers/constraints, drivers, comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rng import uniform_sql
from ..functions.scalars import sig_round
from ..operators import constraints, copula, drivers, evaluate, latent, parametric, profile, project, store
from ..session import discard, dropped_shuffles, materialize
from ..sources import load
from ..sources.contracts import DOUBLE_FEATURES, FEATURES, GROUP_KEYS, ID_COLUMNS, START_DATE, contracts, dated_contracts, with_missing
from . import copula_sql as cs
from .basic_queries import LOOKUP_CONTRACT, _impute_sql
from .copula_queries import SEED, fitted, published
from .marginal_queries import _sig, _sql
from .registry import query, with_contracts


def param_model(spark, sf):
    return parametric.fit_parametric_copula(contracts(spark, sf), FEATURES, parametric.CONTRACT_FAMILIES)


def param_sample(m):
    """Ten synthetic rows per real row."""
    return parametric.sample_parametric_copula(m, 10 * m.n_rows, SEED)


_CHOSEN = " OR ".join(f"(column_name = '{c}' AND family = '{f}')" for c, f in parametric.CONTRACT_FAMILIES.items())


@query("c8_parametric_fit", _sql(
    "SELECT column_name, family, " + ", ".join(f"{_sig(c)} AS {c}" for c in ["p1", "p2", "loc", "scale"])
    + f" FROM params WHERE {_CHOSEN}"))
def c8_parametric_fit(spark, sf):
    from ..operators import marginals as mg
    stats, _ = mg.column_stats(contracts(spark, sf), FEATURES)
    p = mg.fit_params(stats, sorted(set(parametric.CONTRACT_FAMILIES.values())))
    p = p.where(F.expr(_CHOSEN))
    return p.select("column_name", "family", *[sig_round(c).alias(c) for c in ["p1", "p2", "loc", "scale"]])


MIXED = [*FEATURES, *GROUP_KEYS, START_DATE]


def mixed_model(spark, sf):
    """Numbers, categories and the start date of the contracts in one copula."""
    return parametric.fit_parametric_copula(dated_contracts(spark, sf), MIXED, parametric.CONTRACT_FAMILIES)


@query("c9_parametric_sample")
def c9_parametric_sample(spark, sf):
    return param_sample(mixed_model(spark, sf))


def _category_sql() -> str:
    """(feature, category, n, lo, hi, score) of the group keys, and ``scored``: a row's three scores."""
    parts = []
    for k in GROUP_KEYS:
        parts.append(f"i_{k} AS (SELECT {k} AS category, n, (cum - n) / CAST(total AS DOUBLE) AS lo, cum / CAST(total AS DOUBLE) AS hi FROM "
                     f"(SELECT {k}, n, CAST(sum(n) OVER (ORDER BY n DESC, {k}) AS BIGINT) AS cum, CAST(sum(n) OVER () AS BIGINT) AS total FROM "
                     f"(SELECT {k}, count(*) AS n FROM contracts GROUP BY {k})))")
    from ..functions.normal import probit_initial_sql, probit_refine_sql
    for k in GROUP_KEYS:
        ends = "".join(f", CASE WHEN {e} = {o} THEN 0.5 ELSE {e} END AS p_{e}" for e, o in (("lo", "0.0"), ("hi", "1.0")))
        start = ", ".join(f"{probit_initial_sql(f'p_{e}')} AS x_{e}" for e in ("lo", "hi"))
        fine = ", ".join(f"{probit_refine_sql(f'x_{e}', f'p_{e}')} AS z_{e}" for e in ("lo", "hi"))
        dens = {e: f"(CASE WHEN {e} = {o} THEN 0.0 ELSE exp(-0.5 * z_{e} * z_{e}) / sqrt(2 * pi()) END)" for e, o in (("lo", "0.0"), ("hi", "1.0"))}
        parts.append(f"s_{k} AS (SELECT category, n, lo, hi, ({dens['lo']} - {dens['hi']}) / (hi - lo) AS score FROM "
                     f"(SELECT *, {fine} FROM (SELECT *, {start} FROM (SELECT *{ends} FROM i_{k}))))")
    return ",\n".join(parts)


def _with_categories(body: str) -> str:
    return with_contracts(body).replace("\n" + body, ", " + _category_sql() + "\n" + body)


@query("c8_category_intervals", _with_categories(" UNION ALL ".join(
    f"SELECT '{k}' AS feature, category, n, round(lo, 9) AS lo, round(hi, 9) AS hi, round(score, 6) + 0.0 AS score FROM s_{k}" for k in GROUP_KEYS)))
def c8_category_intervals(spark, sf):
    """The interval of (0, 1) that each category owns, and the mean normal over it."""
    data = materialize(contracts(spark, sf).select(*GROUP_KEYS), "c8-keys")
    n = data.count()
    parts = [latent.category_intervals(data, [k], n).select(
        F.lit(k).alias("feature"), F.col(k).alias("category"), "n", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"),
        (F.round("score", 6) + 0.0).alias("score")) for k in GROUP_KEYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("c8_score_correlation", _with_categories("SELECT " + ", ".join(
    f"round(corr({a}.score, {b}.score), 6) + 0.0 AS r_{i}_{j}" for i, j, a, b in
    [(0, 1, "a", "b"), (0, 2, "a", "c"), (1, 2, "b", "c")]) + " FROM contracts t JOIN s_industry_segment a ON t.industry_segment = a.category "
    "JOIN s_state b ON t.state = b.category JOIN s_PD_status c ON t.PD_status = c.category"))
def c8_score_correlation(spark, sf):
    """Correlations of the group keys' scores, from which the latent ones are solved."""
    data = materialize(contracts(spark, sf).select(*GROUP_KEYS), "c8-keys")
    features, n = [[k] for k in GROUP_KEYS], data.count()
    tables = [latent.category_intervals(data, f, n) for f in features]
    scores = parametric._score_columns(data, [], [], features, tables)
    r = latent.pairwise_correlations(scores, scores.columns, {})
    pairs = [(0, 1), (0, 2), (1, 2)]
    row = spark.createDataFrame([tuple(float(r[i, j]) for i, j in pairs)], ", ".join(f"r_{i}_{j} double" for i, j in pairs))
    return row.select(*[(F.round(c, 6) + 0.0).alias(c) for c in row.columns])


def missing_model(spark, sf):
    """The contracts with blanked cells: no row is complete in all of many columns, none is dropped."""
    return parametric.fit_parametric_copula(with_missing(contracts(spark, sf)), FEATURES, parametric.CONTRACT_FAMILIES)


@query("c8_missing_shares", with_contracts(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL{f' OR isnan({c})' if c in DOUBLE_FEATURES else ''} THEN 1.0 ELSE 0.0 END), 9) AS share FROM dirty"
    for c in FEATURES), dirty=True))
def c8_missing_shares(spark, sf):
    """What the fitted model holds as each column's share of missing values."""
    m = missing_model(spark, sf)
    return spark.createDataFrame([(c, round(m.nullable.get(c, 0.0), 9)) for c in FEATURES], "column_name string, share double")


@query("c9_missing_sample")
def c9_missing_sample(spark, sf):
    """Shares of missing values, real and sampled, and how far apart they are in standard errors."""
    m = missing_model(spark, sf)
    n = 10 * m.n_rows
    real = profile.missing_counts(with_missing(contracts(spark, sf)), FEATURES).select("column_name", (F.col("null_count") / m.n_rows).alias("real_share"))
    synth = profile.missing_counts(param_sample(m), FEATURES).select("column_name", (F.col("null_count") / n).alias("synthetic_share"))
    p = F.col("real_share")
    return real.join(synth, "column_name").withColumn("standard_errors", F.abs(F.col("synthetic_share") - p) / F.sqrt(p * (1 - p) / n))


@query("e2_mixed_quality")
def e2_mixed_quality(spark, sf):
    """E2 over numbers, the date and the categories of the mixed copula's sample."""
    real = materialize(dated_contracts(spark, sf).select(*MIXED), "e2-real")
    s = materialize(parametric.sample_parametric_copula(parametric.fit_parametric_copula(real, MIXED, parametric.CONTRACT_FAMILIES), real.count(), SEED), "e2-synth")
    day = F.unix_date(START_DATE)
    return evaluate.quality_report(real.withColumn(START_DATE, day), s.withColumn(START_DATE, day), [*FEATURES, START_DATE], GROUP_KEYS)


def _by_column(df, measures):
    """(column_name, measures) of the features, by one aggregation of whole rows."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[f(F.col(c).cast("double")).alias(f"{m}_{i}") for i, c in enumerate(FEATURES) for m, f in measures.items()])
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, c in enumerate(FEATURES)]
    return wide.where("__n > 0").select(F.inline(F.array(*rows)))


@query("c10_minmax_enforced")
def c10_minmax_enforced(spark, sf):
    """Per column: real bounds and the synthetic range (must lie inside)."""
    m = param_model(spark, sf)
    s = param_sample(m)
    rng = _by_column(s, {"synth_min": F.min, "synth_max": F.max})
    return m.bounds.join(rng, "column_name").withColumn(
        "inside", (F.col("synth_min") >= F.col("lo")) & (F.col("synth_max") <= F.col("hi")))


@query("c11_rounding_enforced")
def c11_rounding_enforced(spark, sf):
    """Per column: decimals learnt from the real data and found in the sample."""
    m = param_model(spark, sf)
    s = param_sample(m)
    dec = _by_column(s, {"synth_decimals": lambda x: F.max(parametric.decimals_of(x))})
    return m.bounds.select("column_name", "decimals").join(dec, "column_name")


@query("c12_uniqueness_check", with_contracts(
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, count(*) FILTER (WHERE n > 1) "
    "AS n_duplicated_keys, count(*) FILTER (WHERE n > 1) = 0 AS satisfied FROM "
    "(SELECT contract_number, count(*) AS n FROM contracts GROUP BY contract_number)"))
def c12_uniqueness_check(spark, sf):
    return constraints.uniqueness_check(contracts(spark, sf), ["contract_number"])


@query("c12_unique_keys")
def c12_unique_keys(spark, sf):
    s = param_sample(param_model(spark, sf))
    keyed = constraints.dense_keys(s, "id")
    return constraints.uniqueness_check(keyed, ["contract_number"])


TIED = ["customer_number", "contract_number", "customer_name"]


@query("c13_fixed_combinations", with_contracts("SELECT 10 * count(*) AS n_rows, CAST(0 AS BIGINT) AS n_violations FROM contracts"))
def c13_fixed_combinations(spark, sf):
    """The copula with (customer_number, contract_number, customer_name) as one feature: the check
    (anti join) must come back empty -> reported as counts."""
    real = contracts(spark, sf)
    m = parametric.fit_parametric_copula(real, [*FEATURES, *TIED], parametric.CONTRACT_FAMILIES, combinations=[TIED])
    # a tuple is checked once, with the number of rows that hold it
    s = materialize(param_sample(m).groupBy(*TIED).agg(F.count(F.lit(1)).alias("n")), "c13")
    discard(m.intervals[0])
    with dropped_shuffles(spark):
        bad = constraints.fixed_combinations_check(s, real, TIED, ["n"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return s.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).withColumn("n_violations", F.lit(bad).cast("bigint"))


@query("c13_tuple_shares")
def c13_tuple_shares(spark, sf):
    """Segment, state and status as one feature: each tuple's share among real and sampled rows."""
    real = contracts(spark, sf)
    m = parametric.fit_parametric_copula(real, ["contract_balance", *GROUP_KEYS], parametric.CONTRACT_FAMILIES, combinations=[GROUP_KEYS])
    s = param_sample(m)
    share = lambda df, name, n: df.groupBy(*GROUP_KEYS).agg((F.count(F.lit(1)) / n).alias(name))
    return share(real, "real_share", m.n_rows).join(share(s, "synthetic_share", 10 * m.n_rows), GROUP_KEYS, "full_outer")


@query("c14_reattach_ids")
def c14_reattach_ids(spark, sf):
    ids = contracts(spark, sf).select(*ID_COLUMNS)
    m = param_model(spark, sf)
    # there are as many identifiers as real rows: those rows are drawn beside them, what the sample has beyond gets none
    first = lambda positions: parametric.sample_parametric_copula(m, m.n_rows, SEED, ids=positions)
    rest = parametric.sample_parametric_copula(m, 9 * m.n_rows, SEED, first_id=m.n_rows)
    out = constraints.reattach_ids(first, ids, ["id"], ["customer_number", "contract_number"], ID_COLUMNS, position="id")
    return out.unionByName(rest, allowMissingColumns=True)


@query("c15_key_map", with_contracts(
    "SELECT hashed_real_pk, 'SYN-' || lpad(CAST(row_number() OVER (ORDER BY hashed_real_pk) - 1 AS VARCHAR), 12, '0') "
    "AS synthetic_pk FROM (SELECT DISTINCT sha256(CAST(customer_number AS VARCHAR)) AS hashed_real_pk FROM contracts)"))
def c15_key_map(spark, sf):
    return constraints.key_map(contracts(spark, sf), "customer_number")


def _j1_sql() -> str:
    body = (f"SELECT s.ordinal, s.{', s.'.join(GROUP_KEYS)}, s.k, {', '.join(f'round(s.{f}, {cs.VALUE_DECIMALS}) + 0.0 AS {f}' for f in FEATURES)}, "
            "r.old_customer_number, r.old_contract_number FROM "
            f"(SELECT *, row_number() OVER (ORDER BY {', '.join(GROUP_KEYS)}, k) - 1 AS ordinal FROM synth) s "
            "FULL OUTER JOIN (SELECT customer_number AS old_customer_number, contract_number AS old_contract_number, "
            "row_number() OVER (ORDER BY customer_number, contract_number) - 1 AS ordinal FROM base2) r "
            "USING (ordinal)")
    return "WITH " + ",\n".join(cs.synth_ctes(SEED) + ["base2 AS (SELECT * FROM contracts)"]) + "\n" + body


@query("j1_ordinal_join", _j1_sql())
def j1_ordinal_join(spark, sf):
    m = fitted(spark, sf)
    synth = copula.with_position(published(copula.sample_group_copula(m, SEED)), m, "__pos")
    ids = contracts(spark, sf).select(F.col("customer_number").alias("old_customer_number"),
                                      F.col("contract_number").alias("old_contract_number"))
    out = constraints.ordinal_join(synth, ids, [*GROUP_KEYS, "k"],
                                   ["old_customer_number", "old_contract_number"], "ordinal", "__pos")
    return out.select(F.col("ordinal"), *GROUP_KEYS, "k", *FEATURES, "old_customer_number", "old_contract_number")


@query("e11_entity_side_by_side", _j1_sql().replace(
    "\nSELECT s.ordinal", "\n, j1 AS (SELECT s.ordinal").replace("USING (ordinal)", "USING (ordinal)) ")
    + "SELECT 'synthetic' AS source, old_contract_number AS contract_number, "
    + ", ".join(FEATURES) + f" FROM j1 WHERE old_contract_number = '{LOOKUP_CONTRACT}' UNION ALL "
    + "SELECT 'real', contract_number, " + ", ".join(FEATURES)
    + f" FROM contracts WHERE contract_number = '{LOOKUP_CONTRACT}'")
def e11_entity_side_by_side(spark, sf):
    synth = j1_ordinal_join(spark, sf).withColumnRenamed("old_contract_number", "contract_number")
    real = contracts(spark, sf)
    both = evaluate.side_by_side(real, synth, "contract_number", LOOKUP_CONTRACT)
    return both.select("source", "contract_number", *FEATURES)


def driver_model(spark, sf):
    df = project.label_score(contracts(spark, sf))
    return drivers.fit_drivers(df, FEATURES, "pd_status_score", ["contract_number", "customer_number"], seed=0)


@query("m1_impute_mean", with_contracts(_impute_sql(), dirty=True))
def m1_impute_mean(spark, sf):
    dirty = with_missing(contracts(spark, sf))
    filled = profile.impute_mean(dirty, FEATURES)
    return filled.select("contract_number", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("m2_random_forest")
def m2_random_forest(spark, sf):
    return drivers.evaluate_drivers(driver_model(spark, sf))


_IN_TRAIN = uniform_sql(0, "split", ["contract_number", "customer_number"], dialect="duckdb")


@query("m2_split_sizes", with_contracts(
    f"SELECT count(*) FILTER (WHERE t) AS n_train, count(*) FILTER (WHERE NOT t) AS n_test, CAST(0 AS BIGINT) AS n_unlabelled FROM (SELECT {_IN_TRAIN} < 0.75 AS t FROM contracts)"))
def m2_split_sizes(spark, sf):
    """Rows that the forest learns from and is scored on."""
    m = driver_model(spark, sf)
    return spark.createDataFrame([(m.train.count(), m.test.count(), m.n_unlabelled)], "n_train bigint, n_test bigint, n_unlabelled bigint")


@query("m3_feature_importance")
def m3_feature_importance(spark, sf):
    return drivers.feature_importances(driver_model(spark, sf))


_FEATURE_ROWS = ", ".join(f"('{f}')" for f in FEATURES)


@query("m3_importance_check", f"SELECT feature, true AS in_range, true AS sums_to_one, true AS ranked FROM (VALUES {_FEATURE_ROWS}) t(feature)")
def m3_importance_check(spark, sf):
    """Every feature once, importances in [0, 1] that sum to 1, ranks 1 to 9 in their order."""
    imp = drivers.feature_importances(driver_model(spark, sf))
    every = Window.partitionBy()  # one row for each feature
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return imp.select("feature", F.col("importance").between(0, 1).alias("in_range"),
                      (F.abs(F.sum("importance").over(every) - 1) < 1e-9).alias("sums_to_one"), (place == F.col("rank")).alias("ranked"))


@query("w4_rank_importances")
def w4_rank_importances(spark, sf):
    return drivers.feature_importances(driver_model(spark, sf)).orderBy("rank")


@query("m4_permutation_importance")
def m4_permutation_importance(spark, sf):
    return drivers.permutation_importance(driver_model(spark, sf))


@query("m4_shapley_summary")
def m4_shapley_summary(spark, sf):
    return drivers.shapley_summary(driver_model(spark, sf))


@query("m4_shapley_additivity", with_contracts(
    f"SELECT count(*) AS n_rows, CAST({len(FEATURES)} * count(*) AS BIGINT) AS n_values, true AS additive FROM contracts WHERE NOT ({_IN_TRAIN} < 0.75)"))
def m4_shapley_additivity(spark, sf):
    """A row's values add up to its prediction less the mean prediction of its backgrounds."""
    v = drivers.shapley_values(driver_model(spark, sf), pairs=1)
    rows = v.groupBy("contract_number").agg(F.count("value").alias("k"), (F.abs(F.sum("value") - F.first("prediction") + F.first("base")) < 1e-9).alias("ok"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("k").alias("n_values"), F.bool_and("ok").alias("additive"))


@query("c16_synthesizer_comparison")
def c16_synthesizer_comparison(spark, sf):
    """Quality reports of four candidate synthetic tables, ranked."""
    real = materialize(copula.complete_rows(contracts(spark, sf), FEATURES).select(*FEATURES), "c16-real")
    m = param_model(spark, sf)
    return evaluate.compare_candidates(real, {
        "group_copula": copula.sample_group_copula(fitted(spark, sf), SEED).select(*FEATURES),
        "parametric_copula": param_sample(m).select(*FEATURES),
        "independent_marginals": parametric.independent_marginals(m, m.n_rows).select(*FEATURES),
        "independent_bootstrap": parametric.independent_bootstrap(real, FEATURES, m.n_rows, written=True).select(*FEATURES),
    }, FEATURES)


# --- stored models -----------------------------------------------------------------

@query("s8_group_model_store", cs.copula_rows_sql(SEED))
def s8_group_model_store(spark, sf):
    """The group copula, saved and loaded, samples the rows of C1."""
    path = load.scratch_path(spark, "group-model")
    store.save_model(fitted(spark, sf), path)
    return published(copula.sample_group_copula(store.load_model(spark, path), SEED))


@query("s8_parametric_model_store", with_contracts("SELECT 10 * count(*) AS n_rows, true AS same FROM contracts"))
def s8_parametric_model_store(spark, sf):
    """Rows of a sample before the mixed model is saved and after it is loaded, hash by hash."""
    path = load.scratch_path(spark, "parametric-model")
    m = mixed_model(spark, sf)
    store.save_model(m, path)

    def digest(s):
        """The number of rows and the sum of their hashes, in three pieces that no number of rows lets overflow."""
        hashed = s.select(F.xxhash64(*s.columns).alias("h"))
        pieces = [F.shiftright("h", 44), F.shiftright("h", 22).bitwiseAND(F.lit(4194303)), F.col("h").bitwiseAND(F.lit(4194303))]
        return hashed.agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"h{i}") for i, p in enumerate(pieces)]).first()

    before, after = digest(param_sample(m)), digest(param_sample(store.load_model(spark, path)))
    return spark.createDataFrame([(after["n"], before == after)], "n_rows bigint, same boolean")
