"""Catalogue part 1: sources, projection, filters, profile, sorts, scalars, generator."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.normal import phi_sql, probit_initial_sql, probit_refine_sql, with_probit
from ..functions.rng import hash_u, hex_hash, uniform_from_hex
from ..functions.scalars import composite_key, fixed4, sha256_hex, to_double, to_string
from ..operators import filters, generate, profile, project
from ..operators.joins import semi_join_values
from ..operators.scan import ordinal
from ..sources import load
from ..sources.contracts import (COUNT_FEATURES, DOUBLE_FEATURES, FEATURES, GROUP_KEYS,
                                 ID_COLUMNS, contract_sources, contracts, read_table,
                                 spread, with_missing)
from .registry import with_contracts, query

CONTRACT_COLS = FEATURES + GROUP_KEYS + ["customer_number", "customer_name", "contract_number"]
ALL = ", ".join(CONTRACT_COLS)
FEATS = ", ".join(FEATURES)
KEYS = ", ".join(GROUP_KEYS)
R6 = lambda c: f"round({c}, 6)"

# The drop list of the parametric notebook (with its duplicate
# entry and names absent from our table) and the analysis projection.
DROP_LIST = ["as_of_date", "region", "member_lender_branch",
             "member_lender_business_unit", "member_lender_business_unit",
             "member_lender_risk_rating", "default_4q_flg", "default_8q_flg",
             "borrower_high_credit", "naics_code", "primary_collateral_type",
             "most_recent_0130", "most_recent_3160", "most_recent_6190",
             "most_recent_over90_dpd", "sic_code", "contract_sbu", "Portfolio",
             "oldest_contract_start_date", "newest_contract_start_date",
             "contract_collateral", "industry_segment", "state"]
LOOKUP_CONTRACT = "0-2-459-60"
SEED = 453


# --- sources --------------------------------------------------------------

@query("s1_tagged_load", with_contracts(f"SELECT {ALL} FROM contracts"))
def s1_tagged_load(spark, sf):
    return load.load_tagged(contract_sources(spark, sf)).select(*CONTRACT_COLS)


@query("s2_catalog_scan", with_contracts(f"SELECT {ALL} FROM contracts"))
def s2_catalog_scan(spark, sf):
    contracts(spark, sf).createOrReplaceTempView("facsimile_contracts")
    return load.read_catalog_table(spark, "facsimile_contracts").select(*CONTRACT_COLS)


@query("s3_row_generator", with_contracts(
    "SELECT unnest(range((SELECT count(*) * 10 FROM contracts))) AS id"))
def s3_row_generator(spark, sf):
    n = contracts(spark, sf).count()
    return load.row_ids(spark, 10 * n).select(F.col("id"))


@query("s4_csv_sink", with_contracts(f"SELECT {ALL} FROM contracts"))
def s4_csv_sink(spark, sf):
    df = contracts(spark, sf).select(*CONTRACT_COLS)
    path = load.write_csv(df, load.scratch_path(spark, "csv"))
    return load.read_csv(spark, path, df.schema)


@query("s5_csv_scan", with_contracts(
    f"SELECT contract_number, {FEATS}, {KEYS} FROM contracts"))
def s5_csv_scan(spark, sf):
    df = contracts(spark, sf).select("contract_number", *FEATURES, *GROUP_KEYS)
    path = load.write_csv(df, load.scratch_path(spark, "csv"))
    as_text = StructType([StructField(c, StringType()) for c in df.columns])
    raw = load.read_csv(spark, path, as_text)
    types = {c: "double" for c in DOUBLE_FEATURES} | {c: "bigint" for c in COUNT_FEATURES}
    return project.bulk_cast(raw, types)


@query("s6_tsv_sink", with_contracts(f"SELECT {KEYS}, contract_number, {FEATS} FROM contracts"))
def s6_tsv_sink(spark, sf):
    df = contracts(spark, sf).select(*GROUP_KEYS, "contract_number", *FEATURES)
    path = load.write_tsv(df, load.scratch_path(spark, "tsv"))
    return load.read_tsv(spark, path, df.schema)


# --- projection -------------------------------------------------------------

@query("p1_select", with_contracts(f"SELECT {FEATS}, {KEYS} FROM contracts"))
def p1_select(spark, sf):
    return project.select_columns(contracts(spark, sf), FEATURES + GROUP_KEYS)


@query("p2_drop", with_contracts(
    f"SELECT {FEATS}, PD_status, customer_number, customer_name, contract_number FROM contracts"))
def p2_drop(spark, sf):
    return project.drop_columns(contracts(spark, sf), DROP_LIST)


_SCORE_SQL = ("CAST(CASE WHEN PD_status = 'performing' THEN 0 "
              "WHEN PD_status = 'defaulted' THEN 1 ELSE NULL END AS INTEGER)")


@query("p3_label_score", with_contracts(
    f"SELECT contract_number, PD_status, {_SCORE_SQL} AS pd_status_score FROM contracts"))
def p3_label_score(spark, sf):
    return project.label_score(contracts(spark, sf)).select(
        "contract_number", "PD_status", "pd_status_score")


@query("p4_label_mixed", with_contracts(
    f"SELECT {KEYS}, {_SCORE_SQL} AS pd_status_score, count(*) AS n FROM contracts "
    f"GROUP BY ALL"))
def p4_label_mixed(spark, sf):
    tagged = load.load_tagged(contract_sources(spark, sf))
    scored = project.label_score(tagged)
    return scored.groupBy(*GROUP_KEYS, "pd_status_score").agg(F.count(F.lit(1)).alias("n"))


@query("p5_bulk_cast", with_contracts(
    "SELECT contract_number, "
    + ", ".join([f"CAST({c} AS DOUBLE) AS {c}" for c in DOUBLE_FEATURES]
                + [f"CAST({c} AS INTEGER) AS {c}" for c in COUNT_FEATURES])
    + " FROM contracts"))
def p5_bulk_cast(spark, sf):
    types = {c: "double" for c in DOUBLE_FEATURES} | {c: "int" for c in COUNT_FEATURES}
    return project.bulk_cast(contracts(spark, sf), types).select(
        "contract_number", *DOUBLE_FEATURES, *COUNT_FEATURES)


@query("p6_rename_ids", with_contracts(
    "SELECT customer_number AS old_customer_number, customer_name AS old_customer_name, "
    "contract_number AS old_contract_number, PD_status AS old_PD_status FROM contracts"))
def p6_rename_ids(spark, sf):
    ids = contracts(spark, sf).select(*ID_COLUMNS)
    return project.rename_columns(ids, {c: f"old_{c}" for c in ID_COLUMNS})


@query("p7_select_numeric", with_contracts(f"SELECT {FEATS}, customer_number FROM contracts"))
def p7_select_numeric(spark, sf):
    return project.select_numeric(contracts(spark, sf))


@query("p9_constant_column", with_contracts(
    "SELECT contract_number, 'Synthetic' AS type_of_data FROM contracts"))
def p9_constant_column(spark, sf):
    df = contracts(spark, sf).select("contract_number")
    return project.with_constant(df, "type_of_data", "Synthetic")


def _meta_sql(table: str, kinds: dict[str, str]) -> str:
    parts = []
    for c, k in kinds.items():
        miss = f"({c} IS NULL OR isnan({c}))" if k == "float" else f"({c} IS NULL)"
        hint = any(c.lower().endswith(h) for h in project.ID_HINTS)
        nd = f"count(DISTINCT CASE WHEN NOT {miss} THEN CAST({c} AS VARCHAR) END)"
        nm = f"count(*) FILTER (WHERE {miss})"
        if k in ("integer", "float"):
            other = "'numerical'"
        else:
            other = "'categorical'"
        sd = (f"CASE WHEN {str(hint).upper()} AND {nm} = 0 AND {nd} = count(*) THEN 'id' "
              f"ELSE {other} END")
        parts.append(f"SELECT '{c}' AS column_name, '{k}' AS kind, {sd} AS sdtype, "
                     f"count(*) AS n_rows, {nm} AS n_missing, {nd} AS n_distinct FROM {table}")
    return " UNION ALL ".join(parts)


_CONTRACT_KINDS = {**{c: "float" for c in DOUBLE_FEATURES}, **{c: "integer" for c in COUNT_FEATURES},
                   "industry_segment": "string", "state": "string", "PD_status": "string",
                   "customer_number": "integer", "customer_name": "string",
                   "contract_number": "string"}


@query("p10_detect_metadata", with_contracts(_meta_sql("contracts", _CONTRACT_KINDS)))
def p10_detect_metadata(spark, sf):
    return project.detect_metadata(contracts(spark, sf))


@query("s8_metadata_save", with_contracts(_meta_sql("contracts", _CONTRACT_KINDS)))
def s8_metadata_save(spark, sf):
    meta = project.detect_metadata(contracts(spark, sf))
    path = load.save_metadata(meta, load.scratch_path(spark, "meta"))
    return load.load_metadata(spark, path, meta.schema)


# --- filters ----------------------------------------------------------------

@query("p10_validate_metadata", with_contracts(
    f"SELECT CAST({len(CONTRACT_COLS)} AS BIGINT) AS n_columns, count(DISTINCT column_name) AS n_described, "
    "CAST(sum(CASE WHEN sdtype = 'id' THEN 1 ELSE 0 END) AS BIGINT) AS n_ids, "
    f"count(DISTINCT column_name) = {len(CONTRACT_COLS)} AND sum(CASE WHEN sdtype = 'id' THEN 1 ELSE 0 END) <= 1 AS valid "
    f"FROM ({_meta_sql('contracts', _CONTRACT_KINDS)})"))
def p10_validate_metadata(spark, sf):
    df = contracts(spark, sf).select(*CONTRACT_COLS)
    return project.validate_metadata(project.detect_metadata(df), CONTRACT_COLS)


@query("f1_conjunctive_equality", with_contracts(
    f"SELECT {ALL} FROM contracts WHERE industry_segment = 'BUILDING' AND state = 'NATION_3'"))
def f1_conjunctive_equality(spark, sf):
    return filters.where_equal(contracts(spark, sf),
                               {"industry_segment": "BUILDING", "state": "NATION_3"}).select(*CONTRACT_COLS)


@query("f2_point_lookup", with_contracts(
    f"SELECT {ALL} FROM contracts WHERE contract_number = '{LOOKUP_CONTRACT}'"))
def f2_point_lookup(spark, sf):
    return filters.point_lookup(contracts(spark, sf), "contract_number",
                                LOOKUP_CONTRACT).select(*CONTRACT_COLS)


@query("f3_membership_semi", with_contracts(
    f"SELECT {ALL} FROM contracts WHERE contract_number IN "
    f"(SELECT DISTINCT contract_number FROM contracts)"))
def f3_membership_semi(spark, sf):
    return filters.member_of(contracts(spark, sf), "contract_number").select(*CONTRACT_COLS)


@query("j2_semi_join", with_contracts(
    f"SELECT {ALL} FROM contracts WHERE customer_number IN "
    f"(SELECT customer_number FROM contracts WHERE state = 'NATION_3')"))
def j2_semi_join(spark, sf):
    """All contracts of customers of one state (the value set repeats its keys)."""
    df = contracts(spark, sf)
    values = df.where(F.col("state") == "NATION_3").select("customer_number")
    return semi_join_values(df, values, "customer_number").select(*CONTRACT_COLS)


@query("f4_missing_predicate", with_contracts(
    "SELECT contract_number, contract_balance IS NULL AS is_null, "
    "coalesce(isnan(contract_balance), false) AS is_nan FROM dirty "
    "WHERE contract_balance IS NULL OR isnan(contract_balance)", dirty=True))
def f4_missing_predicate(spark, sf):
    dirty = with_missing(contracts(spark, sf))
    rows = filters.missing_rows(dirty, "contract_balance")
    return rows.select("contract_number",
                       F.col("contract_balance").isNull().alias("is_null"),
                       F.coalesce(F.isnan("contract_balance"), F.lit(False)).alias("is_nan"))


@query("f5_drop_missing", with_contracts(
    "SELECT contract_number, contract_balance FROM dirty "
    "WHERE NOT (contract_balance IS NULL OR isnan(contract_balance))", dirty=True))
def f5_drop_missing(spark, sf):
    dirty = with_missing(contracts(spark, sf))
    return filters.drop_missing(dirty, "contract_balance").select("contract_number", "contract_balance")


# --- aggregation / profile ---------------------------------------------------

def _missing_sql() -> str:
    parts = []
    for c in FEATURES + GROUP_KEYS + ["customer_number", "customer_name", "contract_number"]:
        miss = f"({c} IS NULL OR isnan({c}))" if c in DOUBLE_FEATURES else f"({c} IS NULL)"
        parts.append(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {miss}) AS null_count FROM dirty")
    return " UNION ALL ".join(parts)


@query("a1_missing_counts", with_contracts(_missing_sql(), dirty=True))
def a1_missing_counts(spark, sf):
    dirty = with_missing(contracts(spark, sf)).select(*CONTRACT_COLS)
    return profile.missing_counts(dirty)


@query("a2_class_shares", with_contracts(
    "SELECT PD_status, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) AS n "
    "FROM contracts GROUP BY PD_status"))
def a2_class_shares(spark, sf):
    out = profile.class_shares(contracts(spark, sf), "PD_status")
    return out.withColumn("share", F.round("share", 6))


@query("a3_group_counts", with_contracts(f"SELECT {KEYS}, count(*) AS n FROM contracts GROUP BY ALL"))
def a3_group_counts(spark, sf):
    return profile.group_counts(contracts(spark, sf), GROUP_KEYS)


@query("a4_group_rows", with_contracts(
    f"SELECT {KEYS}, row_number() OVER (PARTITION BY {KEYS} ORDER BY contract_number) - 1 AS ordinal, "
    f"{FEATS} FROM contracts"))
def a4_group_rows(spark, sf):
    df = contracts(spark, sf).select(*GROUP_KEYS, "contract_number", *FEATURES)
    return profile.group_rows(df, GROUP_KEYS, ["contract_number"]).select(
        *GROUP_KEYS, "ordinal", *FEATURES)


@query("a5_group_means", with_contracts(
    f"SELECT {KEYS}, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in FEATURES)
    + " FROM contracts GROUP BY ALL"))
def a5_group_means(spark, sf):
    out = profile.group_means(contracts(spark, sf), GROUP_KEYS, FEATURES)
    return out.withColumns({f"mean_{c}": F.round(f"mean_{c}", 6) for c in FEATURES})


@query("a10_first_per_group", with_contracts(
    f"SELECT {KEYS}, contract_number, {FEATS} FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY {KEYS} ORDER BY contract_number) AS rn FROM contracts) WHERE rn = 1"))
def a10_first_per_group(spark, sf):
    df = contracts(spark, sf).select(*GROUP_KEYS, "contract_number", *FEATURES)
    return profile.first_per_group(df, GROUP_KEYS, ["contract_number"]).select(
        *GROUP_KEYS, "contract_number", *FEATURES)


@query("a11_distinct_values", with_contracts("SELECT DISTINCT customer_number FROM contracts"))
def a11_distinct_values(spark, sf):
    return profile.distinct_values(contracts(spark, sf), "customer_number")


@query("a12_row_count", with_contracts("SELECT count(*) AS n_rows FROM contracts"))
def a12_row_count(spark, sf):
    return profile.row_count(contracts(spark, sf))


def _impute_sql() -> str:
    means = ", ".join(
        f"avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN NULL ELSE {c} END) AS m_{c}"
        if c in DOUBLE_FEATURES else f"avg({c}) AS m_{c}" for c in FEATURES)
    cols = []
    for c in FEATURES:
        miss = f"({c} IS NULL OR isnan({c}))" if c in DOUBLE_FEATURES else f"({c} IS NULL)"
        cols.append(f"round(CASE WHEN {miss} THEN m_{c} ELSE CAST({c} AS DOUBLE) END, 6) AS {c}")
    return (f"SELECT contract_number, {', '.join(cols)} FROM dirty, "
            f"(SELECT {means} FROM dirty) AS m")


@query("a13_mean_impute", with_contracts(_impute_sql(), dirty=True))
def a13_mean_impute(spark, sf):
    dirty = with_missing(contracts(spark, sf))
    filled = profile.impute_mean(dirty, FEATURES)
    return filled.select("contract_number", *[F.round(c, 6).alias(c) for c in FEATURES])


# --- sorts, windows, sampling, union ----------------------------------------

@query("w1_group_ordinal", with_contracts(
    f"SELECT {KEYS}, contract_number, row_number() OVER (PARTITION BY {KEYS} "
    f"ORDER BY contract_number) - 1 AS ordinal FROM contracts"))
def w1_group_ordinal(spark, sf):
    df = contracts(spark, sf).select(*GROUP_KEYS, "contract_number")
    return ordinal(df, GROUP_KEYS, ["contract_number"], "ordinal")


@query("w2_sort_keys", with_contracts(
    "SELECT customer_number, contract_number, row_number() OVER (ORDER BY customer_number "
    "NULLS LAST, contract_number NULLS LAST) - 1 AS position FROM contracts"))
def w2_sort_keys(spark, sf):
    df = contracts(spark, sf).select("customer_number", "contract_number")
    order = [F.col("customer_number").asc_nulls_last(), F.col("contract_number").asc_nulls_last()]
    return ordinal(df, [], order, "position")


@query("w5_top_n", with_contracts(
    f"SELECT {ALL} FROM contracts ORDER BY contract_balance DESC, contract_number LIMIT 60"))
def w5_top_n(spark, sf):
    return profile.top_n(contracts(spark, sf).select(*CONTRACT_COLS),
                         [F.col("contract_balance").desc(), F.col("contract_number")], 60)


def _u(seed, stream, keys):
    return uniform_from_hex(hex_hash(seed, stream, keys, "duckdb"), 0, "duckdb")


@query("w6_shuffle_within_group", with_contracts(
    "SELECT PD_status, contract_number, row_number() OVER (PARTITION BY PD_status ORDER BY "
    f"{_u(SEED, 'shuffle', ['contract_number'])}, contract_number) - 1 AS shuffled_ordinal "
    "FROM contracts"))
def w6_shuffle_within_group(spark, sf):
    df = contracts(spark, sf).select("PD_status", "contract_number")
    return profile.shuffle_within_group(df, ["PD_status"], ["contract_number"], SEED)


@query("w7_train_test_split", with_contracts(
    f"SELECT contract_number, {_u(0, 'split', ['contract_number'])} < 0.75 AS is_train FROM contracts"))
def w7_train_test_split(spark, sf):
    df = contracts(spark, sf).select("contract_number")
    return profile.train_test_split(df, ["contract_number"], seed=0)


@query("u1_union_all", with_contracts(
    f"SELECT {FEATS}, contract_number FROM contracts WHERE PD_status = 'performing' "
    f"UNION ALL SELECT {FEATS}, contract_number FROM contracts WHERE PD_status = 'defaulted'"))
def u1_union_all(spark, sf):
    src = contract_sources(spark, sf)
    cols = FEATURES + ["contract_number"]
    return load.union_all(src["Performing"].select(*cols),
                          src["PreviouslyDefaulted"].select(*list(reversed(cols))))


# --- scalar functions ---------------------------------------------------------

@query("x1_composite_key", with_contracts(
    f"SELECT DISTINCT concat_ws(chr(9), {KEYS}) AS group_key FROM contracts"))
def x1_composite_key(spark, sf):
    return contracts(spark, sf).select(composite_key(GROUP_KEYS).alias("group_key")).distinct()


@query("x2_string_to_double", with_contracts(
    "SELECT contract_number, " + ", ".join(f"{c} AS {c}" for c in DOUBLE_FEATURES)
    + " FROM contracts"))
def x2_string_to_double(spark, sf):
    df = contracts(spark, sf).select("contract_number", *[to_string(c).alias(c) for c in DOUBLE_FEATURES])
    return df.select("contract_number", *[to_double(c).alias(c) for c in DOUBLE_FEATURES])


@query("x3_number_to_string", with_contracts(
    "SELECT contract_number, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in COUNT_FEATURES)
    + " FROM contracts"))
def x3_number_to_string(spark, sf):
    return contracts(spark, sf).select("contract_number", *[to_string(c).alias(c) for c in COUNT_FEATURES])


@query("x4_fixed4_format", with_contracts(
    "SELECT contract_number, printf('%.4f', contract_balance) AS balance_text FROM contracts"))
def x4_fixed4_format(spark, sf):
    return contracts(spark, sf).select("contract_number", fixed4("contract_balance").alias("balance_text"))


@query("x6_sha256_key", with_contracts(
    "SELECT DISTINCT customer_number, sha256(CAST(customer_number AS VARCHAR)) AS hashed_customer "
    "FROM contracts"))
def x6_sha256_key(spark, sf):
    df = contracts(spark, sf).select("customer_number").distinct()
    return df.select("customer_number", sha256_hex("customer_number").alias("hashed_customer"))


@query("x7_normal_cdf", with_contracts(
    "SELECT contract_number, round(" + phi_sql("z") + ", 9) AS phi FROM "
    "(SELECT contract_number, (cnt_0130_dpd - 25.0) / 10.0 AS z FROM contracts)"))
def x7_normal_cdf(spark, sf):
    df = contracts(spark, sf).select("contract_number", ((F.col("cnt_0130_dpd") - 25.0) / 10.0).alias("z"))
    return df.select("contract_number", F.round(F.expr(phi_sql("z")), 9).alias("phi"))


@query("x8_normal_quantile", with_contracts(
    "SELECT contract_number, round(" + probit_refine_sql("x0", "p") + ", 9) AS z FROM "
    "(SELECT contract_number, p, " + probit_initial_sql("p") + " AS x0 FROM "
    f"(SELECT contract_number, {_u(SEED, 'q', ['contract_number'])} AS p FROM contracts))"))
def x8_normal_quantile(spark, sf):
    df = contracts(spark, sf).select("contract_number", hash_u(SEED, "q", "contract_number").alias("p"))
    return with_probit(df, "p", "z").select("contract_number", F.round("z", 9).alias("z"))


# --- generation -------------------------------------------------------------

@query("g0_hash_uniform", with_contracts(
    f"SELECT contract_number, {_u(SEED, 'g0', ['contract_number'])} AS u FROM contracts"))
def g0_hash_uniform(spark, sf):
    df = contracts(spark, sf).select("contract_number")
    return df.withColumn("u", hash_u(SEED, "g0", "contract_number"))


def _spec_query(spec, source_sql, id_col):
    return generate.spec_sql(spec, SEED, source_sql, id_col=id_col)


_X9 = [generate.Col("int_inclusive", "int", lo=1, hi=6), generate.Col("int_exclusive", "int", lo=1, hi=6, inclusive=False),
       generate.Col("unit", "uniform", lo=0.0, hi=1.0), generate.Col("choice", "choice", values=["a", "b", "c"]),
       generate.Col("fixed_point", "decimal", left=3, right=2)]
_CUST_IDS = "SELECT c_custkey AS id FROM customer"
_ORDER_IDS = "SELECT o_orderkey AS id FROM orders"


def _customers(spark, sf):
    return spread(read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


def _orders(spark, sf):
    return spread(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


_G1 = [generate.Col("TNW_in_MEUR", "int", lo=1, hi=500),
       generate.Col("fundation_year", "int", lo=1900, hi=2020, inclusive=False)]
_G2 = [generate.Col("TNW_to_total_exposure", "uniform", lo=0.0, hi=1.0)]
_G3 = [generate.Col("credit_rating", "choice", values=["A", "B", "C", "D"]),
       generate.Col("segment_weighted", "choice", values=["SME", "Corporate", "Retail"],
                    weights=[0.5, 0.3, 0.2])]
_G4 = [generate.Col("revenue", "decimal", left=8, right=2),
       generate.Col("current_ratio", "decimal", left=3, right=2)]
_G5 = [generate.Col("customer_name", "person"), generate.Col("company_name", "company")]


@query("x9_draw_functions", _spec_query(_X9, _CUST_IDS, "id"))
def x9_draw_functions(spark, sf):
    """Every draw function over the customer keys."""
    return generate.generate(_customers(spark, sf), _X9, SEED)


@query("g1_uniform_int", _spec_query(_G1, _CUST_IDS, "id"))
def g1_uniform_int(spark, sf):
    return generate.generate(_customers(spark, sf), _G1, SEED)


@query("g2_uniform_double", _spec_query(_G2, _CUST_IDS, "id"))
def g2_uniform_double(spark, sf):
    return generate.generate(_customers(spark, sf), _G2, SEED)


@query("g3_categorical_choice", _spec_query(_G3, _CUST_IDS, "id"))
def g3_categorical_choice(spark, sf):
    return generate.generate(_customers(spark, sf), _G3, SEED)


@query("g4_fixed_point_decimal", _spec_query(_G4, _CUST_IDS, "id"))
def g4_fixed_point_decimal(spark, sf):
    return generate.generate(_customers(spark, sf), _G4, SEED)


@query("g5_fake_names", _spec_query(_G5, _CUST_IDS, "id"))
def g5_fake_names(spark, sf):
    return generate.generate(_customers(spark, sf), _G5, SEED)


@query("g6_applicants_26", _spec_query(generate.applicant_spec(), _CUST_IDS, "id"))
def g6_applicants_26(spark, sf):
    return generate.generate(_customers(spark, sf), generate.applicant_spec(), SEED)


@query("g7_applications_77", _spec_query(generate.application_spec(), _ORDER_IDS, "id"))
def g7_applications_77(spark, sf):
    return generate.generate(_orders(spark, sf), generate.application_spec(), SEED)


def _periods_sql() -> str:
    wide = _spec_query(generate.application_spec(), _ORDER_IDS, "id")
    parts = []
    for prefix, _, _ in generate.PERIODS:
        parts.append(f"SELECT id, '{prefix}' AS period, 'year' AS measure, \"{prefix}\" AS value FROM wide")
        for m, _, _ in generate.PERIOD_MEASURES:
            parts.append(f"SELECT id, '{prefix}' AS period, '{m}' AS measure, "
                         f"\"{prefix}_{m}\" AS value FROM wide")
    return f"WITH wide AS ({wide}) " + " UNION ALL ".join(parts)


@query("g8_period_blocks", _periods_sql())
def g8_period_blocks(spark, sf):
    wide = generate.generate(_orders(spark, sf), generate.application_spec(), SEED)
    return generate.periods_long(wide)
