"""Fabricate records from per-column specs (no real values used).

A spec is a list of ``Col(name, kind, **params)``.  Every column is a native
expression of counter-based uniforms over the row id, so a table of any size
is generated by one ``select`` in whole-stage codegen, identical on every run
and partitioning, and reproducible in DuckDB (``spec_sql``).  Uniforms are
packed four to an md5 digest.

Kinds
-----
int       lo..hi, ``inclusive`` top (Faker random_int) or exclusive (numpy randint)
uniform   lo + u (hi - lo)
choice    equal-weight pick from a closed list (optional weights)
decimal   positive fixed point with ``left``/``right`` digits, at least 10^-right
person    "<first> <last>" from fixed word lists
company   "<last> <suffix>" from fixed word lists
const     a literal
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import WORDS, hex_hash, uniform_from_hex

# Word lists for fabricated names (our own, not a locale engine).
FIRST_NAMES = ["Anna", "Ben", "Clara", "David", "Elena", "Felix", "Greta", "Hugo",
               "Ines", "Jonas", "Karin", "Leon", "Maria", "Nils", "Olga", "Paul",
               "Rosa", "Simon", "Tara", "Uwe", "Vera", "Walter", "Xenia", "Yusuf",
               "Zoe", "Amir", "Bianca", "Carlos", "Dana", "Emil"]
LAST_NAMES = ["Adams", "Berg", "Costa", "Dietrich", "Evans", "Fischer", "Garcia",
              "Hansen", "Ivanov", "Jensen", "Keller", "Lopez", "Meyer", "Nowak",
              "Olsen", "Petrov", "Quinn", "Rossi", "Schmidt", "Tanaka", "Urban",
              "Vogel", "Wagner", "Xu", "Young", "Zimmer", "Brandt", "Moreau",
              "Novak", "Silva"]
COMPANY_SUFFIXES = ["Inc", "LLC", "Group", "Ltd", "and Sons", "PLC", "GmbH", "Holdings"]


@dataclass
class Col:
    name: str
    kind: str
    params: dict = field(default_factory=dict)
    as_string: bool = False

    def __init__(self, name: str, kind: str, as_string: bool = False, **params):
        self.name, self.kind, self.as_string, self.params = name, kind, as_string, params

    @property
    def n_uniforms(self) -> int:
        return {"const": 0, "person": 2, "company": 2}.get(self.kind, 1)


def _quote(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _pick(u: str, values: Sequence, weights: Sequence[float] | None = None) -> str:
    if weights is None:
        idx = f"CAST(floor({u} * {len(values)}) AS INT)"
        whens = " ".join(f"WHEN {i} THEN {_quote(v)}" for i, v in enumerate(values))
        return f"(CASE {idx} {whens} END)"
    total = float(sum(weights))
    acc, parts = 0.0, []
    for v, w in zip(values[:-1], weights[:-1]):
        acc += w / total
        parts.append(f"WHEN {u} < {acc!r} THEN {_quote(v)}")
    return f"(CASE {' '.join(parts)} ELSE {_quote(values[-1])} END)"


def _column_sql(col: Col, us: list[str], dialect: str) -> str:
    p = col.params
    if col.kind == "int":
        lo, hi = int(p["lo"]), int(p["hi"])
        span = hi - lo + 1 if p.get("inclusive", True) else hi - lo
        expr = f"CAST({lo} + floor({us[0]} * {span}) AS BIGINT)"
    elif col.kind == "uniform":
        lo, hi = float(p.get("lo", 0.0)), float(p.get("hi", 1.0))
        expr = f"({lo!r} + {us[0]} * {hi - lo!r})"
    elif col.kind == "choice":
        expr = _pick(us[0], p["values"], p.get("weights"))
    elif col.kind == "decimal":
        left, right = int(p["left"]), int(p["right"])
        top = 10 ** (left + right) - 1
        expr = f"(CAST(floor({us[0]} * {top}) + 1 AS DOUBLE) / {float(10 ** right)!r})"
    elif col.kind == "person":
        expr = f"({_pick(us[0], FIRST_NAMES)} || ' ' || {_pick(us[1], LAST_NAMES)})"
    elif col.kind == "company":
        expr = f"({_pick(us[0], LAST_NAMES)} || ' ' || {_pick(us[1], COMPANY_SUFFIXES)})"
    elif col.kind == "const":
        expr = _quote(p["value"])
    else:
        raise ValueError(f"unknown column kind {col.kind!r}")
    if col.as_string:
        if col.kind == "uniform":
            fmt = "format_string('%.8f', {})" if dialect == "spark" else "printf('%.8f', {})"
            expr = fmt.format(expr)
        else:
            expr = f"CAST({expr} AS {'STRING' if dialect == 'spark' else 'VARCHAR'})"
    return expr


def _layout(spec: Sequence[Col]) -> list[list[tuple[int, int]]]:
    """(digest block, word) of every uniform each column consumes."""
    slots, i = [], 0
    for col in spec:
        mine = []
        for _ in range(col.n_uniforms):
            mine.append((i // WORDS, i % WORDS))
            i += 1
        slots.append(mine)
    return slots


def _n_blocks(spec: Sequence[Col]) -> int:
    total = sum(c.n_uniforms for c in spec)
    return -(-total // WORDS)


def generate(base: DataFrame, spec: Sequence[Col], seed: int, id_col: str = "id",
             stream: str = "gen") -> DataFrame:
    """One fabricated record per row of ``base`` (keyed by ``id_col``)."""
    hexes = {f"__gh{b}": F.expr(hex_hash(seed, f"{stream}:{b}", [id_col]))
             for b in range(_n_blocks(spec))}
    staged = base.select(id_col).withColumns(hexes)
    cols = []
    for col, slots in zip(spec, _layout(spec)):
        us = [uniform_from_hex(f"__gh{b}", w) for b, w in slots]
        cols.append(F.expr(_column_sql(col, us, "spark")).alias(col.name))
    return staged.select(F.col(id_col), *cols)


def spec_sql(spec: Sequence[Col], seed: int, source_sql: str, id_col: str = "id",
             stream: str = "gen") -> str:
    """DuckDB text of ``generate`` over ``SELECT <id_col> FROM (<source_sql>)``."""
    hexes = ", ".join(f"{hex_hash(seed, f'{stream}:{b}', [id_col], 'duckdb')} AS __gh{b}"
                      for b in range(_n_blocks(spec)))
    items = []
    for col, slots in zip(spec, _layout(spec)):
        us = [uniform_from_hex(f"__gh{b}", w, "duckdb") for b, w in slots]
        items.append(f'{_column_sql(col, us, "duckdb")} AS "{col.name}"')
    inner = f"SELECT {id_col}{', ' + hexes if hexes else ''} FROM ({source_sql}) AS src"
    return f"SELECT {id_col}, {', '.join(items)} FROM ({inner}) AS staged"


# ---------------------------------------------------------------------------
# The two applicant specs of the reference notebook (names,
# ranges and lists as stated there; see FIXTURES §3-4).

def applicant_spec() -> list[Col]:
    """25 generated columns (doubles by intent) + customer_name."""
    dec = lambda n, l: Col(n, "decimal", left=l, right=2)
    return [
        Col("customer_name", "person"),
        Col("TNW_in_MEUR", "int", lo=1, hi=500),
        Col("profits_perc_TNW", "int", lo=1, hi=100),
        Col("Positive_WC", "int", lo=0, hi=1),
        dec("TNW_to_T-Exposure", 5),
        Col("fleet_size", "int", lo=1, hi=500),
        dec("total_exposure", 8), dec("revenue", 8), dec("EBIT", 5),
        dec("depreciation", 5), dec("net_profit", 5), dec("fixed_assets", 8),
        dec("intangible_assets", 8), dec("current_assets", 8),
        dec("tangible_net_worth", 8), dec("long_term_liab", 8),
        dec("long_term_credit", 8), dec("short_term_liab", 8),
        Col("CR_Rating_score", "int", lo=1, hi=10),
        Col("pmt_discipline_score", "int", lo=1, hi=10),
        dec("debt_equity_ratio", 3), dec("debt_asset_ratio", 3), dec("current_ratio", 3),
        dec("return_on_assets", 5),
        Col("target_variable", "int", lo=0, hi=1),
    ]


PERIOD_MEASURES = [
    ("number_months", 1, 13), ("revenue", 1000, 10000000), ("EBIT", 100, 1000000),
    ("depreciation", 10, 100000), ("net_profit", 10, 1000000),
    ("fixed_assets", 100, 10000000), ("intangible_assets", 10, 1000000),
    ("current_assets", 100, 10000000), ("tangible_net_worth", 100, 10000000),
    ("long_term_liabilities", 0, 1000000), ("long_term_credit", 0, 1000000),
    ("short_term_liabilities", 1000, 10000000), ("short_term_credit", 0, 1000000),
    ("off_balance_liabilities", 0, 1000000),
]
PERIODS = [("current_period", 2010, 2023), ("last_period", 2009, 2022),
           ("period_before_last_period", 2008, 2021)]


def period_block(prefix: str, year_lo: int, year_hi: int) -> list[Col]:
    """The 15 measures of one reporting period (numpy exclusive tops)."""
    r = lambda n, lo, hi: Col(n, "int", lo=lo, hi=hi, inclusive=False, as_string=True)
    cols = [r(prefix, year_lo, year_hi)]
    cols += [r(f"{prefix}_{m}", lo, hi) for m, lo, hi in PERIOD_MEASURES]
    return cols


def application_spec() -> list[Col]:
    """77 string columns of a credit application."""
    r = lambda n, lo, hi: Col(n, "int", lo=lo, hi=hi, inclusive=False, as_string=True)
    ch = lambda n, vals: Col(n, "choice", values=vals)
    yes_no = ["Yes", "No"]
    ccy = ["EUR", "USD", "GBP"]
    spec = [
        Col("customer_name", "company"),
        ch("credit_rating", ["A", "B", "C", "D"]),
        r("years_in_business", 1, 50), r("TNW_in_MEUR", 100, 10000),
        r("profits_perc_TNW", 1, 100), ch("positive_working_capital", yes_no),
        Col("TNW_to_total_exposure", "uniform", lo=0.0, hi=1.0, as_string=True),
        ch("legal_form", ["LLC", "Corporation", "Partnership"]),
        r("fundation_year", 1900, 2020), r("fundation_month", 1, 13), r("fundation_day", 1, 29),
        ch("financing_currency", ccy), r("fleet_size", 1, 500),
        r("fleet_own_trucks", 0, 500), r("fleet_vfs_trucks", 0, 500),
        r("fleet_other_trucks", 0, 500), r("fleet_own_EC", 0, 500),
        r("fleet_vfs_EC", 0, 500), r("fleet_other_EC", 0, 500),
        r("Offer_number_1", 10000, 99999), r("Offer_number_2", 10000, 99999),
        r("Offer_number_3", 10000, 99999),
        ch("financial_performance_currency", ccy),
        ch("type_of_request", ["New", "Renewal", "Increase"]),
        ch("flag_domestic_use", yes_no), ch("vfs_customer", yes_no),
        r("vfs_known_since", 2010, 2022),
        ch("payment_discipline", ["Excellent", "Good", "Fair", "Poor"]),
        r("total_exposure", 1000, 1000000), r("quote_id", 1000000, 9999999),
    ]
    for prefix, lo, hi in PERIODS:
        spec += period_block(prefix, lo, hi)
    spec += [ch("market", ["US", "Europe", "Asia"]),
             Col("type_of_data", "const", value="Synthetic")]
    return spec


def periods_long(wide: DataFrame, id_col: str = "id") -> DataFrame:
    """G8 long form: (id, period, measure, value) from the wide application."""
    items = []
    for prefix, _, _ in PERIODS:
        items.append(F.struct(F.lit(prefix).alias("period"), F.lit("year").alias("measure"),
                              F.col(prefix).alias("value")))
        for m, _, _ in PERIOD_MEASURES:
            items.append(F.struct(F.lit(prefix).alias("period"), F.lit(m).alias("measure"),
                                  F.col(f"{prefix}_{m}").alias("value")))
    return wide.select(id_col, F.explode(F.array(*items)).alias("__c")).select(id_col, "__c.*")
