"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table.  A rule bounds ``100 * numerator / denominator`` (or
``100 * numerator`` when it has no denominator), compared in integers, so no
rounding can differ between engines.  ``quality_columns`` computes the
measures, ``verdict_columns`` compiles the rules; both are built-in functions
only, with no shuffle: every row is judged where it is read.

Defined results: a null text counts as empty, so it has no words and fails the
base rule; an empty table gives an empty result; repeated rows are judged one
by one; other input columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, table
from .registry import query

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "this", "are", "from", "at",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "de", "et", "un", "une", "du", "en", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "plus", "ne", "pas",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "para", "al", "lo", "como", "más", "o", "pero", "sus", "le", "ha",
)
#: Words in a window whose repetition inside one text is counted.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


class Rule(NamedTuple):
    name: str
    numerator: str
    denominator: str | None
    least: int | None   # percent, inclusive
    most: int | None    # percent, inclusive


RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words", None, 100 * MIN_WORDS, None),
    Rule("word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def _n_repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text.

    Window hashes decide whether anything can repeat at all; only then are the
    windows themselves compared, so the count is exact."""
    def by_hash(ws: Column) -> Column:
        hashes = F.transform(ws, lambda w: F.xxhash64(w))
        windows = let(hashes, lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
        return let(windows, lambda v: F.size(F.array_distinct(v)) < F.size(v))

    def exact(ws: Column) -> Column:
        spans = F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(ws) - WINDOW),
            lambda i: F.struct(F.array_join(F.slice(ws, i + 1, WINDOW), " ").alias("s"), i.alias("i"))))
        repeated = let(spans, lambda a: F.transform(
            F.filter(a, lambda x, k: (x["s"] == F.get(a, k - 1)["s"]) | (x["s"] == F.get(a, k + 1)["s"])),
            lambda x: x["i"]))
        return let(F.sort_array(repeated), lambda p: F.aggregate(
            F.transform(p, lambda at, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), at - F.get(p, k - 1)))),
            F.lit(0), lambda total, n: total + n))

    return let(words, lambda ws: F.when(
        F.size(ws) >= WINDOW, F.when(by_hash(ws), exact(ws)).otherwise(0)).otherwise(0)).cast("long")


def quality_measures(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The measures that rules refer to, one row per input row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = df.select(F.col(id_column).alias("doc_id"), text.alias("__t"))
    parts = base.select(
        "doc_id", "__t", _words(F.col("__t")).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    stops = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
    return parts.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _n_repeat_words(F.col("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(*sorted(set(stop_words))))).cast("long").alias("n_stop_words"),
    )


def compile_rule(rule: Rule) -> Column:
    """True where the row breaks the rule."""
    value = F.col(rule.numerator) * 100
    unit = F.col(rule.denominator) if rule.denominator else F.lit(1).cast("long")
    broken = []
    if rule.least is not None:
        broken.append(value < unit * rule.least)
    if rule.most is not None:
        broken.append(value > unit * rule.most)
    return reduce(lambda a, b: a | b, broken)


def quality_rules(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measures, ``base_failed``, the names of broken rules and ``kept`` for each row."""
    measured = quality_measures(df, id_column, text_column)
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    broken = F.concat_ws(",", *[F.when(compile_rule(r), F.lit(r.name)) for r in rules])
    judged = measured.withColumns({"base_failed": base_failed, "broken_rules": broken})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    checks = []
    for r in RULES:
        unit = r.denominator or "1"
        tests = ([f"{r.numerator} * 100 < {unit} * {r.least}"] if r.least is not None else []) + (
            [f"{r.numerator} * 100 > {unit} * {r.most}"] if r.most is not None else [])
        checks.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
spots AS (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM parts WHERE len(w) >= {WINDOW}),
spans AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM spots),
twice AS (SELECT rid, i FROM spans QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) r(k) GROUP BY rid),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣]')))::BIGINT AS n_bullet_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words
  FROM parts LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         concat_ws(',', {', '.join(checks)}) AS broken_rules FROM measured)
SELECT *, NOT base_failed AND broken_rules = '' AS kept FROM judged
"""


@query("op1_quality_rules", _sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
