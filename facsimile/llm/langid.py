"""Language identification by rank-order n-gram profiles.

A profile is the list of the ``PROFILE`` most frequent 1- to 3-grams of letters
(word edges count as a sign of their own; no gram runs over a word edge), most
frequent first.  A document's distance to a language is the sum, over its own
profile, of how far each gram is out of place in the language's; a gram that the
language lacks costs ``PROFILE``.  The nearest language wins.

Learning counts grams of at most about ``TRAIN_ROWS`` documents of each language
(a documented bound; which ones is decided by a hash of the text) with ordinary
aggregation.  The learned table has ``PROFILE`` rows for each language and is
broadcast.  Prediction reads whole texts in one pass without any shuffle.

Defined results: ``und`` with score 0 for a null text, a text without letters, or
when nothing could be learned.  Ties of frequency are broken by the gram, ties of
distance by the language's name.  Repeated rows are predicted one by one; an empty
table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast
from .common import id_bucket, table
from .registry import query

PROFILE = 300
TRAIN_ROWS = 2000
_EDGE = 1  # stands for any run of signs that are not letters
_BITS = 21


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Codes of all 1- to 3-grams of a text, with repeats; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of other signs, the first
    s = np.concatenate(([_EDGE], np.where(letter, points, _EDGE)[keep], [_EDGE]))
    s = s[np.concatenate(([True], (s[1:] != _EDGE) | (s[:-1] != _EDGE)))]
    two = (s[:-1] << _BITS) | s[1:]
    three = (two[:-1] << _BITS) | s[2:]
    return np.concatenate((s[s != _EDGE], two, three[s[1:-1] != _EDGE]))


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    value, count = np.unique(codes, return_counts=True)
    if len(count) and count.max() < 65535:  # sixteen bits are sorted faster
        count = (65535 - count).astype(np.uint16)
    else:
        count = -count
    return value[np.argsort(count, kind="stable")[:size]]


def learn_profiles(df: DataFrame, lang_column: str = "lang", text_column: str = "text",
                   size: int = PROFILE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, gram, place): the profile of every language in ``df``."""
    known = df.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    share = known.groupBy("lang").agg((F.lit(float(train_rows)) / F.count("*")).alias("share"))
    draw = F.xxhash64("text", F.lit(11)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    sample = known.join(sized_broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            for x in sorted(set(lang)):
                codes = [grams(t.as_py()) for t in b.column(1).filter(pa.array(lang == x))]
                value, count = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(value)), pa.array(value), pa.array(count)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    """Profiles of all languages, ready for lookups."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        # one more row for grams that no language has
        self.place = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        at = {x: i for i, x in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.place[np.searchsorted(self.grams, gram), at[lang]] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, self.size)
        i = np.searchsorted(self.grams, own)
        known = i < len(self.grams)
        known[known] = self.grams[i[known]] == own[known]
        place = self.place[np.where(known, i, len(self.grams))]
        out = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(out))
        return self.langs[best], float(1 - out[best] / (self.size * len(own)))


def predict_language(df: DataFrame, profiles: DataFrame, carry: dict[str, Column], text_column: str = "text",
                     size: int = PROFILE) -> DataFrame:
    """The carried columns (long or boolean) with ``lang_pred`` and ``score``."""
    model = df.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.collect()], size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.value.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*b.schema.names[:-1], "lang_pred", "score"])

    rows = df.select(*[c.alias(n) for n, c in carry.items()], F.col(text_column).cast("string").alias("text"))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(id_bucket(3) != 1))
    return predict_language(docs, profiles, {"doc_id": F.col("doc_id"), "held_out": id_bucket(3) == 1})
