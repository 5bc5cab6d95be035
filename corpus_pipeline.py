"""Corpus pipeline: five stages over ``documents``.

1. toxicity: documents predicted toxic go;
2. SimHash near-duplicates: of each group of near copies, the smallest id stays;
3. decontamination: documents that hold a benchmark passage go;
4. personal data: every span found is replaced by its kind in brackets;
5. SentencePiece: the remaining texts become piece ids, with a checksum of the
   text and of what decoding the ids gives.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of their input.  ``run`` writes every
stage's result as Parquet in the shared folder and reads it back, so a lost
executor costs at most the stage it was working on.

Defined results: null and empty texts pass the first, third and fourth stage
unchanged and are near copies of each other in the second; an empty table gives
an empty result; extra columns are carried up to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm import decontaminate, pii, sentencepiece_scan, simhash, toxicity
from facsimile.llm.common import bounded_batches, id_bucket, table
from facsimile.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(id_bucket(5) != 0))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.one_per_component(docs, words_per_shingle=simhash.SHINGLE_WORDS, radius=simhash.RADIUS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pii.redacted(docs, pii.fit(docs))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    pieces = sentencepiece_scan.Pieces.load()
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {c: F.col(c) for c in ("doc_id", "lang", "source", "n_chars")} | {"text_crc32": F.crc32(text)}
    coded = sentencepiece_scan.encode(docs, carry, model=pieces, checksum="decoded_crc32")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"),
                        F.col("ids").alias("pieces"), "text_crc32", "decoded_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("sentencepiece", to_pieces),
]

#: Hashes, trained models and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
