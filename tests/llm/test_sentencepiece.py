import random

import numpy as np
import pytest
import sentencepiece
from facsimile.llm import sentencepiece_scan as S
from pyspark.sql import functions as F
from llm_fixtures import docs, sample  # noqa: F401

SP = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
PIECES = S.Pieces.load()
ODD = ["", " ", "  ", "   a", "a  b   c    d", "é中😀​ﬁ", "\x00a\n\n b", " " * 40 + "x" + " " * 17, "a" * 230, "the" * 100, "tab\tnew\nline \r\n", "<s> </s> <0x41> <unk>"]


def random_texts(n=120, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdethinrs   .,\n é0中") for _ in range(rng.randint(1, 300))) for _ in range(n)] + [
        "".join(rng.choice(["the", "ing", "un", "pre", "ation", " ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_encoding_equals_the_library(sample):
    texts = ODD + random_texts() + [t for _, t in sample]
    assert S.Encoder(PIECES).texts(texts) == SP.encode(texts)


@pytest.mark.parametrize("chunk", [16, 37, 300])
def test_scan_over_any_cuts_equals_the_library(spark, docs, chunk):
    texts = [t for t in ODD + random_texts(15) if "▁" not in t]
    pairs = list(enumerate(texts)) + [(3, texts[3]), (None, "some text without an id"), (-1, None)]
    got = S.encode(docs(pairs), {"doc_id": F.col("doc_id"), "text_n": F.col("n_chars")}, model=PIECES, chunk=chunk).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), SP.encode(t or "")) for i, t in pairs)


def test_path_form_is_unique_without_blanks():
    for text in ("internationalization" * 6, "x" * 90, "éééthethe中中"):
        assert PIECES.to_ids(PIECES.long_word("▁" + text)) == SP.encode(text)


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, 0.0, -np.inf) for _ in range(3))
    assert np.array_equal(S.max_plus(S.max_plus(a, b), c), S.max_plus(a, S.max_plus(b, c)))


def test_round_trip(docs, sample):
    pairs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in sample] + [(999, None)]
    coded = S.encode(docs(pairs), {"doc_id": F.col("doc_id"), "want": F.coalesce(F.col("text"), F.lit(""))}, model=PIECES, chunk=2000)
    back = S.decode(coded, ["doc_id", "want"], model=PIECES)
    assert back.where(~F.col("text").eqNullSafe(F.col("want"))).count() == 0
    assert back.count() == len(pairs)


def test_no_rows(docs):
    assert S.encode(docs([]), {"doc_id": F.col("doc_id")}, model=PIECES).count() == 0
