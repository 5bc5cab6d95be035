import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from facsimile.llm import bloom_lm as B
from pyspark.sql import functions as F
from llm_fixtures import docs  # noqa: F401

END = "\0end"


def toks(t):
    return (t or "").encode().lower().decode().replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def tokens(t):
    return [w for w in toks(t) if w] + [END]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["the", "of", "Cat", "dog", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 80)))) for i in range(n)] + [
        (100, None), (101, ""), (102, "a\tb\nc"), (103, "rare " * 5000), (104, "É é"), (104, "É é")]


def brute(train, pairs):
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in tokens(t))) for i, t in pairs}


@pytest.mark.parametrize("hot", [1 << 21, 3])
def test_counts_and_base_score_match_brute_force(docs, hot):
    pairs = corpus()
    train = [p for p in pairs if p[0] % 3]
    model, words = B.fit(docs(train), hot_words=hot)
    assert model.complete == (hot > 3) and len(model.hot) <= hot
    got = B.score_texts(docs(pairs), model, words, {"doc_id": F.col("doc_id")}).collect()
    want = brute(train, pairs)
    assert len(got) == len(pairs)
    for r in got:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)


def test_score_matches_a_model_with_a_dictionary_for_filter(docs):
    pairs = corpus()
    model, words = B.fit(docs(pairs))
    c, p = Counter(), Counter()
    for _, t in pairs:
        own = tokens(t)
        c.update(own)
        p.update(zip(["\0start", *own], own))
    c["\0start"] = len(pairs)
    n, v = sum(c.values()) - len(pairs), len(c) - 1

    def q(x):
        level = x.bit_length()
        return (2 ** (level - 1) + 2 ** level - 1) / 2 if x else 0
    got = {r.doc_id: r.score for r in B.score_texts(docs(pairs), model, words, {"doc_id": F.col("doc_id")}).collect()}
    for i, t in pairs:
        own = tokens(t)
        want = sum(math.log10((min(q(p[u, w]), q(c[u])) + B.MU * min(1, (q(c[w]) + 1) / (n + v + 1))) / (q(c[u]) + B.MU)) for u, w in zip(["\0start", *own], own))
        assert got[i] == pytest.approx(want, rel=1e-3)


def test_filter_never_loses_and_seldom_invents():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2 ** 63, 30_000, dtype=np.uint64) << np.uint64(1)
    n = rng.integers(1, 5000, len(h))
    bits = np.zeros(16 * B.SEGMENT_BITS, bool)
    for level in range(1, int(B.levels_of(n).max()) + 1):
        own = h[B.levels_of(n) >= level]
        for at in B.probe_bits(own, level):
            bits[(B.segment_of(own, 16) * np.uint64(B.SEGMENT_BITS) + at).astype(np.int64)] = True
    f = B.LogFrequencyFilter(np.packbits(bits, bitorder="little"), 16)
    assert (f.level(h) >= B.levels_of(n)).all()
    assert np.mean(f.level(h) == B.levels_of(n)) > 0.99
    assert np.mean(f.level(rng.integers(0, 2 ** 63, 30_000, dtype=np.uint64)) > 0) < 0.01


def test_levels_and_estimates():
    n = np.array([1, 2, 3, 4, 7, 8, 2 ** 40])
    assert B.levels_of(n).tolist() == [int(x).bit_length() for x in n]
    assert B.count_estimate(np.array([0, 1, 2])).tolist() == [0, 1, 2.5]


def test_tokens_of_odd_texts():
    token, before, text_of, first = B.tokens(pa.array(["a b", None, "", "A"]))
    assert np.diff(first).tolist() == [3, 1, 1, 2] and text_of.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert token[0] == token[5] and (before[first[:-1]] == B.START).all() and (token & np.uint64(1) == 1).all()


def test_empty_training_and_empty_table(docs):
    model, words = B.fit(docs([]))
    (r,) = B.score_texts(docs([(1, "a b")]), model, words, {"doc_id": F.col("doc_id")}).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0)
    assert B.score_texts(docs([]), model, words, {"doc_id": F.col("doc_id")}).count() == 0


def many_words(n=160):
    rng = random.Random(5)
    return [(i, " ".join(f"v{rng.randrange(10 ** 7)}" for _ in range(20_000))) for i in range(n)]


def test_filter_grows_with_the_training_text(docs):
    # 29 MB of text ask for 34 segments; none of them is left out because a block holds fewer
    pairs = many_words()
    model, words = B.fit(docs(pairs[:1]), block_bits=4 * B.SEGMENT_BITS)
    table = docs(pairs[:1]).select("text").crossJoin(docs([(0, "")]).sparkSession.range(160)).select(
        F.regexp_replace("text", "v", F.concat(F.lit("v"), F.col("id").cast("string"), F.lit("x"))).alias("text"))
    large, _ = B.fit(table, block_bits=4 * B.SEGMENT_BITS)
    size = table.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert large.segments == int(size * B.BITS_PER_BYTE) // B.SEGMENT_BITS > 4 * large.per_block
    assert len(large.blocks) == -(-large.segments // 4)
    assert 0 < large.fill < 1 - math.exp(-3 * 2 * large.n / (large.segments * B.SEGMENT_BITS)) + 0.05


def test_blocks_give_the_same_scores(docs, monkeypatch):
    monkeypatch.setattr(B, "GROUP_BYTES", 5_000)
    pairs = corpus()
    by_blocks = []
    for block_bits in (1 << 30, 3 * B.SEGMENT_BITS):
        model, words = B.fit(docs(pairs), hot_words=3, block_bits=block_bits)
        rows = B.score_texts(docs(pairs).repartition(2), model, words, {"doc_id": F.col("doc_id")}).collect()
        by_blocks.append((len(model.blocks), sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9), r.score) for r in rows)))
    (one, whole), (six, parts) = by_blocks
    assert (one, six) == (1, 6) and whole == parts


def test_levels_as_bytes_estimate_counts_beyond_half_floats():
    level = np.array([0, 1, 2, 16, 17, 18, B.MAX_LEVEL], np.uint8)
    want = [0.0, 1.0, 2.5, *[(2.0 ** (q - 1) + 2.0 ** q - 1) / 2 for q in (16, 17, 18, B.MAX_LEVEL)]]
    assert B.count_estimate(level).tolist() == want


def test_frequent_words_have_finite_scores(docs):
    pairs = [(1, "the " * 140_000 + "cat"), (2, "the cat"), (3, "the dog the"), (4, None)]
    model, words = B.fit(docs(pairs[:1]))
    got = {r.doc_id: r for r in B.score_texts(docs(pairs), model, words, {"doc_id": F.col("doc_id")}).collect()}
    assert len(got) == 4 and all(math.isfinite(r.score) and r.score <= 0 for r in got.values())
    assert got[1].score > got[1].base_score - 1
