"""Ranked search and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import docs  # noqa: F401
from pyspark.sql import functions as F

from facsimile.llm import hard_negatives as hn
from facsimile.llm import maxscore as ms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(documents, queries, top=10):
    held = [(i, Counter(terms(t))) for i, t in documents]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Über", "été", "don't", "x_y", "日本"]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    made = [(i, " ".join(r.choices(vocabulary, weight, k=r.randint(1, 30)))) for i in range(n)]
    copies = [(n + k, made[7][1]) for k in range(n // 3)]  # a third of all rows are one text
    return made + copies + [(9000, None), (9001, ""), (9002, "--- !!"), (9003, "W1 w1 W1, w2." + " w3" * 5000), (None, "w1 w2 w40")]


@pytest.mark.parametrize("chars", [ms.QUERY_CHARS, 60])
def test_search_matches_brute_force(spark, docs, chars):  # noqa: F811
    documents = corpus(1)
    r = random.Random(2)
    queries = [(k, " ".join(f"w{r.randint(0, 70)}" for _ in range(r.randint(1, 12)))) for k in range(12)]
    queries += [(50, None), (51, "nowhere"), (52, "W1 w1 über Été"), (3, "w1 w2"), (None, "w5")]
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = ms.search(docs(documents).repartition(5), asked, block_chars=chars)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(documents, queries)


def test_search_of_empty_tables(spark, docs):  # noqa: F811
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ms.search(docs([]), asked).count() == 0
    assert ms.search(docs([(1, "w1")]), asked.limit(0)).count() == 0
    assert ms.search(docs([(1, None)]), asked).count() == 0


def test_pair_bounds_are_bounds_and_tighten():
    """Over all documents of a block, no pair gains more than its bound; the bound is below the two maxima where no document has both."""
    ids = np.arange(6)
    terms_, ends = np.array([0, 1], np.int32), np.array([3, 6], np.int32)
    block = ms.Block(ids, terms_, ends, np.array([0, 1, 2, 2, 3, 4], np.int32), np.array([50, 7, 9, 8, 60, 1]))
    both, joint = block.pair(0, 1)
    assert list(both) == [2] and joint == 17 and block.most == {0: 50, 1: 60}
    assert max(joint, *block.most.values()) == 60 < 50 + 60


def test_search_skips_blocks_and_documents_that_cannot_reach_the_threshold():
    """A rare term fills the list; later blocks with frequent terms alone are not scored."""
    q = ms.Queries([1], np.arange(4, dtype=np.uint64), [np.arange(4)])
    q.weight, q.pairs, q.pairs_of = np.ones(4, np.int64), np.array([[0, 1], [2, 3]]), [np.array([0, 1])]
    s = ms.Search(q, 2)
    first = ms.Block(np.array([5, 6, 7]), np.array([0, 3]), np.array([1, 3]), np.array([2, 0, 1]), np.array([1, 100, 90]))
    s.see(first, {0: (1, 0, np.zeros(0, int)), 1: (100, 0, np.zeros(0, int))})
    assert [list(x) for x in s.best[0]] == [[100, 90], [5, 6]]
    low = ms.Block(np.array([1]), np.array([0, 1]), np.array([1, 2]), np.array([0, 0]), np.array([40, 45]))
    s.see(low, {0: (45, 85, np.array([0]))})
    assert s.skipped == 1
    tie = ms.Block(np.array([2]), np.array([3]), np.array([1]), np.array([0]), np.array([90]))
    s.see(tie, {1: (90, 0, np.zeros(0, int))})
    assert [list(x) for x in s.best[0]] == [[100, 90], [5, 2]]  # the smaller id wins a tie


# --- hard negatives ------------------------------------------------------------------

def brute_negatives(rows, every):
    def scaled(v):
        return [math.floor(256 * float(np.float64(x))) for x in v]

    ok = [(k, i, scaled(v), lab) for k, (i, v, lab) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0, r[2])
    out = []
    for k, i, v, lab in ok:
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, kk, m) for kk, j, w, m in ok if kk != k]
        for p, pid, _, _ in sorted((r for r in scored if r[3] == lab), key=key)[:5]:
            fit = sorted((r for r in scored if r[3] != lab and 50 * p <= 100 * r[0] <= 95 * p), key=key)[:3]
            out += [(i, pid, rank + 1, n[1], p, n[0]) for rank, n in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [hn.BLOCK, 3])
def test_negatives_match_brute_force(spark, block):
    r = np.random.default_rng(5)
    centre = r.normal(size=(4, 6))
    rows = []
    for i in range(240):
        lab = int(r.integers(0, 4))
        v = centre[lab if r.random() < 0.7 else int(r.integers(0, 4))] + 0.4 * r.normal(size=6)
        rows.append((i, [float(np.float32(x)) for x in v], lab))
    rows += [(1000 + i, rows[20][1], 2) for i in range(80)]  # a quarter of the rows are copies
    rows += [(2000, None, 1), (2010, [float("nan")] * 6, 1), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2030, rows[0][1], None),
             (2040, [float("inf")] + [0.0] * 5, 1), (2050, [0.5], 3), (2060, [], 3), (None, rows[20][1], 1), (2070, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("clash")).repartition(4)
    got = hn.mine(df, F.col("id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows, 10)


def test_negatives_of_large_components_are_exact(spark):
    big = 5.0e6  # products beyond 2^53
    rows = [(10, [big, 1.0], 0), (1, [big, 3.0], 0), (2, [big * 0.8, 1.0], 1), (3, [big * 0.8, 2.0], 1), (4, [big * 0.96, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hn.mine(df, F.col("id") % 10 == 0).collect()), key=str) == brute_negatives(rows, 10)


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.mine(df, F.col("id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(10, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hn.mine(one, F.col("id") % 10 == 0).count() == 0


def test_slots_answer_every_window():
    """Suffixes of slots hold the best of each window, for random scores and limits."""
    r = random.Random(3)
    for _ in range(200):
        p = sorted((r.randint(-20, 200) for _ in range(5)), reverse=True)
        scores = [r.randint(-50, 220) for _ in range(60)]
        found = [{"g": 0, "place": k + 1, "id": k, "score": x} for k, x in enumerate(p)]
        upper, least, wanted = hn._slot_limits(found, 1, 50, 95, 100, 5)
        slots = [[] for _ in range(5)]
        for s in scores:
            if least[0] <= s <= upper[0, 0]:
                slots[int((s <= upper[0]).sum()) - 1].append(s)
        slots = [sorted(x, reverse=True)[:3] for x in slots]
        answers = {w[1]: [s for x in slots[w[4]:] for s in x if s >= w[5]][:3] for w in wanted}
        for k, x in enumerate(p):
            want = sorted((s for s in scores if 50 * x <= 100 * s <= 95 * x), reverse=True)[:3]
            assert answers.get(k + 1, []) == want
