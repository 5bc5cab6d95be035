import random
import re
from itertools import combinations

import pyarrow as pa
import pytest
from facsimile.llm import decontaminate as D
from llm_fixtures import docs  # noqa: F401

RNG = random.Random(4)
VOCABULARY = [f"w{i}" for i in range(3000)]


def text(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(i, " ".join(text(n))) for i, n in enumerate([40, 25, 16, 13, 9, 6, 3])] + [(7, None), (8, ""), (None, "w1 w2 w3 w4 w5 w6 w7"), (10, "same " * 30)]
BENCH = [(i, t) for i, t in ITEMS]


def words(t):
    return [w for w in re.split(r"[^0-9a-z]+", (t or "").lower()) if w]


def brute(doc, item):
    """Best line-up by comparing every position, wherever seeds lie."""
    d, b = words(doc), words(item)
    if len(b) < D.MIN_WORDS:
        return False
    size = min(D.WINDOW, len(b))
    for start in range(-len(b) + 1, len(d)):
        same = [0 <= start + j < len(d) and d[start + j] == b[j] for j in range(len(b))]
        if any(sum(same[k:k + size]) >= D.SIMILARITY * size for k in range(len(b) - size + 1)):
            return True
    return False


def planted():
    out = [(1, None), (2, ""), (3, " ".join(text(30_000))), (4, "same same same")]
    n = 100
    for i, t in ITEMS:
        for rate in (0.0, 0.1, 0.15):
            own = [w if RNG.random() >= rate else "changed" for w in (t or "").split()]
            out.append((n, " ".join(text(60)) + ". " + ", ".join(w.upper() for w in own) + "! " + " ".join(text(30))))
            n += 1
    return out + [out[-1], (None, out[5][1])] + [(500 + i, " ".join(text(200))) for i in range(60)]


def test_leaks_match_brute_force(spark, docs):
    pairs = planted()
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(str(r.doc_id), r.item_id) for r in D.find_leaks(docs(pairs), bench).collect()}
    want = {(str(i), k) for i, t in pairs for k, b in BENCH if k is not None and brute(t, b)}
    assert got <= want  # a hit is always verified
    # seeds find nearly all; what they can miss is a window whose substitutions break every mask
    assert len(got) >= 0.95 * len(want)
    exact = {(str(i), k) for i, t in pairs for k, b in BENCH if k is not None and len(words(b)) >= 5 and " ".join(words(b)) in " ".join(words(t))}
    assert exact <= got
    kept = {str(r.doc_id) for r in D.without_leaks(docs(pairs), bench).collect()}
    assert kept == {str(i) for i, _ in pairs} - {i for i, _ in got}


def test_blocks_give_the_same(spark, docs):
    pairs = planted()
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    whole = sorted(map(str, D.find_leaks(docs(pairs), bench).collect()))
    assert sorted(map(str, D.find_leaks(docs(pairs), bench, block_chars=200).collect())) == whole


def test_positions_name_the_passage(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    (r,) = D.find_leaks(docs([(5, "x y alpha beta gamma delta epsilon zeta eta theta z")]), bench).collect()
    assert (r.first_word, r.last_word, r.matched_words, r.item_words) == (2, 9, 8, 8)


@pytest.mark.parametrize("pairs", [[], [(1, None)]])
def test_edge_tables(spark, docs, pairs):
    empty = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(BENCH, "item_id long, text string")
    for bench in (empty, some):
        assert D.find_leaks(docs(pairs), bench).count() == 0
        assert D.without_leaks(docs(pairs), bench).count() == len(pairs)


@pytest.mark.parametrize("size", range(5, 15))
def test_any_tolerated_substitutions_are_found(size):
    """Every pattern of tolerated substitutions, at every place of the window, and none beyond."""
    item = [f"q{i}" for i in range(size)]
    whole = min(size, D.WINDOW)
    most = whole - D.needed(whole, D.SIMILARITY)
    patterns = [c for n in range(most + 2) for c in combinations(range(size), n)]
    texts = [" ".join(["before", "it", *("changed" if i in c else w for i, w in enumerate(item)), "after"]) for c in patterns]
    # passages cut by the text's ends: what is cut off counts as changed
    texts += [" ".join(item[cut:]) for cut in range(4)] + [" ".join(item[:size - cut]) for cut in range(1, 4)]
    seeds = D.build_seeds([1], pa.array([" ".join(item)]))
    assert {t for t, *_ in D.leaks(seeds, pa.array(texts))} == {i for i, t in enumerate(texts) if brute(t, " ".join(item))}


def test_all_leaks_of_brute_force_are_found(spark, docs):
    rng = random.Random(8)
    items = [(i, " ".join(text(n))) for i, n in enumerate([5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 30] * 2)]
    pairs = []
    for i, t in items:
        for n in range(5):
            own = t.split()
            for k in rng.sample(range(len(own)), n):
                own[k] = "changed"
            pairs.append((len(pairs), " ".join(text(rng.randrange(3)) + own + text(rng.randrange(3)))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs(pairs), bench).collect()}
    want = {(i, k) for i, t in pairs for k, b in items if brute(t, b)}
    assert len(want) > 40 and got == want


def test_scripts_without_spaces():
    seeds = D.build_seeds([1, 2], pa.array(["日本の首都はどこですか", "สวัสดีครับ"]))
    assert [(t, i) for t, i, *_ in D.leaks(seeds, pa.array(["問い 日本の首府はどこですか 答え", "日本", "abcสวัสดีครับ", None]))] == [(0, 0), (2, 1)]
