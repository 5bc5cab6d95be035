import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from facsimile.llm import langid, toxicity
from pyspark.sql import functions as F
from llm_fixtures import docs, sample  # noqa: F401

EDGE = [(1, None), (2, ""), (3, " \n "), (4, "12 34 !?"), (5, "the cat " * 20_000), (6, "x" * 30_000), (6, "x" * 30_000), (None, "le chat")]


def brute_profile(text, size=langid.PROFILE):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    counts = Counter()
    for w in words:
        padded = chr(1) + w + chr(1)
        counts.update(w)
        counts.update(padded[i:i + 2] for i in range(len(padded) - 1))
        counts.update(padded[i:i + 3] for i in range(len(padded) - 2))
    code = {g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))) for g in counts}
    return [code[g] for g in sorted(counts, key=lambda g: (-counts[g], code[g]))][:size]


def test_profiles_match_brute_force(sample):
    for t in [t for _, t in EDGE] + [t for _, t in sample[:60]]:
        assert langid.ranked(langid.grams(t)).tolist() == brute_profile(t)


def test_out_of_place_distance():
    p = langid.Profiles([("a", 10, 0), ("a", 11, 1), ("b", 11, 0)], size=3)
    own = np.array([11, 10, 12])
    place = p.place[np.where(np.isin(own, p.grams), np.searchsorted(p.grams, own), len(p.grams))]
    out = np.where(place < 0, 3, np.abs(place - np.arange(3)[:, None])).sum(axis=0)
    assert out.tolist() == [1 + 1 + 3, 0 + 3 + 3]


def test_language_of_held_out_texts(spark):
    from facsimile.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    share, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and share >= 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_texts(docs):
    profiles = langid.learn_profiles(docs([(1, "the cat and the dog"), (2, None)]).withColumn("lang", F.lit("en")))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict_language(docs(EDGE), profiles, {"doc_id": F.col("doc_id")}).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, "en"), (None, "en")}
    nothing = langid.learn_profiles(docs([]))
    assert {r.lang_pred for r in langid.predict_language(docs(EDGE), nothing, {"doc_id": F.col("doc_id")}).collect()} == {"und"}
    assert langid.predict_language(docs([]), profiles, {"doc_id": F.col("doc_id")}).count() == 0


def brute_kernel(a, b):
    def features(w):
        s = "\0" + w + "\0"
        out = Counter()
        from itertools import combinations
        for at in combinations(range(len(s)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out
    x, y = features(a), features(b)
    dot = sum(v * y[k] for k, v in x.items())
    return dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_matches_subsequence_enumeration():
    words = ["idiot", "idxiot", "banana", "bananana", "abc", "worthless", "wort"]
    got = toxicity.kernel(words, words)
    want = [[brute_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-5)
    assert got[0, 1] > 0.4 > got[0, 2]


INSULTS = ["idiot", "moron", "clown", "pathetic"]


def labelled(n=300, seed=2):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["on", "er", "the", "in", "ti", "sha", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    out = []
    for _ in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = labelled()
    return toxicity.train([toxicity.words_of(t) for t, _ in rows], [y for _, y in rows])


def scores(model, texts):
    return model.probability(np.array(toxicity.Scorer(model).margins([toxicity.words_of(t) for t in texts])[0]))


def test_learns_insults_and_tolerates_gaps(model):
    fresh = labelled(seed=9)
    p = scores(model, [t for t, _ in fresh])
    assert np.mean((p >= 0.5) == [y == 1 for _, y in fresh]) >= 0.97
    hidden = ["idxiot", "i.d.i.o.t", "i d i o t", "IDIOT!!", "m0ron", "cl-own", "pa*thetic", "mo_ron"]
    assert (scores(model, [f"on the {w} in re" for w in hidden]) >= 0.5).all()
    assert (scores(model, ["on the tire in re", "sha sha on", "a b c d e f", "", None]) < 0.5).all()


def test_score_of_folded_weights_is_the_svm(model):
    # the score of a word is linear in kernel values to words: doubling a landmark's weight can't change the order
    words = ["idiot", "onthe", "erinti"]
    assert np.argmax(model.word_scores(words)) == 0


def test_degenerate_training():
    assert scores(toxicity.train([], []), ["x", None]).max() < 0.5
    assert scores(toxicity.train([{"a"}], [1]), ["anything"])[0] > 0.5
    assert scores(toxicity.train([{"abc"}, {"def"}], [0, 0]), ["abc"])[0] < 0.5
    assert len(scores(toxicity.train([set(), {"idiot"}], [0, 1]), ["idiot"])) == 1


def test_fit_and_score_tables(spark, docs):
    rows = labelled()
    table = docs([(i, t) for i, (t, _) in enumerate(rows)] + [(1000 + i, t) for i, (_, t) in enumerate(EDGE)] + [(None, "idiot")])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(1000, None), (1001, 0), (None, 1), (9999, 1)], "doc_id long, toxic int")
    m = toxicity.fit(table, labels)
    got = toxicity.score_texts(table, m, {"doc_id": F.col("doc_id")})
    assert got.count() == table.count() and got.where("score is null or score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").count() == 0
    kept = toxicity.without_toxic(table, m)
    assert kept.columns == table.columns and kept.count() == got.where("predicted = 0").count()
    assert toxicity.score_texts(docs([]), m, {"doc_id": F.col("doc_id")}).count() == 0


def test_accents_and_lookalikes():
    assert toxicity.plain_parts("Ïd1ot!!".lower()) == ["idiot"]
    assert unicodedata.normalize("NFKD", "é")[0] == "e" and toxicity.plain_parts("été") == ["ete"]
    assert toxicity.plain_parts("ab") == [] and len(toxicity.plain_parts("x" * 100)) > 1


def with_rare_words(rows, seed=3):
    """Each text with a word of its own."""
    rng = random.Random(seed)
    return [(t + " " + "".join(rng.choice("abcdefghklmnoprstuvz") for _ in range(8)), y) for t, y in rows]


def flipped(rows):
    """Wrong labels: for each insult two of its texts are called clean, and as many clean texts toxic."""
    wrong = {i for w in INSULTS for i in [k for k, (t, y) in enumerate(rows) if y and w in t.split()][:2]}
    wrong |= set([k for k, (_, y) in enumerate(rows) if not y][:len(wrong)])
    return [(t, 1 - y if i in wrong else y) for i, (t, y) in enumerate(rows)], len(wrong) / len(rows)


def test_a_few_wrong_labels_hide_no_insult():
    rows, share = flipped(with_rare_words(labelled(1000)))
    assert 0.01 < share < 0.02
    m = toxicity.train([toxicity.words_of(t) for t, _ in rows], [y for _, y in rows])
    fresh = with_rare_words(labelled(seed=9), 4)
    p = scores(m, [t for t, _ in fresh])
    assert np.mean((p >= 0.5) == [y == 1 for _, y in fresh]) >= 0.97
    assert (scores(m, [f"on the {w} in re" for w in INSULTS]) >= 0.5).all()


def test_witness_candidates_need_evidence():
    clean, toxic = np.array([0, 0, 1, 2, 5, 300]), np.array([0, 1, 40, 700, 1, 300])
    assert toxicity.candidates(clean, toxic, 3000, 3000).tolist() == [False, True, True, True, False, False]
    # few toxic texts: a rare word that is once among them is no candidate
    assert not toxicity.candidates(np.array([5]), np.array([1]), 3000, 100)[0]
