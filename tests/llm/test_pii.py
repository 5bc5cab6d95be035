import hashlib
import random
import re

import numpy as np
import pytest
from facsimile.llm import pii
from pyspark.sql import functions as F
from llm_fixtures import docs, sample  # noqa: F401

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    t = t or ""
    def digits(m):
        return re.sub("[^0-9]", "", m.group())
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return ([(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
            + [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
            + [(2, m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
            + [(3, m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15])


CARD_OK = "4111111111111111"
EDGE = [None, "", "no data", "a@b.c", "a@b", "a@@b.c d@e.f.g", "x@y.z@w.v", "é@b.co", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 01.02.003.0255", "1.2.3. 1.2.3",
        CARD_OK, "4111 1111-1111 1111", CARD_OK + " 7", "4111  1111", "+1 (212) 555-0100", "+12", "+1 2 3 4 5 6 7 8 9-", "++12345678901", "+1234567890123456",
        "7" * 5000, "@" * 50, "1." * 500, "a" * 3000 + "@", "é 😀 a@b.cc 1.1.1.1", "x@y.z " * 3000]


def test_base_matches_the_plain_patterns(sample):
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab@.+-() 0123456789") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for t in EDGE + mixed + [t for _, t in sample]:
        assert pii.base_spans(t or "") == brute(t)


def texts(n=150, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(["the", "of", "call", "on", "in", "mail"]) for _ in range(30)]
        for _ in range(2):
            d = "".join(rng.choice("0123456789") for _ in range(10))
            words[rng.randrange(30)] = rng.choice([f"+1 ({d[:3]}) 555-{d[3:7]}", f"joe{d[:2]}@mail{d[2]}.example.com", f"{d[0]}.{d[1:3]}.{d[3]}.{d[4:6]}", "version 2.0", "in 1999"])
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def weights():
    return pii.train(texts())


def test_repeats_share_labels(weights):
    t = "write to joe42@mail7.example.com today . and later joe42(at)mail7.example.com once"
    ((base, spans),) = pii.find_spans([t], weights)
    assert len(base) == 1 and set(base) <= set(spans)
    alone = "and later 7 things"
    assert pii.find_spans([alone], weights)[0][1] == []
    # what repeats a labelled token is likelier labelled than without the skip edge
    g = pii.build_graph([t])
    cut = g._replace(repeats=[], similar=[])
    assert len(g.repeats) == 1
    none = pii.NONE
    assert pii.marginals(g, weights)[1, none] < pii.marginals(cut, weights)[1, none]


def test_addresses_without_digits_and_repeats_of_a_local_part(weights):
    t = "write to jane.doe@example.org today or to jane(at)example.org , Jane.Doe knows ; joe [at] home and jane do not"
    ((base, spans),) = pii.find_spans([t], weights)
    assert base == [(0, 9, 29)] and set(base) <= set(spans)
    at = t.index("jane(at)")
    assert (0, at, at + len("jane(at)example.org")) in spans
    g = pii.build_graph([t])
    named = [t[a:b] for _, a, b in g.spans]
    assert named == ["jane.doe@example.org", "jane(at)example.org", "Jane.Doe", "[at]"]
    assert g.judged == [True, False, False, False] and (0, 2) in g.repeats
    # a repeat is likelier personal than the same word in a document without the address
    none, cut = pii.NONE, g._replace(repeats=[], similar=[])
    assert pii.marginals(g, weights)[2, none] < pii.marginals(cut, weights)[2, none]
    # plain words as local parts make no nodes of plain words
    assert len(pii.build_graph(["info@example.org gives info"]).nodes) == 1


def test_tokens_that_patterns_cannot_judge_are_no_examples():
    own = texts()
    hidden = [t + " , jane(at)example.org" for t in own]
    plain = pii.train(own)
    with_hidden = pii.train(hidden)
    address = "x jane(at)example.org y"
    for w in (plain, with_hidden):
        assert [s[0] for s in pii.find_spans([address], w)[0][1]] == [0]


def test_crowded_texts_and_copies_in_the_sample(docs):
    crowded = " ".join(f"a{i} b" for i in range(5000))
    part = pii._excerpt(crowded, -7)
    kept = [x for x in part.split() if x != "b"]
    assert pii.TRAIN_TOKENS_OF_TEXT <= len(kept) < 3 * pii.TRAIN_TOKENS_OF_TEXT
    assert int(kept[-1][1:]) > 4000 and int(kept[0][1:]) < 1000  # from the whole text
    assert pii._excerpt("a b c 1 d e f", 3) == "b c 1 d e"
    # copies count once: a third of all rows does not change the weights
    rows = list(enumerate(texts(60)))
    once = pii.fit(docs(rows), train_rows=10_000)
    more = pii.fit(docs(rows + [(100 + i, rows[0][1]) for i in range(300)]), train_rows=10_000)
    assert np.array_equal(once.node, more.node) and np.array_equal(once.chain, more.chain)


def test_messages_on_a_small_loop_are_near_enumeration():
    """Loopy messages are approximate; with rewards of the trained size they keep label and probability."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        w = pii.Weights(rng.normal(size=(len(pii.FEATURES), pii.LABELS)), 0.5 * rng.normal(size=(pii.LABELS, pii.LABELS)), 0.5, 0.3)
        g = pii.Graph([(0, 0, 0)] * 4, [[0, 1], [0, 2], [0, 3], [0, 4]], [(0, 1), (1, 2), (2, 3)], [(0, 3)], [(0, 2)])
        scores = np.stack([w.node[on].sum(axis=0) for on in g.nodes])
        joint = np.zeros((pii.LABELS,) * 4)
        for y in np.ndindex(joint.shape):
            joint[y] = np.exp(sum(scores[i, y[i]] for i in range(4)) + sum(w.chain[y[a], y[b]] for a, b in g.chain)
                              + w.repeat * (y[0] == y[3]) + w.similar * (y[0] == y[2]))
        joint /= joint.sum()
        want = np.stack([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
        assert np.abs(pii.marginals(g, w, rounds=100) - want).max() < 0.05


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(3)
    w = pii.Weights(rng.normal(size=(len(pii.FEATURES), pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), 0.7, 0.3)
    g = pii.Graph([(0, 0, 0)] * 4, [[0, 1], [0, 2], [0, 3], [0]], [(0, 1), (1, 2)], [(2, 3)], [])
    scores = np.stack([w.node[on].sum(axis=0) for on in g.nodes])
    joint = np.zeros((pii.LABELS,) * 4)
    for y in np.ndindex(joint.shape):
        joint[y] = np.exp(sum(scores[i, y[i]] for i in range(4)) + w.chain[y[0], y[1]] + w.chain[y[1], y[2]] + w.repeat * (y[2] == y[3]))
    joint /= joint.sum()
    want = [joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)]
    assert np.allclose(pii.marginals(g, w, rounds=200), want, atol=1e-6)


def test_added_spans_touch_no_base_span(weights, sample):
    for t, (base, spans) in zip([t for _, t in sample], pii.find_spans([t for _, t in sample], weights)):
        assert set(base) <= set(spans) and spans == sorted(spans)
        for s in set(spans) - set(base):
            assert 0 <= s[1] < s[2] <= len(t) and not any(s[1] < e and b < s[2] for _, b, e in base)


def test_query_columns(docs, weights):
    pairs = list(enumerate(EDGE)) + [(5, EDGE[5]), (None, "a@b.c")]
    got = pii.personal_data(docs(pairs), weights, {"doc_id": F.col("doc_id")}).withColumn("h", F.sha2("base", 256)).collect()
    assert len(got) == len(pairs)
    for r in got:
        want = brute(EDGE[r.doc_id] if r.doc_id is not None else "a@b.c")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert r.h == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_redaction(docs, weights):
    assert pii.redact("x a@b.c y 1.1.1.1", [(0, 2, 7), (1, 10, 17)]) == "x [EMAIL] y [IP]"
    assert pii.redact("abcdef", [(0, 1, 4), (3, 2, 5)]) == "a[EMAIL]f"
    pairs = list(enumerate(EDGE))
    out = pii.redacted(docs(pairs), weights)
    assert out.columns == docs(pairs).columns and out.count() == len(pairs)
    for r in out.collect():
        t = EDGE[r.doc_id]
        assert (r.text is None) == (t is None) and (t is None or r.n_chars == len(r.text))
        if t and brute(t):
            assert r.text != t


def test_nothing_to_learn_from(docs):
    w = pii.fit(docs([(1, None), (2, "no digits")]))
    assert pii.personal_data(docs([(1, "a@b.c"), (2, None)]), w, {"doc_id": F.col("doc_id")}).count() == 2
    assert pii.personal_data(docs([]), w, {"doc_id": F.col("doc_id")}).count() == 0
