import random

import numpy as np
import pytest
import xxhash
from facsimile.llm import simhash
from llm_fixtures import docs, sample  # noqa: F401

EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "A b  c\td"), (8, "x " * 30_000), (9, "x " * 30_000), (9, "x " * 30_000)]


def brute_fp(text):
    words = [w for w in bytes((text or "").encode()).lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def near_texts(n=60, seed=5):
    rng = random.Random(seed)
    words = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(300)] = "changed"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_components_match_all_pairs(docs, sample, bucket_rows):
    pairs = EDGE + [(100 + i, t) for i, t in sample[:120]] + [(1000 + i, t) for i, t in enumerate(near_texts())] + [(None, "one")]
    got = simhash.simhash_components(docs(pairs), bucket_rows=bucket_rows).collect()
    fps = [brute_fp(t) for _, t in pairs]
    want = brute_components([i for i, _ in pairs], fps)
    assert sorted((str(r.doc_id), r.fp % 2 ** 64, str(r.component_id)) for r in got) == sorted((str(i), f, str(c)) for (i, _), f, c in zip(pairs, fps, want))


def test_every_pair_within_the_radius_meets_under_some_mask():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & flip == 0 for m in masks)


def test_spark_hash_is_the_contract_hash(spark):
    from pyspark.sql import functions as F
    (row,) = spark.range(1).select(F.xxhash64(F.lit("a b é")).alias("h")).collect()
    assert row.h % 2 ** 64 == xxhash.xxh64_intdigest("a b é".encode(), 42)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = dict(simhash.component_labels(links).collect())
    assert all(got[i] == 0 for i in range(201)) and got[901] == got[900] == 900


def test_forest_connects_like_all_links():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2 ** 12, 200, dtype=np.uint64)
    a, b = simhash._forest(fps, 1)
    assert len(a) < 200
    want = brute_components(list(range(200)), [int(x) for x in fps], 1)
    groups = {}
    for f, c in zip(fps.tolist(), want):
        groups.setdefault(c, set()).add(f)
    merged = {f: c for c, fs in groups.items() for f in fs}
    assert all(merged[int(x)] == merged[int(y)] for x, y in zip(a, b))


def test_one_row_of_each_component_stays(docs):
    near = near_texts(6)
    unique = [(i, t) for i, t in enumerate([*near, "something else entirely here", None, "", "another text of its own"])]
    kept = simhash.one_per_component(docs(unique))
    fps = [brute_fp(t) for _, t in unique]
    want = brute_components([i for i, _ in unique], fps)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert kept.columns == docs(unique).columns
    repeated = unique + [(0, near[0]), (None, near[1]), (None, "no id and no copy"), (None, "no id and no copy")]
    kept = simhash.one_per_component(docs(repeated)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, set(want)), "None"])


def test_no_rows(docs):
    assert simhash.simhash_components(docs([])).count() == 0
    assert simhash.one_per_component(docs([])).count() == 0
