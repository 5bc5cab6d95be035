import re
import zlib

from facsimile.llm import quality_rules, sharding
from pyspark.sql import functions as F
from llm_fixtures import docs, sample  # noqa: F401

SPACE = re.compile(r"[\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 4000), (5, "the same line of words\n" * 40), (5, "the same line of words\n" * 40),
        (None, "a b"), (7, "# * $ % & | < >\n- x\n...\n"), (8, " not space \x1c here"), (9, "x" * 50_000)]


def repeats(words, window=8):
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i:i + window]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)})


def brute(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats(words)


def test_measures_match_brute_force(docs, sample):
    pairs = EDGE + sample
    got = quality_rules.quality_rules(docs(pairs)).collect()
    want = sorted((str(i), *brute(t)) for i, t in pairs)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.broken_rules == "")


def test_quality_of_no_rows_is_no_rows(docs):
    assert quality_rules.quality_rules(docs([])).count() == 0


def test_quality_plan_is_native(docs):
    plan = quality_rules.quality_rules(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def shards(df, n):
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shard_by_bytes(df, F.xxhash64(text), F.octet_length(text) + 16, {"doc_id": F.col("doc_id"), "crc": F.crc32(text)}, n).collect()


def test_shards_are_equal_shares_with_gapless_slots(docs, sample):
    pairs = EDGE + sample + [(1000 + i, "one text that a third of all rows hold") for i in range(300)] + [(77, "twice")] * 50
    got = shards(docs(pairs), 7)
    assert sorted((str(r.doc_id), r.crc) for r in got) == sorted((str(i), zlib.crc32((t or "").encode())) for i, t in pairs)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(7))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 7) <= largest


def test_equal_texts_are_neighbours(docs):
    pairs = [(i, f"text {i % 5}" * 20) for i in range(400)]
    got = shards(docs(pairs), 5)
    line = [r.crc for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(line, line[1:])) == 4


def test_overfull_ranges_are_subdivided(spark):
    # one key for all rows: only the tie can part them
    df = spark.range(4000).select(F.lit(5).cast("long").alias("key"), F.xxhash64("id").alias("tie"), F.lit(100).cast("long").alias("size"), F.col("id").alias("rid"))
    splitters, placed = sharding._splitters(df, 400_000, 16)
    assert placed.groupBy("part").count().agg(F.max("count")).first()[0] <= 4000 / 16 * sharding.OVERFULL
    assert splitters == sorted(splitters)


def test_sharding_edge_tables(docs):
    assert shards(docs([]), 4) == []
    (only,) = shards(docs([(1, None)]), 4)
    assert (only.size, only.slot, only.crc) == (16, 0, 0)
