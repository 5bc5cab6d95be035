import pytest

import __spark_entry__ as entry
import corpus_pipeline
from facsimile.llm import decontaminate, pii, sentencepiece_scan, simhash, toxicity
from facsimile.llm.queries import QUERIES
from llm_fixtures import SF as SF_SMALL
from oracle_harness import check
from llm_fixtures import docs  # noqa: F401


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "personal_data", "sentencepiece"]


def test_quality_rules_match_sql(spark):
    ok, said = check(spark, "op1_quality_rules", SF_SMALL)
    assert ok, said


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    got = QUERIES[name](spark, SF_SMALL).count()
    assert got == {"op2_warc": 2 * spark.read.parquet(f"{SF_SMALL}/pages.parquet").count(), "op10_decontamination": got}.get(name, n)


def test_pipeline_matches_a_plain_one(spark):
    """The stages, one after the other, over plain lists."""
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in table.collect()}
    from facsimile.llm.common import id_bucket
    model = toxicity.fit(table, spark.read.parquet(f"{SF_SMALL}/labels.parquet").where(id_bucket(5) != 0))
    ids = list(rows)
    p = model.probability(__import__("numpy").array(toxicity.Scorer(model).margins([toxicity.words_of(rows[i]) for i in ids])[0]))
    rows = {i: rows[i] for i, x in zip(ids, p) if x < 0.5}
    ids = sorted(rows)
    fps = [simhash.simhash(rows[i]) for i in ids]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    rows = {i: t for i, t in rows.items() if find(i) == i}
    import pyarrow as pa
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    seeds = decontaminate.build_seeds([b.item_id for b in bench], pa.array([b.text for b in bench]))
    gone = {x[0] for x in decontaminate.leaks(seeds, pa.array(list(rows.values())))}
    rows = {i: t for k, (i, t) in enumerate(rows.items()) if k not in gone}
    w = pii.fit(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    rows = {i: pii.redact(t, spans) for (i, t), (_, spans) in zip(rows.items(), pii.find_spans(list(rows.values()), w))}
    pieces = sentencepiece_scan.Encoder(sentencepiece_scan.Pieces.load()).texts(list(rows.values()))
    want = {i: (len(t), x) for (i, t), x in zip(rows.items(), pieces)}
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_chars, r.pieces) for r in got} == want and len(got) == len(want)
    assert all(r.text_crc32 == r.decoded_crc32 for r in got)


def test_stages_keep_columns_and_survive_edge_tables(spark, docs):
    for pairs in ([], [(1, None), (2, ""), (2, ""), (None, "a b c"), (4, "long " * 9000)]):
        df = docs(pairs)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF_SMALL)
            assert out.count() <= len(pairs)
            if name != "sentencepiece":
                assert out.columns == df.columns
                df = out
