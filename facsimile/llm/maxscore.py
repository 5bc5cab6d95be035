"""Operator 12: ranked lexical search by MaxScore with pair bounds.

Score of a document: the sum over a query's terms (once each) of
``w * ((10^9 tf) div (1000 tf + 8 m))``, with w from the term's document frequency and m from the document's length.

Index, built where the documents lie (no shuffle of texts or postings):
1. A block is a run of documents of about 1 MB of text.  Words are hashed to 64 bits by prefix sums over bytes; the
   postings of the queries' terms are kept: (term, document in block, tf), beside the length of each document.
   Block counts add up to N, L and each term's document frequency.
2. With these known, each block gets its impacts (a posting's part of the score), the largest of each term, and for each
   term pair that the queries use the intersection list and the largest joint impact over it.  A query's terms
   are paired by frequency, neighbours together: frequent terms, whose lists make a search long, meet in the pair lists.

Search: a task goes through its blocks and keeps each query's best k documents so far; the last of them is the threshold.
* A pair adds at most max(largest joint impact, either term's largest), which is less than the sum of the two
  terms' largest.  A block whose pairs' bounds add up to less than the threshold is skipped.
* Pairs are taken by rising bound; those whose bounds add up to less than the threshold are not essential: only documents
  with a term of an essential pair are candidates.
* Remaining pairs are then added in descending order, to candidates that can still reach the threshold: one that is
  on the pair's intersection list may gain the joint maximum, any other only the larger single maximum.
* Documents that tie with the threshold stay in, as equal scores go to the smaller id.
Each task gives at most k documents of each query; those lists are merged by query.

Bounds: queries come in blocks of ``QUERY_CHARS`` characters, each with an index of its vocabulary; a block of documents is one
row, and a task holds one of them and queries x k results.  Nothing else is broadcast or collected but one number for each term of
a query block.  Equal words have equal hashes; that two different words share one (about 10^-8 for 10^5 query terms and 10^6
words) is not looked into.

Defined results: null and empty texts hold no term and count for nothing; a query without terms, or whose terms are nowhere, gives no row;
repeated queries are ranked each on its own and repeated documents are documents of their own; null document ids come last among ties;
an empty table gives an empty result; extra columns are not looked at.  A very long text is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.session import materialize

from .common import flat_bytes, table, text_slices, word_hashes
from .registry import query

#: Documents given for each query, and characters of a block of queries.
TOP, QUERY_CHARS = 10, 2_000_000
#: Length normalisation: m = (100 - LENGTH) + (LENGTH n N) div L.
LENGTH = 90
LAST_ID = int(np.iinfo(np.int64).max)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that part terms: ASCII but letters and digits.
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the texts, and the text it is in."""
    data, starts = flat_bytes(texts)
    return word_hashes(_LOWER[data], starts, _PARTS)


@dataclass
class Queries:
    """A block of queries; a term is a number, ``terms`` its hashes in ascending order."""
    ids: list
    terms: np.ndarray
    of: list[np.ndarray]                                    # terms of each query
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    pairs_of: list[np.ndarray] = field(default_factory=list)  # pairs of each query; a last single term pairs with itself

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Weights from document frequencies, and the pairs of each query."""
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        known: dict[tuple[int, int], int] = {}
        for terms in self.of:
            held = [int(t) for t in terms[np.lexsort((terms, self.weight[terms]))] if df[t]]
            two = [(held[i], held[min(i + 1, len(held) - 1)]) for i in range(0, len(held), 2)]
            self.pairs_of.append(np.array([known.setdefault(p, len(known)) for p in two], np.int64))
        self.pairs = np.array(list(known), np.int64).reshape(-1, 2)


def parse_queries(ids: list, texts: pa.Array) -> Queries:
    h, at = term_hashes(texts)
    terms, number = np.unique(h, return_inverse=True)
    return Queries(ids, terms, [np.unique(number[at == q]) for q in range(len(ids))])


def query_blocks(queries: DataFrame, id_column: str, text_column: str, block_chars: int) -> Iterator[Queries]:
    """The queries in blocks of about ``block_chars`` characters, each collected."""
    items = queries.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_chars)
    if blocks > 1:
        items = materialize(items.withColumn("row", F.monotonically_increasing_id()), "search-queries")
    for k in range(blocks):
        part = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)).toArrow()
        yield parse_queries(part.column("id").to_pylist(), part.column("text").combine_chunks())


_POSTINGS = "ids array<long>, n array<long>, terms array<int>, ends array<int>, docs array<int>, tf array<long>"


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def build_postings(documents: DataFrame, terms: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Step 1, written: one row for each block of documents, with the postings of ``terms``."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)
    narrow = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for a, b in text_slices(batch):
                part = batch.slice(a, b - a)
                h, at = term_hashes(part.column("text"))
                n = np.bincount(at, minlength=part.num_rows)
                term = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                hit = vocabulary[term] == h if len(vocabulary) else np.zeros(len(h), bool)
                key, tf = np.unique(term[hit].astype(np.int64) * part.num_rows + at[hit], return_counts=True)
                term, doc = key // part.num_rows, key % part.num_rows
                found, first = np.unique(term, return_index=True)
                ends = np.append(first[1:], len(term)) if len(found) else first
                ids = pc.fill_null(part.column("id"), LAST_ID).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [_list(ids, pa.int64()), _list(n, pa.int64()), _list(found, pa.int32()), _list(ends, pa.int32()), _list(doc, pa.int32()), _list(tf, pa.int64())],
                    ["ids", "n", "terms", "ends", "docs", "tf"])

    return materialize(narrow.mapInArrow(run, _POSTINGS), "search-postings")


def statistics(postings: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, document frequency of each term)."""
    row = postings.agg(F.sum(F.size(F.filter("n", lambda x: x > 0))).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
    each = postings.select(F.posexplode("terms").alias("k", "term"), "ends")
    held = F.element_at("ends", F.col("k") + 1) - F.when(F.col("k") > 0, F.element_at("ends", F.greatest(F.col("k"), F.lit(1)))).otherwise(0)
    df = np.zeros(terms, np.int64)
    for r in each.select("term", held.cast("long").alias("held")).groupBy("term").agg(F.sum("held").alias("df")).collect():
        df[r["term"]] = r["df"]
    return int(row["docs"] or 0), int(row["words"] or 0), df


def length_norms(n: np.ndarray, n_docs: int, words: int) -> np.ndarray:
    """m of each document."""
    if len(n) and int(n.max()) * LENGTH * n_docs >= 2 ** 63:
        return np.array([100 - LENGTH + LENGTH * int(x) * n_docs // words for x in n], np.int64)
    return 100 - LENGTH + (LENGTH * n * n_docs) // max(words, 1)


class Block:
    """A block's impacts and pair lists."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, ends: np.ndarray, docs: np.ndarray, impact: np.ndarray):
        self.ids, self.impact, self.docs = ids, impact, docs
        self.at = {int(t): (int(a), int(b)) for t, a, b in zip(terms, np.append(0, ends[:-1]) if len(ends) else ends, ends, strict=True)}
        self.most = {t: int(impact[a:b].max()) for t, (a, b) in self.at.items()}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at.get(term, (0, 0))
        return self.docs[a:b], self.impact[a:b]

    def pair(self, one: int, two: int) -> tuple[np.ndarray, int]:
        """Documents that hold both terms, and their largest joint impact."""
        if one == two or one not in self.at or two not in self.at:
            return np.zeros(0, np.int32), 0
        (d1, i1), (d2, i2) = self.list_of(one), self.list_of(two)
        common, p, q = np.intersect1d(d1, d2, assume_unique=True, return_indices=True)
        return common, int((i1[p] + i2[q]).max()) if len(common) else 0


_IMPACTS = ("ids array<long>, terms array<int>, ends array<int>, docs array<int>, impact array<long>, "
            "pairs array<int>, single array<long>, joint array<long>, pair_ends array<int>, pair_docs array<int>")


def build_impacts(postings: DataFrame, queries: Queries, n_docs: int, words: int) -> DataFrame:
    """Step 2, written: impacts, and for each pair its largest single and joint impacts and its intersection list."""
    shared = postings.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n, terms, ends, docs, tf = (batch.column(c)[k].values.to_numpy() for c in ("ids", "n", "terms", "ends", "docs", "tf"))
                m = length_norms(n, n_docs, words)
                term = np.repeat(terms, np.diff(ends, prepend=0))
                impact = asked.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
                block = Block(ids, terms, ends, docs, impact)
                held, single, joint, size, lists = [], [], [], [], [np.zeros(0, np.int32)]
                for p, (one, two) in enumerate(asked.pairs.tolist()):
                    if one in block.at or two in block.at:
                        common, most = block.pair(one, two)
                        held.append(p)
                        single.append(max(block.most.get(one, 0), block.most.get(two, 0)))
                        joint.append(most)
                        size.append(len(common))
                        lists.append(common)
                yield pa.RecordBatch.from_arrays(
                    [_list(ids, pa.int64()), _list(terms, pa.int32()), _list(ends, pa.int32()), _list(docs, pa.int32()), _list(impact, pa.int64()),
                     _list(np.array(held, np.int32), pa.int32()), _list(np.array(single, np.int64), pa.int64()), _list(np.array(joint, np.int64), pa.int64()),
                     _list(np.cumsum(np.array(size, np.int64)), pa.int32()), _list(np.concatenate(lists), pa.int32())],
                    ["ids", "terms", "ends", "docs", "impact", "pairs", "single", "joint", "pair_ends", "pair_docs"])

    return materialize(postings.mapInArrow(run, _IMPACTS), "search-impacts")


class Search:
    """The best documents of each query over the blocks seen so far."""

    def __init__(self, queries: Queries, top: int):
        self.queries, self.top = queries, top
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.of]  # scores, ids
        self.skipped = self.scored = 0

    def threshold(self, q: int) -> int:
        """A document must reach it (and be above 0)."""
        scores = self.best[q][0]
        return max(int(scores[-1]), 1) if len(scores) == self.top else 1

    def keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.best[q][0], scores)), np.concatenate((self.best[q][1], ids))
        order = np.lexsort((ids, -scores))[:self.top]
        self.best[q] = scores[order], ids[order]

    def see(self, block: Block, bounds: dict[int, tuple[int, int, np.ndarray]]) -> None:
        """``bounds``: largest single and joint impact and the intersection list of each pair in the block."""
        acc = np.zeros(len(block.ids), np.int64)
        for q, wanted in enumerate(self.queries.pairs_of):
            pairs = [(max(bounds[p][:2]), p) for p in wanted.tolist() if p in bounds]
            pairs.sort()
            goal = self.threshold(q)
            rising = np.cumsum([b for b, _ in pairs])
            if not len(pairs) or rising[-1] < goal:
                self.skipped += 1
                continue
            optional = int(np.searchsorted(rising, goal, side="left"))  # bounds of the first so many add up to less than the goal
            acc[:] = 0
            held = np.zeros(len(acc), bool)
            for _, p in pairs[optional:]:
                for term in set(self.queries.pairs[p].tolist()):
                    docs, impact = block.list_of(term)
                    acc[docs] += impact
                    held[docs] = True
            docs = np.flatnonzero(held)
            score = acc[docs]
            for k in range(optional - 1, -1, -1):
                p = pairs[k][1]
                single, joint, both = bounds[p]
                rest = int(rising[k - 1]) if k else 0
                # only documents on the pair's list can gain the joint maximum
                gain = np.full(len(acc), single)
                gain[both] = max(joint, single)
                alive = score + gain[docs] + rest >= goal
                docs, score = docs[alive], score[alive]
                if not len(docs):
                    break
                acc[docs] = 0
                for term in set(self.queries.pairs[p].tolist()):
                    at, impact = block.list_of(term)
                    acc[at] += impact
                score = score + acc[docs]
                for term in self.queries.pairs[p].tolist():
                    acc[block.list_of(term)[0]] = 0
            ok = score >= goal
            self.scored += int(ok.sum())
            if ok.any():
                self.keep(q, score[ok], block.ids[docs[ok]])


def search(documents: DataFrame, queries: DataFrame, query_id: str = "item_id", id_column: str = "doc_id", text_column: str = "text",
           top: int = TOP, block_chars: int = QUERY_CHARS) -> DataFrame:
    """(query id, rank, document id, score): the ``top`` best documents of each query."""
    parts = [_search_block(documents, q, query_id, id_column, text_column, top) for q in query_blocks(queries, query_id, text_column, block_chars)]
    if not parts:
        return documents.sparkSession.createDataFrame([], f"`{query_id}` long, rank int, `{id_column}` long, score long")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _search_block(documents: DataFrame, asked: Queries, query_id: str, id_column: str, text_column: str, top: int) -> DataFrame:
    spark = documents.sparkSession
    postings = build_postings(documents, asked.terms, id_column, text_column)
    n_docs, words, df = statistics(postings, len(asked.terms))
    asked.weigh(n_docs, df)
    shared = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(shared.value, top)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, terms, ends, docs, impact, pairs, single, joint, pair_ends, pair_docs = (batch.column(c)[k].values.to_numpy() for c in columns)
                begins = np.append(0, pair_ends[:-1]) if len(pair_ends) else pair_ends
                bounds = {int(p): (int(s), int(j), pair_docs[a:b]) for p, s, j, a, b in zip(pairs, single, joint, begins, pair_ends, strict=True)}
                found.see(Block(ids, terms, ends, docs, impact), bounds)
        counts = [len(s) for s, _ in found.best]
        q = np.repeat(np.arange(len(counts)), counts)
        scores = np.concatenate([s for s, _ in found.best]) if counts else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i in found.best]) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids), pa.array(scores)], ["q", "id", "score"])

    columns = ("ids", "terms", "ends", "docs", "impact", "pairs", "single", "joint", "pair_ends", "pair_docs")
    impacts = build_impacts(postings, asked, n_docs, words)
    place = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = impacts.mapInArrow(run, "q long, id long, score long").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, i in enumerate(asked.ids)], f"q long, `{query_id}` long")
    return ranked.join(F.broadcast(names), "q").select(query_id, "rank", F.nullif(F.col("id"), F.lit(LAST_ID)).alias(id_column), "score")  # names: one block's


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
tf AS (SELECT doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY doc_id, len(t), term),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // words)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""


@query("op12_ranked_search", SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
