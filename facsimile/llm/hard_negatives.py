"""Operator 13: hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label.  A positive of score p allows the negatives
whose score lies in [low * p, high * p]; the windows of an anchor's positives overlap.  Their upper
limits split the scores into disjoint slots: slot j holds what is at most the j-th largest limit and
above the next one.

1. Positives: every task scores its rows against a block of anchors and keeps the best few of each anchor.
2. Slots: the limits of each anchor's positives, largest first.
3. Negatives: every task puts each score into its one slot and keeps the best ``per_positive`` of each slot.
4. Suffix merge: the best of slots j, j+1, ... merged answer every window whose upper limit is the j-th;
   rows come in descending order, so those under a window's lower limit are its tail.

A task's state is anchors x slots x few rows, whatever it reads; nothing is joined with everything.  Anchors
come in blocks of ``BLOCK`` (bounded), each with two passes over the rows.  Ties go to the smaller id, so the
result does not depend on how rows are dealt.

Scores are integer inner products of floor(scale * x).  Doubles hold them exactly while
largest component squared times length is under 2^53; beyond, Python integers are used, and a score outside
64 bits is given as the nearest 64-bit number.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; shorter
vectors count as zero beyond their end; a null id is no anchor and comes last among ties (as does 2^63 - 1, which is given as null); repeated ids are rows of their
own; anchors without a positive or whose windows are empty give no row; an empty table gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.session import materialize

from .common import table
from .registry import query

#: Anchors of one block, and rows that are scored against it at once.
BLOCK, SLICE = 2048, 512
LAST_ID = int(np.iinfo(np.int64).max)
#: Positives of an anchor, negatives of a positive, and the window [LOW, HIGH] / OF of a positive's score.
POSITIVES, PER_POSITIVE, LOW, HIGH, OF, SCALE = 5, 3, 50, 95, 100, 256
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Best:
    """The best ``k`` (score, id) of each of ``groups`` groups: larger scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score = np.full((groups, k), -1, np.int64)
        self.id = np.full((groups, k), LAST_ID, np.int64)
        self.row = np.full((groups, k), -1, np.int64)
        self.full = np.zeros((groups, k), bool)

    def may_enter(self, score: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Which of the entries beat their group's last one."""
        last, tie = self.score[groups, -1], self.id[groups, -1]
        return ~self.full[groups, -1] | (score > last) | ((score == last) & (ids < tie))

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, groups: np.ndarray) -> None:
        keep = self.may_enter(score, ids, groups)
        if not keep.any():
            return
        score, ids, rows, groups = score[keep], ids[keep], rows[keep], groups[keep]
        touched = np.unique(groups)
        g, place = np.nonzero(self.full[touched])
        g = touched[g]
        score = np.concatenate((self.score[g, place], score))
        ids = np.concatenate((self.id[g, place], ids))
        rows = np.concatenate((self.row[g, place], rows))
        groups = np.concatenate((g, groups))
        order = np.lexsort((rows, ids, ~score, groups))  # ~ turns the order of 64-bit numbers round without overflow
        at = groups[order]
        rank = np.arange(len(order)) - np.searchsorted(at, at, side="left")
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.full[touched] = False
        where = groups[order], rank
        self.score[where], self.id[where], self.row[where], self.full[where] = score[order], ids[order], rows[order], True

    def entries(self) -> tuple[np.ndarray, ...]:
        """(group, score, id, row) in order."""
        g, place = np.nonzero(self.full)
        return g, self.score[g, place], self.id[g, place], self.row[g, place]


def prepared(df: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(row, id, label, v): the rows that take part, written, with a number of their own."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "label", "v"), "negatives-rows")


def integer_matrix(column: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors as rows, with zeros beyond their ends."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    first = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(first, sizes)] = np.floor(np.nan_to_num(flat * scale))
    return out


def inner_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Integer scores, rows by anchors."""
    most = np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) * max(rows.shape[1], 1)
    if most < 2.0 ** 53:
        return (rows @ anchors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(rows) @ whole(anchors).T
    return np.vectorize(lambda x: max(-LAST_ID - 1, min(LAST_ID, x)), otypes=[np.int64])(exact)


@dataclass
class Anchors:
    """A block of anchors: bounded arrays that tasks get with their code."""
    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    scale: int

    def scored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(scores, ids, row numbers, labels) of a few rows at a time."""
        width = self.v.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                row, id_, label = (pc.fill_null(b.column(n), LAST_ID).to_numpy() for n in ("row", "id", "label"))
                yield inner_products(integer_matrix(b.column("v"), width, self.scale), self.v), id_, row, label


def _anchor_blocks(rows: DataFrame, is_anchor: Column, width: int, scale: int, block: int) -> Iterator[Anchors]:
    chosen = rows.where(is_anchor)
    count = chosen.count()
    blocks = -(-count // block)
    for k in range(blocks):
        part = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)
        t = part.orderBy("row").toArrow().combine_chunks()
        row, id_, label = (t.column(n).to_numpy() for n in ("row", "id", "label"))
        vectors = pa.concat_arrays(t.column("v").chunks) if t.num_rows else pa.array([], pa.list_(pa.float64()))
        yield Anchors(row, id_, label, integer_matrix(vectors, width, scale), scale)


def _emitted(best: Best, slots: int) -> pa.RecordBatch:
    g, score, id_, row = best.entries()
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (g // slots, g % slots, score, id_, row)], ["g", "slot", "score", "id", "row"])


_PARTIAL = "g long, slot long, score long, id long, row long"


def _merged(partial: DataFrame, k: int) -> DataFrame:
    """The tasks' lists of each (g, slot) merged."""
    place = Window.partitionBy("g", "slot").orderBy(F.desc("score"), "id", "row")
    return partial.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _positives(rows: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.row), k)
        for s, id_, row, label in anchors.scored(batches):
            r, g = np.nonzero((label[:, None] == anchors.label) & (row[:, None] != anchors.row))
            best.add(s[r, g], id_[r], row[r], g)
        yield _emitted(best, 1)

    return _merged(rows.mapInArrow(run, _PARTIAL), k)


def windows(scores: list[int], low: int, high: int, of: int) -> list[tuple[int, int]]:
    """(lower, upper) limit of each positive: low * p <= of * score <= high * p."""
    return [(-((-low * p) // of), (high * p) // of) for p in scores]


def _slot_limits(found: list, anchors: int, low: int, high: int, of: int, slots: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Upper limits of each anchor's slots in descending order, the least lower limit, and the positives with slot and window."""
    upper = np.full((anchors, slots), -LAST_ID - 1, np.int64)
    least = np.full(anchors, LAST_ID, np.int64)
    wanted, by_anchor = [], {}
    for r in found:
        by_anchor.setdefault(r["g"], []).append(r)
    for g, rows in by_anchor.items():
        limits = windows([r["score"] for r in rows], low, high, of)
        ends = sorted({u for lo, u in limits if lo <= u}, reverse=True)
        upper[g, :len(ends)] = ends
        for r, (lo, u) in zip(rows, limits, strict=True):
            if lo <= u:
                least[g] = min(least[g], lo)
                wanted.append((g, r["place"], r["id"], r["score"], ends.index(u), lo))
    return upper, least, wanted


def _slot_best(rows: DataFrame, anchors: Anchors, upper: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    slots = upper.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(anchors.row) * slots, k)
        for s, id_, row, label in anchors.scored(batches):
            r, g = np.nonzero((label[:, None] != anchors.label) & (s <= upper[:, 0]) & (s >= least))
            score = s[r, g]
            slot = (score[:, None] <= upper[g]).sum(axis=1) - 1
            best.add(score, id_[r], row[r], g * slots + slot)
        yield _emitted(best, slots)

    return _merged(rows.mapInArrow(run, _PARTIAL), k)


def mine(df: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
         positives: int = POSITIVES, per_positive: int = PER_POSITIVE, low: int = LOW, high: int = HIGH, of: int = OF,
         scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the rows that ``is_anchor`` (over a column ``id``) selects, against all rows."""
    spark = df.sparkSession
    rows = prepared(df, id_column, vector_column, label_column)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    parts = []
    for anchors in _anchor_blocks(rows, is_anchor, width, scale, block):
        # a block's positives and limits are bounded: they come to the driver and go out with the code
        found = _positives(rows, anchors, positives).orderBy("g", "place").collect()
        upper, least, wanted = _slot_limits(found, len(anchors.row), low, high, of, positives)
        best = _slot_best(rows, anchors, upper, least, per_positive)
        asked = spark.createDataFrame([(*w[:4], int(anchors.id[w[0]]), *w[4:]) for w in wanted],
                                      "g long, positive int, positive_id long, positive_score long, anchor_id long, first_slot long, lower long")
        hits = best.join(F.broadcast(asked), "g").where((F.col("slot") >= F.col("first_slot")) & (F.col("score") >= F.col("lower")))
        # slots descend, and so do the rows in them: their first few are the window's best
        place = Window.partitionBy("g", "positive").orderBy("slot", "place")
        ranked = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= per_positive)
        known = lambda c: F.nullif(F.col(c), F.lit(LAST_ID))
        out = ranked.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"),
                            "positive_score", F.col("score").alias("negative_score"))
        parts.append(materialize(out, "negatives-block") if len(anchors.row) >= block else out)
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], RESULT)


SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
              FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM pos JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3
"""


@query("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("id") % 50 == 0)
