"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` bits are linked; a document's
component is everything reachable over links.

*Covering masks.*  Every bit position i gets a non-zero vector phi(i) of
``radius + 1`` bits.  For each non-zero vector v there is one mask holding the
positions with <phi(i), v> odd.  ``radius`` differing positions span at most
``radius`` dimensions, so some v is orthogonal to all of them: that mask drops
every differing bit and the pair agrees on it.  2**(radius+1) - 1 tables thus
lose no pair, and each keeps about half the bits, so unrelated fingerprints
seldom meet.

*Scale.*  Only distinct fingerprints enter the tables, so groups of exact copies
cost one row.  A bucket of two is settled inside its aggregate.  Buckets up to
``BUCKET_ROWS`` are compared inside a task and give a spanning forest (fewer
links than members, never all pairs).  Members of larger buckets go another
exact way: two fingerprints are within 4 bits exactly if some value lies
within 2 bits of both, so each member is written under all values within half
the radius, and whoever meets there is linked to the smallest.  Links and
labels stay distributed; components come from minimum labels with pointer jumping.

Defined results: a null or empty text has no words and fingerprint zero, linked
like any other.  Repeated rows each return a row.  A null id never becomes a
component id unless all ids of the component are null.  Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.joins import sized_broadcast
from ..session import materialize
from .common import table
from .registry import query

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Members of one bucket that a task compares directly; larger buckets take the exact way over midpoints.
BUCKET_ROWS = 4096


def simhash(text: str | None, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text as an unsigned 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        spans = zip((ends - lens)[: len(words) - words_per_shingle + 1].tolist(), ends[words_per_shingle - 1:].tolist(), strict=True)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in spans]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per input row, fp as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), words_per_shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    narrow = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks as unsigned integers."""
    dims = radius + 1
    phi = [1 + i % (2 ** dims - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() % 2) for v in range(1, 2 ** dims)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect the members of one bucket as all its links would."""
    n = len(fps)
    root = np.full(n, -1)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        edge = [first]
        while edge:  # each member is compared once with those that are still free
            free = np.flatnonzero(root < 0)
            if not len(free):
                break
            near = free[np.bitwise_count(fps[free] ^ fps[edge.pop()]) <= radius]
            root[near] = first
            edge.extend(near.tolist())
    at = np.flatnonzero(root != np.arange(n))
    return fps[at], fps[root[at]]


def _bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Spanning forests of buckets (t, key) with at most ``BUCKET_ROWS`` members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(t, key, fp):
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            parts = [_forest(x, radius) for x in np.split(fp, cut)]
            a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
            t, key, fp = (np.concatenate([h[i] for h in held]) for i in range(3))
            whole = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))
            if len(whole):  # the last bucket may go on in the next batch
                cut = whole[-1] + 1
                yield flush(t[:cut], key[:cut], fp[:cut])
                held = [(t[cut:], key[cut:], fp[cut:])]
            else:
                held = [(t, key, fp)]
        if held:
            yield flush(*held[0])

    ordered = members.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    return ordered.mapInArrow(run, "a long, b long")


def _midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Exact links of many fingerprints that lie close together, without comparing pairs.

    Two values within ``radius`` (even) bits share a value within radius / 2 of both,
    and whoever shares one is within ``radius``.  A midpoint's group is bounded by
    the ball of that size (2,081 values for radius 4)."""
    flips = [0] + [sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(BITS), k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = np.array(flips, np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 64):
                some = fp[at:at + 64]
                mid = (some[:, None] ^ ball[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mid.view(np.int64)), pa.array(np.repeat(some, len(ball)).view(np.int64))], ["mid", "fp"])

    met = (fps.select("fp").mapInArrow(run, "mid long, fp long")
           .groupBy("mid").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("members"))
           .where(F.size("members") > 1))
    return met.select(F.explode("members").alias("a"), "b").where("a <> b")


def near_links(distinct_fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) whose components equal those of all pairs within ``radius`` bits."""
    if radius % 2:
        raise ValueError("radius must be even: larger buckets are linked over midpoints")
    masks = covering_masks(radius)
    keyed = distinct_fps.select(F.explode(F.array(*[
        F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), F.col("fp"))
        for t, m in enumerate(masks)])).alias("x")).select("x.*")
    buckets = materialize(
        keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1 and (n > 2 or bit_count(a ^ b) <= %d)" % radius), "simhash-buckets")
    pairs = buckets.where("n = 2").select("a", "b")
    several = buckets.where("n > 2").select("t", "key", "n")
    members = keyed.join(sized_broadcast(several), ["t", "key"])
    links = pairs.unionByName(_bucket_links(members.where(F.col("n") <= bucket_rows), radius))
    if several.where(F.col("n") > bucket_rows).limit(1).count():
        crowded = members.where(F.col("n") > bucket_rows).select("fp").distinct()
        links = links.unionByName(_midpoint_links(crowded, radius))
    return links.distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected links (a, b).

    Each round takes the smallest label among neighbours and then the label of
    that label, so long chains shrink by halves.  A round's table is written to
    the shared folder, which also cuts the lineage."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "component-links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "component-labels")
    while True:
        around = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                  .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")))
        near = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        done = near.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), "old")
        labels = materialize(done, "component-labels")
        if not labels.where("label <> old").limit(1).count():
            return labels.select("node", "label")


def simhash_components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS,
                       bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``df``; root is a fingerprint that names the component."""
    fps = materialize(fingerprints(df, id_column, text_column, words_per_shingle), "simhash")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "simhash-classes")
    labels = component_labels(near_links(classes.select("fp"), radius, bucket_rows))
    member = classes.join(labels.withColumnRenamed("node", "fp"), "fp")
    smallest = member.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = labels.join(smallest, "label").select(F.col("node").alias("fp"), "label", "component_id")
    # a row whose fingerprint is its own and has no link is its own component: only the others are looked up,
    # and these are few enough to broadcast unless counting them says otherwise
    several = materialize(classes.join(linked, "fp", "left").where("rows > 1 or label is not null").select(
        "fp", F.coalesce("label", "fp").alias("root"),
        # a component may hold rows without an id only
        F.when(F.col("label").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")), "simhash-several")
    found = fps.join(sized_broadcast(several), "fp", "left")
    return found.select("doc_id", "fp", F.coalesce("root", "fp").alias("root"),
                        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each component, that of its smallest id; all columns stay.

    Ids that repeat or are null can't name a row alone: then rows are told apart by
    fingerprint too, and of rows that agree in both, one stays."""
    found = materialize(simhash_components(df, id_column, text_column, words_per_shingle, radius), "simhash-found")
    rows, ids, distinct = found.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if rows == ids == distinct:
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_column))
        return df.join(sized_broadcast(gone), id_column, "left_anti")
    chosen = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("x"))
              .select(F.col("x.doc_id").alias("__id"), F.col("x.fp").alias("__kept_fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_column))
            fps = np.fromiter((simhash(t.as_py(), words_per_shingle) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, "__fp"])

    tagged = df.mapInArrow(run, StructType([*df.schema.fields, StructField("__fp", LongType())]))
    kept = tagged.join(chosen, tagged[id_column].cast("long").eqNullSafe(chosen["__id"]) & (tagged["__fp"] == chosen["__kept_fp"]), "left_semi")
    return kept.dropDuplicates([id_column, "__fp"]).drop("__fp")


def fingerprint_hex(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")
