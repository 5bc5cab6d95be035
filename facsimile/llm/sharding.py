"""Sharding by sampled splitters: range partitions of near equal bytes.

1. The rows are reduced to (key, tie, size) and written once.
2. A sample of keys is drawn with probability in proportion to size; the draw
   is a hash of the row, so a retried task draws the same rows.  Quantiles of
   the sample are the splitters of ``RANGES_PER_SHARD`` ranges per shard.
3. Rows go to the range of their key.  Ranges that turn out overfull are
   sampled again on their own and subdivided, until none is left or a range is
   one single (key, tie).
4. Exact bytes and rows of the ranges, added up in order, say where each range
   begins; a running sum inside each range places its rows.  A shard is an
   equal share of all bytes on that line, so its size is off by one row at most.

The key decides the order, so equal keys are neighbours; the tie (a hash of the
row's id, then the row's place in the written table) lets a key that holds a
third of all rows be split like any other.  The driver sees splitters and range
totals only, both bounded by the number of shards.

Defined results: a null text has no bytes, size 16 and checksum 0; null keys
come first; an empty table gives no rows; repeated rows are placed one by one.
Extra columns are dropped.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import table
from .registry import query

SHARDS = 40
ROW_BYTES = 16
RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 24
#: A range with more bytes and rows than this many times the mean is subdivided.
OVERFULL = 3.0

Splitter = tuple[int, int]


def _draw_splitters(rows: DataFrame, total: int, ranges: int, seed: int) -> list[Splitter]:
    """Quantiles of a size-weighted sample of (key, tie)."""
    rate = ranges * SAMPLES_PER_RANGE / max(total, 1)
    draw = (F.xxhash64("key", "tie", "rid", F.lit(seed)).bitwiseAND((1 << 53) - 1) / float(1 << 53))
    sample = sorted(tuple(r) for r in rows.where(draw < F.col("size") * rate).select("key", "tie").collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def _range_of(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """Add ``part``: the number of splitters at or below the row's (key, tie)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array([s[0] for s in splitters], np.int64)
        for b in batches:
            key, tie = b.column("key").to_numpy(), b.column("tie").to_numpy()
            part, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for i in np.flatnonzero(hi > part):  # the key itself is a splitter: the tie decides
                part[i] = bisect.bisect_right(splitters, (int(key[i]), int(tie[i])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], [*b.schema.names, "part"])

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", part int")


def _splitters(rows: DataFrame, total: int, ranges: int) -> tuple[list[Splitter], DataFrame]:
    """Splitters without overfull ranges, and the rows with their range."""
    splitters = _draw_splitters(rows, total, ranges, seed=0)
    most = OVERFULL * total / ranges
    seed = 0
    while True:
        placed = _range_of(rows, splitters)
        full = (placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
                .where((F.col("bytes") > most) & (F.col("n") > 1)).collect())
        seed += 1
        more = set()
        for r in full:
            more |= set(_draw_splitters(placed.where(F.col("part") == r["part"]), r["bytes"],
                                        2 + int(OVERFULL * r["bytes"] / most), seed))
        if not more - set(splitters):
            return splitters, placed
        splitters = sorted(more | set(splitters))


def shard_by_bytes(df: DataFrame, key: Column, size: Column, carry: dict[str, Column], shards: int = SHARDS) -> DataFrame:
    """``carry`` columns with ``size``, ``shard`` and ``slot`` (0, 1, ... within the shard).

    ``key`` is a bigint that orders the rows; the carried columns break its ties."""
    narrow = df.select(*[c.alias(n) for n, c in carry.items()], size.cast("long").alias("size"),
                       F.coalesce(key.cast("long"), F.lit(-(1 << 63))).alias("key"))
    rows = materialize(narrow.withColumns({"tie": F.xxhash64(*carry), "rid": F.monotonically_increasing_id()}), "shard-rows")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    splitters, placed = _splitters(rows, total, shards * RANGES_PER_SHARD)
    ranges = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ranges.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("part").orderBy("key", "tie", "rid")
    run = placed.select("*", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("in_bytes"),
                        (F.row_number().over(inside) - 1).alias("in_rows"))
    line = run.join(F.broadcast(offsets), "part").select(
        *carry, "size", (F.col("rows_before") + F.col("in_rows")).alias("place"),
        # the middle of a row's bytes lies in its shard's share
        F.least(F.lit(shards - 1), F.floor(((F.col("bytes_before") + F.col("in_bytes")) * 2 + F.col("size")) * shards / (2.0 * max(total, 1)))).cast("int").alias("shard"))
    line = materialize(line, "shard-line")
    firsts = line.groupBy("shard").agg(F.min("place").alias("first"))
    return line.join(F.broadcast(firsts), "shard").select(*carry, "size", "shard", (F.col("place") - F.col("first")).alias("slot"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    # equal texts share the key's upper 40 bits; the lower 24 spread them in a fixed order
    key = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 24))).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 24) - 1)))
    out = shard_by_bytes(docs, key, F.octet_length(text) + ROW_BYTES,
                         {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text).cast("long")}, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
                      F.lit(None).cast("int").alias("grown_shard"))
