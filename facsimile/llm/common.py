"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separator of the contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Bytes of text that a Python helper works on at once (one longer text is taken alone).
SLICE_BYTES = 1024 * 1024
#: Rows of one Arrow batch: whole texts are long, and Spark's default of 10,000 rows makes batches of tens of MB.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Let this session hand texts to Python in batches of at most ``BATCH_ROWS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the queries that read it hand it on in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``mod`` (a null id gives null)."""
    return F.crc32(F.col(column).cast("string")) % mod


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it for ``body``.

    A column referenced inside a lambda may be inlined by the optimizer and
    then be computed once per array element; a lambda variable cannot be."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_slices(batch: pa.RecordBatch, column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) row bounds of runs of rows whose texts sum to about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, to
        at = to


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array with a space after each text, and where each text begins."""
    data = [(t or "").encode() for t in texts.to_pylist()]
    lens = np.fromiter((len(x) + 1 for x in data), np.int64, len(data))
    starts = np.concatenate(([0], np.cumsum(lens)))
    return np.frombuffer(b" ".join(data) + b" ", np.uint8), starts


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
    have = 1
    with np.errstate(over="ignore"):
        step = base
        while have < n:
            take = min(have, n - have)
            out[have:have + take] = out[:take] * step
            have += take
            step = step * step
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, separator: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of ``flat_bytes`` output, and the text each word is in.

    ``separator`` says for each byte value whether it parts words.

    Polynomial hash over bytes by prefix sums, so the cost is a few vector
    operations per byte; equal words have equal hashes wherever they stand."""
    space = separator[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))))
        value = (total[end] - total[begin]) * _powers(_BASE_INV, len(data) + 1)[begin]
    return mix64(value ^ (end - begin).astype(np.uint64)), np.searchsorted(starts, begin, side="right") - 1
