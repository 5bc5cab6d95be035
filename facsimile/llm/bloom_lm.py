"""Language-model scores from a log-frequency Bloom filter.

*Filter.*  Words and word pairs of the training texts are counted exactly.  A count n
is held as its quantised logarithm q = 1 + floor(log2 n): the n-gram is entered q times,
together with 1, 2, ... q.  A lookup probes 1, 2, ... until a probe misses; the last hit
is q, and n is estimated by the middle of its class.  A false hit can only raise an
estimate, and a pair's estimate is held to that of its first word.

*Smoothing.*  p(w | u) = (n(u w) + MU p(w)) / (n(u) + MU), with p(w) = (n(w) + 1) / (N + V + 1);
all n are read from the filter.  A text's score is the sum of log10 p over its words
and its end, each after the word before it (the first after a start sign).

*Scale.*  Counting combines inside each task and then shuffles (hash, count).  The
shuffle is dealt by segments of the filter, so that each task finishes whole
segments.  These are ``BITS_PER_BYTE`` bits for each byte of training text at every size,
so the share of false hits does not grow with the corpus (``model.fill`` tells it).  They are
broadcast in blocks of at most ``BLOCK_BITS`` (128 MB).  A worker holds one block at a
time: it tokenises about ``GROUP_BYTES`` of text, goes through the blocks, probes in each
the n-grams that hash into it, and only then scores.  Texts are read once; what grows with
the corpus is the number of blocks that each group of texts goes through.  Exact counts of single words, which the base score needs, are
broadcast for the most frequent ones only (at most ``HOT_WORDS``); the other words
of each text are joined to the count table by shuffle, so nothing is left out.

Words are told apart by a 64-bit hash.  Defined results: null and empty texts hold
one token, the end; an empty training set gives N = V = 0; rows with a null id are in
neither part (``held_out`` null) and are scored; repeated rows are scored one by one;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .common import flat_bytes, id_bucket, mix64, table, text_slices, word_hashes
from .registry import query

BITS_PER_BYTE = 1.25
SEGMENT_BITS = 1 << 20
#: Bits of the filter that a worker holds at a time.
BLOCK_BITS = 1 << 30
#: Bytes of text for which a worker goes through the blocks once, if there are several.
GROUP_BYTES = 24_000_000
PROBES = 3
HOT_WORDS = 1 << 21
MU = 100.0
MAX_LEVEL = 48
#: Bytes of text that one shuffle partition of counts stands for.
PARTITION_BYTES = 24_000_000
COUNT_BYTES = 8_000_000

_ONE = np.uint64(1)
END = np.uint64(0x8F1BBCDCCA62C1D7)    # the end of a text, counted as a token
START = np.uint64(0x5BE0CD19137E2179)  # what stands before the first word
START_KEY = START ^ _ONE               # its count is entered as a pair's would be


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token and of the one before it, the text of each, and the first token of each text.

    A token's hash is odd, so that it is never that of a pair."""
    lowered = pa.array([(t or "").encode().lower().decode() for t in texts.to_pylist()], pa.string())
    words, text_of = word_hashes(*flat_bytes(lowered))
    n = len(texts)
    per_text = np.bincount(text_of, minlength=n) + 1
    first = np.concatenate(([0], np.cumsum(per_text)))
    token = np.empty(len(words) + n, np.uint64)
    token[first[1:] - 1] = END
    token[np.arange(len(words)) + text_of] = words
    token |= _ONE
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = START
    return token, before, np.repeat(np.arange(n), per_text), first


def pair_hashes(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(before * np.uint64(0xD6E8FEB86659FD93) + token) & ~_ONE


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def probe_bits(h: np.ndarray, level: np.ndarray | int) -> list[np.ndarray]:
    """Bits inside the segment that stand for an n-gram at a level."""
    with np.errstate(over="ignore"):
        x = mix64(h ^ (np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64)))
    return [(x >> np.uint64(20 * k)) & np.uint64(SEGMENT_BITS - 1) for k in range(PROBES)]


def levels_of(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n), exactly."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


class LogFrequencyFilter(NamedTuple):
    """Neighbouring segments of the filter."""
    bits: np.ndarray     # packed, low bit first
    segments: int        # of the whole filter
    first: int = 0       # the first segment held

    def level(self, h: np.ndarray) -> np.ndarray:
        """Probe 1, 2, ... for each n-gram until one misses; the last hit."""
        out = np.zeros(len(h), np.int64)
        alive = np.arange(len(h))
        base = (segment_of(h, self.segments) - np.uint64(self.first)) * np.uint64(SEGMENT_BITS)
        q = 0
        while len(alive) and q < MAX_LEVEL:
            q += 1
            hit = np.ones(len(alive), bool)
            for at in probe_bits(h[alive], q):
                at = at + base[alive]
                hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = q
        return out


def count_estimate(level: np.ndarray) -> np.ndarray:
    """Middle of the counts that share a level.

    Levels come as bytes, of which numpy would make half floats that end at 65,504."""
    level = np.asarray(level, np.float64)
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(level) - 1) / 2, 0.0)


class Blocks:
    """The whole filter in blocks of ``per_block`` segments; one is in memory."""

    def __init__(self, blocks: list[Broadcast], segments: int, per_block: int):
        self.blocks, self.segments, self.per_block = blocks, segments, per_block
        self.now: tuple[int, LogFrequencyFilter] | None = None

    def level(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        block = (segment_of(h, self.segments) // np.uint64(self.per_block)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(len(self.blocks) + 1))
        wanted = np.flatnonzero(np.diff(ends)).tolist()
        # the block at hand first
        for k in sorted(wanted, key=lambda k: self.now is None or k != self.now[0]):
            if self.now is None or self.now[0] != k:
                if self.now is not None and getattr(self.blocks[self.now[0]], "_path", None):
                    vars(self.blocks[self.now[0]]).pop("_value", None)  # it can be read from its file again
                self.now = None
                self.now = k, self.blocks[k].value
            own = order[ends[k]:ends[k + 1]]
            out[own] = self.now[1].level(h[own])
        return out


class Prepared(NamedTuple):
    """A slice of texts, tokenised; ``grams`` are its distinct words, the start and its pairs."""
    grams: np.ndarray
    words: int
    inverse: np.ndarray   # by token: its word
    text_of: np.ndarray   # by token: its text
    first: np.ndarray     # by text: its first token


def prepare(texts: pa.Array) -> Prepared:
    token, before, text_of, first = tokens(texts)
    word, inverse = np.unique(token, return_inverse=True)
    return Prepared(np.concatenate((word, [START_KEY], pair_hashes(before, token))), len(word), inverse, text_of, first)


class BloomModel(NamedTuple):
    blocks: list[Broadcast]  # each holds a LogFrequencyFilter
    segments: int
    per_block: int
    set_bits: int
    n: int                # training tokens
    v: int                # distinct ones
    hot: np.ndarray       # hashes of frequent words, sorted
    hot_n: np.ndarray     # their exact counts
    complete: bool        # whether hot holds every word

    @property
    def fill(self) -> float:
        """Share of bits set; a false hit has this to the power ``PROBES``."""
        return self.set_bits / (self.segments * SEGMENT_BITS)

    def score(self, part: Prepared, level: np.ndarray) -> tuple[np.ndarray, ...]:
        """By text: tokens, tokens known from the hot words, their base part, the model's score, and
        (text, hash, times) of words that are not hot.  ``level`` is that of the part's n-grams."""
        word, inverse, text_of, first = part.grams[:part.words], part.inverse, part.text_of, part.first
        at = np.searchsorted(self.hot, word)
        known = at < len(self.hot)
        known[known] = self.hot[at[known]] == word[known]
        exact = np.zeros(len(word), np.int64)
        exact[known] = self.hot_n[at[known]]
        rows = len(first) - 1
        n_known = np.bincount(text_of, known[inverse], rows).astype(np.int64)
        base = np.bincount(text_of, np.log10(exact + 1.0)[inverse], rows)
        context = count_estimate(level[:len(word) + 1])
        alone = np.minimum(1.0, (context[:-1] + 1) / (self.n + self.v + 1))[inverse]
        left = np.concatenate(([len(word)], inverse[:-1]))
        left[first[:-1]] = len(word)
        left_n = context[left]
        pair = np.minimum(count_estimate(level[len(word) + 1:]), left_n)
        score = np.bincount(text_of, np.log10((pair + MU * alone) / (left_n + MU)), rows)
        rare = np.flatnonzero(~known[inverse])
        key, times = np.unique(np.stack((text_of[rare], inverse[rare])), axis=1, return_counts=True) if len(rare) and not self.complete else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        return np.diff(first), n_known, base, score, key[0], word[key[1]], times


def _counts(texts: DataFrame) -> DataFrame:
    """(h, n): counts of tokens (odd h), pairs and starts (even h), combined inside batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in text_slices(b, limit=COUNT_BYTES):
                token, before, _, first = tokens(b.column(0).slice(at, to - at))
                h, n = np.unique(np.concatenate((token, pair_hashes(before, token))), return_counts=True)
                # starts are contexts, not tokens
                h, n = np.append(h, START_KEY), np.append(n, len(first) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(run, "h long, n long")


def _segments(counted: DataFrame, segments: int) -> DataFrame:
    """Rows of whole filter segments (seg, bits) and of single words (h, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        names = ["seg", "h", "n", "bits"]
        for b in batches:
            h, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            single = (h & _ONE) == 1
            if single.any():
                rows = int(single.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int32()), pa.array(h[single].view(np.int64)), pa.array(n[single]), pa.nulls(rows, pa.binary())], names)
            top = levels_of(n)
            key = np.repeat(h, top)
            level = np.arange(len(key)) - np.repeat(np.cumsum(top) - top, top) + 1
            seg = segment_of(key, segments).astype(np.int64)
            order = np.argsort(seg, kind="stable")
            bits = [x[order] for x in probe_bits(key, level)]
            own, begin = np.unique(seg[order], return_index=True)
            for s, a, z in zip(own.tolist(), begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):
                if s not in held:
                    held[s] = np.zeros(SEGMENT_BITS, bool)
                for x in bits:
                    held[s][x[a:z]] = True
        for s, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()])], names)

    return counted.select("h", "n").mapInArrow(run, "seg int, h long, n long, bits binary")


def _broadcast_blocks(rows: DataFrame, segments: int, block_bits: int) -> tuple[list[Broadcast], int, int]:
    """The filter's blocks, the segments of each, and the number of bits set; the driver holds one block."""
    spark = rows.sparkSession
    per_block = min(segments, max(1, block_bits // SEGMENT_BITS))
    step = SEGMENT_BITS // 8
    blocks, set_bits, bits = [], 0, None

    def close() -> None:
        nonlocal set_bits
        set_bits += int(np.bitwise_count(bits).sum(dtype=np.int64))
        blocks.append(spark.sparkContext.broadcast(LogFrequencyFilter(bits, segments, len(blocks) * per_block)))

    def opened() -> np.ndarray:
        return np.zeros(min(per_block, segments - len(blocks) * per_block) * step, np.uint8)

    bits = opened()
    for row in (rows if per_block == segments else rows.orderBy("seg")).toLocalIterator():
        while row["seg"] >= (len(blocks) + 1) * per_block:
            close()
            bits = opened()
        at = (row["seg"] - len(blocks) * per_block) * step
        bits[at:at + step] = np.frombuffer(row["bits"], np.uint8)
    while len(blocks) * per_block < segments:
        close()
        bits = opened() if len(blocks) * per_block < segments else None
    return blocks, per_block, set_bits


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, together of about ``limit`` bytes of text."""
    held, size = [], 0
    for b in batches:
        for at, to in text_slices(b):
            held.append(b.slice(at, to - at))
            size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def fit(texts: DataFrame, text_column: str = "text", hot_words: int = HOT_WORDS, block_bits: int = BLOCK_BITS) -> tuple[BloomModel, DataFrame]:
    """The model, and the count table (h, n) of all words."""
    spark = texts.sparkSession
    texts = texts.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    segments = max(16, int(size * BITS_PER_BYTE) // SEGMENT_BITS)
    parts = max(shuffle_partitions(spark), -(-size // PARTITION_BYTES))
    seg = F.shiftright(F.shiftrightunsigned("h", 32) * segments, 32)
    counted = _counts(texts).repartition(parts, seg).groupBy(seg.alias("seg"), "h").agg(F.sum("n").alias("n"))
    built = materialize(_segments(counted, segments), "bloom-lm")
    words = built.where("bits is null").select("h", "n")
    blocks, per_block, set_bits = _broadcast_blocks(built.where("bits is not null").select("seg", "bits"), segments, block_bits)
    # how many words have at least 1, 2, 4, ... tokens
    by_level = {r["q"]: r for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("q")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    v, n = (sum(r[k] for r in by_level.values()) for k in ("v", "n"))
    least, total = 0, v
    while total > hot_words:
        total -= by_level[least]["v"] if least in by_level else 0
        least += 1
    hot = words.where(F.floor(F.log2("n")) >= least).toArrow()
    h = hot.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    model = BloomModel(blocks, segments, per_block, set_bits, n, v, h[order], hot.column("n").to_numpy()[order], total == v)
    return model, words


def score_texts(df: DataFrame, model: BloomModel, words: DataFrame, carry: dict[str, Column], text_column: str = "text") -> DataFrame:
    """The carried columns with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    spark = df.sparkSession
    shared, blocks = spark.sparkContext.broadcast(model._replace(blocks=[])), model.blocks
    limit = GROUP_BYTES if len(blocks) > 1 else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        whole = Blocks(blocks, model.segments, model.per_block)
        for group in _groups(batches, limit):
            prepared = [prepare(part.column(part.num_columns - 1)) for part in group]
            levels = whole.level(np.concatenate([x.grams for x in prepared])).astype(np.uint8)
            ends = np.cumsum([len(x.grams) for x in prepared])[:-1]
            for part, x, level in zip(group, prepared, np.split(levels, ends), strict=True):
                n, known, base, score, row, h, times = model.score(x, level)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], ["h", "times"]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n), pa.array(known), pa.array(base), pa.array(score), rare],
                                                 [*part.schema.names[:-1], "n_tokens", "n_known", "base", "score", "rare"])

    rows = df.select(*[c.alias(k) for k, c in carry.items()], F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes[:-1])
    scored = rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, base double, score double, rare array<struct<h: long, times: long>>")
    if not model.complete:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "bloom-scores")
        seldom = scored.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.times")
        found = (seldom.join(words, "h").groupBy("row")
                 .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("part")))
        scored = scored.drop("rare").join(found, "row", "left").withColumns({
            "n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "base": F.col("base") + F.coalesce("part", F.lit(0.0))})
    unit = float(np.log10(model.n + model.v + 1))
    return scored.select(*carry, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
                         (F.col("base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score")


@query("op7_language_model")
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, words = fit(docs.where(id_bucket(7) != 2))
    return score_texts(docs, model, words, {"doc_id": F.col("doc_id"), "held_out": id_bucket(7) == 2})
