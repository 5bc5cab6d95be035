"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a mask over consecutive words: kept positions are hashed,
ignored ones may differ.  The seeds of all benchmark items form one sorted
table; every window of every training text is hashed under the same masks and
looked up in it.  A hit fixes how text and item line up; the whole line-up is
then compared word by word.  A document leaks an item when, along one line-up,
``window`` neighbouring words of the item (or all of a shorter item) agree with
the text in a share of at least ``similarity``, so substituted words are tolerated.

*Masks.*  A window of s words may have t = s - ceil(``similarity`` s) substitutions.  Its positions
are dealt to groups, and each mask ignores t of the groups: t substitutions lie in at most t
groups, so one mask is free of them wherever they are, and no passage is missed.  Shorter items
have masks for their own length.

*Scale.*  The benchmark is the stated query set.  It goes through the documents
in blocks of at most ``BLOCK_CHARS`` characters: a block's seed table is
broadcast and is bounded by that, the documents are read where they lie, and
nothing is shuffled.  A benchmark of more blocks costs more passes, not memory.

Defined results: words are runs of letters, digits and non-ASCII characters in
lower case; in scripts written without spaces each character is a word.  A null or empty text leaks nothing; items with fewer than
``MIN_WORDS`` words are no passages and match nothing; equal items each match;
repeated documents each return their rows.  Extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat_bytes, mix64, table, text_slices, word_hashes
from .registry import query

#: Groups of positions of which masks ignore some; more if that leaves fewer than two.
GROUPS = 4
WINDOW = 13
SIMILARITY = 0.8
MIN_WORDS = 5
BLOCK_CHARS = 4_000_000

_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FILTER_BITS = 22
#: Thai, Lao, Burmese, Khmer, kana and Han characters.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


class Seeds(NamedTuple):
    """The seed table of a block of items."""
    masks: list[tuple[int, ...]]     # kept positions of each mask
    filters: list[np.ndarray]        # by mask: which top bits of a seed occur at all (a power of two of them)
    hashes: list[np.ndarray]         # by mask: sorted seeds
    item: list[np.ndarray]           # by mask: the item of each seed
    at: list[np.ndarray]             # by mask: the word of the mask's first kept position
    words: list[np.ndarray]          # by item: word hashes
    ids: np.ndarray                  # by item: item_id


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lowered = (t.lower() if t else t for t in texts.to_pylist())
    lowered = pa.array([t if not t or t.isascii() else _UNSPACED.sub(r" \1 ", t) for t in lowered], pa.string())
    return word_hashes(*flat_bytes(lowered), _PARTS)


def _keys(words: np.ndarray, kept: tuple[int, ...]) -> np.ndarray:
    """Seed hash at each position from which the mask fits."""
    n = len(words) - kept[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in kept:
            key += words[k:k + n] * np.uint64(2 * k + 0x2545F4914F6CDD1D)
    return mix64(key)


def masks_for(size: int, changed: int) -> list[tuple[int, ...]]:
    """Kept positions, counted from the first kept one, of masks one of which avoids any ``changed`` positions."""
    groups = max(GROUPS, changed + 2)
    kept = [[i for i in range(size) if i % groups not in out] for out in combinations(range(groups), changed)]
    return sorted({tuple(i - k[0] for i in k) for k in kept})


def needed(size: int, similarity: float) -> int:
    """Words of a window that have to agree."""
    return math.ceil(similarity * size - 1e-9)


def _which(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each seed in a filter: its top bits."""
    return key >> np.uint64(65 - len(filter_).bit_length())


def build_seeds(ids: list[int], texts: pa.Array, window: int = WINDOW, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> Seeds:
    hashes, text_of = _tokens(texts)
    words = np.split(hashes, np.searchsorted(text_of, np.arange(1, len(texts))))
    sizes: dict[tuple[int, ...], set[int]] = {}  # by mask: the window sizes that have it
    for size in sorted({min(window, len(w)) for w in words if len(w) >= min_words}):
        for k in masks_for(size, size - needed(size, similarity)):
            sizes.setdefault(k, set()).add(size)
    out = Seeds(list(sizes), [], [], [], [], words, np.array(ids, np.int64))
    for k in out.masks:
        use = [i for i, w in enumerate(words) if len(w) >= min_words and min(window, len(w)) in sizes[k]]
        keys = [_keys(words[i], k) for i in use]
        key = np.concatenate([*keys, np.empty(0, np.uint64)])
        item = np.repeat(np.array(use, np.int64), [len(x) for x in keys])
        at = np.concatenate([*(np.arange(len(x)) for x in keys), np.empty(0, np.int64)])
        order = np.argsort(key, kind="stable")
        seen = np.zeros(1 << min(_FILTER_BITS, 8 + len(key).bit_length()), bool)
        seen[_which(seen, key)] = True
        for held, x in ((out.filters, seen), (out.hashes, key[order]), (out.item, item[order]), (out.at, at[order].astype(np.int64))):
            held.append(x)
    return out


def _line_ups(seeds: Seeds, words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Distinct (item, word of the slice that lies under the item's first word, text)."""
    found = []
    for k, kept in enumerate(seeds.masks):
        key = _keys(words, kept)
        if not len(key) or not len(seeds.hashes[k]):
            continue
        inside = np.flatnonzero(seeds.filters[k][_which(seeds.filters[k], key)])
        inside = inside[text_of[inside] == text_of[inside + kept[-1]]]
        lo = np.searchsorted(seeds.hashes[k], key[inside], "left")
        n = np.searchsorted(seeds.hashes[k], key[inside], "right") - lo
        if not n.sum():
            continue
        pos = np.repeat(inside, n)
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(np.stack((seeds.item[k][entry], pos - seeds.at[k][entry], text_of[pos]), axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def _agreeing(seeds: Seeds, found: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, similarity: float) -> np.ndarray:
    """The line-ups without those of items up to one window long that agree in too few words."""
    size = np.array([len(w) for w in seeds.words], np.int64)
    least = np.array([needed(n, similarity) for n in size.tolist()], np.int64)
    first = np.cumsum(size) - size
    own = np.concatenate([*seeds.words, np.empty(0, np.uint64)])
    short = np.flatnonzero(size[found[:, 0]] <= window)
    item, start, text = found[short].T
    same = np.zeros(len(short), np.int64)
    for j in range(int(size[item].max(initial=0))):
        at = start + j
        inside = np.flatnonzero((j < size[item]) & (at >= begin[text]) & (at < end[text]))
        same[inside] += own[first[item[inside]] + j] == words[at[inside]]
    keep = np.ones(len(found), bool)
    keep[short] = same >= least[item]
    return found[keep]


def leaks(seeds: Seeds, texts: pa.Array, window: int = WINDOW, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, matched words, item words, first and last word of the text) for the best line-up of each pair."""
    words, text_of = _tokens(texts)
    begin = np.searchsorted(text_of, np.arange(len(texts)))
    end = np.searchsorted(text_of, np.arange(len(texts)), "right")
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    found = _line_ups(seeds, words, text_of)
    for item, start, text in _agreeing(seeds, found, words, begin, end, window, similarity).tolist():
        own = seeds.words[item]
        lo, hi = max(0, begin[text] - start), min(len(own), end[text] - start)
        same = np.zeros(len(own), np.int64)
        same[lo:hi] = own[lo:hi] == words[start + lo:start + hi]
        size = min(window, len(own))
        run = np.concatenate(([0], np.cumsum(same)))
        in_window = run[size:] - run[:-size]
        if in_window.max() >= similarity * size - 1e-9:
            at = np.flatnonzero(same)
            entry = (int(same.sum()), int(start + at[0] - begin[text]), int(start + at[-1] - begin[text]))
            best[text, item] = max(best.get((text, item), entry), entry, key=lambda e: (e[0], -e[1]))
    return [(text, item, m, len(seeds.words[item]), a, b) for (text, item), (m, a, b) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text",
                     block_chars: int = BLOCK_CHARS) -> Iterator[Seeds]:
    """Seed tables of the benchmark, each over about ``block_chars`` characters."""
    items = benchmark.select(F.col(id_column).cast("long").alias("item_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.toArrow()
        ids = rows.column("item_id").to_pylist()
        keep = [i for i, x in enumerate(ids) if x is not None]
        yield build_seeds([ids[i] for i in keep], rows.column("text").combine_chunks().take(pa.array(keep, pa.int64())))


def find_leaks(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and benchmark item whose passage it holds."""
    spark = df.sparkSession
    narrow = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = "doc_id long, item_id long, matched_words long, item_words long, first_word long, last_word long"
    found = None
    for seeds in benchmark_blocks(benchmark, block_chars=block_chars):
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table_ = shared.value
            for batch in batches:
                rows = [(at + t, *rest) for at, to in text_slices(batch) for t, *rest in leaks(table_, batch.column("text").slice(at, to - at))]
                if rows:
                    text, item, *rest = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(text)), pa.array(table_.ids[item]), *map(pa.array, rest)],
                        ["doc_id", "item_id", "matched_words", "item_words", "first_word", "last_word"])

        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(df: DataFrame, benchmark: DataFrame, text_column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` without the documents that hold a benchmark passage; all columns stay."""
    for seeds in benchmark_blocks(benchmark, block_chars=block_chars):
        shared = df.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_column))
                clean = np.ones(batch.num_rows, bool)
                for at, to in text_slices(batch, text_column):
                    clean[[at + x[0] for x in leaks(shared.value, texts.slice(at, to - at))]] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(run, df.schema)
    return df


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
