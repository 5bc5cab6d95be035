"""SentencePiece BPE encoding and decoding by a max-plus parallel scan.

*Path form.*  A sequence of pieces is the model's encoding of a text exactly when
every two neighbours are what the model gives for the two joined (a merge that
could cross their border would have happened otherwise).  So encoding is a
best-path problem: a step from one piece to the next weighs 0 if the two are
compatible and minus infinity if not, and exactly one path is finite.  No piece
holds a word beginning inside, so words are independent of each other.

*Scan.*  A text of more than ``CHUNK`` characters is cut every ``CHUNK`` characters,
wherever that falls.  The state at a cut is the piece that ends at or runs over it
and how far it runs over.  Each chunk gives a transfer matrix in the max-plus
semiring: from each state at its left cut, the weight of reaching each state at
its right cut.  Matrices of a text are combined by the (associative) max-plus
product into prefix and suffix weights; the state at a cut is the one with finite
prefix plus suffix.  Then every chunk is backtraced by itself between its two
states.  Chunks are rows, so one giant text occupies many tasks; only the small
matrices of a text and its result meet.

Inside a chunk, words up to ``SHORT`` characters are merged in bulk, in score order,
and remembered; longer ones take the path form.

Defined results: a null or empty text has no ids.  Characters that the model lacks
become byte pieces.  Decoding returns the text exactly, save that U+2581, with
which the model writes blanks, decodes to a blank.  Repeated rows are encoded
one by one; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import sized_broadcast
from ..session import materialize, shuffle_partitions
from .common import table, text_slices
from .registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
SHORT = 64
BLANK = "▁"
#: Remembered words of a worker; the memory is emptied when full.
CACHE = 300_000
_EMPTY = (None, 0)  # the state at a cut between two words

State = tuple[str | None, int]


class Pieces:
    """Vocabulary of a BPE model with byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], first: int):
        self.names = [p for p, _ in pieces]
        self.scores = [s for _, s in pieces]
        self.byte_ids = byte_ids
        self.first = first  # ids below are control and byte pieces

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if plain != list(range(plain[0], n)):
            raise ValueError("plain pieces must follow all others")
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)], [byte_ids[b] for b in range(256)], plain[0])

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.names) if i >= self.first}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def words(self) -> re.Pattern:
        """Parts of a text in blank form between which no merge can happen."""
        known = set("".join(self.ids))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece goes over the beginning of a word")
        apart = re.escape("".join(c for c in map(chr, range(32)) if c not in known))
        return re.compile(f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+|[{apart}]")

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, int, np.uint64]:
        """Open-addressed table: (left id, right id) -> id of the merged piece."""
        ids = self.ids
        key, to = zip(*[((ids[p[:k]] << 20) | ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids], strict=True)
        bits = max(16, (4 * len(key)).bit_length())
        factor = np.uint64(0x9E3779B97F4A7C15)
        keys, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for k, m in zip(key, to, strict=True):
            at = ((k * int(factor)) & ((1 << 64) - 1)) >> (64 - bits)
            while keys[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            keys[at], merged[at] = k, m
        return keys, merged, bits, factor

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs merge to, -1 where they don't."""
        keys, merged, bits, factor = self._pairs
        key = (left << 20) | right
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * factor) >> np.uint64(64 - bits)).astype(np.int64)
        out = np.where(keys[at] == key, merged[at], -1)
        go = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        while len(go):
            at[go] = (at[go] + 1) & ((1 << bits) - 1)
            hit = keys[at[go]] == key[go]
            out[go[hit]] = merged[at[go[hit]]]
            go = go[~hit & (keys[at[go]] >= 0)]
        out[(left < 0) | (right < 0)] = -1
        return out

    @cached_property
    def _score(self) -> np.ndarray:
        return np.array([*self.scores, -np.inf])  # at -1: no merge

    @cached_property
    def _sign(self) -> np.ndarray:
        """Symbol of each code point: its piece's id, or -2 - code point if the model lacks it."""
        out = -2 - np.arange(0x110000, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                out[ord(p)] = i
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, one after the other, and how many each word has.

        Best-scoring merges first, leftmost among equals.  All words of one length
        take their next merge at once; each merge shortens a word by one."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sign = self._sign[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(lens) - lens
        left: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_length = np.argsort(lens, kind="stable")
        for rows in np.split(by_length, np.flatnonzero(np.diff(lens[by_length])) + 1) if len(words) else ():
            n = int(lens[rows[0]])
            left[n] = [(rows, sign[starts[rows][:, None] + np.arange(n)])]
        done_rows, done_syms = [], []
        for n in range(max(left, default=0), 0, -1):
            if n not in left:
                continue
            blocks = left.pop(n)
            rows, sym = (np.concatenate([x[i] for x in blocks]) for i in (0, 1))
            done = np.ones(len(rows), bool)
            if n > 1:
                to = self.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(rows), n - 1)
                best = np.argmax(self._score[to], axis=1)
                done = to[np.arange(len(rows)), best] < 0
                go = np.flatnonzero(~done)
                if len(go):
                    at = best[go]
                    sym[go, at] = to[go, at]
                    keep = np.ones((len(go), n), bool)
                    keep[np.arange(len(go)), at + 1] = False
                    left.setdefault(n - 1, []).append((rows[go], sym[go][keep].reshape(len(go), n - 1)))
            done_rows.append((rows[done], n))
            done_syms.append(sym[done].ravel())
        count = np.zeros(len(words), np.int64)
        for rows, n in done_rows:
            count[rows] = n
        out = np.empty(int(count.sum()), np.int64)
        begin = np.cumsum(count) - count
        for (rows, n), sym in zip(done_rows, done_syms, strict=True):
            out[(begin[rows][:, None] + np.arange(n)).ravel()] = sym
        return out, count

    def merge_words(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word, as text."""
        sym, count = self.merge(words)
        text = [self.names[x] if x >= 0 else chr(-2 - x) for x in sym.tolist()]
        ends = np.cumsum(count).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ids_of_symbols(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids and their number by word: symbols that the model lacks become byte pieces."""
        lacking = np.flatnonzero(sym < 0)
        if not len(lacking):
            return sym.astype(np.int32), count
        coded = [[self.byte_ids[b] for b in chr(-2 - x).encode("utf-8", "surrogatepass")] for x in sym[lacking].tolist()]
        times = np.ones(len(sym), np.int64)
        times[lacking] = [len(c) for c in coded]
        out = np.repeat(sym, times)
        out[np.repeat(sym < 0, times)] = list(chain.from_iterable(coded))
        word = np.repeat(np.arange(len(count)), count)
        return out.astype(np.int32), np.bincount(word, times, len(count)).astype(np.int64)

    def compatible(self, left: str, right: str) -> bool:
        """Whether the model keeps the two pieces when they stand next to each other."""
        memory = self.__dict__.setdefault("_memory", {})
        key = (left, right)
        if key not in memory:
            if len(memory) > 1_000_000:
                memory.clear()
            memory[key] = self.merge_words([left + right])[0] == [left, right]
        return memory[key]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def reach(self, text: str, begin: int, end: int, start: State) -> dict[tuple[int, str | None], tuple[int, str | None]]:
        """Finite paths over text[begin:end] inside one word, from ``start`` at ``begin``.

        Maps (position, last piece) to what came before; positions beyond ``end``
        are pieces that run over it."""
        last, over = start
        first = (begin + over, last)
        back: dict = {first: None}
        todo: dict[int, list[str | None]] = {begin + over: [last]}
        for pos in range(begin + over, end):
            for prev in todo.pop(pos, ()):
                for n in range(1, min(self.longest, len(text) - pos) + 1):
                    piece = text[pos:pos + n]
                    if (piece in self.ids or n == 1) and (prev is None or self.compatible(prev, piece)):
                        to = (pos + n, piece)
                        if to not in back:
                            back[to] = (pos, prev)
                            todo.setdefault(pos + n, []).append(piece)
        return back

    @staticmethod
    def trace(back: dict, at: tuple[int, str | None]) -> list[str]:
        out = []
        while back[at] is not None:
            out.append(at[1])
            at = back[at]
        return out[::-1]

    def long_word(self, word: str) -> list[str]:
        back = self.reach(word, 0, len(word), _EMPTY)
        ends = [k for k in back if k[0] == len(word)]
        if len(ends) != 1:
            raise ValueError("a word must have exactly one finite path")
        return self.trace(back, ends[0])


class Encoder:
    """Encodes words with a memory of those it has seen: word -> place in flat arrays of ids."""

    def __init__(self, model: Pieces):
        self.model = model
        self.place: dict[str, int] = {}
        self.flat, self.begin, self.count, self.used = (np.empty(0, t) for t in (np.int32, np.int64, np.int64, np.int64))

    def _forget(self) -> None:
        """Keep the words that were used at least twice lately, if these are few enough."""
        kept = np.flatnonzero(self.used >= 2)
        if len(kept) > CACHE // 2:
            kept = kept[:0]
        new = {int(i): k for k, i in enumerate(kept.tolist())}
        self.place = {w: new[i] for w, i in self.place.items() if i in new}
        self.flat = gather(self.flat, self.begin[kept], self.count[kept])
        self.count, self.used = self.count[kept], self.used[kept] // 2
        self.begin = np.cumsum(self.count) - self.count

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if len(w) <= SHORT]
        flat, count = self.model.ids_of_symbols(*self.model.merge(new))
        for w in words.difference(new):
            ids = self.model.to_ids(self.model.long_word(w))
            new.append(w)
            flat, count = np.concatenate((flat, np.array(ids, np.int32))), np.append(count, len(ids))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.flat, self.count = np.concatenate((self.flat, flat)), np.concatenate((self.count, count))
        self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))

    def encode_words(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are given as lists of words: all ids, and their number by text."""
        new = set().union(*parts).difference(self.place)
        if new and len(new) + len(self.place) > CACHE:
            self._forget()
            new = set().union(*parts).difference(self.place)
        if new:
            self._learn(new)
        words = [len(p) for p in parts]
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, sum(words))
        self.used += np.bincount(at, minlength=len(self.used))
        count = self.count[at]
        per_text = np.bincount(np.repeat(np.arange(len(parts)), words), count, len(parts)).astype(np.int64)
        return gather(self.flat, self.begin[at], count), per_text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        find = self.model.words.findall
        return self.encode_words([find(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts])

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text."""
        flat, count = self.encode(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] if texts else []


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[begin : begin + count], one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - count), count) + np.arange(total)]


def states(model: Pieces, text: str, cut: int) -> list[State]:
    """The states that a path can have at ``cut`` inside ``text``."""
    if cut == 0 or cut == len(text) or _between_words(model, text, cut):
        return [_EMPTY]
    found = []
    for n in range(1, model.longest + 1):
        for over in range(n):
            a = cut + over - n
            if a >= 0 and cut + over <= len(text) and (n == 1 or text[a:cut + over] in model.ids):
                found.append((text[a:cut + over], over))
    return found


def _between_words(model: Pieces, text: str, cut: int) -> bool:
    return model.words.fullmatch(text[cut - 1:cut + 1]) is None


class Chunk:
    """text[begin:end] is the chunk, the rest is what its border pieces can reach."""

    def __init__(self, encoder: Encoder, text: str, begin: int, end: int):
        self.encoder, self.model = encoder, encoder.model
        self.text, self.begin, self.end = text, begin, end
        self.left, self.right = states(self.model, text, begin), states(self.model, text, end)
        cuts = [m.start() for m in self.model.words.finditer(text) if begin <= m.start() <= end]
        if end == len(text):
            cuts.append(end)
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (None, None)

    def _to(self, start: State, end: int, goal: State | None) -> list[str] | None:
        """Pieces after ``start`` up to ``goal`` at ``end`` (None: any that ends there)."""
        back = self.model.reach(self.text, self.begin, end, start)
        if goal is None or goal == _EMPTY:
            ends = [k for k in back if k[0] == end]
        else:
            ends = [k for k in back if k == (end + goal[1], goal[0])]
        return self.model.trace(back, ends[0]) if ends else None

    def matrix(self) -> np.ndarray:
        """Max-plus transfer matrix: left states by right states."""
        low = -np.inf
        if self.first is None:  # inside one word
            return np.array([[0.0 if self._to(s, self.end, g) is not None else low for g in self.right] for s in self.left])
        head = np.array([0.0 if s == _EMPTY or self._to(s, self.first, None) is not None else low for s in self.left])
        tail = np.array([0.0 if g == _EMPTY or self._tail(g) is not None else low for g in self.right])
        return head[:, None] + tail[None, :]

    def _tail(self, goal: State) -> list[str] | None:
        back = self.model.reach(self.text, self.last, self.end, _EMPTY)
        at = (self.end + goal[1], goal[0])
        return self.model.trace(back, at) if at in back else None

    def ids(self, start: State, goal: State) -> np.ndarray:
        """Ids of the pieces that begin in the chunk, between two known states."""
        to_ids = lambda pieces: np.array(self.model.to_ids(pieces), np.int32)
        if self.first is None:
            return to_ids(self._to(start, self.end, goal))
        none = np.zeros(0, np.int32)
        head = none if start == _EMPTY else to_ids(self._to(start, self.first, None))
        tail = none if goal == _EMPTY else to_ids(self._tail(goal))
        middle, _ = self.encoder.encode_words([self.model.words.findall(self.text[self.first:self.last])])
        return np.concatenate((head, middle.astype(np.int32), tail))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def cut_states(matrices: list[np.ndarray]) -> list[int]:
    """Index of the state at each cut (both ends included), from prefix and suffix products."""
    prefix, suffix = [np.zeros((1, 1))], [np.zeros((1, 1))]
    for m in matrices:
        prefix.append(max_plus(prefix[-1], m))
    for m in reversed(matrices):
        suffix.append(max_plus(m, suffix[-1]))
    return [int(np.argmax(p[0] + s[:, 0])) for p, s in zip(prefix, suffix[::-1], strict=True)]


def _chunks(giant: DataFrame, chunk: int, margin: int) -> DataFrame:
    """Rows (row, no, n, at, size, piece) of the texts in blank form."""
    blank = F.concat(F.lit(BLANK), F.translate("text", " ", BLANK))
    marked = giant.select("row", blank.alias("s")).withColumn("n", F.ceil(F.length("s") / chunk).cast("int"))
    cut = marked.select("row", "n", "s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no"))
    begin = F.greatest(F.col("no") * chunk - margin, F.lit(0))
    return cut.select("row", "n", "no", (F.col("no") * chunk - begin).alias("at"),
                      F.least(F.lit(chunk), F.length("s") - F.col("no") * chunk).alias("size"),
                      F.substring("s", begin + 1, F.col("no") * chunk - begin + chunk + margin).alias("s"))


def _giant_ids(giant: DataFrame, shared, chunk: int, margin: int) -> DataFrame:
    """(row, ids) of giant texts."""
    # a giant's chunks lie together: they are dealt anew, so that no task has a giant's share of the work
    dealt = _chunks(giant, chunk, margin).repartition(shuffle_partitions(giant.sparkSession), "row", "no")
    parts = materialize(dealt, "piece-chunks")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch bounds rows, not bytes: about 1 MB of chunks at a time."""
        for b in batches:
            for at, to in text_slices(b, "s"):
                yield b.slice(at, to - at)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in slices(batches):
            found = [Chunk(encoder, r["s"], r["at"], r["at"] + r["size"]).matrix() for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), pa.array([m.shape[1] for m in found], pa.int32()),
                                              pa.array([m.tobytes() for m in found], pa.binary())], ["row", "no", "width", "matrix"])

    def combined(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("no")
        found = cut_states([np.frombuffer(m).reshape(-1, w) for m, w in zip(pdf["matrix"], pdf["width"], strict=True)])
        return pd.DataFrame({"row": pdf["row"], "no": pdf["no"], "left": found[:-1], "right": found[1:]})

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in slices(batches):
            out = []
            for r in b.to_pylist():
                c = Chunk(encoder, r["s"], r["at"], r["at"] + r["size"])
                out.append(c.ids(c.left[r["left"]], c.right[r["right"]]))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("no"), ids], ["row", "no", "ids"])

    steps = parts.mapInArrow(matrices, "row long, no int, width int, matrix binary")
    at_cuts = materialize(steps.groupBy("row").applyInPandas(combined, "row long, no int, left int, right int"), "piece-states")
    known = parts.join(sized_broadcast(at_cuts), ["row", "no"])
    traced = known.mapInArrow(backtrace, "row long, no int, ids array<int>")
    return traced.groupBy("row").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(df: DataFrame, carry: dict[str, Column], text_column: str = "text", model: str | Pieces = MODEL,
           chunk: int = CHUNK, checksum: str | None = None) -> DataFrame:
    """The carried columns with ``ids``, the piece ids of each text.

    ``checksum`` names a column for the crc32 of what the ids decode to: decoding in
    the same pass spares moving the ids to a second set of workers."""
    pieces = Pieces.load(model) if isinstance(model, str) else model
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    decoder = df.sparkSession.sparkContext.broadcast(PieceBytes(pieces)) if checksum else None
    rows = df.select(*[c.alias(n) for n, c in carry.items()], F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    small = rows.where(F.length("text") < chunk)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for at, to in text_slices(b):
                part = b.slice(at, to - at)
                flat, count = encoder.encode(part.column("text").to_pylist())
                ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                more = [pa.array(decoder.value.checksums(flat, count))] if checksum else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *more],
                                                 [*part.schema.names[:-1], "ids", *([checksum] if checksum else [])])

    direct = small.mapInArrow(run, f"{kinds}, ids array<int>" + (f", `{checksum}` long" if checksum else ""))
    giant = materialize(rows.where(F.length("text") >= chunk).withColumn("row", F.monotonically_increasing_id()), "piece-giants")
    scanned = giant.drop("text").join(_giant_ids(giant, shared, chunk, pieces.longest), "row").drop("row")
    if checksum:
        scanned = decode(scanned, list(carry), model=pieces).withColumn(checksum, F.crc32("text")).drop("text")
    return direct.unionByName(scanned)


class PieceBytes:
    """UTF-8 bytes of every piece."""

    def __init__(self, pieces: Pieces):
        byte_of = {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        raw = [byte_of.get(i, p.replace(BLANK, " ").encode() if i >= pieces.first else b"") for i, p in enumerate(pieces.names)]
        self.count = np.array([len(r) for r in raw], np.int64)
        self.begin = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def raw(self, ids: np.ndarray, per_list: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and where each ends, without the blank that encoding puts first."""
        data = gather(self.flat, self.begin[ids], self.count[ids])
        size = np.bincount(np.repeat(np.arange(len(per_list)), per_list), self.count[ids], len(per_list)).astype(np.int64)
        begin = np.cumsum(size) - size
        blank = np.flatnonzero(size)
        blank = blank[data[begin[blank]] == 32]
        data = np.delete(data, begin[blank])
        size[blank] -= 1
        return data, np.cumsum(size)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Text of each list of ids."""
        data, ends = self.raw(lists.flatten().to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        out = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(data)])
        try:
            return out.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that make no valid text
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())

    def checksums(self, ids: np.ndarray, per_list: np.ndarray) -> np.ndarray:
        """crc32 of each decoded text."""
        data, ends = self.raw(ids, per_list)
        view, begin = memoryview(np.ascontiguousarray(data)), np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return np.array([zlib.crc32(view[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], np.int64)


def decode(df: DataFrame, carry: list[str], ids_column: str = "ids", model: str | Pieces = MODEL) -> DataFrame:
    """The carried columns and the ids with ``text``, decoded from them (a null list gives an empty text)."""
    pieces = Pieces.load(model) if isinstance(model, str) else model
    shared = df.sparkSession.sparkContext.broadcast(PieceBytes(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, shared.value.decode(part.column(part.num_columns - 1))], [*part.schema.names, "text"])

    rows = df.select(*[c for c in carry if c != ids_column], ids_column)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, text string")


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = Pieces.load()
    text = F.coalesce(F.col("text"), F.lit(""))
    coded = encode(docs, {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text)}, model=pieces, checksum="decoded_crc32")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.col("ids").alias("pieces"), "text_crc32", "decoded_crc32")
