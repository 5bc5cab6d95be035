"""Counter-based uniforms and normal draws.

``u = (int(hex[16k:16k+13]) + 0.5) / 2^52`` where ``hex = md5(seed:stream:keys)``.
One md5 yields two independent uniforms in (0, 1) of 52 bits each.  The value
depends only on (seed, stream, keys), never on partitioning, task order or
retries, and the same formula runs in DuckDB, so synthetic data can be checked
against SQL.  Each key is written with its length before it, and a null as ``~``,
so no two different key tuples give the same text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0
#: Uniforms that one digest holds.
WORDS = 2


def hex_hash(seed: int, stream: str, keys: Sequence[str], dialect: str = "spark") -> str:
    """SQL text of the md5 hex digest of seed, stream and keys."""
    return "md5(concat_ws(':', " + ", ".join([f"'{int(seed)}'", f"'{stream}'", *_key_parts(keys, dialect)]) + "))"


def key_text(keys: Sequence[str]) -> Column:
    """What ``hex_hash`` hashes behind the seed and the stream."""
    return F.expr("concat_ws(':', " + ", ".join(_key_parts(keys, "spark")) + ")")


def _key_parts(keys: Sequence[str], dialect: str) -> list[str]:
    kind = "STRING" if dialect == "spark" else "VARCHAR"
    parts = []
    for k in keys:
        text = f"CAST({k} AS {kind})"
        parts.append(f"coalesce(concat(CAST(length({text}) AS {kind}), '=', {text}), '~')" if dialect == "spark" else
                     f"CASE WHEN {k} IS NULL THEN '~' ELSE concat(CAST(length({text}) AS {kind}), '=', {text}) END")
    return parts


def uniform_from_hex(hex_col: str, k: int, dialect: str = "spark") -> str:
    """k-th (0 or 1) uniform in (0,1) taken from a 32-hex-digit digest column."""
    if not 0 <= k < WORDS:
        raise ValueError("an md5 digest holds two 52-bit words")
    piece = f"substr({hex_col}, {16 * k + 1}, 13)"
    if dialect == "spark":
        word = f"CAST(conv({piece}, 16, 10) AS DOUBLE)"
    else:
        word = f"CAST(CAST('0x' || {piece} AS BIGINT) AS DOUBLE)"
    return f"(({word} + 0.5) / {TWO_52})"


def uniform_sql(seed: int, stream: str, keys: Sequence[str], k: int = 0,
                dialect: str = "spark") -> str:
    """One-shot uniform (inlines the digest)."""
    return uniform_from_hex(hex_hash(seed, stream, keys, dialect), k, dialect)


def hash_u(seed: int, stream: str, *keys: str) -> Column:
    """Column uniform in (0,1) for (seed, stream, key columns)."""
    return F.expr(uniform_sql(seed, stream, keys, 0))


def with_uniforms(df: DataFrame, seed: int, stream: str, keys: Sequence[str],
                  names: Sequence[str]) -> DataFrame:
    """Add one uniform column per name; two names share one md5 digest."""
    out = df
    for block in range(0, len(names), WORDS):
        hx = f"__hx_{stream}_{block}"
        out = out.withColumn(hx, F.expr(hex_hash(seed, f"{stream}:{block // WORDS}", keys)))
        out = out.withColumns({
            name: F.expr(uniform_from_hex(hx, i))
            for i, name in enumerate(names[block:block + WORDS])
        })
        out = out.drop(hx)
    return out


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1)) * 2 ** 32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_words(words: Sequence, n: int, start: Sequence = _START) -> list[np.ndarray]:
    """The four words of the md5 digests of ``n`` messages after a block: 16 words each, numbers or uint32 arrays.

    ``start`` holds the words after the block before."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in start)
    f = np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        # f takes the round's function, and a, which no later round needs, the new word
        if turn == 3:
            np.invert(d, out=f)
            f |= b
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            x, y, z = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            f &= x
            f ^= z
        f += a
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
        if isinstance(word, int):
            f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[i])
        s = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(s), out=a)
        f >>= np.uint32(32 - s)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return [v + np.asarray(o, np.uint32) for v, o in zip((a, b, c, d), start, strict=True)]


def _put_uniforms(out: np.ndarray, own, block: int, digest: Sequence[np.ndarray]) -> None:
    """The uniforms of a digest's words in their rows of ``out``."""
    a, b, c, d = (v.byteswap().astype(np.uint64) for v in digest)
    for i, (high, low) in enumerate(((a, b), (c, d))):
        if WORDS * block + i < len(out):
            out[WORDS * block + i, own] = ((high << np.uint64(20) | low >> np.uint64(12)) + 0.5) / TWO_52


def text_uniforms(seed: int, stream: str, texts: pa.Array, count: int, numbered: bool = True) -> np.ndarray:
    """``with_uniforms`` on arrays, over keys given as ``key_text``: ``count`` rows of uniforms.

    Without ``numbered`` the digest is that of ``hash_u``, which holds two.  Messages of as many md5 blocks go together, whatever their lengths."""
    texts = texts.cast(pa.binary())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first, sizes = ends[:-1], np.diff(ends)
    out = np.empty((count, len(texts)))
    head, width = b"", np.zeros(len(texts), np.int64)
    messages: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for block in range(-(-count // WORDS)):
        before, head = len(head), f"{int(seed)}:{stream}:{f'{block}:' if numbered else ''}".encode()
        if len(head) != before:
            # as ``hex_hash`` has it: the text, a set bit, zeros, its length in bits
            total = len(head) + sizes.astype(np.int64)
            width, messages = (total + 72) // 64, {}
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                text = np.zeros((len(own), 64 * w), np.uint8)
                for size in np.unique(sizes[own]).tolist():
                    at = np.flatnonzero(sizes[own] == size)
                    end = len(head) + size
                    text[at, len(head):end] = data[first[own[at]][:, None] + np.arange(size)]
                    text[at, end] = 0x80
                    text[at, 64 * w - 8:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
                messages[w] = own, text
        for w, (own, text) in messages.items():
            text[:, :len(head)] = np.frombuffer(head, np.uint8)
            words = np.ascontiguousarray(text.view("<u4").T)
            digest: Sequence = _START
            for i in range(w):
                digest = _md5_words(words[16 * i:16 * (i + 1)], len(own), digest)
            _put_uniforms(out, own, block, digest)
    return out


def normal_pairs(u: np.ndarray) -> np.ndarray:
    """``with_normals`` from an even number of rows of uniforms."""
    radius, turn = np.sqrt(-2.0 * np.log(u[0::2])), 2 * np.pi * u[1::2]
    e = np.empty_like(u)
    e[0::2], e[1::2] = radius * np.cos(turn), radius * np.sin(turn)
    return e


def id_uniforms(seed: int, stream: str, ids: np.ndarray, count: int) -> np.ndarray:
    """``with_uniforms`` over one key of non-negative whole numbers, on arrays: ``count`` rows of uniforms."""
    out = np.empty((count, len(ids)))
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), ids, side="right") + 1
    for k in np.unique(digits).tolist():
        own = slice(None) if (digits == k).all() else np.flatnonzero(digits == k)
        n, text = ids[own], []
        for _ in range(k):
            n, digit = np.divmod(n, 10)
            text.insert(0, digit.astype(np.uint32) + np.uint32(ord("0")))
        for block in range(-(-count // WORDS)):
            # as ``hex_hash`` has it: the text, a set bit, zeros, its length in bits
            message = [*f"{int(seed)}:{stream}:{block}:{k}=".encode(), *text, 0x80]
            if len(message) > 56:
                raise ValueError(f"stream name {stream!r} is too long for one block")
            size = 8 * (len(message) - 1)
            message += [0] * (56 - len(message)) + [size & 255, size >> 8, 0, 0, 0, 0, 0, 0]
            words = [sum(v << 8 * j for j, v in enumerate(message[i:i + 4])) for i in range(0, 64, 4)]
            _put_uniforms(out, own, block, _md5_words(words, len(n)))
    return out


def box_muller_sql(u1: str, u2: str, which: int) -> str:
    """Standard normal from two uniforms; ``which`` 0 -> cos, 1 -> sin."""
    trig = "cos" if which == 0 else "sin"
    return f"(sqrt(-2.0 * ln({u1})) * {trig}(6.283185307179586 * {u2}))"


def with_normals(df: DataFrame, seed: int, stream: str, keys: Sequence[str],
                 names: Sequence[str]) -> DataFrame:
    """Add independent N(0,1) columns (Box-Muller over hash uniforms)."""
    d = len(names)
    pairs = (d + 1) // 2
    unames = [f"__u_{stream}_{i}" for i in range(2 * pairs)]
    out = with_uniforms(df, seed, stream, keys, unames)
    cols = {}
    for i, name in enumerate(names):
        p = i // 2
        cols[name] = F.expr(box_muller_sql(unames[2 * p], unames[2 * p + 1], i % 2))
    return out.withColumns(cols).drop(*unames)


def normals_sql(seed: int, stream: str, keys: Sequence[str], d: int,
                dialect: str = "duckdb") -> tuple[list[str], list[str]]:
    """SQL select items for the same draws as ``with_normals``.

    Returns (digest/uniform items for an inner SELECT, normal items for an
    outer SELECT); the uniforms are named ``__u_<stream>_<i>``.
    """
    pairs = (d + 1) // 2
    inner = []
    for block in range(0, 2 * pairs, WORDS):
        hx = hex_hash(seed, f"{stream}:{block // WORDS}", keys, dialect)
        for i in range(block, min(block + WORDS, 2 * pairs)):
            inner.append(f"{uniform_from_hex(hx, i - block, dialect)} AS __u_{stream}_{i}")
    outer = []
    for i in range(d):
        p = i // 2
        outer.append(box_muller_sql(f"__u_{stream}_{2 * p}", f"__u_{stream}_{2 * p + 1}", i % 2))
    return inner, outer
