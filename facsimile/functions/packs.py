"""Sorted values in few bytes: what a shuffle of values holds.

A run is some distinct doubles in order with a count each.  It is a row of four columns: how
many values, the first one, the steps from each to the next in as many bytes as the longest one of the
run takes, and the counts less one likewise (nothing where all are one).  Steps are differences of
the doubles' bit patterns, which rise with the values, so they are exact.  No negative zeros and no NaN."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Values of a run.
RUN_VALUES = 256
#: Rows whose values are sorted at once.
SORT_ROWS = 400_000
#: Type of the columns of a run.
RUN_SCHEMA = "size int, first long, steps binary, counts binary"
RUN_COLUMNS = ["size", "first", "steps", "counts"]

_LOW = np.int64(0x7FFFFFFFFFFFFFFF)
_LIMITS = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)


def _bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    b = x.view(np.int64)
    return b ^ ((b >> 63) & _LOW)


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes of whole numbers, none for 0."""
    return np.where(most == 0, 0, np.searchsorted(_LIMITS, most, side="right") + 1)


def _cut(v: np.ndarray, sizes: np.ndarray, width: int) -> pa.Array:
    """Binary values: the lowest ``width`` bytes of ``v``, run after run."""
    data = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width])
    ends = np.concatenate(([0], np.cumsum(sizes * width))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def distinct(code: np.ndarray | None, x: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """The distinct (code, x) in order and how often each occurs (with ``c``: the sum of its counts)."""
    if code is None:
        order = None if c is None else np.argsort(x, kind="stable")
        x = np.sort(x) if order is None else x[order]
        new = np.concatenate(([True], x[1:] != x[:-1]))[:len(x)]
    else:
        order = np.lexsort((x, code))
        code, x = code[order], x[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (code[1:] != code[:-1])))[:len(x)]
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(x))) if c is None else np.add.reduceat(c[order], start) if len(x) else np.zeros(0, np.int64)
    return None if code is None else code[start], x[start], n.astype(np.int64)


def runs(code: np.ndarray, x: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """The runs of ``distinct`` values: their codes and their four columns, widths of a kind together."""
    if not len(x):
        return
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    sizes = np.diff(np.append(start, len(x)))
    inside = np.arange(len(x)) - np.repeat(start, sizes)
    start = np.flatnonzero(inside % RUN_VALUES == 0)
    sizes = np.diff(np.append(start, len(x)))
    bits = _bits(x)
    step = np.diff(bits, prepend=bits[:1]).view(np.uint64)
    step[start] = 0
    more = (c - 1).astype(np.uint64)
    wide, often = _width(np.maximum.reduceat(step, start)), _width(np.maximum.reduceat(more, start))
    for kind in np.unique(wide * 16 + often).tolist():
        own = np.flatnonzero(wide * 16 + often == kind)
        rows = slice(None) if len(own) == len(start) else np.repeat(wide * 16 + often == kind, sizes)
        n = sizes[own]
        yield code[start[own]], [pa.array(n.astype(np.int32)), pa.array(bits[start[own]]), _cut(step[rows], n, kind // 16), _cut(more[rows], n, kind % 16)]


def _uncut(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ``_cut``, for runs of any widths."""
    out = np.zeros(int(sizes.sum()), np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    width = np.diff(ends) // np.maximum(sizes, 1)
    first = np.cumsum(sizes) - sizes
    for w in np.unique(width).tolist():
        if not w:
            continue
        own = np.flatnonzero(width == w)
        n = sizes[own]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(ends[own], n) + inside * w
        whole = np.zeros((len(at), 8), np.uint8)
        for k in range(w):
            whole[:, k] = data[at + k]
        out[np.repeat(first[own], n) + inside] = whole.view(np.uint64).ravel()
    return out


def values(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, x, c) of the runs in the four columns, one after the other."""
    size, first, steps, counts = columns
    sizes = size.to_numpy().astype(np.int64)
    start = np.cumsum(sizes) - sizes
    step = _uncut(steps, sizes).view(np.int64)
    if len(step):
        step[start] = first.to_numpy()
        bits = np.cumsum(step)
        bits -= np.repeat(bits[start] - step[start], sizes)  # sums of the runs before; whole numbers wrap
    else:
        bits = step
    bits = bits ^ ((bits >> 63) & _LOW)
    return sizes, bits.view(np.float64), _uncut(counts, sizes).astype(np.int64) + 1


def lists(v: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the numbers between each two of ``cuts``."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * v.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))])


def listed(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``lists`` one after the other, and how many each holds."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer((column.buffers()[2] or b"")[ends[0]:ends[-1]], kind), np.diff(ends) // np.dtype(kind).itemsize
