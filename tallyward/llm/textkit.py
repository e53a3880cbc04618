"""Vectorised word kernels shared by the corpus operators.

Texts reach Python as Arrow batches.  Everything here works on the UTF-8 bytes of many texts at once, in slices of
bounded size, so that no per-word Python object is made.  A word is a maximal run of bytes other than 0x20 and
0x09-0x0D after A-Z have been lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: UTF-8 bytes handled at once by the numpy kernels (one longer text is handled alone).
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (in place when possible)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Word hashes of consecutive texts; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, with nulls as empty texts and offsets from 0."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if column.null_count:
        import pyarrow.compute as pc

        filled = pc.fill_null(column, "")
        return utf8_buffers(filled) if filled.null_count == 0 else (data, offsets)
    return data, offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column holding about ``most`` bytes: (first, last, bytes, offsets from 0)."""
    if not len(column):
        return
    data, offsets = utf8_buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Hashes of the words of consecutive texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none, data)
    inside = ~_SEPARATOR[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LOWER_VALUES[data] * power, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values (a sort of a few hundred values is faster than np.unique)."""
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[:1] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(w: Words, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    h, factor = w.hashes, np.uint64(0xD6E8FEB86659FD93)
    m = max(0, len(h) - width + 1)
    acc = np.zeros(m, np.uint64)
    for k in range(width):
        acc = acc * factor + h[k : k + m]
    acc = mix64(acc + np.uint64(width))
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(distinct(acc[a : b - width + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for x in h[a:b]:
                one = one * factor + x
            out.append(mix64(one + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as the longs that Spark has."""
    return x.view(np.int64)


def ending(run: Callable) -> Callable:
    """A function on batches that gives back what memory a task has freed when it ends: workers are used again, and what
    the allocators keep of one task would add to what the next one of another kind needs."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole
