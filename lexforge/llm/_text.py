"""Numpy helpers that treat a batch of texts as one UTF-8 byte array.

A text column's Arrow buffers are viewed without copying; words, lines and n-grams
are then found with array operations over the whole slice, so no Python code runs
per word. Slices hold at most `SLICE_BYTES` (or one text), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and every ASCII character that is neither a letter nor a digit.
LOOSE = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept per process for the longest n so far."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 2)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def forget() -> None:
    """Drop the tables kept for later calls."""
    _powers.clear()


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with offsets[0] == 0; null texts are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


@dataclass
class Words:
    """Words of a slice: byte ranges, owning text, first word of each text, and hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: the hash of data[a:b] is (p[b] - p[a]) / BASE ** a."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_HASH[data] * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, equal for equal bytes wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start]
    return mix(h + (end - start).astype(U64))


def bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators; a run never crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    start[edge] |= inside[edge]
    end[edge - 1] |= inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, prefix: np.ndarray | None = None) -> Words:
    start, end = bounds(data, offsets, separators)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    prefix = prefix_hash(data) if prefix is None else prefix
    return Words(start, end, doc, first, span_hash(prefix, start, end))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every n-word window that stays in one text."""
    size = len(w.hash) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = w.hash[:size].copy()
    for j in range(1, n):
        h *= U64(0x9E3779B97F4A7C15)
        h += w.hash[j : size + j]
    ok = np.flatnonzero(w.doc[:size] == w.doc[n - 1 :])
    return ok, mix(h[ok])


def keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Text number above 52 bits of hash: sorts by text, and groups equal hashes in it."""
    return (doc.astype(U64) << U64(52)) | (h >> U64(12))
