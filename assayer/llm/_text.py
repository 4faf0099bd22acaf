"""Vectorised text kernels over Arrow string columns (NumPy, no per-word Python objects).

A *block* is a run of whole texts as one byte array with offsets. Words, lines and windows
become index arrays into it; equal byte strings get equal 64-bit hashes whatever their position,
because the hash of bytes ``[s, e)`` is a difference of prefix sums scaled back to position 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = U64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one text that is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_P, _P_INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Block:
    """Whole texts as bytes ``data`` with ``offsets``; ``lower`` folds A-Z first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (LOWER[data] if lower else data), offsets
        self.docs = len(offsets) - 1
        self._sums: np.ndarray | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        power, inverse = _tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum((self.data.astype(U64) + U64(1)) * power[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts])

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (exclusive) and text index of the maximal runs of bytes that are no ``space``."""
        n = len(self.data)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        inside = ~space[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, self.doc_of(starts)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of the lines between line feeds (without an empty last one)."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.union1d(feeds + 1, self.offsets[:-1])
        starts = starts[starts < len(self.data)]
        doc = self.doc_of(starts)
        ends = np.append(feeds, len(self.data))[np.searchsorted(feeds, starts)]
        return starts, np.minimum(ends, self.offsets[doc + 1]), doc

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a per-byte array by text."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def windows(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and hash of every run of ``width`` words inside one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    acc = hashes[:n].copy()
    for k in range(1, width):
        acc = acc * _Q + hashes[k : n + k]
    ok = np.flatnonzero(docs[:n] == docs[width - 1 :])
    return ok, mix(acc[ok] + U64(width))


def shingle_sets(block: Block, width: int, space: np.ndarray = SPACE) -> list[np.ndarray]:
    """Each text's sorted distinct ``width``-word shingle hashes; a shorter text is one shingle, an empty one none."""
    starts, ends, doc = block.words(space)
    h = block.hashes(starts, ends)
    at, shingles = windows(h, doc, width)
    bounds = np.searchsorted(doc[at], np.arange(block.docs + 1))
    word_bounds = np.searchsorted(doc, np.arange(block.docs + 1))
    out = []
    for d in range(block.docs):
        a, b = bounds[d], bounds[d + 1]
        if b > a:
            s = np.sort(shingles[a:b])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif word_bounds[d + 1] > word_bounds[d]:
            own = h[word_bounds[d] : word_bounds[d + 1]]
            acc = own[:1].copy()
            for k in range(1, len(own)):
                acc = acc * _Q + own[k : k + 1]
            out.append(mix(acc + U64(len(own))))
        else:
            out.append(np.zeros(0, U64))
    return out
