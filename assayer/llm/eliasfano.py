"""Elias-Fano sequences: monotone integers as unary-coded high parts and packed low parts."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the set bit number ``k`` (from 0) of each word."""
    at, k, words = np.zeros(len(words), np.int64), k.astype(np.int64), words.copy()
    for half in (32, 16, 8, 4, 2, 1):
        low = words & ((_ONE << np.uint64(half)) - _ONE)
        inside = np.bitwise_count(low).astype(np.int64)
        right = k >= inside
        k -= np.where(right, inside, 0)
        at += np.where(right, half, 0)
        words = np.where(right, words >> np.uint64(half), low)
    return at


class EliasFano:
    """Holds a non-decreasing sequence of values in [0, universe); arrays may be memory-mapped."""

    def __init__(self, arrays: dict[str, np.ndarray], size: int, low_bits: int):
        self.size, self.low_bits = size, low_bits
        self.high, self.ones, self.zeros, self.low = (arrays[k] for k in ("high", "ones", "zeros", "low"))

    @classmethod
    def build(cls, values: np.ndarray, universe: int, store=None) -> "EliasFano":
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(bits)).astype(np.int64)
        length = n + (int(universe) >> bits) + 2
        flags = np.zeros((length + 63) // 64 * 64, bool)
        flags[high + np.arange(n)] = True
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
        zeros = np.arange(len(words) + 1, dtype=np.int64) * 64 - ones
        width = 1 if bits <= 8 else 2 if bits <= 16 else 4 if bits <= 32 else 8
        low = (values & ((_ONE << np.uint64(bits)) - _ONE)).astype(f"<u{width}")
        arrays = {"high": words, "ones": ones, "zeros": zeros, "low": low}
        if store:
            arrays = {k: store(a) for k, a in arrays.items()}
        return cls(arrays, n, bits)

    def _select(self, directory: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(directory, i, side="right") - 1
        word = np.asarray(self.high[np.minimum(w, len(self.high) - 1)])
        return w * 64 + _select_in_word(~word if flip else word, i - directory[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the indices ``i``."""
        i = np.asarray(i, np.int64)
        high = self._select(self.ones, i, False) - i
        return (high << self.low_bits) | self.low[i].astype(np.int64)

    def _range(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of the elements with each high part; runs of equal ones are looked up once."""
        head = np.append(True, high[1:] != high[:-1])
        part = high[head]
        a = np.zeros(len(part), np.int64)
        some = np.flatnonzero(part > 0)
        a[some] = self._select(self.zeros, part[some] - 1, True) - (part[some] - 1)
        b = self._select(self.zeros, part, True) - part
        if len(part) == len(high):
            return a, b
        run = np.cumsum(head) - 1
        return a[run], b[run]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element equal to each value, or -1: a successor search among the elements of the value's high part."""
        values = np.asarray(values, np.int64)
        out = np.full(len(values), -1, np.int64)
        if not self.size or not len(values):
            return out
        high, low = values >> self.low_bits, values & ((1 << self.low_bits) - 1)
        a, end = self._range(high)
        todo = np.flatnonzero(a < end)
        b = end.copy()
        while len(todo):
            middle = (a[todo] + b[todo]) >> 1
            below = self.low[middle].astype(np.int64) < low[todo]
            a[todo[below]] = middle[below] + 1
            b[todo[~below]] = middle[~below]
            todo = todo[a[todo] < b[todo]]
        some = np.flatnonzero(a < end)
        hit = some[self.low[a[some]].astype(np.int64) == low[some]]
        out[hit] = a[hit]
        return out
