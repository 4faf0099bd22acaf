"""FM-index over integer symbols: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the separators 0 are distinct and ordered by position."""
    n = len(symbols)
    first = symbols.astype(np.int64) * (n + 1)
    zero = symbols == 0
    first[zero] = np.flatnonzero(zero)
    _, rank = np.unique(first, return_inverse=True)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        pair = rank * np.int64(n + 1) + after
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        new = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= n:
            return order


class _Bits:
    """A bit vector in 64-bit words with a running count for each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class FmIndex:
    """Index of a sequence whose symbol 0 separates runs; patterns hold no 0 and never cross one."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        symbols = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(symbols)
        last = symbols[order - 1]
        top = int(symbols.max())
        self.starts = np.append(0, np.cumsum(np.bincount(symbols, minlength=top + 1)))
        self.levels: list[tuple[int, _Bits, int]] = []
        now = last
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = (now >> shift) & 1
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, _Bits(bit.astype(bool)), zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.size = len(symbols)
        kept = (order % sample == 0) | (symbols[order - 1] == 0)
        self.sampled, self.positions = _Bits(kept), order[kept]
        self.base = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``i`` of the transformed sequence."""
        return self._descend(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of ``patterns`` (all of one length)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.size, np.int64)
        alive = np.flatnonzero((patterns < len(self.base)).all(axis=1))
        hi[(patterns >= len(self.base)).any(axis=1)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            a = self.starts[c] + self.rank(c, lo[alive])
            b = self.starts[c] + self.rank(c, hi[alive])
            lo[alive], hi[alive] = a, b
            alive = alive[a < b]
            if not len(alive):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix rows: step back to a sampled one and add the steps."""
        out = np.zeros(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            hit = self.sampled.get(row).astype(bool)
            out[todo[hit]] = self.positions[self.sampled.rank(row[hit])] + steps
            todo, row, steps = todo[~hit], row[~hit], steps + 1
            if len(todo):
                symbol, i = np.zeros(len(row), np.int64), row
                for shift, bits, zeros in self.levels:
                    bit = bits.get(i).astype(np.int64)
                    ones = bits.rank(i)
                    i = np.where(bit, zeros + ones, i - ones)
                    symbol |= bit << shift
                row = self.starts[symbol] + i - self.base[symbol]
        return out
