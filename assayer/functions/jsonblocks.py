"""JSON objects inside free text, by a structural index.

The bytes of a whole Arrow batch are looked at once, vectorised: where braces and quotes are, and for each quote whether
the run of backslashes before it is even, so that it can end a string. What remains is a walk over braces and opening
quotes alone; a string is crossed in one step to the next quote that can end it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUOTE, SLASH, OPEN, CLOSE = b'"\\{}'


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def spans(texts: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The batch's bytes, and (row, start, end) of every top-level object that is closed."""
    data, off = _buffers(texts)
    marks = np.flatnonzero((data == QUOTE) | (data == OPEN) | (data == CLOSE))
    quotes = marks[data[marks] == QUOTE]
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != SLASH, at, -1)) if len(data) else at  # the last byte that is no backslash
    before = np.where(quotes > 0, other[np.maximum(quotes - 1, 0)], -1)
    row_start = off[np.searchsorted(off, quotes, side="right") - 1]
    run = quotes - 1 - np.maximum(before, row_start - 1)
    ends = quotes[run % 2 == 0]  # inside a string, the quotes that end it
    after = np.searchsorted(ends, quotes, side="right").tolist()
    number = dict(zip(quotes.tolist(), range(len(quotes)), strict=True))
    ends, kinds, places = ends.tolist(), data[marks].tolist(), marks.tolist()
    bounds = np.searchsorted(marks, off).tolist()
    found = []
    for row in range(len(off) - 1):
        i, last, limit = bounds[row], bounds[row + 1], int(off[row + 1])
        depth = start = 0
        while i < last:
            kind, place = kinds[i], places[i]
            i += 1
            if kind == OPEN:
                start = start if depth else place
                depth += 1
            elif kind == CLOSE:
                if depth == 1:
                    found.append((row, start, place + 1))
                depth -= depth > 0
            elif depth:
                k = after[number[place]]
                if k >= len(ends) or ends[k] >= limit:
                    break  # the string is never closed
                i = np.searchsorted(marks, ends[k], side="right") if ends[k] - place > 4096 else i
                while i < last and places[i] <= ends[k]:
                    i += 1
    return data, found


def blocks(texts: pa.Array) -> pa.ListArray:
    """Each text's objects, in order; nulls have none."""
    data, found = spans(texts)
    raw = data.tobytes()
    rows = np.array([r for r, _, _ in found], np.int64)
    offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([raw[a:b].decode() for _, a, b in found], pa.string()))
