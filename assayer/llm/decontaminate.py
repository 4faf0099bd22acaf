"""Benchmark decontamination with one FM-index per shard of the training texts.

A shard's index holds the maximal runs of benchmark words that are long enough for a window:
a window consists of benchmark words only, so nothing else can take part in a match. All windows
are searched backwards at once through wavelet ranks, the occurrences are located by sampled
suffix positions, and overlapping ones are merged into removal spans.

The benchmark is read in blocks of at most ``block_bytes`` of text (or of one item that is longer),
each of which is sent to the executors as text; these make its windows, and search them in all
texts. With more text there are more blocks, one after another in the same pass. The driver holds
the benchmark's text and nothing made from it.

Null and empty texts have no words and are never hit. Items without words have no windows; those
of an item without an id are hit, but name no item. Repeated rows and items are judged alone, and a
word in several windows is hit once. Very long texts are a shard of their own. An empty benchmark
hits nothing, an empty table gives an empty result. Extra columns of either table are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._text import LOWER, Block, slices, text_buffers
from assayer.llm._work import CACHES, releasing, ship
from assayer.llm.fmindex import FmIndex

SHARD_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
#: Bytes that are no part of a word: all of ASCII but digits and lower-case letters.
NO_WORD = np.zeros(256, bool)
NO_WORD[:0x80] = True
NO_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


class Windows:
    """The distinct windows of some items, as rows of word numbers from 1, by length; ``names`` are the items' ids."""

    def __init__(self, ids: list[str | None], texts: pa.Array, width: int):
        data, off = text_buffers(texts)
        block = Block(LOWER[data], off)
        starts, ends, doc = block.words(NO_WORD)
        self.vocabulary, number = np.unique(block.hashes(starts, ends), return_inverse=True)
        number = (number + 1).astype(np.int32)
        self.names = sorted({k for k in ids if k is not None})
        at = {k: i for i, k in enumerate(self.names)}
        name = np.array([at.get(k, -1) for k in ids], np.int64)  # an item without an id has windows but no name
        size = np.bincount(doc, minlength=len(ids))
        first = np.searchsorted(doc, np.arange(len(ids)))
        length = np.minimum(size, width)
        self.groups = []
        for n in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == n)
            count = size[own] - n + 1
            item = np.repeat(own, count)
            begin = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            rows, which = np.unique(number[begin[:, None] + np.arange(n)], axis=0, return_inverse=True)
            owners = np.unique(np.stack([which.ravel(), name[item]], axis=1), axis=0)
            owners = owners[owners[:, 1] >= 0]
            self.groups.append((n, rows, np.searchsorted(owners[:, 0], np.arange(len(rows) + 1)), owners[:, 1]))
        self.shortest = min((g[0] for g in self.groups), default=0)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


class _Shard:
    """Runs of benchmark words of many texts, and the batches they came from."""

    def __init__(self, windows: Windows):
        self.windows, self.batches = windows, []
        self.symbols, self.docs, self.places, self.n_words, self.bytes = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        base = sum(b.num_rows for b in self.batches)
        self.batches.append(batch)
        data, off = text_buffers(batch.column(1))
        self.bytes += len(data)
        for a, b in slices(off, BLOCK_BYTES):
            block = Block(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
            starts, ends, doc = block.words(NO_WORD)
            self.n_words.append(np.bincount(doc, minlength=block.docs))
            if not self.windows.shortest or not len(starts):
                continue
            number = self.windows.number(block.hashes(starts, ends))
            inside = np.flatnonzero(number)
            if not len(inside):
                continue
            first = np.append(True, (np.diff(inside) > 1) | (doc[inside][1:] != doc[inside][:-1]))
            run = np.cumsum(first) - 1
            length = np.bincount(run)
            keep = inside[length[run] >= self.windows.shortest]
            if not len(keep):
                continue
            first = np.append(True, (np.diff(keep) > 1) | (doc[keep][1:] != doc[keep][:-1]))
            where = np.arange(len(keep)) + np.cumsum(first)  # a separator before every run
            size = where[-1] + 1
            symbols, docs, places = np.zeros(size, np.int64), np.full(size, -1), np.zeros(size, np.int64)
            symbols[where], docs[where] = number[keep], doc[keep] + a + base
            places[where] = keep - np.searchsorted(doc, doc[keep])
            self.symbols.append(symbols), self.docs.append(docs), self.places.append(places)

    def spans(self) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
        n_words = np.concatenate(self.n_words)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        if self.symbols:
            symbols, docs, places = map(np.concatenate, (self.symbols, self.docs, self.places))
            index = FmIndex(symbols)
            cover = np.zeros(len(symbols) + 1, np.int64)
            for n, patterns, edges, owners in self.windows.groups:
                lo, hi = index.search(patterns.astype(np.int64))
                count = hi - lo
                pattern = np.repeat(np.arange(len(patterns)), count)
                rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                at = index.locate(rows)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n, -1)
                for d, p in set(zip(docs[at].tolist(), pattern.tolist(), strict=True)):
                    items.setdefault(d, set()).update(owners[edges[p] : edges[p + 1]].tolist())
            hit = np.cumsum(cover)[:-1] > 0
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                spans.setdefault(int(docs[s]), []).append((int(places[s]), int(places[s]) + e - s))
        return n_words, spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_made: dict[str, Windows] = CACHES.setdefault("windows", {})


def _windows(name: str, sent, width: int) -> Windows:
    """The windows of a block of items, made once a Python worker; the latest few are kept."""
    if name not in _made:
        while len(_made) > 3:
            _made.pop(next(iter(_made)))
        ids, texts = sent.value
        _made[name] = Windows(ids, pa.array(texts, pa.large_string()), width)
    return _made[name]


def _search(name: str, sent, width: int, last: bool):
    def flush(shard: _Shard) -> Iterator[pa.RecordBatch]:
        windows = shard.windows
        n_words, spans, items = shard.spans()
        at = 0
        for batch in shard.batches:
            n = batch.num_rows
            old_items, old_spans = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            new_items = [sorted({*(old_items[i] or ()), *(windows.names[k] for k in items.get(at + i, ()))}) for i in range(n)]
            new_spans = [_merge([(x["start"], x["stop"]) for x in old_spans[i] or ()] + spans.get(at + i, [])) for i in range(n)]
            new_spans = [[{"start": s, "stop": e} for s, e in x] for x in new_spans]
            text = pa.nulls(n, pa.string()) if last else batch.column(1)
            arrays = [batch.column(0), text, pa.array(n_words[at : at + n]), pa.array(new_items, pa.list_(pa.string())), pa.array(new_spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row_key", "text", "n_words", "items", "spans"])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(name, sent, width)
        shard = _Shard(windows)
        for batch in batches:
            if batch.num_rows:
                shard.add(batch)
            if shard.bytes >= SHARD_BYTES:
                yield from flush(shard)
                shard = _Shard(windows)
        if shard.batches:
            yield from flush(shard)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """One row a document: key, n_words, items (ids as sorted strings) and merged spans of word numbers [start, stop)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    items = benchmark.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = docs.select(
        F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b)
        rows = part.collect()  # about ``block_bytes`` of text
        sent = docs.sparkSession.sparkContext.broadcast(([r["k"] for r in rows], [r["t"] for r in rows]))
        schema = f"row_key {kind}, text string, n_words long, items array<string>, spans array<struct<start:bigint,stop:bigint>>"
        out = out.mapInArrow(releasing(_search(uuid.uuid4().hex, sent, width, b == blocks - 1), "windows"), schema)
    return out.select(F.col("row_key").alias(key), "n_words", "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", share: int = 20, **options) -> DataFrame:
    """``benchmark_spans`` with n_hit, n_items, items_sha256 and contaminated (hit words are at least 1/share of all)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return (
        benchmark_spans(docs, benchmark, key=key, **options)
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
        .select(key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")
    )
