"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window (sequence) of L tokens grants source s a
quantum of L * share(s) tokens; what it cannot use, because tokens are whole, is its deficit and
is carried on. With shares equal to the corpus proportions no queue ever runs dry, and the
state after w windows has a closed form: queue s has given floor(w * L * T_s / T) tokens, plus one
for the queues with the largest deficits so that windows are exactly full. So every window holds
each source within one token of its target, deficits carry over windows and partitions alike, and
any partition computes its pieces alone from the offset of its documents in their queues.

Sources of less than one token a window share one queue. What is left after the last full window
is cut into sequences of powers of two, so there is no padding at all. Documents are cut freely.

Null texts are empty (one end token), null sources count as '', repeated rows are packed one by
one, extra columns are ignored, and an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm._work import materialise, releasing, ship
from assayer.llm.tokens import WordCoder

OFFSET_BROADCAST_ROWS = 100_000


def tokenise(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 1) -> DataFrame:
    """block, source, before (tokens of the source earlier in the block), row_key, n, ids (packed, with ``end_id`` last)."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = WordCoder.load(tokenizer)
        end = np.array([end_id], coder.dtype).tobytes()
        block, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                sources = part.column(1).to_pylist()
                ids = [coder.encode(t or "") + end for t in part.column(2).to_pylist()]
                n = [len(x) // coder.dtype.itemsize for x in ids]
                before = []
                for s, k in zip(sources, n, strict=True):
                    before.append(given.get(s, 0))
                    given[s] = before[-1] + k
                arrays = [pa.array([block] * len(n), pa.int64()), part.column(1), pa.array(before, pa.int64()), part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "source", "before", "row_key", "n", "ids"])

    rows = docs.select(F.col(key).alias("row_key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run, "coder"), f"block long, source string, before long, row_key {kind}, n long, ids binary")


class Quotas:
    """Cumulative tokens of every queue after w windows of ``length`` tokens."""

    CHUNK = 256

    def __init__(self, totals: list[int], length: int):
        self.totals, self.length, self.all = totals, length, sum(totals)
        self.full = self.all // length
        wide = self.all * (self.all + length) < 1 << 62
        self.weights = np.array(totals, np.int64 if wide else object)
        self._chunks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _chunk(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        if c not in self._chunks:
            if len(self._chunks) > 64:
                self._chunks.clear()
            w = np.arange(c * self.CHUNK, (c + 1) * self.CHUNK).astype(self.weights.dtype)
            grant = w[:, None] * self.length * self.weights[None, :]
            given = (grant // self.all).astype(np.int64)
            deficit = grant % self.all
            short = (w * self.length).astype(np.int64) - given.sum(axis=1)
            place = np.argsort(np.argsort(-deficit, axis=1, kind="stable"), axis=1, kind="stable")
            given = given + (place < short[:, None])
            self._chunks[c] = given, np.cumsum(given, axis=1) - given
        return self._chunks[c]

    def after(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows for ``first`` <= w <= ``last``: what each queue has given, and what the queues before it have."""
        a, b = first // self.CHUNK, last // self.CHUNK
        parts = [self._chunk(c) for c in range(a, b + 1)]
        inside = slice(first - a * self.CHUNK, last - a * self.CHUNK + 1)
        return tuple(x[0][inside] if a == b else np.concatenate(x)[inside] for x in zip(*parts, strict=True))

    def cut(self, queue: int, start: int, stop: int) -> list[tuple[int, int, int, int]]:
        """(from, to, sequence, offset) of the pieces of positions [start, stop) of a queue."""
        out, total = [], self.totals[queue]
        first = min(max(0, start * self.all // (total * self.length) - 2), self.full)
        last = min(stop * self.all // (total * self.length) + 2, self.full)
        given, others = self.after(first, last)
        edges = given[:, queue]
        if last > first:
            i = max(0, int(np.searchsorted(edges, start, side="right")) - 1)
            j = min(int(np.searchsorted(edges, stop, side="left")), len(edges) - 1)
            if i < j:
                begun, ahead = edges[i:j], np.diff(others[i : j + 1, queue])
                lo, hi = np.maximum(begun, start), np.minimum(edges[i + 1 : j + 1], stop)
                out = [p for p in zip(lo.tolist(), hi.tolist(), range(first + i, first + j), (ahead + lo - begun).tolist(), strict=True) if p[0] < p[1]]
        if last == self.full and stop > edges[-1]:
            done = given[-1]
            base = sum(t - int(g) for t, g in zip(self.totals[:queue], done[:queue], strict=True)) - int(edges[-1])
            a, b, at, sequence = max(start, int(edges[-1])) + base, stop + base, 0, self.full
            rest = self.all - self.full * self.length
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    lo, hi = max(a, at), min(b, at + (1 << bit))
                    if lo < hi:
                        out.append((lo - base, hi - base, sequence, lo - at))
                    at, sequence = at + (1 << bit), sequence + 1
        return out


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, *, key: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 1) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    tokens = materialise(tokenise(docs, tokenizer, key=key, text=text, source=source, end_id=end_id), "pack-tokens")
    sums = materialise(tokens.groupBy("block", "source").agg(F.sum("n").alias("n")), "pack-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    own = [(r["source"], r["n"]) for r in by_source.where(F.col("n") * length >= F.lit(total)).orderBy("source").collect()]  # at most `length` rows
    pool = total - sum(n for _, n in own)
    while own and 0 < pool * length < total:
        least = min(own, key=lambda x: (x[1], x[0]))
        own.remove(least)
        pool += least[1]
    names = {s: i for i, (s, _) in enumerate(own)}
    totals = [n for _, n in own] + [pool] * (pool > 0)
    queue = F.coalesce(F.create_map(*[x for s, i in names.items() for x in (F.lit(s), F.lit(i))])[F.col("source")], F.lit(len(own))) if own else F.lit(0)
    sums = sums.withColumn("queue", queue)
    blocks = sums.groupBy("queue", "block").agg(F.sum("n").alias("n"))
    ahead = blocks.withColumn("ahead", F.sum("n").over(Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    inside = Window.partitionBy("queue", "block").orderBy("source").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sums.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(ahead, ["queue", "block"])
    offsets = offsets.select("block", "source", "queue", (F.col("ahead") + F.col("inside")).alias("offset"))
    if sums.count() <= OFFSET_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    quotas = Quotas(totals, length)
    names_out = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = WordCoder.load(tokenizer).dtype
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                who, at, cols = [], [], [[] for _ in range(6)]
                for i, (n, q, p, ids) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True)):
                    wide = memoryview(np.frombuffer(ids, dtype).astype("<u4").tobytes())
                    pieces = quotas.cut(q, p, p + n)
                    who += [i] * len(pieces)
                    cols[0] += [lo - p for lo, _, _, _ in pieces]
                    cols[1] += [hi - lo for lo, hi, _, _ in pieces]
                    cols[2] += [zlib.crc32(wide[4 * (lo - p) : 4 * (hi - p)]) for lo, hi, _, _ in pieces]
                    cols[3] += [n] * len(pieces)
                    cols[4] += [sequence for _, _, sequence, _ in pieces]
                    cols[5] += [offset for _, _, _, offset in pieces]
                take = pa.array(who, pa.int64())
                arrays = [part.column(0).take(take), *(pa.array(c, pa.int64()) for c in cols), part.column(5).take(take)]
                yield pa.RecordBatch.from_arrays(arrays, names=names_out)

    rows = tokens.join(offsets, ["block", "source"]).select("row_key", "n", "queue", (F.col("offset") + F.col("before")).alias("at"), "ids", "source")
    return rows.mapInArrow(releasing(run, "coder"), f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
