"""Near-duplicate passages by compact windows.

A text is a sequence of 5-word shingles; equal sequences form one class, of which one copy is kept
in blocks, in a table bucketed by block. Blocks send their distinct shingles to owner partitions and
get back about how many classes have each. A window of ``length`` shingles can only be repeated if
six in seven of its shingles are in other classes; the unions of such windows are the segments, and
only they go on.

Under each of ``HASHES`` hash functions, the nodes of the Cartesian tree over a segment's hashes
that span at least ``length`` shingles are its compact windows: (l, c, r) stands for all sequences
that lie in [l, r] and have their smallest hash at c. They are found as the runs of equal sliding
minima, which are the same nodes, with l and r as far as windows of the least length reach. The
functions are taken in bands of two; within a segment the compact windows of a band are joined by
interval, so that each band window (s, e) stands for all sequences that start in [s, e], and
sequences that agree under five of the eight functions agree in one whole band. Band windows of
equal minima form lists.

Every list compares its members' segments with a pivot: within a chunk of segments first, and then
the chunks' pivots with each other, so a very common list costs one task no more than a row a chunk.
Lists that are not settled then (windows without a verified repeat, members of different components)
are divided by rare shingles: a window goes to the lists of its rarest shingles, one more than it may
lack. Two windows that have six in seven shingles in each other meet in one of these lists; windows
that share no more than a common line meet seldom. Members are compared with ``PIVOTS`` others of
their lists, and what that leaves with all members, pair by pair, so no such pair is left out. A
passage is a run of windows of ``length`` shingles of which six in seven occur in one region of the
other segment, in both segments (Jaccard similarity 0.75 for windows of one length).

Null, empty and short texts hold no passage and give no row; repeated rows are copies of each
other, whose whole text is a passage; rows without a key take part, and a class without any key
has a null id. Texts of any length are taken as a whole. Ties of hashes go to the first position.
Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm._text import Block, mix, slices, text_buffers, windows
from assayer.llm._work import discard, materialise, ship, spark_gc
from assayer.llm.components import connected_components
from assayer.llm.ngram import _by_owner, _pack, _unpack

SLICE_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
WIDTH = 5
HASHES, BAND = 8, 2
#: Members of a list that its unsettled members are compared with before all are.
PIVOTS = 16
#: Members of a list that one task takes at most, of those that its active members are joined with.
LIST_MEMBERS = 2000
#: Text bytes for each owner partition, segment bytes for each bucket, band windows of a bucket of lists and shingles of a chunk.
OWNER_BYTES, SEGMENT_BUCKET_BYTES, LIST_ROWS, CHUNK = 8 << 20, 64 << 20, 400_000, 1_000_000
SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
REST = np.uint64((1 << 40) - 1)


def sequences(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's shingle hashes in order; none for texts of fewer than ``WIDTH`` words."""
    data, off = text_buffers(column)
    for a, b in slices(off, SLICE_BYTES):
        block = Block(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
        starts, ends, doc = block.words()
        at, h = windows(block.hashes(starts, ends), doc, WIDTH)
        yield from np.split(h, np.searchsorted(doc[at], np.arange(1, block.docs)))


def sequence_class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def needed(length: int) -> int:
    """Shingles of a window that the other text has, at least."""
    return -(-6 * length // 7)


def sliding_minima(hashes: np.ndarray, length: int) -> np.ndarray:
    """Position of the smallest hash of every window of ``length``; the first one of equals."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.int64)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    padded = np.full(-(-n // length) * length, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = ((hashes >> bits) << bits) | np.arange(n, dtype=np.uint64)
    rows = padded.reshape(-1, length)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - length + 1], ahead[length - 1 : n]) & low).astype(np.int64)


def compact_windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of one sequence; l and r at most ``length`` - 1 from c."""
    least = sliding_minima(hashes, length)
    if not len(least):
        return least, least, least
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    return first, least[first], last + length - 1


def _text_blocks(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Rows (block, keys, nodes, lengths, own, sizes, bytes): all rows' classes, and the text of each class once a task."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, nr, seen = TaskContext.get().partitionId() << 32, 0, set()
        keys, nodes, lengths, own, parts, held, rows = [], [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            column = pa.concat_arrays(keys)
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            arrays = [pa.array([base + nr], pa.int64()), whole(column), whole(pa.array(nodes, pa.int64())), whole(pa.array(lengths, pa.int64())), pa.array([np.array(own, "<i8").tobytes()], pa.binary()),
                      pa.array([np.array([len(p) for p in parts], "<i8").tobytes()], pa.binary()), pa.array([zlib.compress(b"".join(parts), 1)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "keys", "nodes", "lengths", "own", "sizes", "bytes"])

        for batch in batches:
            data, off = text_buffers(batch.column(1))
            keys.append(batch.column(0))
            done = 0
            for i, s in enumerate(sequences(batch.column(1))):
                name = sequence_class(s)
                nodes.append(name), lengths.append(len(s))
                if len(s) >= length and name not in seen:
                    seen.add(name), own.append(name)
                    parts.append(data[off[i] : off[i + 1]].tobytes())
                    held += len(parts[-1])
                if held > BLOCK_BYTES:
                    keys[-1] = batch.column(0).slice(done, i + 1 - done)
                    yield flush()
                    done, nr, keys, nodes, lengths, own, parts, held = i + 1, nr + 1, [batch.column(0).slice(i + 1)], [], [], [], [], 0
        if nodes:
            yield flush()

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"block long, keys array<{kind}>, nodes array<long>, lengths array<long>, own binary, sizes binary, bytes binary")


class _Stored:
    """The sequences of a block's texts that the block owns, and their distinct shingles by owner partition."""

    def __init__(self, row: dict, owned: list[int], owners: int):
        own, sizes = np.frombuffer(row["own"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        off = np.append(0, np.cumsum(sizes)).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(off.tobytes()), pa.py_buffer(zlib.decompress(row["bytes"])))
        keep = np.isin(own, np.array(owned, np.int64))
        self.nodes = own[keep]
        self.sequences = list(sequences(texts.filter(pa.array(keep, pa.bool_()))))
        every = np.concatenate([*self.sequences, np.zeros(0, np.uint64)])
        doc = np.repeat(np.arange(len(self.sequences)), [len(s) for s in self.sequences])
        entry = ((every % np.uint64(owners)) << np.uint64(40)) | (every >> np.uint64(24))
        order = np.argsort(entry, kind="stable")
        entry = entry[order]
        first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])) if len(entry) else np.zeros(0, np.int64)
        self.entries = entry[first]
        last = np.append(first[1:], len(entry)) - 1
        doc = doc[order]  # ascending within an entry
        again = np.append(False, (doc[1:] == doc[:-1]) & (entry[1:] == entry[:-1])) if len(entry) else np.zeros(0, bool)
        self.classes = np.minimum(np.add.reduceat(~again, first, dtype=np.int64), 65535).astype("<u2") if len(entry) else np.zeros(0, "<u2")
        self.at = np.empty(len(entry), np.int64)
        self.at[order] = np.repeat(np.arange(len(first)), last - first + 1)
        self.edges = np.searchsorted(self.entries, np.arange(owners + 1, dtype=np.uint64) << np.uint64(40))


_SENT = "block long, part int, blob binary, owned array<long>"


def _sent(block, part, blob) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array(part, pa.int32()), "blob": pa.array(blob, pa.binary()), "owned": pa.nulls(len(block), pa.list_(pa.int64()))})


def _owned(right: pa.Table) -> list[int]:
    return [x for own in right.column("owned").to_pylist() for x in own or ()]


def _send_shingles(owners: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, part, blob = [], [], []
        for row in left.to_pylist():
            t = _Stored(row, _owned(right), owners)
            for p in np.flatnonzero(np.diff(t.edges)).tolist():
                a, b = t.edges[p], t.edges[p + 1]
                block.append(row["block"]), part.append(p)
                blob.append(_pack(np.diff(t.entries[a:b] & REST, prepend=np.uint64(0)), t.classes[a:b]))
        return _sent(block, part, blob)

    return run


def _flag_shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Answers every block, in its order: 0 for shingles that one class has, for others a step of the number of classes that have them."""
    sent = [_unpack(b) for b in table.column("blob").to_pylist()]
    rest = [np.cumsum(d, dtype=np.uint64) for d, _ in sent]
    every, at = np.unique(np.concatenate(rest), return_inverse=True)
    times = np.bincount(at, weights=np.concatenate([c for _, c in sent]), minlength=len(every))
    steps = np.minimum(8 * np.log2(np.maximum(times, 1)), 255).astype(np.uint8)
    edges = np.cumsum([len(r) for r in rest])[:-1]
    return _sent(table.column("block").to_pylist(), [key[0].as_py()] * len(sent), [zlib.compress(f.tobytes(), 1) for f in np.split(steps[at], edges)])


def _find_segments(owners: int, length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, rows = ("sid", "node", "start", "good", "hashes", "steps"), []
        for row in left.to_pylist():
            t = _Stored(row, _owned(right), owners)
            flags = np.zeros(len(t.entries), np.uint8)
            for p, blob in zip(right.column("part").to_pylist(), right.column("blob").to_pylist(), strict=True):
                if blob is not None:
                    a, b = t.edges[p], t.edges[p + 1]
                    flags[a:b] = np.frombuffer(zlib.decompress(blob), np.uint8)
            flags, base = flags[t.at], 0
            for node, s in zip(t.nodes.tolist(), t.sequences, strict=True):
                steps = flags[base : base + len(s)]
                total = np.append(0, np.cumsum(steps > 0))
                base += len(s)
                good = total[length:] - total[:-length] >= needed(length)
                if not good.any():
                    continue
                at = np.flatnonzero(good)
                new = np.flatnonzero(np.append(True, np.diff(at) > length))
                for a, b in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True):
                    sid = mix(np.array([node], np.int64).astype(np.uint64) ^ mix(np.array([a + 1], np.uint64)))
                    rows.append((int(sid.astype(np.int64)[0]), node, a, np.packbits(good[a : b + 1]).tobytes(), s[a : b + length].tobytes(), steps[a : b + length].tobytes()))
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.table([pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(cols)], names=names)

    return run


def band_windows(sequence: np.ndarray, good: np.ndarray, length: int, breaks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each band (key, s, e): runs of window starts with equal minima under its functions and a start that is ``good``; a run begins at each of ``breaks``."""
    before = np.append(0, np.cumsum(good))
    for band in range(HASHES // BAND):
        key = np.zeros(max(0, len(sequence) - length + 1), np.uint64)
        change = np.zeros(max(0, len(key) - 1), bool)
        change[breaks[(breaks > 0) & (breaks < len(key))] - 1] = True
        for f in range(band * BAND, band * BAND + BAND):
            h = mix(sequence ^ SEEDS[f])
            least = sliding_minima(h, length)
            key = mix(key + h[least])
            change |= least[1:] != least[:-1]
        first = np.flatnonzero(np.append(True, change)) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1
        some = before[last + 1] > before[first]
        first, last = first[some], last[some]
        yield (key[first] & ~np.uint64(3)) | np.uint64(band), first, last


_ENTRY = "k long, sid long, node long, s int, e int, psid long, pnode long"


def _entries(k, sid, node, s, e, pivot) -> pa.RecordBatch:
    cols = [k.astype(np.int64), sid, node, s.astype(np.int32), e.astype(np.int32), sid[pivot], node[pivot]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in _ENTRY.split(", ")])


def _with_pivots(k, sid, node) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by key and pivot rank: the index of each one's pivot, and whether its list has two classes."""
    first = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    run_of = np.cumsum(first) - 1
    pivot = np.flatnonzero(first)[run_of] if len(k) else np.zeros(0, np.int64)
    two = np.bincount(run_of, weights=node != node[pivot], minlength=1)[run_of] > 0 if len(k) else np.zeros(0, bool)
    return pivot, two


def _rank(node: np.ndarray) -> np.ndarray:
    return mix(node.astype(np.uint64))


def _chunk_lists(segments: DataFrame, length: int, buckets: int) -> DataFrame:
    """Entries of the lists that have two classes within a chunk, and (bucket, blob): one packed entry a list and chunk."""

    def flush(chunk: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        whole, good = np.concatenate([c[3] for c in chunk]), np.concatenate([np.append(c[4], np.zeros(length - 1, bool)) for c in chunk])
        base = np.append(0, np.cumsum([len(c[3]) for c in chunk]))
        of, shift = np.searchsorted(base, np.arange(len(whole)), side="right") - 1, np.array([c[2] for c in chunk])
        sids, nodes = np.array([c[0] for c in chunk], np.int64), np.array([c[1] for c in chunk], np.int64)
        k, s, e = (np.concatenate(x) for x in zip(*band_windows(whole, good[: len(whole) - length + 1], length, base), strict=True))
        # a run of starts may pass the end of a segment: it is cut there
        at = of[s]
        e = np.minimum(e, base[at + 1] - length)
        keep = e >= s
        k, s, e, at = k[keep], s[keep], e[keep], at[keep]
        sid, node = sids[at], nodes[at]
        s, e = s - base[at] + shift[at], e - base[at] + shift[at]
        order = np.lexsort((s, sid, _rank(node), k))
        k, sid, node, s, e = k[order], sid[order], node[order], s[order], e[order]
        pivot, two = _with_pivots(k, sid, node)
        own = pivot == np.arange(len(k))
        some = np.flatnonzero(two)
        place = np.cumsum(two) - 1
        local = _entries(k[some], sid[some], node[some], s[some], e[some], place[pivot[some]])
        yield pa.RecordBatch.from_arrays([*local.columns, pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], names=[*local.schema.names, "bucket", "blob"])
        k, sid, node, s, e = k[own], sid[own], node[own], s[own], e[own]
        bucket, blob = [], []
        for p, g in _by_owner((mix(k) % np.uint64(buckets)).astype(np.int64)):
            bucket.append(p)
            blob.append(np.array([len(g)], "<i8").tobytes() + b"".join(np.ascontiguousarray(c[g]).astype(t).tobytes() for c, t in ((k, "<u8"), (sid, "<i8"), (node, "<i8"), (s, "<i4"), (e, "<i4"))))
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(bucket), f.type) for f in local.schema), pa.array(bucket, pa.int32()), pa.array(blob, pa.binary())], names=[*local.schema.names, "bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            for sid, node, start, good, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(hashes, "<u8")
                chunk.append((sid, node, start, h, np.unpackbits(np.frombuffer(good, np.uint8), count=len(h) - length + 1).astype(bool)))
                held += len(h)
                if held > CHUNK:
                    yield from flush(chunk)
                    chunk, held = [], 0
        if chunk:
            yield from flush(chunk)

    return segments.select("sid", "node", "start", "good", "hashes").mapInArrow(run, f"{_ENTRY}, bucket int, blob binary")


def _bucket_lists(table: pa.Table) -> pa.Table:
    """Entries of the lists to which chunks with different classes sent theirs."""
    cols = []
    for b in table.column("blob").to_pylist():
        n, at, own = int(np.frombuffer(b, "<i8", 1)[0]), 8, []
        for t in ("<u8", "<i8", "<i8", "<i4", "<i4"):
            own.append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
        cols.append(own)
    k, sid, node, s, e = map(np.concatenate, zip(*cols, strict=True))
    order = np.lexsort((s, sid, _rank(node), k))
    k, sid, node, s, e = k[order], sid[order], node[order], s[order], e[order]
    pivot, two = _with_pivots(k, sid, node)
    some = np.flatnonzero(two)
    place = np.cumsum(two) - 1
    return pa.Table.from_batches([_entries(k[some], sid[some], node[some], s[some], e[some], place[pivot[some]])])


def shared_runs(a: np.ndarray, b: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """Runs of windows of ``a`` of which six in seven shingles occur in one region of ``b``: (first and last start, span start and stop)."""
    if len(a) < length or len(b) < length:
        return []
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    left, right = np.searchsorted(ordered, a), np.searchsorted(ordered, a, side="right") - 1
    hit = right >= left
    good, any_hit = np.zeros(len(a) - length + 1, bool), np.zeros(len(a), bool)
    ways = [order[np.minimum(left, len(b) - 1)]]
    if (right > left).any():
        ways.append(order[right])  # shingles that b repeats: the first and the last place
    for place in ways:
        region = (place - np.arange(len(a)) + len(a)) // (2 * length)
        names, sizes = np.unique(region[hit], return_counts=True)
        for r in names[2 * sizes >= needed(length)].tolist():
            for lo in (r - 1, r):
                inside = hit & (region >= lo) & (region <= lo + 1)
                total = np.append(0, np.cumsum(inside))
                some = total[length:] - total[:-length] >= needed(length)
                if some.any():
                    good |= some
                    any_hit |= inside
    at = np.flatnonzero(good)
    if not len(at):
        return []
    new = np.flatnonzero(np.append(True, np.diff(at) > length))
    out = []
    for x, y in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True):
        inside = np.flatnonzero(any_hit[x : y + length])
        out.append((x, y, x + int(inside[0]), x + int(inside[-1]) + 1))
    return out


_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _verify(pairs: DataFrame, segments: DataFrame, length: int) -> DataFrame:
    """(psid, sid, pnode, node, runs_p, runs) of the pairs (psid, sid) of segments that share passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["psid", "sid", "pnode", "node", "runs_p", "runs"]
        for batch in batches:
            keep, one, two = [], [], []
            for i, (x, y, p, q) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6, 7)), strict=True)):
                a, b = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                mine = shared_runs(a, b, length)
                other = shared_runs(b, a, length) if mine else []
                if other:
                    keep.append(i)
                    one.append([dict(zip(("first", "last", "start", "stop"), (v + x for v in r), strict=True)) for r in mine])
                    two.append([dict(zip(("first", "last", "start", "stop"), (v + y for v in r), strict=True)) for r in other])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(4)), pa.array(one, pa.list_(_RUN)), pa.array(two, pa.list_(_RUN))], names=names)

    pivots = materialise(segments.join(pairs.select(F.col("psid").alias("sid")).distinct(), "sid", "left_semi").select(F.col("sid").alias("psid"), F.col("node").alias("pnode"), F.col("start").alias("pstart"), F.col("hashes").alias("phashes")), "passage-pivots")
    met = pairs.join(segments.select("sid", "node", "start", "hashes"), "sid").join(pivots, "psid")
    run_type = "array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>"
    out = met.select("psid", "sid", "pnode", "node", "pstart", "start", "phashes", "hashes").mapInArrow(run, f"psid long, sid long, pnode long, node long, runs_p {run_type}, runs {run_type}")
    out = materialise(out, "passages")
    discard(pivots)
    return out


def _islands(rows: DataFrame, by: str, first: str, last: str, gap: int) -> DataFrame:
    """Ranges [first, last] of each ``by`` joined where they overlap or are up to ``gap`` apart; at most one row a start goes to the window."""
    rows = rows.groupBy(by, first).agg(F.max(last).alias(last))
    order = Window.partitionBy(by).orderBy(first)
    reach = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", (reach.isNull() | (F.col(first) > reach + gap)).cast("long"))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "island").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("island")


def _settled(entries: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """``entries`` with ``done``: a window that starts in [s, e] has a verified repeat in any text, or verified passages cover all words of [s, e + length) anyway."""
    sides = found.select("sid", F.inline("runs")).union(found.select(F.col("psid").alias("sid"), F.inline("runs_p")))
    listed = lambda a, b, gap: _islands(sides.select("sid", a, b), "sid", a, b, gap).groupBy("sid").agg(F.collect_list(F.struct(a, b)).alias(f"{a}s"))  # noqa: E731  at most a range a start
    inside = F.exists("firsts", lambda r: (r["first"] <= F.col("e")) & (F.col("s") <= r["last"]))
    covered = F.exists("starts", lambda r: (r["start"] <= F.col("s")) & (F.col("e") + length <= r["stop"]))
    met = entries.drop("done").join(listed("first", "last", 1), "sid", "left").join(listed("start", "stop", WIDTH - 1), "sid", "left")
    return met.withColumn("done", F.coalesce(inside, F.lit(False)) | F.coalesce(covered, F.lit(False))).drop("firsts", "starts")


def _labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with their component, of the lists that hold two components or a window which is not settled."""
    return _open(entries.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def _open(marked: DataFrame) -> DataFrame:
    open_ = marked.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("done").alias("all_done"), F.min("node").alias("one"), F.max("node").alias("two"))
    return marked.join(open_.where("one <> two and (lo <> hi or not all_done)").select("k"), "k", "left_semi")


def rarest(hashes: np.ndarray, steps: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each of the windows at ``starts`` the places of its first shingles in the order by (steps, hash), so many that the window cannot lack them all: a row each, -1 for shingles of one class.

    Two windows that each have ``needed(length)`` shingles in the other have one of these in common, the first that both have: less than so many are before it in either.
    """
    order = np.lexsort((hashes, steps))
    place = np.empty(len(hashes), np.int32)
    place[order] = np.arange(len(hashes), dtype=np.int32)
    most = length - needed(length)
    first = order[np.partition(np.lib.stride_tricks.sliding_window_view(place, length)[starts], most, axis=1)[:, : most + 1]]
    return np.where(steps[first] > 0, first, -1)


_MARKED = "k long, sid long, node long, s int, e int, done boolean, label long"


def _divided(left: DataFrame, segments: DataFrame, length: int) -> DataFrame:
    """``left`` with a list for each shingle that is among the ``rarest`` of a member's window. Windows that have six in seven shingles in each other meet in one of these, whatever lists they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for sid, node, label, start, good, hashes, steps, entries in zip(*(batch.column(c) for c in range(8)), strict=True):
                h, level = np.frombuffer(hashes.as_buffer(), "<u8"), np.frombuffer(steps.as_buffer(), np.uint8)
                fit = np.unpackbits(np.frombuffer(good.as_buffer(), np.uint8), count=len(h) - length + 1).astype(bool)
                s, e, done = (entries.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                a, b = s - start.as_py(), e - start.as_py() + 1
                change = np.bincount(a, minlength=len(fit) + 1) - np.bincount(b, minlength=len(fit) + 1)
                at = np.flatnonzero((np.cumsum(change)[:-1] > 0) & fit)
                first = rarest(h, level, at, length)
                # the windows of each entry, then their shingles, once each
                lo, hi = np.searchsorted(at, a), np.searchsorted(at, b)
                of = np.repeat(np.arange(len(s)), hi - lo)
                window = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[of]
                of, x = np.repeat(of, first.shape[1]), first[window].ravel()
                key, of = h[x[x >= 0]], of[x >= 0]
                # of settled windows one row a list is enough
                order = np.lexsort((np.where(done[of], 0, of), done[of], key))
                key, of = key[order], of[order]
                new = np.append(True, (key[1:] != key[:-1]) | (done[of[1:]] != done[of[:-1]]) | (~done[of[1:]] & (of[1:] != of[:-1]))) if len(of) else np.zeros(0, bool)
                key, of = key[new], of[new]
                cols.append((key.astype(np.int64), np.full(len(of), sid.as_py()), np.full(len(of), node.as_py()), s[of], e[of], done[of], np.full(len(of), label.as_py())))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], names=[x.split()[0] for x in _MARKED.split(", ")])

    listed = left.groupBy("sid").agg(F.first("label").alias("label"), F.collect_set(F.struct("s", "e", "done")).alias("entries"))  # at most one a band and window
    met = segments.select("sid", "node", "start", "good", "hashes", "steps").join(listed, "sid")
    return met.select("sid", "node", "label", "start", "good", "hashes", "steps", "entries").mapInArrow(run, _MARKED)


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the components that the pairs of ``found`` join; only links between components are followed."""
    links = found.select(F.col("pnode").alias("a"), F.col("node").alias("b")).distinct()
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = materialise(labels.union(nodes.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "passage-nodes")
    one = links.join(every.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(every.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    across = one.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    roots = connected_components(across).select(F.col("node").alias("label"), F.col("label").alias("root"))
    out = materialise(every.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "passage-labels")
    discard(every)
    return out


def _untried(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    ordered = lambda df: df.withColumn("lo", F.least("psid", "sid")).withColumn("hi", F.greatest("psid", "sid"))
    done = ordered(reduce(DataFrame.union, tried)).select("lo", "hi")
    return ordered(pairs).join(done, ["lo", "hi"], "left_anti").select("psid", "sid")


_OTHER = ("sid", "node", "s", "label", "done")


def _pivot_pairs(left: DataFrame) -> DataFrame:
    """(psid, sid): entries that are not settled, or in another component, with ``PIVOTS`` members of their list."""
    other = left.select("k", *[F.col(c).alias(f"p{c}") for c in _OTHER])
    nth = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("pnode"), "psid", "ps"))
    other = other.withColumn("nth_", nth).where(F.col("nth_") <= PIVOTS)  # Spark keeps so many a task before the shuffle
    near = (F.col("label") != F.col("plabel")) | ~F.col("done")
    return left.join(other, "k").where(near & (F.col("node") != F.col("pnode"))).select("psid", "sid").distinct()


def _all_pairs(left: DataFrame, most: int = LIST_MEMBERS) -> DataFrame:
    """(psid, sid): all pairs of a list of which a member is not settled, or which are of two components.

    Each such pair has a member that is not settled or outside the list's largest component: only these, the active ones, are joined with their lists.
    A list of more than ``most`` members is dealt: its active members to as many tasks as it has ``most`` members, its members to all of these.
    """
    segments = left.groupBy("k", "sid", "node", "label").agg(F.min("done").alias("done"))  # a segment's windows in a list make the same pairs
    largest = segments.groupBy("k", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.ceil(F.sum("n") / most).cast("int").alias("deals"))
    every = segments.join(largest, "k").withColumn("active", ~F.col("done") | (F.col("label") != F.col("main")))
    deal = F.pmod(F.xxhash64("sid"), F.col("deals")).cast("int")
    one = every.where("active").select("k", deal.alias("deal"), "sid", "node", "label", "done")
    two = every.select("k", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), *[F.col(c).alias(f"p{c}") for c in ("sid", "node", "label", "done", "active")])
    # few bytes make many pairs, so tasks are not joined by their bytes
    tasks = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = (F.col("label") != F.col("plabel")) | ~F.col("done") | ~F.col("pdone")
    met = one.repartition(tasks, "k", "deal").join(two.repartition(tasks, "k", "deal"), ["k", "deal"])
    pairs = met.where(near & (F.col("node") != F.col("pnode")) & (~F.col("pactive") | (F.col("sid") < F.col("psid"))))
    return pairs.select(F.greatest("sid", "psid").alias("psid"), F.least("sid", "psid").alias("sid")).distinct()


def _passages(segments: DataFrame, length: int, windows_: int) -> tuple[list[DataFrame], DataFrame]:
    """Verified pairs of segments, and the components (node, label) that they make."""
    spark = segments.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(windows_ / LIST_ROWS))
    sent = materialise(_chunk_lists(segments, length, buckets), "passage-windows")
    columns = [x.split()[0] for x in _ENTRY.split(", ")]
    far = sent.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_bucket_lists, _ENTRY)
    entries = materialise(sent.where("bucket is null").select(*columns).union(far), "passage-lists")
    discard(sent)
    tried = [materialise(entries.where("sid <> psid and node <> pnode").select("psid", "sid").distinct(), "passage-pairs")]
    found = [_verify(tried[0], segments, length)]
    spark_gc(spark)

    # a list is settled when every member has a verified repeat in its pivot at the window
    seen = found[0].select("psid", "sid", "runs")
    inside = F.exists("runs", lambda r: (r["first"] <= F.col("e")) & (F.col("s") <= r["last"]))
    met = entries.join(seen, ["psid", "sid"], "left").withColumn("done", (F.col("sid") == F.col("psid")) | F.coalesce(inside, F.lit(False)))
    open_ = materialise(met.groupBy("k").agg(F.min("done").alias("all_done")).where("not all_done").select("k"), "passage-open")
    entries_left = materialise(entries.join(open_, "k", "left_semi").select("k", "sid", "node", "s", "e").distinct(), "passage-lists")
    discard(entries), discard(open_)
    spark_gc(spark)

    labels = _merged(spark.createDataFrame([], "node long, label long"), found[0])
    for last in (False, True):
        left = materialise(_labelled(_settled(entries_left, reduce(DataFrame.union, found), length), labels), "passage-lists")
        discard(entries_left)
        if not last:
            parts = materialise(_divided(left, segments, length), "passage-parts")
            discard(left)
            left = materialise(_open(parts), "passage-lists")
            discard(parts)
        entries_left = left
        pairs = _all_pairs(left) if last else _pivot_pairs(left)
        tried.append(materialise(_untried(pairs, tried), "passage-pairs"))
        found.append(_verify(tried[-1], segments, length))
        spark_gc(spark)
        labels = _merged(labels, found[-1])
    discard(entries_left)
    for df in tried:
        discard(df)
    return found, labels


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """One row a document with repeated passages: key, class_id (smallest key that shared passages reach), n_passages, n_repeat_words, spans (word numbers start:stop, comma-joined)."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    length = least_words - WIDTH + 1
    if not 1 < length < 256:
        raise ValueError("least_words must be from 6 to 259")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(parallel, ceil(size / OWNER_BYTES))
    blocks = materialise(_text_blocks(docs, key, text, length), "passage-blocks", by="block", buckets=min(50_000, max(parallel, ceil(size / BLOCK_BYTES))))
    listed = blocks.select("block", F.inline(F.arrays_zip(F.col("keys").alias("row_key"), F.col("nodes").alias("node"), F.col("lengths").alias("n"))))
    rows = materialise(listed.where(F.col("n") >= length).toDF("block", "row_key", "node", "n"), "passage-rows")
    classes = materialise(rows.groupBy("node").agg(F.min("block").alias("block"), F.count(F.lit(1)).alias("copies"), F.min("row_key").alias("least"), F.first("n").alias("n")), "passage-classes")

    owned = materialise(classes.groupBy("block").agg(F.collect_list("node").alias("owned")).select("block", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("blob"), "owned"), "passage-owned")  # a block's classes
    stored = blocks.select("block", "own", "sizes", "bytes")
    asked = stored.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(_send_shingles(owners), _SENT)
    answers = materialise(asked.groupBy("part").applyInArrow(_flag_shared, _SENT), "passage-flags")
    spark_gc(spark)
    cut = stored.groupBy("block").cogroup(answers.union(owned).groupBy("block")).applyInArrow(_find_segments(owners, length), "sid long, node long, start long, good binary, hashes binary, steps binary")
    segments = materialise(cut.repartition(max(parallel, min(50_000, ceil(size / SEGMENT_BUCKET_BYTES))), "sid"), "passage-segments", by="sid", buckets=max(parallel, min(50_000, ceil(size / SEGMENT_BUCKET_BYTES))))
    for df in (blocks, answers, owned):
        discard(df)
    total = segments.agg(F.sum(F.length("hashes"))).first()[0] or 0
    found, labels = _passages(segments, length, total // 8 * 2 * HASHES // length)
    discard(segments)

    every = reduce(DataFrame.union, found)
    spans = every.select("node", F.inline("runs")).union(every.select(F.col("pnode").alias("node"), F.inline("runs_p"))).select("node", "start", (F.col("stop") + WIDTH - 1).alias("stop"))
    spans = spans.union(classes.where("copies > 1").select("node", F.lit(0).cast("long"), F.col("n") + WIDTH - 1))
    merged = _islands(spans, "node", "start", "stop", 0).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))  # at most a span a word
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    class_id = named.groupBy("label").agg(F.min("least").alias("class_id"))
    per_class = merged.join(named.select("node", "label"), "node").join(class_id, "label").drop("label")
    out = rows.select("row_key", "node").join(per_class, "node")
    return out.select(F.col("row_key").alias(key), "class_id", F.size("spans").cast("long").alias("n_passages"), _words_of("spans").alias("n_repeat_words"), _shown("spans").alias("spans"))


def _words_of(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])


def _shown(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
