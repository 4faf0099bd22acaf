"""Exact Jaccard self-join of shingle sets by a size-aware heavy-light plan.

Sets that are equal form one class. Shingles are ordered from rare to common by a counting sketch
of fixed size, an order that all tasks share. Two linked sets of n shingles agree in at least
c = ceil(0.75 n) of them, so:

* light sets (n up to a boundary) enumerate the pairs of their first n - c + 2 shingles: two linked
  light sets share one such fixed-size subset;
* heavy sets scan the inverted lists of their first n - c + 1 shingles. Light sets that are large
  enough to link with a heavy one are in these lists too.

The boundary is the size up to which enumeration costs less than scanning lists of the measured
mean length. In a few rounds every list first compares its members with one pivot, on whole texts;
lists whose members are then connected are finished, and only pairs across components are
enumerated, filtered by size, position and bitmap, and verified. No link is lost, and a group of
copies costs a number of pairs in proportion to its size. The lists of very common shingles are
packed in several buckets; whether such a list has two classes is decided over all its buckets.

The texts of the classes that share a list are shuffled once, into a table bucketed by class, which
all verifications read in place.

64-bit hashes stand for shingles (two different ones are equal with probability 2^-64).
Null and empty texts have no shingles and link with nothing. Repeated rows are equal sets. Rows
without a key link like others, and a component of such rows alone has a null id. Very long texts
are hashed in pieces of a block and take part as a whole. Extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._text import Block, mix, shingle_sets, slices, text_buffers
from assayer.llm._work import discard, materialise, releasing, ship, spark_gc
from assayer.llm.components import connected_components

BLOCK_BYTES = 1 << 20
SKETCH_BITS = 22
SKETCH_SLICES = 64
#: Postings of one bucket, and classes by the sketch for each salt of a shingle's list.
BUCKET_POSTINGS, HOT_LIST = 400_000, 50_000
#: Postings that a task gathers before it packs them.
FLUSH_POSTINGS = 600_000
#: Bit of a packed position that marks a salted list's posting; larger positions are held as the one below it.
SALTED = 1 << 15
MAX_LIGHT = 40
#: 64-bit words of a set's parity bitmap, and rounds of pivots before the remaining pairs are enumerated.
BITMAP_WORDS, PIVOT_ROUNDS = 4, 2
#: Bits of the filter of classes that share a list (4 MB), and text bytes for each bucket of the class texts.
FILTER_BITS, TEXT_BUCKET_BYTES = 25, 64 << 20
#: The pivot rounds look at two in so many lists (subset keys are odd, single ones even).
PIVOT_SHARE = 16


def required(n: int) -> int:
    """Shingles that a set of ``n`` shares with any set it links to, at least."""
    return -(-3 * n // 4)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, off = text_buffers(column)
    for a, b in slices(off, BLOCK_BYTES):
        yield from shingle_sets(Block(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True), width)


def _class(s: np.ndarray) -> int:
    """A 64-bit name of a set; 0 is the empty set."""
    if not len(s):
        return 0
    both = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s)), len(s)], np.uint64)
    return int(mix(mix(mix(both[:1]) + both[1:2]) + both[2:])[0].astype(np.int64)) or 1


def set_classes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Rows (row_key, node, n) of all documents, and slices of the shingle-count sketch (slice, counts)."""
    kind = dict(docs.dtypes)[key]
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_key", "node", "n", "slice", "counts"]
        sketch, waiting, held, keys_type = np.zeros(1 << SKETCH_BITS, np.int64), [], 0, types.get(kind, pa.int64())
        seen = set()  # the sketch counts classes, once a task, so that copies do not saturate it

        def count() -> None:
            nonlocal sketch
            if waiting:
                at = np.concatenate(waiting) & np.uint64(len(sketch) - 1)
                sketch += np.bincount(at.astype(np.int64), minlength=len(sketch))

        for batch in batches:
            node, n = [], []
            keys_type = batch.column(0).type
            for s in _sets(batch.column(1), width):
                node.append(_class(s)), n.append(len(s))
                if node[-1] in seen:
                    continue
                seen.add(node[-1]), waiting.append(s)
                held += len(s)
                if held > 1 << 21:
                    count()
                    waiting, held = [], 0
            rows = len(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        count()
        parts = np.minimum(sketch, 0xFFFFFFFF).astype("<u4").reshape(SKETCH_SLICES, -1)
        some = [i for i in range(SKETCH_SLICES) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), keys_type), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())], names=names)

    rows = docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), f"row_key {kind}, node long, n long, slice int, counts binary")


def sum_sketch(slices_: DataFrame) -> np.ndarray:
    """The sketch over all tasks: 2 ** SKETCH_BITS 32-bit counters, whatever the input's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
                total[i] = total[i] + part if i in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.uint32)
    for r in slices_.repartition(SKETCH_SLICES, "slice").mapInArrow(releasing(run), "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def mean_list(sketch: np.ndarray) -> float:
    """The mean length of a posting's list, summed in slices, so that the driver holds no second copy of the sketch."""
    total = squares = 0.0
    for at in range(0, len(sketch), 1 << 16):
        part = sketch[at : at + (1 << 16)].astype(np.float64)
        total, squares = total + float(part.sum()), squares + float((part**2).sum())
    return squares / total if total else 1.0


def light_boundary(sizes: dict[int, int], mean_list: float, scan_cost: float = 0.1) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning lists."""
    best, light, heavy = 2, 0.0, 0.0
    for n in range(3, MAX_LIGHT + 1):
        spare = n - required(n)
        light += sizes.get(n, 0) * comb(spare + 2, 2)
        heavy += sizes.get(n, 0) * (spare + 1) * (1 + scan_cost * max(0.0, mean_list - 1) / 2)
        if light <= heavy and comb(spare + 2, 2) <= (spare + 1) * (1 + scan_cost * max(0.0, mean_list - 1) / 2):
            best = n
    return best


def postings(docs: DataFrame, shared: Broadcast, boundary: int, buckets: int, text: str, width: int) -> DataFrame:
    """(bucket, blob): packed signatures of the classes of each task; copies within a task are sent once. ``shared`` is the sketch."""

    def blobs(keys, node, n, pos, bucket) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        groups = [g for g in np.split(order, edges) if len(g)]  # none if no shingle is in two sets
        out = []
        for g in groups:
            nodes, index = np.unique(node[g], return_inverse=True)
            sizes = np.zeros(len(nodes), "<u4")
            sizes[index] = n[g]
            head = np.array([len(nodes), len(g)], "<i8").tobytes()
            out.append(head + nodes.astype("<i8").tobytes() + sizes.tobytes() + keys[g].astype("<u8").tobytes() + index.astype("<u4" if len(nodes) > 0xFFFF else "<u2").tobytes() + pos[g].astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        parts, held = [], 0
        mask = np.uint64(len(counts) - 1)

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                keys, node, n, pos, hot = map(np.concatenate, zip(*parts, strict=True))
                salt = np.where(hot > 1, mix(node.astype(np.uint64)) % np.maximum(hot, 1).astype(np.uint64), 0)
                pos = np.minimum(pos, SALTED - 1) + (hot > 1) * SALTED
                yield from blobs(keys, node, n, pos, (mix(keys ^ mix(salt.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64))

        for batch in batches:
            for s in _sets(batch.column(0), width):
                size = len(s)
                name = _class(s)
                if size < 3 or name in seen:  # one and two shingles link with equal sets only
                    continue
                seen.add(name)
                count = counts[(s & mask).astype(np.int64)]
                order = np.argsort(count, kind="stable")  # s is sorted: ties by hash
                spare = size - required(size)
                if size <= boundary:
                    first = s[order[: spare + 2]]
                    i, j = np.triu_indices(len(first), 1)
                    k = mix(first[i] * np.uint64(3) + mix(first[j])) | np.uint64(1)  # subset keys are odd
                    parts.append((k, np.full(len(k), name), np.full(len(k), size), i, np.ones(len(k), np.int64)))
                    held += len(k)
                if 4 * size > 3 * boundary:
                    keep = order[: spare + 1]
                    place = np.flatnonzero(count[keep] > 1)  # a count of one: no other set has it
                    k = s[keep[place]] & ~np.uint64(1)
                    hot = -(-count[keep[place]].astype(np.int64) // HOT_LIST)
                    parts.append((k, np.full(len(k), name), np.full(len(k), size), place, hot))
                    held += len(k)
                if held > FLUSH_POSTINGS:
                    yield from flush()
                    parts, held = [], 0
        yield from flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(releasing(run), "bucket int, blob binary")


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    cols = []
    for b in blobs:
        m, k = np.frombuffer(b, "<i8", 2)
        at = 16
        nodes = np.frombuffer(b, "<i8", m, at)
        sizes = np.frombuffer(b, "<u4", m, at + 8 * m)
        at += 12 * m
        keys = np.frombuffer(b, "<u8", k, at)
        wide = m > 0xFFFF
        index = np.frombuffer(b, "<u4" if wide else "<u2", k, at + 8 * k)
        pos = np.frombuffer(b, "<u2", k, at + (12 if wide else 10) * k)
        cols.append((keys, nodes[index], sizes[index].astype(np.int32), pos.astype(np.int32)))
    return tuple(np.concatenate(c) for c in zip(*cols, strict=True))


def _lists():
    """Inverted lists of two or more classes, and all postings of salted lists: other buckets may hold their other classes."""

    def run(table: pa.Table) -> pa.Table:
        keys, node, n, pos = _unpack(table.column("blob").to_pylist())
        order = np.lexsort((node, n, keys))
        keys, node, n, pos = keys[order], node[order], n[order], pos[order]
        again = (keys[1:] == keys[:-1]) & (node[1:] == node[:-1])
        keep = np.append(True, ~again)
        keys, node, n, pos = keys[keep], node[keep], n[keep], pos[keep]
        run_of = np.cumsum(np.append(False, keys[1:] != keys[:-1]))
        length = np.bincount(run_of)
        keep = (length[run_of] > 1) | (pos >= SALTED)
        keys, node, n, pos = keys[keep], node[keep], n[keep], pos[keep]
        return pa.table({"k": keys.astype(np.int64), "node": node, "n": n.astype(np.int32), "pos": (pos % SALTED).astype(np.int32), "salted": pos >= SALTED})

    return run


def _whole_lists(lists: DataFrame) -> DataFrame:
    """Salted lists of one class over all their buckets are dropped; the others are whole already."""
    salted = lists.where("salted")
    if salted.isEmpty():
        return _stored(lists.drop("salted"), lists)
    two = salted.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("k")
    out = materialise(lists.where("not salted").union(salted.join(two, "k", "left_semi").select(*lists.columns)).drop("salted"), "set-lists")
    discard(lists)
    return out


def _stored(df: DataFrame, as_: DataFrame) -> DataFrame:
    """``df``, discarded with the table ``as_`` which it reads."""
    df._stored_at = as_._stored_at
    return df


def _class_texts(docs: DataFrame, shared: DataFrame, text: str, width: int, buckets: int) -> DataFrame:
    """(node, text, bits) of the classes of ``shared``, bucketed by node; a filter of fixed size keeps most other texts from the shuffle."""
    spark, low = docs.sparkSession, (1 << FILTER_BITS) - 1
    bit = F.col("node").bitwiseAND(F.lit(low)) + 1
    maps = shared.groupBy(F.bitmap_bucket_number(bit).alias("nr")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    filter_ = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in maps.collect():  # 2 ** FILTER_BITS bits at most
        part = np.frombuffer(r["bits"], np.uint8)
        filter_[(r["nr"] - 1) * len(part) : r["nr"] * len(part)] = part
    known = spark.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            node, keep, bits = [], [], []
            for i, s in enumerate(_sets(batch.column(0), width)):
                name = _class(s)
                if name in seen or not known.value[(name & low) >> 3] >> (name & 7) & 1:
                    continue
                seen.add(name), node.append(name), keep.append(i), bits.append(_bits(s))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), batch.column(0).take(pa.array(keep, pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["node", "text", "bits"])

    texts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(releasing(run), "node long, text string, bits array<long>")
    texts = texts.repartition(buckets, "node").join(shared.select("node"), "node", "left_semi").dropDuplicates(["node"])
    out = materialise(texts, "set-texts", by="node", buckets=buckets)
    known.destroy()
    return out


def _bits(s: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles by hash: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((mix(s) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link: 100 * intersection >= 75 * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for at in range(0, len(a), 64):
                others = list(_sets(batch.column(3).slice(at, 64), width))
                for i, other in enumerate(others, at):
                    if a[i] != last:
                        last, own = a[i], next(_sets(batch.column(2).slice(i, 1), width))
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * both >= 75 * (len(own) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    # members meet their texts where these lie; the pivots' texts go to the pairs, where a pivot of many pairs can be split
    pivots = materialise(texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", "text"), "set-pivots")
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(pivots.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    out = materialise(two.select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), "a long, b long"), "set-links")
    discard(pivots)
    return out


def jaccard_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """One row a document: key, n_shingles, component_id (smallest key that links reach, itself included)."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    made = materialise(set_classes(docs, key, text, width), "set-classes")
    rows = made.where("slice is null").select("row_key", "node", "n")
    sketch = sum_sketch(made.where("slice is not null").select("slice", "counts"))
    sizes = {r["n"]: r["count"] for r in rows.where(F.col("n").between(3, MAX_LIGHT)).groupBy("n").count().collect()}
    boundary = light_boundary(sizes, mean_list(sketch))
    heavy = F.when(4 * F.col("n") > 3 * boundary, F.floor(F.col("n") / 4) + 1).otherwise(0)
    held = (rows.agg(F.sum(heavy)).first()[0] or 0) + sum(c * comb(n - required(n) + 2, 2) for n, c in sizes.items() if n <= boundary)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parallel, ceil(held / BUCKET_POSTINGS))

    sent = spark.sparkContext.broadcast(sketch)  # 2 ** SKETCH_BITS counters
    del sketch
    packed = postings(docs, sent, boundary, buckets, text, width)
    lists = _whole_lists(materialise(packed.groupBy("bucket").applyInArrow(_lists(), "k long, node long, n int, pos int, salted boolean"), "set-lists"))
    sent.destroy()
    spark_gc(spark)
    shared = materialise(lists.groupBy("node").agg(F.count(F.lit(1)).alias("f")), "set-shared")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    texts = _class_texts(docs, shared, text, width, min(50_000, max(parallel, ceil(size / TEXT_BUCKET_BYTES))))
    spark_gc(spark)

    # members against one pivot a list, over a share of the lists: copies have many lists in common, and
    # what these rounds do not link is left to the join below, which takes all lists
    some = materialise(lists.where(F.pmod("k", F.lit(PIVOT_SHARE)) < 2).join(shared, "node").withColumn("label", F.col("node")), "set-lists")
    links = tried = None
    for turn in range(PIVOT_ROUNDS):
        rank = F.struct("f", -F.col("n"), "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "n", "node")
        pivot = some.groupBy("k").agg(F.max(F.struct(rank.alias("rank"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))).alias("p"))
        star = some.join(pivot.select("k", "p.a", "p.na", "p.la"), "k").where("label <> la and 4 * least(n, na) >= 3 * greatest(n, na)")
        star = star.select("a", F.col("node").alias("b")).distinct()
        star = materialise(star if tried is None else _untried(star, tried), "set-star")
        found = _verify(star, texts, width)
        links, tried = (found, star) if links is None else (links.union(found), tried.union(star))
        labels = materialise(connected_components(links), "set-labels")
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        spark_gc(spark)
        if turn + 1 < PIVOT_ROUNDS:
            some = _open_lists(some, labels)
    discard(some), discard(shared)
    lists = _open_lists(lists, labels)

    # what still shares a list but no component: all pairs that size, position and bitmap allow
    held = lists.join(texts.select("node", "bits"), "node")
    x = held.select("k", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"), F.col("bits").alias("ba"))
    y = held.select("k", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"), F.col("bits").alias("bb"))
    both = F.col("na") + F.col("nb")
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    apart = sum((F.bit_count(F.col("ba")[i].bitwiseXOR(F.col("bb")[i])) for i in range(BITMAP_WORDS)), F.lit(0))
    near = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (7 * left >= 3 * both)
    pairs = x.join(y, "k").where(near & (7 * apart <= both)).select("a", "b").distinct()
    pairs = materialise(_untried(pairs, tried), "set-star")
    more = _verify(pairs, texts, width)
    labels = materialise(connected_components(links.union(more)), "set-labels")

    least = rows.groupBy("node").agg(F.min("row_key").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    component = least.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = least.join(component, "label").select("node", "component_id")
    out = rows.join(classes, "node", "left")
    for df in (lists, texts, pairs):
        discard(df)
    alone = F.col("n") == 0
    return out.select(F.col("row_key").alias(key), F.col("n").alias("n_shingles"), F.when(alone, F.col("row_key")).otherwise(F.col("component_id")).alias("component_id"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs that were not compared, in either order."""
    done = tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(done, ["lo", "hi"], "left_anti").select("a", "b")


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold more than one component, with their members' labels."""
    marked = lists.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = marked.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("k")
    out = materialise(marked.join(open_, "k", "left_semi"), "set-lists")
    discard(lists)
    return out
