"""Ranked lexical search: WAND over document shards, shard heaps merged.

One pass over the texts stores each document's length and its counts of query terms. From these come the global
figures and each term's weight. A second pass reads the counts as shards. A shard keeps inverted lists of impacts
(what a term adds to a document's score) with the largest impact of each. An item's lists are taken in order of
these; a document is a pivot if the maxima of the lists that hold it reach the heap's threshold, and only pivots
are scored. Pivots are selected for a whole shard at once with the threshold it starts with, which is safe because
thresholds only rise. A task carries its heaps from shard to shard and returns them once; they are merged in two levels.

Thresholds start at the last score that enters the result among about one in ``PRIMER`` documents: a lower bound of
the final one, so nothing that belongs to the result is skipped, and what tasks return hardly grows with their number.

Items come in blocks of about ``block_bytes`` of text (or one longer item); driver and executors hold one block's
terms at a time, whatever the size of the item table.

Defined cases: null and empty texts have no terms, are not counted and never found. Items without terms find nothing.
Repeated documents are found as often as they occur, repeated items have a ranking each. Equal scores rank by ascending
document id, null ids last. Very long texts are read whole, in slices of a text's bytes. Empty tables give an empty result.
Extra columns of both tables are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm._text import Block, slices, text_buffers
from assayer.llm._work import CACHES, materialise, releasing, ship
from assayer.llm.decontaminate import NO_WORD

#: Bytes of text hashed at a time.
SLICE_BYTES = 1 << 20
#: Counts of terms that a shard holds before it is searched (or those of one document).
SHARD_COUNTS = 1 << 21
#: One in so many documents sets the thresholds to begin with.
PRIMER = 32
#: Heaps of so many groups of tasks are merged first.
GROUPS = 64


class Terms:
    """The distinct terms of some items, numbered by their hashes' order, and each item's term numbers."""

    def __init__(self, texts: list[str]):
        data, off = text_buffers(pa.array(texts, pa.large_string()))
        block = Block(data, off, lower=True)
        starts, ends, doc = block.words(NO_WORD)
        self.hashes, number = np.unique(block.hashes(starts, ends), return_inverse=True)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.items = [np.unique(number[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are terms, and their numbers."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        number = np.searchsorted(self.hashes, hashes[at])
        ok = number < len(self.hashes)
        ok[ok] = self.hashes[number[ok]] == hashes[at][ok]
        return at[ok], number[ok]


def _terms(token: str, sent: Broadcast) -> Terms:
    cache = CACHES.setdefault("search", {})
    if token not in cache:
        cache.clear()
        cache[token] = Terms(sent.value[1])
    return cache[token]


def _count(token: str, sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document with a term: its key, number of terms, and the query terms among them with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _terms(token, sent)
        width = max(1, len(terms.hashes))
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for a, b in slices(off, SLICE_BYTES):
                block = Block(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
                starts, ends, doc = block.words(NO_WORD)
                n = np.bincount(doc, minlength=block.docs)
                at, number = terms.find(block.hashes(starts, ends))
                pairs, tf = np.unique(doc[at] * width + number, return_counts=True)
                keep = np.flatnonzero(n)
                bounds = pa.array(np.searchsorted(pairs // width, np.append(keep, block.docs)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (pairs % width, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(keep)), pa.array(n[keep]), *lists], ["row_key", "n", "terms", "tfs"])

    return releasing(run, "search")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What terms add to scores, of documents with ``n`` of all ``words``."""
    fits = not len(n) or 50 * int(n.max()) * documents < 1 << 63
    m = 50 + (50 * n * documents // words if fits else np.array([50 * x * documents // words for x in n.tolist()], np.int64))
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Shard:
    """Inverted lists of documents and impacts, with the largest impact of each list."""

    def __init__(self, keys: list, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_terms: int):
        order = np.argsort(terms, kind="stable")
        self.keys, self.docs, self.impact = keys, docs[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(self.bounds))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.bounds[held])

    def search(self, terms: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that reach ``threshold`` (at least 1), with their scores."""
        terms = terms[self.most[terms] > 0]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        most = self.most[terms]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # the maxima from each list on
        if rest[0] < threshold:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = int(np.searchsorted(-rest, -threshold, side="right"))  # lists from here on make no pivot among themselves
        bound = np.zeros(len(self.keys), np.int64)
        for t, x in zip(terms[:lead].tolist(), most.tolist(), strict=False):
            bound[self.docs[self.bounds[t] : self.bounds[t + 1]]] += x
        pivots = np.flatnonzero((bound > 0) & (bound + rest[lead] >= threshold))
        bound = bound[pivots]
        for i in range(lead, len(terms)):  # the other lists, from the highest maximum down, while they can decide
            docs = self.docs[self.bounds[terms[i]] : self.bounds[terms[i] + 1]]
            at = np.searchsorted(docs, pivots)
            at[at == len(docs)] = 0
            bound += np.where(docs[at] == pivots, most[i], 0)
            ok = bound + rest[i + 1] >= threshold
            pivots, bound = pivots[ok], bound[ok]
        score = np.zeros(len(pivots), np.int64)
        for t in terms.tolist():
            a, b = self.bounds[t], self.bounds[t + 1]
            at = np.searchsorted(self.docs[a:b], pivots)
            at[at == b - a] = 0
            score += np.where(self.docs[a:b][at] == pivots, self.impact[a:b][at], 0)
        ok = score >= threshold
        return pivots[ok], score[ok]


def _wand(token: str, sent: Broadcast, figures: Broadcast, top: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, (weight, documents, words, floors) = _terms(token, sent), figures.value
        heaps: list[list[tuple]] = [[] for _ in terms.items]
        least = list(floors)

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, lists = table.column("row_key").to_pylist(), table.column("terms").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            term, tf = lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            docs = np.repeat(np.arange(len(keys)), size)
            n = np.repeat(table.column("n").to_numpy(), size)
            shard = Shard(keys, term, docs, impacts(weight[term], tf, n, documents, words), len(weight))
            for i, own in enumerate(terms.items):
                found, score = shard.search(own, least[i])
                if len(found) > top:  # ties of the last place stay
                    ok = score >= np.partition(score, -top)[-top]
                    found, score = found[ok], score[ok]
                if len(found):
                    new = [(-s, keys[d] is None, keys[d]) for d, s in zip(found.tolist(), score.tolist(), strict=True)]
                    heaps[i] = heapq.nsmallest(top, heaps[i] + new, key=lambda x: x if not x[1] else x[:2])
                    if len(heaps[i]) == top:
                        least[i] = max(least[i], -heaps[i][-1][0])

        held, counts = [], 0
        for batch in batches:
            held.append(batch)
            counts += len(batch.column("terms").flatten())
            if counts >= SHARD_COUNTS:
                search(held)
                held, counts = [], 0
        if held:
            search(held)
        rows = [{"item_no": i, "item": sent.value[0][i], "row_key": k, "score": -s} for i, heap in enumerate(heaps) for s, _, k in heap]
        yield pa.RecordBatch.from_pylist(rows, schema)

    return releasing(run, "search")


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item with their ``rank``, first within groups of tasks."""
    order = [F.desc("score"), F.asc_nulls_last("row_key")]
    first = Window.partitionBy("item_no", "group").orderBy(*order)
    some = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_no").orderBy(*order))).where(F.col("rank") <= top)


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 50, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20
) -> DataFrame:
    """The ``top`` best documents of each item: item key, rank (from 1), document key and score."""
    spark = docs.sparkSession
    ship(spark)
    asked = items.select(F.col(f"`{item_key}`").alias("k"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t IS NOT NULL")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / block_bytes))
    rows = docs.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind, item_kind = dict(rows.dtypes)["row_key"], dict(asked.dtypes)["k"]
    out = []
    for b in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)).collect()  # about ``block_bytes`` of text
        sent = spark.sparkContext.broadcast(([r["k"] for r in own], [r["t"] for r in own]))
        token = uuid.uuid4().hex
        n_terms = len(Terms(sent.value[1]).hashes)
        stored = materialise(rows.mapInArrow(_count(token, sent), f"row_key {kind}, n long, terms array<int>, tfs array<int>"), "search-counts")
        documents, words = stored.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(n_terms, np.int64)
        for r in stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # at most the block's terms
            df[r["term"]] = r["df"]
        figures = (weights(df, documents), documents, max(1, words or 0))
        made = f"item_no int, item {item_kind}, row_key {kind}, score long"
        schema = pa.schema([("item_no", pa.int32()), ("item", _arrow(item_kind)), ("row_key", _arrow(kind)), ("score", pa.int64())])

        def heaps(counts: DataFrame, floors: list[int], token=token, sent=sent, figures=figures, made=made, schema=schema) -> DataFrame:
            return counts.mapInArrow(_wand(token, sent, spark.sparkContext.broadcast((*figures, floors)), top, schema), made)

        primer = stored.where(F.pmod(F.xxhash64("row_key", "n"), F.lit(PRIMER)) == 0)
        last = _best(heaps(primer, [1] * len(own)), top).where(F.col("rank") == top).select("item_no", "score").collect()  # a row an item
        floors = [1] * len(own)
        for r in last:
            floors[r["item_no"]] = r["score"]
        out.append(_best(heaps(stored, floors), top).select(F.col("item").alias(item_key), "rank", F.col("row_key").alias(key), "score"))
    return reduce(DataFrame.unionAll, out)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
