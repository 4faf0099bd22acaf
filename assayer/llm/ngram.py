"""N-gram scores from an Elias-Fano trie that is spread over partitions.

Texts are kept in blocks, in a table bucketed by block: their bytes are never shuffled, and what the
owners answer goes to where the blocks lie. A block sends its distinct words, and later its distinct trigrams, once
to the partitions that own them, and gets back counts over all training texts. An owner
of trigrams builds a trie of its contexts: a level of words v with monotone pointers to their
successors w, and a level of pairs (u, v) with monotone pointers to successors which are coded
relative to the successors of v. All levels are Elias-Fano sequences with quantised counts, memory-mapped
from the task's own folder, and queries are answered by successor search. Very common words v are
divided among owners by w, so no owner holds more than its share of trigrams.

With counts c over training texts, a text's probability multiplies, over its tokens w after u v,
p3 = (c(uvw) + m p2) / (c(uv) + m), p2 = (c(vw) + m p1) / (c(v) + m) and p1 = (c(w) + 0.5) / (N + 0.5 (V + 1)).
Counts to 127 are exact; larger ones are quantised to within 0.04 %.

Null and empty texts have one token, the end. Repeated rows count as often as they occur; rows without
a key are training texts. A text longer than a block is a block. Extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._text import Block, mix, slices, text_buffers
from assayer.llm._work import materialise, ship, spark_gc
from assayer.llm.eliasfano import EliasFano

BLOCK_BYTES = 12 << 20
SLICE_BYTES = 1 << 20
#: Text bytes for each owner partition, and the share of an owner's tokens from which a word is divided.
OWNER_BYTES, HOT_SHARE = 8 << 20, 0.25
END = np.uint64(0x9D5C3A1F00000001)
PRIOR = 2.0


def _squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _expand(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them, by a hash table: only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[coded.indices.to_numpy(zero_copy_only=False)]


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = _squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), len(planes).to_bytes(8, "little"), planes]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(int.from_bytes(blob[:4], "little")):
        dtype = np.dtype(blob[at : at + 4].decode().strip())
        n, size = int.from_bytes(blob[at + 4 : at + 12], "little"), int.from_bytes(blob[at + 12 : at + 20], "little")
        at += 20
        if n:
            out.append(np.ascontiguousarray(np.frombuffer(_expand(blob[at : at + size], n * dtype.itemsize), np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel())
        else:
            out.append(np.zeros(0, dtype))
        at += size
    return out


def quantise(counts: np.ndarray) -> np.ndarray:
    """16-bit codes: counts to 127 as they are, larger ones on a logarithmic scale."""
    counts = counts.astype(np.float64)
    return np.where(counts < 128, counts, 128 + np.round(np.log2(np.maximum(counts, 128) / 128) * 1024)).astype("<u2")


def dequantise(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes < 128, codes, 128 * 2 ** ((codes - 128) / 1024))


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (block, keys, train, offsets, bytes) of whole texts, about ``BLOCK_BYTES`` each."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, nr = TaskContext.get().partitionId() << 32, 0
        keys, train, parts, sizes, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            flags = pa.array([np.packbits(np.array(train, bool)).tobytes()], pa.binary())
            blob = pa.array([_squeeze(b"".join(parts))], pa.binary())
            column = pa.concat_arrays(keys)
            names = ["block", "keys", "train", "sizes", "bytes"]
            return pa.RecordBatch.from_arrays([pa.array([base + nr], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), flags, pa.array([_pack(np.concatenate(sizes))], pa.binary()), blob], names=names)

        for batch in batches:
            data, off = text_buffers(batch.column(2))
            flags = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(off, BLOCK_BYTES // 4):
                if held and held + off[b] - off[a] > BLOCK_BYTES:
                    yield flush()
                    nr, keys, train, parts, sizes, held = nr + 1, [], [], [], [], 0
                keys.append(batch.column(0).slice(a, b - a)), train.extend(flags[a:b].tolist())
                parts.append(data[off[a] : off[b]].tobytes()), sizes.append(np.diff(off[a : b + 1]))
                held += off[b] - off[a]
        if keys:
            yield flush()

    held_out = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.col(key), (~held_out).alias("train"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"block long, keys array<{kind}>, train binary, sizes binary, bytes binary")


class _Tokens:
    """The tokens of a block as hashes, their distinct words and which token is for training."""

    def __init__(self, row: dict):
        sizes = _unpack(row["sizes"])[0]
        self.docs = len(sizes)
        self.train = np.unpackbits(np.frombuffer(row["train"], np.uint8))[: self.docs].astype(bool)
        off = np.append(0, np.cumsum(sizes))
        data = np.frombuffer(_expand(row["bytes"], int(off[-1])), np.uint8)
        parts, counts = [], []
        for a, b in slices(off, SLICE_BYTES):
            block = Block(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
            starts, ends, doc = block.words()
            out = np.full(len(starts) + block.docs, END)
            out[np.arange(len(starts)) + doc] = block.hashes(starts, ends)
            parts.append(out), counts.append(np.bincount(doc, minlength=block.docs) + 1)
        self.lengths = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.words, self.at = _distinct(tokens)
        self.training = np.repeat(self.train, self.lengths)
        self.first = np.append(0, np.cumsum(self.lengths))[:-1]

    def owner(self, owners: int) -> np.ndarray:
        return (mix(self.words ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(owners)).astype(np.int64)

    def trigrams(self, hot: np.ndarray, owners: int) -> tuple[np.ndarray, ...]:
        """Distinct (v, u, w) as word indices from 1 (0: before the text), each token's trigram, and the owner of each."""
        w = self.at + 1
        v, u = np.append(0, w[:-1]), np.concatenate([[0, 0], w[:-2]])[: len(w)]
        v[self.first] = 0
        u[self.first] = 0
        second = self.first[self.lengths > 1] + 1
        u[second] = 0
        if len(self.words) < (1 << 21) - 1:
            key, which = np.unique((v << 42) | (u << 21) | w, return_inverse=True)
            v, u, w = key >> 42, (key >> 21) & ((1 << 21) - 1), key & ((1 << 21) - 1)
        else:
            rows, which = np.unique(np.stack([v, u, w], axis=1), axis=0, return_inverse=True)
            v, u, w, which = rows[:, 0], rows[:, 1], rows[:, 2], which.ravel()
        name = np.append(np.uint64(1), self.words)
        parts = np.append(1, hot)[v].astype(np.uint64)
        if len(self.words):
            parts[v == 0] = hot[np.searchsorted(self.words, END)]  # texts begin as often as they end
        salt = np.where(parts > 1, mix(name[w]) % parts, 0)
        return v, u, w, which, (mix(name[v] ^ mix(salt + np.uint64(11))) % np.uint64(owners)).astype(np.int64)


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _frame(block, part, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], names=["block", "part", "blob"])


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(owner, kind="stable")
    for g in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
        if len(g):
            yield int(owner[g[0]]), g


def _send_words(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = _Tokens(row)
                counts = np.bincount(t.at[t.training], minlength=len(t.words))
                for p, g in _by_owner(t.owner(owners)):
                    words = t.words[g]  # sorted, as np.unique sorts
                    yield _frame([row["block"]], [p], [_pack(np.diff(words, prepend=np.uint64(0)), counts[g].astype("<u4"))])

    return run


def _count_words(owners: int):
    """Word counts over all blocks; answers every block in its order with word numbers and counts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        sent = [_unpack(b) for b in table.column("blob").to_pylist()]
        words = [np.cumsum(d, dtype=np.uint64) for d, _ in sent]
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c for _, c in sent]), minlength=len(every)).astype(np.int64)
        rank = np.empty(len(every), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(every))
        number = rank * owners + part + 1
        edges = np.cumsum([len(w) for w in words])[:-1]
        answers = [_pack(number[i], total[i]) for i in np.split(at, edges)]
        stats = _pack(np.array([int((total > 0).sum()), int(total.sum())], np.int64))
        return pa.table({"block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(sent) + 1), pa.int32()), "blob": pa.array([*answers, stats], pa.binary())})

    return run


def _answers(table: pa.Table, owner: np.ndarray, columns: int) -> list[np.ndarray]:
    """Puts the owners' answers, each in the block's order, back on the block's distinct entries."""
    out = [np.zeros(len(owner), np.int64) for _ in range(columns)]
    blobs = dict(zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True))
    for p, g in _by_owner(owner):
        for o, a in zip(out, _unpack(blobs[p]), strict=True):
            o[g] = a
    return out


def _hot(counts: np.ndarray, tokens: int, owners: int) -> np.ndarray:
    """Owners among which a word's trigrams are divided."""
    return np.maximum(1, np.minimum(owners, np.ceil(counts * owners / max(tokens, 1) / HOT_SHARE))).astype(np.int64)


def _send_trigrams(owners: int, tokens: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in _rows(left):
            t = _Tokens(row)
            number, count = _answers(right, t.owner(owners), 2)
            v, u, w, which, owner = t.trigrams(_hot(count, tokens, owners), owners)
            seen = np.bincount(which[t.training], minlength=len(v))
            ids = np.append(0, number)
            for p, g in _by_owner(owner):
                a, b, c = ids[v[g]], ids[u[g]], ids[w[g]]
                turn = np.diff(a, prepend=0)
                wide = "<i8" if number.max(initial=0) >= 1 << 31 else "<i4"
                out.append(_frame([row["block"]], [p], [_pack(turn.astype(wide), b.astype(wide), c.astype(wide), np.minimum(seen[g], 0xFFFFFFFF).astype("<u4"))]))
        return pa.Table.from_batches(out) if out else pa.table({"block": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})

    return run


class Trie:
    """Contexts v with successors w, and contexts (v, u) with successors relative to those of v."""

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, folder: str):
        def store(a: np.ndarray) -> np.ndarray:
            if not a.nbytes:
                return a
            path = f"{folder}/{uuid.uuid4().hex}"
            a.tofile(path)
            return np.memmap(path, a.dtype, "r")

        # the trigrams come distinct and sorted by v, u, w, so that only the (v, w) pairs are sorted here
        self.wide = int(max(w.max(initial=0), u.max(initial=0))) + 1
        new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
        self.contexts, vi = v[new], np.cumsum(new) - 1
        pair, where = np.unique(vi * self.wide + w, return_inverse=True)
        self.successors = EliasFano.build(pair, len(self.contexts) * self.wide + 1, store)
        self.second = store(quantise(np.bincount(where, weights=count, minlength=len(pair))))
        starts = np.searchsorted(pair, np.arange(len(self.contexts) + 1) * self.wide)
        self.pointers = EliasFano.build(starts, len(pair) + 1, store)
        rank = where - starts[vi]
        self.span = int(np.diff(starts).max(initial=0)) + 1
        new[1:] |= u[1:] != u[:-1]
        before = (vi * self.wide + u)[new]
        self.pairs = EliasFano.build(before, len(self.contexts) * self.wide + 1, store)
        self.last = EliasFano.build((np.cumsum(new) - 1) * self.span + rank, len(before) * self.span + 1, store)
        self.third = store(quantise(count))

    def counts(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantised c(vw) and c(uvw)."""
        two, three = np.zeros(len(v), "<u2"), np.zeros(len(v), "<u2")
        if not len(self.contexts):
            return two, three
        vi = np.minimum(np.searchsorted(self.contexts, v), len(self.contexts) - 1)
        known = np.flatnonzero((self.contexts[vi] == v) & (w < self.wide))
        at = self.successors.find(vi[known] * self.wide + w[known])
        known, at = known[at >= 0], at[at >= 0]
        two[known] = self.second[at]
        rank = at - self.pointers.get(vi[known])
        ok = u[known] < self.wide
        known, rank = known[ok], rank[ok]
        pair = self.pairs.find(vi[known] * self.wide + u[known])
        known, rank, pair = known[pair >= 0], rank[pair >= 0], pair[pair >= 0]
        hit = self.last.find(pair * self.span + rank)
        three[known[hit >= 0]] = self.third[hit[hit >= 0]]
        return two, three


def _trigram_order(v: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order by v, u, w: of one key where all three fit into it, with v by rank, since an owner has few of them."""
    contexts, rank = _distinct(v)
    wide, low = int(u.max(initial=0)).bit_length(), int(w.max(initial=0)).bit_length()
    if len(contexts).bit_length() + wide + low < 64:
        return np.argsort((rank << wide | u) << low | w)
    return np.lexsort((w, u, rank))


def _count_trigrams(table: pa.Table) -> pa.Table:
    sent = []
    for b in table.column("blob").to_pylist():
        turn, u, w, seen = _unpack(b)
        sent.append((np.cumsum(turn.astype(np.int64)), u.astype(np.int64), w.astype(np.int64), seen.astype(np.int64)))
    edges = np.cumsum([len(x[0]) for x in sent])[:-1]
    v, u, w, seen = map(np.concatenate, zip(*sent, strict=True))
    del sent
    order = _trigram_order(v, u, w)
    v, u, w = v[order], u[order], w[order]
    new = np.append(True, (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1]))
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    v, u, w, seen = v[new], u[new], w[new], np.bincount(at, weights=seen).astype(np.int64)
    some = seen > 0
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(v[some], u[some], w[some], seen[some], folder)
        two, three = trie.counts(v, u, w)
        del trie
    answers = [_pack(two[i], three[i]) for i in np.split(at, edges)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "blob": pa.array(answers, pa.binary())})


def _score(owners: int, tokens: int, kinds: int, key: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words, trigrams = right.filter(pc.equal(right.column("level"), 1)), right.filter(pc.equal(right.column("level"), 3))
        out = []
        for i, row in enumerate(_rows(left)):
            t = _Tokens(row)
            _, count = _answers(words, t.owner(owners), 2)
            v, _, _, which, owner = t.trigrams(_hot(count, tokens, owners), owners)
            two, three = _answers(trigrams, owner, 2)
            c2, c3 = dequantise(two)[which], dequantise(three)[which]
            c1 = count[t.at].astype(np.float64)
            context = np.append(0.0, c1[:-1])
            context[t.first] = count[np.searchsorted(t.words, END)] if t.docs else 0  # every training text begins once
            pair = np.append(0.0, c2[:-1])
            pair[t.first] = context[t.first]
            p1 = (c1 + 0.5) / (tokens + 0.5 * (kinds + 1))
            p2 = (c2 + PRIOR * p1) / (np.maximum(context, c2) + PRIOR)
            p3 = (c3 + PRIOR * p2) / (np.maximum(pair, c3) + PRIOR)
            add = lambda x: np.add.reduceat(x, t.first) if t.docs else np.zeros(0)
            out.append(pa.table({
                key: left.column("keys").chunk(0).slice(i, 1).flatten() if left.column("keys").num_chunks == 1 else left.column("keys").combine_chunks().slice(i, 1).flatten(),
                "held_out": pa.array(~t.train), "n_tokens": pa.array(t.lengths, pa.int64()), "n_known": pa.array(add((c1 > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(t.docs, tokens), pa.int64()), "base_score": pa.array(add(np.log10(p1)), pa.float64()), "score": pa.array(add(np.log10(p3)), pa.float64()),
            }))
        return pa.concat_tables(out)

    return run


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialise(text_blocks(docs, key, text), "lm-blocks", by="block", buckets=min(50_000, max(parallel, ceil(size / BLOCK_BYTES))))
    owners = max(parallel, ceil(size / OWNER_BYTES))
    schema = "block long, part int, blob binary"
    words = materialise(blocks.mapInArrow(_send_words(owners), schema).groupBy("part").applyInArrow(_count_words(owners), schema), "lm-words")
    kinds = tokens = 0
    for r in words.where("block = -1").select("blob").collect():  # one row an owner
        a = _unpack(r["blob"])[0]
        kinds, tokens = kinds + int(a[0]), tokens + int(a[1])
    words = words.where("block >= 0")
    spark_gc(spark)
    asked = blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_send_trigrams(owners, tokens), schema)
    trigrams = materialise(asked.groupBy("part").applyInArrow(_count_trigrams, schema), "lm-trigrams")
    spark_gc(spark)
    answers = words.withColumn("level", F.lit(1)).union(trigrams.withColumn("level", F.lit(3)))
    out = f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(owners, tokens, kinds, key), out)
