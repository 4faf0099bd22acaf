"""Balanced shards by sampled splitters, in DataFrame functions only.

Every record has a key (a hash of its text, so that equal texts are neighbours) and a second key
(a hash of its id). A size-weighted sample of (key, second key) pairs gives quantile splitters for
many more ranges than shards. The exact bytes of every range are then counted; a range that holds
more than twice its share is subdivided by the second key until its parts fit. Running sums over
the ranges and within each range place every record on one line of bytes, which is cut into equal
pieces: shards differ by at most about one record's size.

Null texts count no bytes, null keys are hashed like any value, repeated rows are placed one by one, and an
empty table gives an empty one. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm._work import materialise

#: Bits of the key that look up the splitters of a slot.
SLOT_BITS = 12


def record_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """The id, size, CRC-32 and the two range keys of each record, without its text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(t) + overhead).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("k1"),
        F.xxhash64(F.col(key), F.lit("second")).alias("k2"),
    )


def sample_splitters(records: DataFrame, ranges: int, per_range: int = 16, seed: int = 7) -> list[tuple[int, int]]:
    """At most ``ranges`` - 1 quantiles of (k1, k2), from about ``ranges * per_range`` records drawn in proportion to size."""
    total = records.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    want = ranges * per_range
    uniform = (F.xxhash64("k1", "k2", "text_crc32", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
    # A record larger than a stratum counts once for every whole stratum it covers.
    copies = F.floor(F.col("size") * F.lit(want / total) + uniform).cast("int")
    drawn = records.select("k1", "k2", copies.alias("n")).where("n > 0")
    rows = drawn.orderBy("k1", "k2").collect()  # bounded: about ranges * per_range rows
    line: list[tuple[int, int]] = []
    for r in rows:
        line += [(r["k1"], r["k2"])] * r["n"]
    cuts = {line[i * len(line) // ranges] for i in range(1, ranges)} if line else set()
    return sorted(cuts)


def _slot(k: Column) -> Column:
    return (F.shiftright(k, 64 - SLOT_BITS) + (1 << (SLOT_BITS - 1))).cast("int")


def assign_ranges(records: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range_id``: the number of splitters at or below the record's keys."""
    spark = records.sparkSession
    by_slot: dict[int, list] = {}
    for a, b in splitters:
        by_slot.setdefault((a >> (64 - SLOT_BITS)) + (1 << (SLOT_BITS - 1)), []).append((a, b))
    rows, before = [], 0
    for s in range(1 << SLOT_BITS):
        own = by_slot.get(s, [])
        rows.append((s, before, [{"a": a, "b": b} for a, b in own]))
        before += len(own)
    table = spark.createDataFrame(rows, "slot int, before int, cuts array<struct<a:bigint,b:bigint>>")  # 2 ** SLOT_BITS rows
    passed = F.size(F.filter("cuts", lambda c: (c["a"] < F.col("k1")) | ((c["a"] == F.col("k1")) & (c["b"] <= F.col("k2")))))
    return records.withColumn("slot", _slot(F.col("k1"))).join(F.broadcast(table), "slot").withColumn("range_id", F.col("before") + passed).drop("slot", "before", "cuts")


def balanced_shards(docs: DataFrame, shards: int = 40, *, key: str = "doc_id", text: str = "text", overhead: int = 16, ranges_per_shard: int = 32) -> DataFrame:
    """id, size, text_crc32, shard (0 to ``shards`` - 1) and slot (gapless from 0 within its shard)."""
    spark = docs.sparkSession
    records = materialise(record_keys(docs, key, text, overhead), "shard-records")
    ranges = shards * ranges_per_shard
    ranged = assign_ranges(records, sample_splitters(records, ranges))
    counted = ranged.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    full = counted.collect()  # at most `ranges` rows
    total = sum(r["bytes"] for r in full)
    share = max(1, total // max(1, ranges))
    split = [(r["range_id"], math.ceil(r["bytes"] / share)) for r in full if r["bytes"] > 2 * share]
    if split:
        parts = spark.createDataFrame(split, "range_id int, parts int")
        ranged = ranged.join(F.broadcast(parts), "range_id", "left").withColumn("part", F.pmod(F.xxhash64("k2", F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    else:
        ranged = ranged.withColumn("part", F.lit(0))
    cells = ranged.groupBy("range_id", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    at, row, offsets = 0, 0, []
    for r in sorted(cells.collect(), key=lambda r: (r["range_id"], r["part"])):  # at most 2 * `ranges` cells or so
        offsets.append((r["range_id"], r["part"], at, row))
        at, row = at + r["bytes"], row + r["rows"]
    if not offsets:
        return records.select(key, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    starts = spark.createDataFrame(offsets, "range_id int, part int, at long, row long")
    order = Window.partitionBy("range_id", "part").orderBy("k1", "k2", key, "text_crc32")
    placed = (
        ranged.withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("nth", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["range_id", "part"])
        .withColumn("position", F.col("at") + F.col("within"))
        .withColumn("ordinal", F.col("row") + F.col("nth"))
        .withColumn("shard", F.least(F.floor((F.col("position") + F.col("size") / 2) * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
        .select(key, "size", "text_crc32", "shard", "ordinal", "range_id", "part")
    )
    placed = materialise(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("ordinal").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(key, "size", "text_crc32", "shard", (F.col("ordinal") - F.col("first")).cast("long").alias("slot"))
