"""Deterministic splits, samples and sequential ids without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_even(n: int, ratio: float) -> int:
    return round(n * ratio)


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order: sha1 of seed and key, as hexadecimal text."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def _cut(df: DataFrame, order: str, n: int) -> str | None:
    """The ``n``-th smallest value of a hexadecimal column (from 1): counts by prefix find its bucket, only that is sorted."""
    if n <= 0:
        return None
    seen = 0
    for r in sorted(df.groupBy(F.substring(order, 1, 3).alias("p")).count().collect(), key=lambda r: r["p"]):  # 4096 rows at most
        if seen + r["count"] >= n:
            inside = df.where(F.substring(order, 1, 3) == r["p"]).select(order).orderBy(order)
            return inside.offset(n - seen - 1).limit(1).first()[0]
        seen += r["count"]
    return None


def deterministic_split(ids: DataFrame, key: str, ratios: Sequence[float] = (0.8, 0.1), names: Sequence[str] = ("train", "val", "test"), seed: int = 42) -> DataFrame:
    """Adds ``split``: exact half-even sizes, remainder to the last name, in hash order. Ids must be distinct."""
    rows = ids.withColumn("order_", hash_order(F.col(key), seed))
    total, split, at = rows.count(), F.lit(names[len(ratios)]), 0
    bounds = []
    for name, ratio in zip(names, ratios, strict=False):
        at = min(total, at + half_even(total, ratio))
        bounds.append((name, _cut(rows, "order_", at)))
    for name, last in reversed(bounds):
        if last is not None:
            split = F.when(F.col("order_") <= last, name).otherwise(split)
    return rows.withColumn("split", split).drop("order_")


def balanced_sample(df: DataFrame, by: str, order: str, per_group: int) -> DataFrame:
    """The first rows of every group in order; Spark keeps ``per_group`` rows a task and group before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("nth") <= per_group)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, in their original order."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n).orderBy(key)


def sequential_ids(df: DataFrame, split: str, key: str, name: str, width: int = 4096) -> DataFrame:
    """Ids from 1 in key order within each split: row numbers of key ranges plus the ranges' offsets."""
    ranged = df.withColumn("range_", F.floor(F.col(key) / width))
    sizes = ranged.groupBy(split, "range_").agg(F.count(F.lit(1)).alias("size_"))
    ahead = F.sum("size_").over(Window.partitionBy(split).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(split, "range_", F.coalesce(ahead, F.lit(0)).alias("offset_"))
    nth = F.row_number().over(Window.partitionBy(split, "range_").orderBy(key))
    return ranged.withColumn("nth_", nth).join(offsets, [split, "range_"]).withColumn(name, (F.col("nth_") + F.col("offset_")).cast("long")).drop("nth_", "offset_", "range_")


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Ids from 1 in ``order`` within each group, for keys of any type: rows are dealt by ranges, and a row's id is its place in its range plus
    what the group has in earlier ranges. No task holds a group. Rows that are equal by ``order`` are numbered in any order; nulls come first.

    Ranges are drawn anew when they are computed again, so they are fixed first: in the checkpoint folder, or kept by Spark where there is none.
    """
    placed = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at_", F.monotonically_increasing_id())
    fixed = placed.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else placed.persist()
    part = F.shiftright("at_", 33)
    sizes = fixed.groupBy(F.col(group).alias("group_"), part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
    ahead = F.sum("n_").over(Window.partitionBy("group_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before_", F.coalesce(ahead, F.lit(0)))  # a row for each range of a group
    same = F.col(group).eqNullSafe(F.col("group_")) & (part == F.col("part_"))
    return fixed.join(sizes, same).withColumn(name, F.col("at_") - F.col("first_") + F.col("before_") + 1).select(*[c for c in df.columns if c != name], name)


def last_wins(df: DataFrame, key: Column, value: Column, pos: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.max_by(value, pos).alias("value"))


def grid(spark, axes: dict[str, list], cap: int = 18) -> DataFrame:
    """The cartesian product of small axes in nested order, capped."""
    from itertools import islice, product

    rows = [(i, *values) for i, values in enumerate(islice(product(*axes.values()), cap))]
    return spark.createDataFrame(rows, ["pos", *axes])
