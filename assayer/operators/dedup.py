"""Duplicates and leakage: hash groups, normalised identifiers, owner windows, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: Column, member: str) -> DataFrame:
    """Groups of more than one member by ``key``: key, n_members, first_member, members (sorted)."""
    out = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_members"), F.min(member).alias("first_member"), F.sort_array(F.collect_list(member)).alias("members"))
    return out.where("n_members > 1")


def near_minus_exact(near: DataFrame, exact: DataFrame) -> DataFrame:
    """Near-duplicate groups whose member set is not an exact group already."""
    return near.join(exact.select("members"), "members", "left_anti")


def cross_split(df: DataFrame, key: Column, split: str) -> DataFrame:
    """Keys that occur in more than one split: key, n_splits, n_rows."""
    return df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.countDistinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")


def split_changes(df: DataFrame, case: str, split: str, pos: str) -> DataFrame:
    """Rows whose split differs from the split recorded just before for the same case."""
    before = F.lag(split).over(Window.partitionBy(case).orderBy(pos))
    return df.withColumn("previous_split", before).where(F.col("previous_split") != F.col(split))


def content_leakage(df: DataFrame, key: str, split: str, case: str, pos: str) -> DataFrame:
    """Rows of another split than the first one of their content, with the latest earlier case of that split."""
    by = Window.partitionBy(key).orderBy(pos)
    owner = F.first(split).over(by)
    rows = df.where(F.col(key).isNotNull()).withColumn("owner_split", owner)
    latest = F.last(F.when(F.col(split) == F.col("owner_split"), F.col(case)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("owner_case", latest).where(F.col(split) != F.col("owner_split"))


def split_overlap(splits: DataFrame) -> DataFrame:
    """Ids in train and val, or in train and test; val and test are not compared."""
    side = lambda s: splits.where(F.col("split") == s).select("case_id").distinct()
    pair = lambda a, b: side(a).intersect(side(b)).withColumn("pair", F.lit(f"{a}-{b}"))
    return pair("train", "val").unionByName(pair("train", "test"))


def ordered_digest(df: DataFrame, group: str, order: str, content: Column, block: int = 1024) -> DataFrame:
    """A digest of each group's contents in order, in two levels so that no group is concatenated whole."""
    line = F.concat_ws("", F.col(order).cast("string"), F.lit(":"), F.sha2(content.cast("binary"), 256), F.lit("\n"))
    rows = df.select(group, F.col(order).alias("o"), F.floor(F.col(order) / block).alias("b"), line.alias("line"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(F.collect_list(a)), lambda x: x["line"]), "")
    parts = rows.groupBy(group, "b").agg(F.sha2(joined(F.struct("o", "line")), 256).alias("line"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(group).agg(F.sum("n").alias("n_files"), F.sha2(joined(F.struct("b", "line")), 256).alias("digest"))
