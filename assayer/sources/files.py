"""File trees as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import case_id, file_kind, file_name, stem, suffix


def tree(spark: SparkSession, root: str, max_depth: int | None = None, content: bool = False) -> DataFrame:
    """Files under ``root``: path, rel_path, name, suffix, kind, depth, size_bytes, mtime (content is read only if asked for)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    path = F.regexp_replace("path", "^file:/+", "/")
    rel = F.regexp_replace(path, f"^/?{_quoted(base)}/?", "")
    out = files.select(path.alias("path"), rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    out = out.withColumns({"name": file_name(F.col("path")), "suffix": suffix(F.col("path")), "kind": file_kind(F.col("path")), "depth": F.when(F.col("rel_path") == "", 0).otherwise(F.size(F.split("rel_path", "/")))})
    return out if max_depth is None else out.where(F.col("depth") <= max_depth)


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def inventory(files: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Totals, and the most frequent suffixes (ties by name)."""
    totals = files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes"), F.countDistinct(_folder()).alias("n_folders"))
    return totals, frequent(files, "suffix", top)


def frequent(files: DataFrame, column: str, top: int = 50) -> DataFrame:
    """The most frequent values with their numbers of files; of equally frequent ones the first by name."""
    return files.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)


def _folder() -> Column:
    return F.regexp_replace("rel_path", "/?[^/]*$", "")


def folder_summary(files: DataFrame) -> DataFrame:
    """One row a folder: files, images, JSON files and a map of suffix counts."""
    by = files.withColumn("folder", _folder()).groupBy("folder", "suffix").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "json").alias("json"))
    return by.groupBy("folder").agg(F.sum("n").alias("file_count"), F.sum("images").alias("image_file_count"), F.sum("json").alias("json_file_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("suffix", "n")))).alias("extensions"))


def cases(files: DataFrame, variant: str = "channel", kinds: Sequence[str] = ("image",)) -> DataFrame:
    """One file a case and folder; of several, the last by name wins."""
    rows = files.where(F.col("kind").isin(*kinds)).withColumn("case_id", case_id(F.col("path"), variant)).withColumn("folder", _folder())
    return rows.groupBy("folder", "case_id").agg(F.max_by("path", "name").alias("path"))


def with_suffix(files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    return files.where(F.col("suffix").isin(*suffixes)).orderBy("path")


def primary_folder(folders: DataFrame, positive: str = r"image|radiograph|scan", negative: str = r"mask|label|annot|pred") -> DataFrame:
    """The folder that most looks like the image folder: ten points an image, bonuses and penalties by name, less for depth."""
    name, depth = F.lower("folder"), F.size(F.split("folder", "/"))
    score = 10 * F.col("image_file_count") + F.when(name.rlike(positive), 500).otherwise(0) - F.when(name.rlike(negative), 600).otherwise(0) - 5 * depth
    return folders.agg(F.max_by(F.struct("folder", score.alias("score")), F.struct(score, F.col("image_file_count"), -depth, F.col("folder"))).alias("b")).select("b.*")


def label_folders(files: DataFrame, primary: str, ratio: float = 0.05, least: int = 5) -> DataFrame:
    """Folders whose stems overlap the primary folder's: by ratio or by count."""
    rows = files.withColumn("folder", _folder()).withColumn("stem", stem(F.col("path")))
    own = rows.where(F.col("folder") == primary).select("stem").distinct()
    n = own.agg(F.count(F.lit(1)).alias("n_primary"))
    hits = rows.where(F.col("folder") != primary).join(own, "stem", "left_semi").groupBy("folder").agg(F.countDistinct("stem").alias("overlap"))
    return hits.crossJoin(F.broadcast(n)).where((F.col("overlap") >= least) | (F.col("overlap") >= ratio * F.col("n_primary"))).select("folder", "overlap")  # one row


def split_files(spark: SparkSession, root: str) -> DataFrame:
    """split, case_id from train.txt, val.txt and test.txt: distinct non-blank lines."""
    lines = spark.read.option("pathGlobFilter", "{train,val,test}.txt").text(root).withColumn("split", F.regexp_extract(F.input_file_name(), r"([a-z]+)\.txt$", 1))
    return lines.select("split", F.trim("value").alias("case_id")).where("case_id <> ''").distinct()


def archive_members(spark: SparkSession, paths: str) -> DataFrame:
    """Members (archive, member, content, safe) of zip and tar files; members that leave the target are not safe and have no content."""
    from assayer.sources.archives import whole_members

    return whole_members(spark, paths)


def flattened(members: DataFrame) -> DataFrame:
    """Member paths without the folders that all members of an archive share (descending while there is one folder and no file)."""
    parts = F.split("member", "/")
    shared = members.groupBy("archive").agg(F.min(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("lo"), F.max(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("hi"))
    same = F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.least(F.size("lo"), F.size("hi")) - 1, F.lit(0))), lambda i: F.slice("lo", F.lit(1), i + 1) == F.slice("hi", F.lit(1), i + 1)))
    depth = F.when((F.size("lo") == 0) | (F.size("hi") == 0), 0).otherwise(same)
    joined = members.join(shared.select("archive", depth.alias("root_depth")), "archive")
    return joined.withColumn("target", F.array_join(F.slice(parts, F.col("root_depth") + 1, F.size(parts)), "/")).drop("root_depth")
