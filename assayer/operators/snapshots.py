"""Fingerprints of file trees: a Merkle tree over folders, stored by level, and the difference of two of them.

A folder's digest covers its children's names, kinds and digests. Levels are built from the deepest up, each in two
aggregates: a folder's children first in up to 4,096 buckets by name, then the buckets, so that one folder with a large
part of all files is no single group. A stored snapshot is sorted by parent within each level; the difference starts
at the root and reads, level by level, only children of folders that differ.

Defined cases: paths are relative; leading and doubled slashes are dropped, null and empty paths are no files. A path that is
listed twice is one child with the greatest digest. Null digests (unreadable files) are a value of their own. An empty tree has
one node, the root, with a digest of nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A node of the tree; the root has depth 0, an empty name and no parent.
NODES = "depth int, parent string, name string, kind string, digest string, files bigint, bytes bigint"
#: Folders that are named in a filter, which Parquet's statistics can use; more are joined.
NAMED = 1000


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _line() -> Column:
    """What a child adds to its folder; the name's length keeps names with line ends apart."""
    return F.concat_ws(" ", "kind", F.coalesce("digest", F.lit("-")), F.length("name").cast("string"), "name")


def _folders(children: DataFrame, depth: int) -> DataFrame:
    """The nodes at ``depth`` that hold ``children``."""
    bucket = F.substring(_sha(F.col("name")), 1, 3)
    some = children.groupBy(F.col("parent").alias("path"), bucket.alias("bucket")).agg(
        _sha(F.array_join(F.array_sort(F.collect_list(_line())), "\n")).alias("digest"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")
    )
    whole = some.groupBy("path").agg(
        _sha(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "bucket", "digest"))), "\n")).alias("digest"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")
    )  # at most 4,096 buckets a folder
    parent = F.regexp_replace("path", r"/?[^/]*\z", "") if depth else F.lit(None).cast("string")
    return whole.select(F.lit(depth).alias("depth"), parent.alias("parent"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), F.lit("folder").alias("kind"), "digest", "files", "bytes")


def tree_nodes(files: DataFrame, path: str = "rel_path", digest: str = "sha256", size: str = "size_bytes") -> DataFrame:
    """``NODES`` of all files and folders. Each level is cut from its lineage where the session names a checkpoint folder."""
    clean = F.regexp_replace(F.regexp_replace(F.col(path), "/+", "/"), r"^/|/\z", "")
    rows = files.select(clean.alias("path"), F.col(digest).cast("string").alias("digest"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("bytes"))
    one = rows.where("path IS NOT NULL AND path <> ''").groupBy("path").agg(F.max("digest").alias("digest"), F.max("bytes").alias("bytes"))
    leaves = one.select(
        F.size(F.split("path", "/")).alias("depth"), F.regexp_replace("path", r"/?[^/]*\z", "").alias("parent"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"),
        F.lit("file").alias("kind"), "digest", F.lit(1).cast("long").alias("files"), "bytes",
    )
    leaves = _settled(leaves)
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    if not deepest:
        root = (0, None, "", "folder", None, 0, 0)
        return files.sparkSession.createDataFrame([root], NODES).withColumn("digest", _sha(F.lit("")))
    out, level = leaves, None
    for depth in range(deepest, 0, -1):
        own = leaves.where(F.col("depth") == depth)
        level = _settled(_folders(own if level is None else own.unionByName(level), depth - 1))
        out = out.unionByName(level)
    return out


def _settled(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def fingerprint(nodes: DataFrame, top: int = 20) -> DataFrame:
    """One row: the root's digest, files and bytes, and the most frequent suffixes (of equal ones the first by name)."""
    end = F.lower(F.regexp_extract("name", r"[^.](\.[^.]+)\z", 1))
    counts = nodes.where("kind = 'file'").groupBy(F.when(end == "", "<no_ext>").otherwise(end).alias("suffix")).agg(F.sum("files").alias("n"))
    first = counts.orderBy(F.desc("n"), "suffix").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "suffix"))).alias("s"))
    listed = F.transform("s", lambda x: F.struct(x["suffix"].alias("suffix"), (-x["r"]).alias("count"))).alias("top_extensions")
    root = nodes.where("depth = 0").select("digest", F.col("files").alias("file_count"), F.col("bytes").alias("total_bytes"))
    return root.crossJoin(F.broadcast(first.select(listed)))  # one row each


def write_snapshot(nodes: DataFrame, path: str) -> None:
    """By level, sorted by parent: a folder's children lie together."""
    nodes.repartitionByRange("depth", "parent").sortWithinPartitions("depth", "parent", "name").write.partitionBy("depth").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def _children(nodes: DataFrame, depth: int, parents: list[str] | DataFrame) -> DataFrame:
    level = nodes.where(F.col("depth") == depth)
    return level.where(F.col("parent").isin(parents)) if isinstance(parents, list) else level.join(parents, "parent", "left_semi")


def level_changes(old: DataFrame, new: DataFrame, depth: int, parents: list[str] | DataFrame) -> DataFrame:
    """Children of ``parents`` at ``depth`` that were added, removed or changed."""
    a, b = (_children(x, depth, parents).select("parent", "name", "kind", F.col("digest").alias(d), F.lit(True).alias(f"is_{d}")) for x, d in ((old, "old"), (new, "new")))
    j = a.join(b, ["parent", "name", "kind"], "full_outer").where(~(F.col("old").eqNullSafe(F.col("new")) & F.col("is_old").eqNullSafe(F.col("is_new"))))
    change = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").otherwise("changed")
    return j.select(F.concat_ws("/", F.nullif("parent", F.lit("")), "name").alias("path"), "kind", change.alias("change"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of the files that differ: added, removed or changed. One small job a level of depth; equal subtrees are not read."""
    spark = old.sparkSession
    roots = old.where("depth = 0").select("digest").union(new.where("depth = 0").select("digest")).collect()
    if len({r["digest"] for r in roots}) <= 1:
        return spark.createDataFrame([], "path string, change string")
    parents: list[str] | DataFrame = [""]
    found, depth = [], 1
    while True:
        changes = _settled(level_changes(old, new, depth, parents))
        found.append(changes.where("kind = 'file'").select("path", "change"))
        deeper = changes.where("kind = 'folder'").select(F.col("path").alias("parent")).distinct()
        head = deeper.limit(NAMED + 1).collect()
        if not head:
            break
        parents = [r["parent"] for r in head] if len(head) <= NAMED else deeper
        depth += 1
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
