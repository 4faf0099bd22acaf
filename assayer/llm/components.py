"""Connected components by alternating large-star and small-star rounds; links stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm._work import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: long): label is the smallest node of its component.

    Self links and repeated links are allowed; without links the result is empty.
    """
    edges = materialise(links.where("a <> b").select("a", "b").distinct(), "links")
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialise(small.union(root.select("a", F.col("m").alias("b"))).distinct(), "links")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))
