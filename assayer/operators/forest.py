"""Isolation forest on given features: trees from a bounded sample, all rows scored in Arrow batches.

The driver grows the trees from at most ``sample_rows * trees`` rows, the smallest by a hash of their key, so the forest is
the same in every run and for every partitioning, and does not grow with the data. Every row is scored where it lies:
a tree is three flat arrays (feature, threshold, what a leaf adds), and a batch goes down all trees a level at a time. As a
column expression a row took milliseconds, since folds over arrays are not compiled; so it takes microseconds. The threshold of a given share is an exact quantile of the scores.

Defined cases: a row whose features are null, not finite or of another length than most rows' has no score. Equal rows score alike. With
fewer rows than a tree takes all are used; one row or none, or rows that are all equal, score 0.5 by definition. Extra columns stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.cohort import exact_quantiles

EULER = 0.5772156649015329
#: Rows that go down the trees together.
CHUNK = 4096


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def grow(rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 in a leaf), threshold and path length by node; the children of node i are 2i + 1 and 2i + 2."""
    size = 2 ** (depth + 1) - 1
    feature, threshold, length = np.full(size, -1), np.zeros(size), np.zeros(size)
    left = [(0, 0, rows)]
    while left:
        node, at, own = left.pop()
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(0), np.zeros(0))
        open_ = np.flatnonzero(high > low)
        if at == depth or len(own) < 2 or not len(open_):
            length[node] = at + expected_path(len(own))
            continue
        f = int(rng.choice(open_))
        cut = rng.uniform(low[f], high[f])
        below = own[:, f] < cut
        if not below.any():  # the draw met the lower end
            cut, below = high[f], own[:, f] < high[f]
        feature[node], threshold[node] = f, cut
        left += [(2 * node + 1, at + 1, own[below]), (2 * node + 2, at + 1, own[~below])]
    return feature, threshold, length


def fit(df: DataFrame, key: str, features: str, trees: int = 100, sample_rows: int = 256, seed: int = 42) -> dict:
    """The forest as flat arrays; see the module for what the driver holds."""
    usable = df.where(_usable(F.col(features)))
    common = usable.groupBy(F.size(features).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = common["w"] if common else 0
    usable = usable.where(F.size(features) == width).select(F.col(features).cast("array<double>").alias("x"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    pool = np.array([r["x"] for r in usable.orderBy("h", F.col("x")).limit(sample_rows * trees).collect()])
    take = min(sample_rows, len(pool))
    depth = max(1, math.ceil(math.log2(max(2, take))))
    rng = np.random.default_rng(seed)
    grown = []
    for t in range(trees):
        own = pool[t * take : (t + 1) * take] if len(pool) >= trees * take else pool[rng.permutation(len(pool))[:take]]
        grown.append(grow(own, depth, rng))
    stacked = [np.concatenate([g[k] for g in grown]) if grown else np.zeros(0) for k in range(3)]
    return {"trees": trees, "depth": depth, "width": width, "unit": expected_path(take), "feature": stacked[0].astype(int), "threshold": stacked[1], "length": stacked[2]}


def _usable(x: Column) -> Column:
    finite = F.forall(x.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & (F.size(x) > 0), F.lit(False))


def path_lengths(forest: dict, rows: np.ndarray) -> np.ndarray:
    """The sum of each row's path lengths over all trees: all rows go down all trees a level at a time."""
    size = 2 ** (forest["depth"] + 1) - 1
    base = np.arange(forest["trees"]) * size
    out = np.zeros(len(rows))
    for at in range(0, len(rows), CHUNK):
        part = rows[at : at + CHUNK]
        node = np.zeros((len(part), forest["trees"]), np.int64)
        for _ in range(forest["depth"]):
            place = base + node
            feature = forest["feature"][place]
            right = np.take_along_axis(part, np.maximum(feature, 0), axis=1) >= forest["threshold"][place]
            node = np.where(feature < 0, node, 2 * node + 1 + right)
        out[at : at + CHUNK] = forest["length"][base + node].sum(axis=1)
    return out


def score(forest: dict, features: Column) -> Column:
    """2 to the power of minus the mean path length over its expectation: near 1 for what is soon alone."""

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        width = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ok = np.flatnonzero((width == forest["width"]) & (width > 0))
        x = rows.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), -1) if len(ok) else np.zeros((0, 1))
        finite = np.isfinite(x).all(axis=1)
        out = np.full(len(rows), np.nan)
        out[ok[finite]] = 2.0 ** (-path_lengths(forest, x[finite]) / (forest["trees"] * forest["unit"])) if forest["unit"] else 0.5
        return pa.array(out, mask=np.isnan(out))

    return run(features.cast("array<double>"))


def isolation_scores(df: DataFrame, key: str, features: str, contamination: float = 0.1, **fitting) -> DataFrame:
    """``df`` with ``score`` and ``anomaly``: whether the score exceeds the exact quantile of 1 - ``contamination``."""
    forest = fit(df, key, features, **fitting)
    scored = df.withColumn("score", score(forest, F.col(features)))
    bound = exact_quantiles(scored, F.col("score"), [], (1 - contamination,)).select(F.col("q")[0].alias("bound_"))
    return scored.join(F.broadcast(bound), how="left").withColumn("anomaly", F.col("score") > F.col("bound_")).drop("bound_")  # one row
