"""Ordered folds against plain loops, and isolation forests against their trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import forest, registry


def watcher(rows):
    """(epoch, dice, hd95) in order."""
    best = None
    for e, d, h in rows:
        d, h = float("nan") if d is None else d, 1e9 if h is None else h
        if d != d:
            continue
        if best is None or d > best[1] or (abs(d - best[1]) < 1e-8 and h < best[2]):
            best = (e, d, h)
    return best or (None, None, None)


@pytest.mark.parametrize("seed", [0, 1])
def test_best_epoch_equals_a_sequential_watcher(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), *[rng.choice([0.5, 0.7]) + rng.choice([0, 4e-9, -4e-9, 2e-8, 0.1]) for _ in range(12)]])
    rows = [(r, e, value(), rng.choice([None, 1.0, 2.0, 3.0])) for r in ("a", "b", "", None) for e in rng.sample(range(1000), 60)] + [("none", 1, None, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, epoch int, dice double, hd95 double").withColumn("best_epoch", F.lit("clash"))
    got = {r["run"]: tuple(r)[1:] for r in registry.best_epoch(df, "run").collect()}
    assert got == {run: watcher(sorted(r[1:] for r in rows if r[0] == run)) for run in {r[0] for r in rows}}
    assert registry.best_epoch(df.limit(0), "run").collect() == []


def test_a_long_run_streams(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("one").alias("run"), F.col("id").alias("epoch"), (F.floor(F.col("id") / 1000) / 1e4).alias("dice"), (F.col("id") % 1000).cast("double").alias("hd95"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        r = registry.best_epoch(df, "run").first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (r["best_epoch"], r["best_dice"], r["best_hd95"]) == (n - 1000, (n // 1000 - 1) / 1e4, 0.0)


def walk(f, x):
    """Path lengths of one row, tree by tree."""
    size = 2 ** (f["depth"] + 1) - 1
    for t in range(f["trees"]):
        node = 0
        while f["feature"][t * size + node] >= 0:
            node = 2 * node + (1 if x[f["feature"][t * size + node]] < f["threshold"][t * size + node] else 2)
        yield f["length"][t * size + node]


def test_forest_scores(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(0, 1, (600, 4))
    data[:6] += 9
    rows = [(i, x.tolist()) for i, x in enumerate(data)] + [(700, None), (701, [1.0]), (702, [1.0, 2.0, float("nan"), 0.0]), (703, data[10].tolist())]
    df = spark.createDataFrame(rows, "id long, x array<double>").withColumn("bound_", F.lit(1)).drop("bound_").withColumn("extra", F.lit("e"))
    f = forest.fit(df, "id", "x", trees=20, sample_rows=64, seed=1)
    assert f["depth"] == 6 and len(f["feature"]) == 20 * 127
    got = {r["id"]: r for r in forest.isolation_scores(df, "id", "x", 0.01, trees=20, sample_rows=64, seed=1).collect()}
    for i in [*range(12), 703]:
        x = dict(rows)[i]
        assert got[i]["score"] == pytest.approx(2 ** (-np.mean(list(walk(f, x))) / forest.expected_path(64)), abs=1e-12)
    assert [got[i]["score"] for i in (700, 701, 702)] == [None] * 3 and got[703]["score"] == got[10]["score"]
    ranked = sorted((i for i in got if got[i]["score"] is not None), key=lambda i: -got[i]["score"])
    assert set(ranked[:6]) == set(range(6))
    flagged = {i for i in got if got[i]["anomaly"]}
    assert flagged == set(ranked[: len(flagged)]) and 5 <= len(flagged) <= 7
    again = forest.fit(df.repartition(7).orderBy(F.desc("id")), "id", "x", trees=20, sample_rows=64, seed=1)
    assert all((again[k] == f[k]).all() for k in ("feature", "threshold", "length"))


def test_forest_edges(spark):
    one = spark.createDataFrame([(1, [1.0])], "id long, x array<double>")
    assert forest.isolation_scores(one, "id", "x", trees=3).first()["score"] == 0.5
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, x array<double>")
    assert {round(r["score"], 9) for r in forest.isolation_scores(same, "id", "x", trees=3).collect()} == {0.5}
    assert forest.isolation_scores(one.limit(0), "id", "x", trees=3).collect() == []
