"""Robust cohort statistics: exact quantiles, bounds and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Groups whose state is small enough to lie on the driver, and values that one task sorts at most.
STATE_ROWS, SORTED_VALUES, WIDTH = 100_000, 1_000_000, 4096


def _settled(targets: DataFrame) -> DataFrame:
    """``targets`` cut from its lineage: few rows become a local table, many are checkpointed where the session names a folder."""
    head = targets.limit(STATE_ROWS + 1).collect()
    if len(head) <= STATE_ROWS:
        return targets.sparkSession.createDataFrame(head, targets.schema)
    return targets.checkpoint() if targets.sparkSession.conf.get("spark.checkpoint.dir", None) else targets


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Each range of values replaced by those of its buckets that hold a wanted rank; the ranges go to the rows, as a shuffle by group would give a large group to one task."""
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"t{i}_")) for i, k in enumerate(keys)], F.lit(True))
    state = targets.select(*[F.col(k).alias(f"t{i}_") for i, k in enumerate(keys)], "n", "lo", "hi", "below", "ranks")
    inside = rows.join(F.broadcast(state), same & F.col("v_").between(F.col("lo"), F.col("hi")))
    sizes = inside.groupBy(*keys, "n", "lo", "hi", "below", "ranks", bucket.alias("b_")).agg(F.sum("c_").alias("m"), F.min("v_").alias("least"), F.max("v_").alias("most"))
    ahead = F.sum("m").over(Window.partitionBy(*keys, "lo", "hi").orderBy("b_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("below", F.col("below") + F.coalesce(ahead, F.lit(0)))
    hit = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("m")))
    return sizes.withColumn("ranks", hit).where(F.size("ranks") > 0).select(*keys, "n", F.col("least").alias("lo"), F.col("most").alias("hi"), "below", "m", "ranks")


def exact_quantiles(df: DataFrame, value: Column, by: list[str], shares: Sequence[float], sorted_values: int = SORTED_VALUES) -> DataFrame:
    """(by, n, q): exact quantiles with linear interpolation, one row a group; null and NaN are no values.

    No task holds a group of more than ``sorted_values`` values: for these, which are few, rounds count values in ``WIDTH`` equal parts of a range and go on with the
    parts that hold a wanted rank, until a part has at most ``sorted_values`` values, which are sorted. The other groups take one aggregate.
    Groups of null keys stay; infinities are values; an empty table has no rows.
    """
    rows = df.select(*by, value.cast("double").alias("v_")).where("v_ is not null and not isnan(v_)").withColumn("c_", F.lit(1).cast("long"))
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    ranks = F.array_sort(F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])))
    targets = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v_").alias("lo"), F.max("v_").alias("hi"))
    smallest, largest = targets.agg(F.min("n"), F.max("n")).first()
    whole = lambda df: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("v_", F.array(*[F.lit(float(p)) for p in shares])).alias("q"))
    if (largest or 0) <= sorted_values:  # every group fits into a task: one aggregate
        return whole(rows)
    targets = _settled(targets.where(F.col("n") > sorted_values).select(*by, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), ranks.alias("ranks")))
    part = F.floor((F.col("v_") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * WIDTH)
    part = F.when(F.col("v_") == F.col("lo"), -1).when(F.col("v_") == F.col("hi"), WIDTH).otherwise(part)
    while not targets.where((F.col("lo") < F.col("hi")) & (F.col("m") > sorted_values)).isEmpty():
        targets = _settled(_narrowed(rows, targets, by, part))
    # joined with the few ranges first, counted after
    found = _narrowed(rows, targets, by, F.col("v_")).select(*by, "n", F.explode("ranks").alias("rank"), F.col("lo").alias("v_"))
    held = found.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v_"))).alias("at_"))  # two ranks a share

    def between(x: Column) -> Column:
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        return F.when(low == high, F.col("at_")[low]).otherwise((high - x) * F.col("at_")[low] + (x - low) * F.col("at_")[high])

    out = held.select(*by, "n", F.array(*[between(x) for x in at]).alias("q"))
    if smallest > sorted_values:
        return out
    large = F.broadcast(targets.select(*[F.col(k).alias(f"t{i}_") for i, k in enumerate(by)]).distinct())
    return out.union(whole(rows.join(large, reduce(and_, [F.col(k).eqNullSafe(F.col(f"t{i}_")) for i, k in enumerate(by)]), "left_anti")))


def robust_bounds(df: DataFrame, value: Column, by: list[str], least: int = 5) -> DataFrame:
    """Bounds Q1 - 3 IQR and Q3 + 3 IQR by group; a flat cohort gets its median and a small margin, a small one none."""
    g = exact_quantiles(df, value, by, (0.25, 0.5, 0.75))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    iqr, margin = q3 - q1, F.greatest(F.abs(q2) * 0.1, F.lit(1e-3))
    flat = iqr <= 1e-6
    return g.where(F.col("n") >= least).select(*by, "n", q2.alias("median"), F.when(flat, q2 - margin).otherwise(q1 - 3 * iqr).alias("lower"), F.when(flat, q2 + margin).otherwise(q3 + 3 * iqr).alias("upper"))


def outliers(df: DataFrame, value: Column, by: list[str], least: int = 5) -> DataFrame:
    """Rows outside their group's bounds; the bounds have one row a group and are joined as Spark sees fit."""
    bounds = robust_bounds(df, value, by, least)
    return df.withColumn("value_", value.cast("double")).join(bounds, by).where("value_ < lower or value_ > upper")


def axis_values(df: DataFrame, case: str, values: str) -> DataFrame:
    """One row an axis of an array column: case, axis (from 0), value."""
    return df.select(case, F.posexplode(values).alias("axis", "value"))


def robust_distance(df: DataFrame, case: str, values: str) -> DataFrame:
    """An anomaly score without a learned forest: mean absolute deviation from the axis medians, in units of the axis IQR."""
    axes = axis_values(df, case, values)
    stats = exact_quantiles(axes, F.col("value"), ["axis"], (0.25, 0.5, 0.75)).select("axis", "q")
    scaled = F.abs(F.col("value") - F.col("q")[1]) / F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-9))
    return axes.join(stats, "axis").groupBy(case).agg(F.avg(scaled).alias("score"))
