"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-5


def overlap(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column]:
    """Dice and intersection over union with a small epsilon, so that empty against empty is 1."""
    return (2 * tp + EPSILON) / (2 * tp + fp + fn + EPSILON), (tp + EPSILON) / (tp + fp + fn + EPSILON)


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """One row a class: tp, fp, fn, tn, dice, iou, accuracy."""
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).withColumn("class_id", F.explode(F.array(*map(F.lit, classes))))
    t, p = F.col(truth) == F.col("class_id"), F.col(predicted) == F.col("class_id")
    g = rows.groupBy("class_id").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    dice, iou = overlap(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.withColumn("dice", dice).withColumn("iou", iou).withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def macro(per_class: DataFrame, case: str, metric: str) -> DataFrame:
    """Mean over cases of the per-case means; 0.0 without cases."""
    return per_class.groupBy(case).agg(F.avg(metric).alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias(metric))


def majority(df: DataFrame, by: list[str], vote: str) -> DataFrame:
    """The most frequent vote, ties to the smallest: by, vote, n_votes."""
    counts = df.where(F.col(vote).isNotNull()).groupBy(*by, vote).agg(F.count(F.lit(1)).alias("n_votes"))
    best = Window.partitionBy(*by).orderBy(F.desc("n_votes"), vote)
    return counts.withColumn("r_", F.row_number().over(best)).where("r_ = 1").drop("r_")


def psnr_ssim(df: DataFrame, by: list[str], x: Column, y: Column, peak: float) -> DataFrame:
    """Mean squared error, PSNR (infinite for equal signals) and global SSIM by group."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    g = df.groupBy(*by).agg(F.avg((x - y) * (x - y)).alias("mse"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cov"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / F.col("mse")))
    ssim = ((2 * F.col("mx") * F.col("my") + c1) * (2 * F.col("cov") + c2)) / ((F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + c1) * (F.col("vx") + F.col("vy") + c2))
    return g.select(*by, "mse", psnr.alias("psnr"), ssim.alias("ssim"))


def recall_by_category(injected: DataFrame, observed: DataFrame) -> DataFrame:
    """Injections (category, case_id, expected) found among observed (case_id, codes): injected, detected, recall."""
    joined = injected.join(observed, "case_id", "left")
    hit = F.coalesce(F.arrays_overlap("expected", "codes"), F.lit(False))
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("injected"), F.count_if(hit).alias("detected"), (F.count_if(hit) / F.count(F.lit(1))).alias("recall"))


def weighted_rubric(checks: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the checks that apply: a null check counts in neither sum."""
    top = sum((F.coalesce(c.cast("double") * w, F.lit(0.0)) for c, w in checks.values()), F.lit(0.0))
    base = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in checks.values()), F.lit(0.0))
    return F.when(base > 0, top / base)


def mean_difference(df: DataFrame, group: str, value: str, baseline: object, other: object) -> DataFrame:
    """One row: the means of two groups and by how much the second exceeds the first; null where a group is empty."""
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    return df.agg(mean(baseline).alias("baseline"), mean(other).alias("platform"), (mean(other) - mean(baseline)).alias("difference"))
