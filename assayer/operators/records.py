"""Joins, profiles, splits and selections over case, run and trace records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.splits import _cut, hash_order


def with_status(df: DataFrame, allowed: Sequence[str], status: str = "status") -> DataFrame:
    """Rows whose status, trimmed and in lower case, is one of ``allowed``."""
    return df.where(F.lower(F.trim(F.col(status))).isin(*[a.strip().lower() for a in allowed]))


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every value which is not None."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def missing_partners(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows of ``left`` without a partner in ``right`` of the same lower-case name; what only ``right`` has is not reported."""
    return left.withColumn("name_", F.lower(name)).join(right.select(F.lower(name).alias("name_")).distinct(), "name_", "left_anti").drop("name_")


def built_cases(images: DataFrame, labels: DataFrame, key: str = "case_id", role: str = "role", path: str = "path") -> DataFrame:
    """One row a case with an image: its path (the first by name) and a map from role to label path (the first by name); labels without an image make no case."""
    one = images.groupBy(key).agg(F.min(path).alias("image"))
    roles = labels.groupBy(key, role).agg(F.min(path).alias(path)).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(role, path)))).alias("labels"))  # a case's roles
    return one.join(roles, key, "left").withColumn("n_labels", F.coalesce(F.size("labels"), F.lit(0)))


def with_split(cases: DataFrame, assignments: DataFrame, key: str = "case_id", split: str = "split", order: str = "pos") -> DataFrame:
    """Cases with the split that was assigned last, if any."""
    return cases.join(assignments.groupBy(key).agg(F.max_by(split, order).alias(split)), key, "left")


def scored_pairs(predictions: DataFrame, truth: DataFrame, key: str, shape: str) -> DataFrame:
    """(key, state): matched, shape_mismatch, no_truth or no_prediction; only matched pairs are scored."""
    p, t = predictions.select(key, F.col(shape).alias("p_"), F.lit(True).alias("has_p")), truth.select(key, F.col(shape).alias("t_"), F.lit(True).alias("has_t"))
    j = p.join(t, key, "full_outer")
    state = F.when(F.col("has_t").isNull(), "no_truth").when(F.col("has_p").isNull(), "no_prediction").when(F.col("p_").eqNullSafe(F.col("t_")), "matched").otherwise("shape_mismatch")
    return j.select(key, state.alias("state"))


def with_reports(datasets: DataFrame, reports: DataFrame, key: str, fields: Sequence[str], default: str = "unknown") -> DataFrame:
    """Datasets with the fields of their report, or ``default`` where there is none."""
    return datasets.join(reports.select(key, *fields), key, "left").select(*datasets.columns, *[F.coalesce(F.col(f).cast("string"), F.lit(default)).alias(f) for f in fields if f not in datasets.columns])


def agreeing_steps(steps: DataFrame, calls: DataFrame, run: str, step: str, call: str) -> DataFrame:
    """Steps with ``met``: whether a call of the run contains the step's action or is contained in it, by lower case. Calls are made distinct a run first."""
    c = calls.select(run, F.lower(call).alias("call_")).distinct().where("call_ <> ''")
    low = F.lower(F.col(step))
    met = steps.join(c, run).where((low != "") & (F.col("call_").contains(low) | low.contains(F.col("call_")))).select(*steps.columns).distinct().withColumn("met", F.lit(True))
    return steps.join(met, steps.columns, "left").withColumn("met", F.coalesce("met", F.lit(False)))


def not_available(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Requested keys without an artifact: a delivery goes ahead only if there are none."""
    return requested.select(key).distinct().join(available.select(key), key, "left_anti")


def unequal_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, with the ``side`` that lacks them; none if the sets are equal."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("right")).union(r.join(l, key, "left_anti").withColumn("side", F.lit("left")))


def histogram(df: DataFrame, columns: Sequence[str], other: str = "unknown") -> DataFrame:
    """(field, value, n) of several columns in one aggregate."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit(other)).alias("value")) for c in columns])))
    return rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def annotation_profile(df: DataFrame, by: str, boxes: str, category: str) -> DataFrame:
    """Least, most and mean number of boxes a case, and the set of categories, by group."""
    n = F.col(boxes)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_cases"), F.min(n).alias("min_boxes"), F.max(n).alias("max_boxes"), F.avg(n).alias("avg_boxes"), F.array_sort(F.collect_set(category)).alias("categories"))


def export_stats(cases: DataFrame, values: str, ratio: str, width: str, height: str) -> tuple[DataFrame, DataFrame]:
    """(distinct label values and the mean foreground ratio; image sizes by number, then by size)."""
    labels = cases.select(F.explode(values).alias("value")).distinct().agg(F.array_sort(F.collect_list("value")).alias("label_values"))
    mean = cases.agg(F.avg(ratio).alias("mean_foreground"), F.count(F.lit(1)).alias("n_cases"))
    size = F.concat_ws("x", F.col(width).cast("string"), F.col(height).cast("string"))
    sizes = cases.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size")
    return mean.crossJoin(labels), sizes  # two single rows


def top_values(df: DataFrame, value: Column, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values; ties by value."""
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def folder_counts(files: DataFrame, path: str, folders: Sequence[str]) -> DataFrame:
    """One row with the number of files directly under each of ``folders``."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return files.agg(*[F.count_if(parent == f).alias(f) for f in folders])


def slice_deltas(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean and 95th percentile of the absolute differences between neighbours, by group; zero for a single one."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))
    return df.withColumn("d_", step).groupBy(by).agg(F.coalesce(F.avg("d_"), F.lit(0.0)).alias("mean_delta"), F.coalesce(F.percentile("d_", 0.95), F.lit(0.0)).alias("p95_delta"))


def lowest(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` rows of the smallest score with their rank from 1; ties by key."""
    top = df.orderBy(score, key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(score, key)))  # at most n rows


def best_so_far(df: DataFrame, by: str, order: str, keys: Sequence[Column], value: str) -> DataFrame:
    """After every trial, the ``value`` of the best one up to it: larger keys win in turn, ties go to the earlier trial."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max_by(value, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], (-F.col(order)).alias("o"))).over(w))


def consecutive_repeats(df: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """(by, repeats, n): rows that repeat the value of the row before them, and all rows; nulls repeat nothing."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return df.select(by, (F.col(value) == before).alias("same_")).groupBy(by).agg(F.count_if("same_").alias("repeats"), F.count(F.lit(1)).alias("n"))


def wide(df: DataFrame, key: str, metric: str, value: str) -> DataFrame:
    """One row a key with a column for every metric, in the order of their names; of a metric that a key has twice the larger value."""
    names = sorted(r[metric] for r in df.select(metric).distinct().collect() if r[metric] is not None)  # the kinds of metrics
    columns = [F.max(F.when(F.col(metric) == n, F.col(value))).alias(n) for n in names]
    return df.groupBy(key).agg(*columns) if columns else df.select(key).distinct()


def totals(df: DataFrame, by: Sequence[str], sums: Sequence[str], whole: str = "all") -> DataFrame:
    """Numbers of rows and sums for every level of ``by``, from the finest to all rows; ``whole`` stands for what is summed over."""
    g = df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return g.withColumns({c: F.coalesce(c, F.lit(whole)) for c in by})


def topped_up(df: DataFrame, by: str, order: str, per_group: int, least: int = 4) -> DataFrame:
    """The first rows of every group; if that gives fewer than ``least``, the next rows in order come along."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    picked = df.withColumn("nth_", nth).where(F.col("nth_") <= per_group).drop("nth_")
    short = least - picked.limit(least).count()
    if short <= 0:
        return picked
    return picked.union(df.join(picked.select(order), order, "left_anti").orderBy(order).limit(short).select(*df.columns))


def first_by(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """The first row in ascending order of several keys."""
    return df.orderBy(*by).limit(1)


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows, in order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def cut_split(ids: DataFrame, key: str, sizes: Sequence[tuple[str, int]], rest: str, seed: int = 42) -> DataFrame:
    """The first so many ids in hash order are of each named split, the others of ``rest``. Ids must be distinct."""
    rows, at, bounds = ids.withColumn("order_", hash_order(F.col(key), seed)), 0, []
    for name, n in sizes:
        at += n
        bounds.append((name, _cut(rows, "order_", at) if n > 0 else None))
    split = F.lit(rest)
    for name, last in reversed(bounds):
        if last is not None:
            split = F.when(F.col("order_") <= last, name).otherwise(split)
    return rows.withColumn("split", split).drop("order_")


def holdout_split(ids: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """The first round(n * ratio) ids in hash order are the test split, the others train."""
    n = ids.count()
    return cut_split(ids, key, [("test", min(n, round(n * ratio)))], "train", seed)


def cumulative_split(ids: DataFrame, key: str, ratios: Sequence[tuple[str, float]] = (("train", 0.7), ("val", 0.15)), rest: str = "test", seed: int = 42) -> DataFrame:
    """Splits whose ends are the rounded cumulative shares."""
    n, at, share, sizes = ids.count(), 0, 0.0, []
    for name, ratio in ratios:
        share += ratio
        end = min(n, round(n * share))
        sizes.append((name, end - at))
        at = end
    return cut_split(ids, key, sizes, rest, seed)


def first_n_split(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """In every group the first ``n`` rows are train, the others test."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("split", F.when(nth <= n, "train").otherwise("test"))


def distinct_union(sources: Sequence[DataFrame], key: str) -> DataFrame:
    out = sources[0].select(key)
    for s in sources[1:]:
        out = out.union(s.select(key))
    return out.distinct()


def label_summary(df: DataFrame, by: str, value: str, most: int = 256) -> DataFrame:
    """Number of distinct values, whether they are whole numbers, the number of values other than zero, and up to ``most`` of the values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("v_"))
    return counted.withColumn("r_", nth).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_values"), F.every(F.col("v_") == F.round("v_")).alias("integer_like"), F.sum(F.when(F.col("v_") != 0, F.col("n_")).otherwise(0)).alias("nonzero"),
        F.array_sort(F.collect_list(F.when(F.col("r_") <= most, F.col("v_")))).alias("values"),
    )


def replaced(ids: Column, old, new) -> Column:
    return F.transform(ids, lambda i: F.when(i == old, F.lit(new)).otherwise(i))


def run_manifest(events: DataFrame, run: str = "run_id", event: str = "event", ts: str = "ts") -> DataFrame:
    """One row a run: start, end and state (completed, failed, or running where no end was seen)."""
    at = lambda e: F.min(F.when(F.col(event) == e, F.col(ts)))
    out = events.groupBy(run).agg(at("start").alias("started"), F.max(F.when(F.col(event).isin("end", "error"), F.col(ts))).alias("ended"), F.bool_or(F.col(event) == "error").alias("failed_"))
    return out.withColumn("state", F.when(F.col("failed_"), "failed").when(F.col("ended").isNotNull(), "completed").otherwise("running")).drop("failed_")


def assertions(cases: DataFrame, key: str, criteria: str, forbidden: str) -> DataFrame:
    """(key, assertion_id, kind, target): success criteria, then forbidden paths, with ids from 1 in that order."""


    def of_kind(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target")))

    both = F.concat(of_kind(criteria, "success"), of_kind(forbidden, "forbidden"))
    return cases.select(key, F.posexplode(both).alias("pos_", "a")).select(key, (F.col("pos_") + 1).alias("assertion_id"), "a.kind", "a.target")


def recall_by_category(df: DataFrame, category: str, wanted: str, found: str, every: bool = False) -> DataFrame:
    """Injections, detected ones and recall by category; detected if any of the wanted codes was found, or all of them."""
    hit = F.size(F.array_except(wanted, found)) == 0 if every else F.arrays_overlap(wanted, found)
    out = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("detected"))
    return out.withColumn("recall", F.round(F.col("detected") / F.col("n"), 6))


def usable(records: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Records whose file exists."""
    return records.join(files.select(path).distinct(), path, "left_semi")


def run_folders(files: DataFrame, path: str, name: str) -> DataFrame:
    """Folders that hold a file of the given name."""
    return files.where(F.regexp_extract(path, r"([^/]+)$", 1) == name).select(F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("folder")).distinct()


def elapsed_totals(plans: DataFrame, before: DataFrame, key: str, seconds: str) -> DataFrame:
    """Plans with the seconds of an earlier scoring added; none counts as zero."""
    return plans.join(before.select(key, F.col(seconds).alias("before_")), key, "left").withColumn(seconds, F.col(seconds) + F.coalesce("before_", F.lit(0.0))).drop("before_")


def merged_spec(df: DataFrame, fields: Sequence[str], layers: Sequence[str]) -> DataFrame:
    """Each field from the first layer that has it; columns are named layer_field."""
    return df.select("*", *[F.coalesce(*[F.col(f"{layer}_{f}") for layer in layers]).alias(f) for f in fields])
