"""Registries, lineage, joins with fall-backs, trace summaries and selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_or_prefix(left: DataFrame, left_id: str, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Equal keys, else keys of which one begins with the other; one match a left row (exact first, then smallest).

    Keys of any length: a key is cut only at lengths that keys of the other side have, so each row makes at
    most as many prefixes as there are distinct lengths, and all joins are by equality.
    """
    l, l_key, r_key = left.where(F.length(left_key) > 0), F.col(left_key), F.col(right_key)
    keys = right.where(F.length(right_key) > 0).select(right_key).distinct()

    def cut(df: DataFrame, key: Column, other: DataFrame, other_key: Column) -> DataFrame:
        lengths = other.select(F.length(other_key).alias("n_")).distinct()
        return df.withColumn("own_", F.length(key)).join(F.broadcast(lengths), F.col("own_") >= F.col("n_")).withColumn("p_", F.left(key, F.col("n_"))).drop("own_", "n_")

    longer = cut(l, l_key, keys, r_key).join(keys.withColumn("p_", r_key), "p_")
    shorter = cut(keys, r_key, l, l_key).join(l.withColumn("p_", l_key), "p_")
    both = longer.select(left_id, left_key, right_key).union(shorter.select(left_id, left_key, right_key)).distinct()
    first = F.row_number().over(Window.partitionBy(left_id).orderBy(l_key != r_key, right_key))
    return both.withColumn("r_", first).where("r_ = 1").withColumn("kind", F.when(l_key == r_key, "exact").otherwise("prefix")).drop("r_")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("registered_at",)) -> DataFrame:
    """Full outer upsert: new values win, but columns in ``keep`` stay as they were first written."""
    columns = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in columns])
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in columns])
    pick = lambda c: F.coalesce(f"o_{c}", f"n_{c}") if c in keep else F.coalesce(f"n_{c}", f"o_{c}")
    return o.join(n, key, "full_outer").select(key, *[pick(c).alias(c) for c in columns])


def lineage(models: DataFrame, datasets: DataFrame, on: str = "dataset_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Which model was trained on which dataset, with the columns ``keep`` of either side; models of unknown datasets have no row."""
    return models.join(datasets, on, "inner").select(on, "model_id", F.lit("trained_on").alias("relation"), *keep)


def trace_totals(events: DataFrame, *by: str) -> DataFrame:
    """total, completed, failed, skipped, milliseconds and their mean of each agent's calls (or of each value of ``by``)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    took = F.col("duration_ms")
    return events.groupBy(*(by or ("agent",))).agg(F.count(F.lit(1)).alias("total"), count("completed"), count("failed"), count("skipped"), F.sum(took).alias("duration_ms"), F.avg(took).alias("mean_ms"))


def first_events(events: DataFrame, key: str = "call_id", order: str = "sequence") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def best_record(df: DataFrame, keys: list[Column], pos: str, by: list[str] | None = None) -> DataFrame:
    """The row with the largest keys in order; ties go to the smallest ``pos``."""
    whole = F.struct(*df.columns)
    return df.groupBy(*(by or [])).agg(F.max_by(whole, F.struct(*keys, -F.col(pos))).alias("best")).select("best.*")


def ordered_fold(df: DataFrame, by: str, order: list[str], fold: Callable[[dict], Callable[[pa.RecordBatch], object]], schema: str) -> DataFrame:
    """A sequential fold over each group's rows in order, one result row a group.

    Rows are dealt by group and sorted within their partition, which spills; they then stream past, so a group of any size takes the
    memory of one Arrow batch. ``fold`` starts a group: given its state (empty at first), it returns a function that takes the group's rows
    of a batch and changes the state. The state's items, with the group, are the result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        step, group, started, out = None, None, False, []
        for batch in batches:
            keys = batch.column(0)
            codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(batch)] if len(batch) else [0]
            for at, end in zip(cuts, cuts[1:], strict=False):
                key = keys[at].as_py()
                if not started or key != group:
                    if started:
                        out.append({names[0]: group} | state)
                    group, started, state = key, True, {}
                    step = fold(state)
                step(batch.slice(at, end - at))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if started:
            out.append({names[0]: group} | state)
        yield pa.RecordBatch.from_pylist(out, kind)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def best_epoch(df: DataFrame, run: str, order: str = "epoch", dice: str = "dice", hd95: str = "hd95", tie: float = 1e-8) -> DataFrame:
    """The epoch a sequential watcher ends with: higher dice, or dice within ``tie`` and lower hd95 (none is 1e9); epochs without dice never win."""
    kinds = dict(df.dtypes)

    def start(state: dict) -> Callable[[pa.RecordBatch], None]:
        def step(rows: pa.RecordBatch) -> None:
            won = -1
            best, distance = state.get("best_dice", float("nan")), state.get("best_hd95", float("inf"))
            for i, (d, h) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                if d > best or (best != best and d == d) or (abs(d - best) < tie and h < distance):
                    won, best, distance = i, d, h
            if won >= 0:
                state.update(best_epoch=rows.column(1)[won].as_py(), best_dice=best, best_hd95=distance)

        return step

    rows = df.select(run, order, F.coalesce(F.col(dice).cast("double"), F.lit(float("nan"))).alias("d_"), F.coalesce(F.col(hd95).cast("double"), F.lit(1e9)).alias("h_"))
    return ordered_fold(rows, run, [order, "d_", "h_"], start, f"{run} {kinds[run]}, best_epoch {kinds[order]}, best_dice double, best_hd95 double")


def monitored_best(trials: DataFrame, pos: str, dice: str = "dice", iou: str = "iou", by: list[str] | None = None) -> DataFrame:
    """The monitor's best of the completed trials: highest (dice, iou) with nothing else, so it may differ from the best by all metrics."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return best_record(trials, [zero(dice), zero(iou)], pos, by)


def unseen_candidates(candidates: DataFrame, history: DataFrame, identity: str, order: str, n: int = 1) -> DataFrame:
    return candidates.join(history.select(identity).distinct(), identity, "left_anti").orderBy(order).limit(n)


def next_id(df: DataFrame, column: str, minimum: int) -> DataFrame:
    return df.agg(F.greatest(F.coalesce(F.max(column) + 1, F.lit(minimum)), F.lit(minimum)).alias("next_id"))


def discoveries(events: DataFrame, asset: str = "asset", order: str = "ts", threshold: int = 2, keep: int = 5) -> DataFrame:
    """Assets seen at least ``threshold`` times, with their latest triggers."""
    latest = Window.partitionBy(asset).orderBy(F.desc(order))
    recent = events.withColumn("r_", F.row_number().over(latest)).where(F.col("r_") <= keep).groupBy(asset).agg(F.sort_array(F.collect_list(order)).alias("triggers"))
    counts = events.groupBy(asset).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    return counts.join(recent, asset)


def readiness(methods: DataFrame, evidence: DataFrame, key: str = "id") -> DataFrame:
    """Methods with their execution evidence as ready, partial, failed or untested."""
    runs = evidence.groupBy(key).agg(F.bool_or(F.col("status") == "completed").alias("ok"), F.count(F.lit(1)).alias("n_runs"))
    j = methods.join(runs, key, "left")
    state = F.when(F.col("n_runs").isNull(), "untested").when(F.col("ok") & (F.col("status") == "active"), "ready").when("ok", "partial").otherwise("failed")
    return j.withColumn("readiness", state).na.fill(0, ["n_runs"]).drop("ok")


def annotated(cases: DataFrame, sources: list[DataFrame], key: str = "case_id", value: str = "annotation") -> DataFrame:
    """Cases with the bag of their annotations over all sources (duplicates stay, none gives an empty list)."""
    union = sources[0]
    for s in sources[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    bags = union.groupBy(key).agg(F.collect_list(value).alias("annotations"))
    return cases.join(bags, key, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(bags.schema["annotations"].dataType)))


def assembled(tagged: DataFrame, key: str, role: str, value: str, roles: list[str], order: str | None = None) -> DataFrame:
    """One row a case from (key, role, value) rows of all sources: one shuffle instead of a chain of outer joins; the last value by ``order`` wins, else the largest."""
    return tagged.groupBy(key).pivot(role, roles).agg(F.max_by(value, order) if order else F.max(value))


def coverage_gaps(required: dict[str, bool], provided: set[str]) -> list[str]:
    return [k for k, needed in required.items() if needed and k not in provided]
