"""Run supervision over an event log, as a stream and as a batch with the same rule.

The stream keeps facts, not verdicts: for each run the latest controller and launcher status, process, exit code and
declared counts, which required artifacts are there, how many predictions are readable, and when it was last heard
of. ``planner.run_state`` turns facts into a status, in the stream's output and in the batch alike. What is latest is
decided by (timestamp, sequence), then by value, so events may come in any order, in any cut into batches, and again.

Silence is measured in event time: a run that named a process and was not heard of for ``silence`` is of unknown liveness, after
``gone`` it counts as dead. Timers on the watermark emit those changes, though no event comes.

Defined cases: events without a run or a timestamp, and of unknown kinds, count for nothing. Null sequences come first.
Events later than the watermark allows are dropped by Spark, as everywhere. An empty log has no runs. State is what a run's
artifacts and predictions need, and a run that ended for good and was not heard of for ``gone`` keeps no timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from assayer.operators.planner import run_state

#: ``kind``: controller and launcher (status, pid, number: exit code), heartbeat, artifact (name: its path, ok: not empty),
#: prediction (name, ok: readable), declared and expected (number of predictions), trial (name, status, dice, iou), limit (number of trials).
EVENTS = "run_id string, sequence bigint, timestamp timestamp, kind string, status string, pid bigint, number bigint, name string, ok boolean, dice double, iou double"
#: Artifacts of a finished run.
REQUIRED = ("run_summary.json", "main_handoff.json", "report/summary.json", "best_inference/inference_summary.json", "model")
FACTS = "run_id string, status string, launcher string, code bigint, pid bigint, declared bigint, expected bigint, present int, readable int, seen bigint, alive boolean"
#: Which fact an event's field gives.
_FIELDS = {"controller": (("status", "status"), ("pid", "pid")), "launcher": (("launcher", "status"), ("pid", "pid"), ("code", "number")), "declared": (("declared", "number"),), "expected": (("expected", "number"),)}
_KINDS = (*_FIELDS, "heartbeat", "artifact", "prediction")


def _plain(v: object) -> object:
    return None if v is None or v != v else v


class RunFacts(StatefulProcessor):
    """One state a run; ``silence`` and ``gone`` in milliseconds."""

    def __init__(self, silence: int, gone: int, required: tuple[str, ...]):
        self.silence, self.gone, self.required = silence, gone, frozenset(required)

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "fact string", "at bigint, sequence bigint, text string, number bigint")
        self.files = handle.getMapState("files", "file string", "at bigint, sequence bigint, ok boolean")
        self.counts = handle.getValueState("counts", "present int, readable int, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        present, readable, seen = self.counts.get() or (0, 0, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                at, sequence = int(r.at), int(r.sequence) if _plain(r.sequence) is not None else -1
                seen = max(seen, at)
                for fact, field in _FIELDS.get(r.kind, ()):
                    self._newest(fact, at, sequence, _plain(getattr(r, field)), always=fact != "pid")
                if r.kind in ("artifact", "prediction") and _plain(r.name) is not None:
                    change = self._file(f"{r.kind[0]}{r.name}", at, sequence, bool(_plain(r.ok)))
                    if r.kind == "prediction":
                        readable += change
                    elif r.name in self.required:
                        present += change
        self.counts.update((present, readable, seen))
        now = timerValues.getCurrentWatermarkInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for wait in (self.silence, self.gone):
            if seen + wait > now:
                self.handle.registerTimer(seen + wait)
        yield self._facts(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._facts(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _newest(self, fact: str, at: int, sequence: int, value: object, always: bool) -> None:
        if value is None and not always:
            return  # an event that names no process says nothing about it
        text, number = (value, None) if isinstance(value, str) else (None, None if value is None else int(value))
        old = self.latest.getValue((fact,)) if self.latest.containsKey((fact,)) else None
        if old is None or (at, sequence, text or "", -1 if number is None else number) > (old[0], old[1], old[2] or "", -1 if old[3] is None else old[3]):
            self.latest.updateValue((fact,), (at, sequence, text, number))

    def _file(self, name: str, at: int, sequence: int, ok: bool) -> int:
        """1 or -1 if the file's latest event makes it count or no longer count."""
        old = self.files.getValue((name,)) if self.files.containsKey((name,)) else None
        if old is not None and (at, sequence, ok) <= (old[0], old[1], old[2]):
            return 0
        self.files.updateValue((name,), (at, sequence, ok))
        return int(ok) - int(old is not None and old[2])

    def _facts(self, key, now: int) -> pd.DataFrame:
        present, readable, seen = self.counts.get()
        value = {}
        for fact in ("status", "launcher", "code", "pid", "declared", "expected"):
            found = self.latest.getValue((fact,)) if self.latest.containsKey((fact,)) else None
            value[fact] = None if found is None else found[2] if fact in ("status", "launcher") else found[3]
        alive = True if now < seen + self.silence else None if now < seen + self.gone else False
        row = [key[0], value["status"], value["launcher"], value["code"], value["pid"], value["declared"], value["expected"], present, readable, seen, alive]
        return pd.DataFrame([row], columns=[c.split()[0] for c in FACTS.split(", ")]).astype(object)


def _milliseconds(at: Column) -> Column:
    return F.unix_millis(at)


def run_facts(events: DataFrame, late: str = "1 hour", silence: int = 15 * 60_000, gone: int = 60 * 60_000, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A stream of ``FACTS``, a row whenever a run is heard of or falls silent."""
    known = events.where(F.col("run_id").isNotNull() & F.col("timestamp").isNotNull() & F.col("kind").isin(*_KINDS))
    rows = known.withWatermark("timestamp", late).withColumn("at", _milliseconds(F.col("timestamp")))
    return rows.groupBy("run_id").transformWithStateInPandas(RunFacts(silence, gone, required), FACTS, "Update", "EventTime")


def batch_facts(events: DataFrame, late_ms: int = 60 * 60_000, silence: int = 15 * 60_000, gone: int = 60 * 60_000, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``FACTS`` of a whole log, as the stream has them when it has read it: maxima by (timestamp, sequence), no state."""
    known = events.where(F.col("run_id").isNotNull() & F.col("timestamp").isNotNull() & F.col("kind").isin(*_KINDS)).withColumn("at", _milliseconds(F.col("timestamp")))
    sequence = F.coalesce("sequence", F.lit(-1).cast("long"))

    def newest(kind: tuple[str, ...], field: str, always: bool = True) -> Column:
        value = F.col(field)
        rank = F.struct("at", sequence.alias("s"), F.coalesce(value, F.lit("") if field == "status" else F.lit(-1)).alias("v"))
        says = F.col("kind").isin(*kind) if always else F.col("kind").isin(*kind) & value.isNotNull()
        return F.max_by(F.struct(value.alias("v")), F.when(says, rank))["v"]

    files = known.where(F.col("kind").isin("artifact", "prediction") & F.col("name").isNotNull()).groupBy("run_id", "kind", "name")
    ok = files.agg(F.max(F.struct("at", sequence.alias("s"), F.coalesce("ok", F.lit(False)).alias("ok")))["ok"].alias("ok")).where("ok")
    counts = ok.groupBy("run_id").agg(
        F.count_if((F.col("kind") == "artifact") & F.col("name").isin(*required)).cast("int").alias("present"), F.count_if(F.col("kind") == "prediction").cast("int").alias("readable")
    )
    facts = known.groupBy("run_id").agg(
        newest(("controller",), "status").alias("status"), newest(("launcher",), "status").alias("launcher"), newest(("launcher",), "number").alias("code"),
        newest(("controller", "launcher"), "pid", always=False).alias("pid"), newest(("declared",), "number").alias("declared"), newest(("expected",), "number").alias("expected"), F.max("at").alias("seen"),
    )
    now = known.agg((F.max("at") - late_ms).alias("now"))
    quiet = F.col("now") - F.col("seen")
    alive = F.when(quiet < silence, True).when(quiet < gone, F.lit(None)).otherwise(False)
    joined = facts.join(counts, "run_id", "left").crossJoin(F.broadcast(now))  # one row
    return joined.select(
        "run_id", "status", "launcher", "code", "pid", "declared", "expected", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("readable", F.lit(0)).alias("readable"), "seen", alive.alias("alive"),
    )


def with_state(facts: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``facts`` with ``state``, by the rule of the planner."""
    c = F.col
    missing = F.lit(len(required)) - c("present")
    state = run_state(c("status"), c("launcher"), c("code"), c("pid"), c("alive"), missing, c("declared"), F.coalesce("expected", F.lit(0)), c("readable"))
    return facts.withColumn("state", state)


def follow(facts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each batch's rows under its number; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return facts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest facts of every run that ``follow`` wrote."""
    rows = spark.read.parquet(path)
    whole = F.struct(*[c for c in rows.columns if c != "batch"])
    # in one batch an event's row comes before that of a timer: the quieter one is later
    order = F.struct("batch", "seen", F.when(F.col("alive"), 0).when(F.col("alive").isNull(), 1).otherwise(2))
    return rows.groupBy("run_id").agg(F.max_by(whole, order).alias("r")).select("r.*")


def supervision(events: DataFrame) -> DataFrame:
    """Each run's trials: the latest record of each counts; the best is that of the highest (dice, iou), of equal ones the first by name.

    (run_id, n_completed, n_failed, best_trial, best_dice, best_iou, max_trials, run_status, advice); a status without trials has zeros.
    """
    rank = F.struct("timestamp", F.coalesce("sequence", F.lit(-1).cast("long")).alias("s"))
    trials = events.where("kind = 'trial' and name is not null").groupBy("run_id", "name").agg(F.max_by(F.struct("status", "dice", "iou"), rank).alias("t")).select("run_id", "name", "t.*")
    score = F.struct(F.coalesce("dice", F.lit(0.0)).alias("d"), F.coalesce("iou", F.lit(0.0)).alias("i"))
    done = F.col("status") == "completed"
    best = trials.where(done).groupBy("run_id").agg(F.max(score).alias("top"))
    first = trials.where(done).join(best, "run_id").where(score == F.col("top")).groupBy("run_id").agg(F.min(F.struct("name", "dice", "iou")).alias("b"))
    counts = trials.groupBy("run_id").agg(F.count_if(done).alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    runs = events.where("run_id is not null").groupBy("run_id").agg(
        F.max_by("status", F.when(F.col("kind") == "controller", rank)).alias("run_status"), F.max_by("number", F.when(F.col("kind") == "limit", rank)).alias("max_trials")
    )
    n = F.coalesce("n_completed", F.lit(0).cast("long"))
    advice = (
        F.when(F.col("run_status") == "completed", "report_results").when(F.col("run_status") == "failed", "inspect_failure")
        .when(n < F.coalesce("max_trials", F.lit(0)), "keep_monitoring").otherwise("inspect_ambiguous")
    )
    joined = runs.join(counts, "run_id", "left").join(first, "run_id", "left")
    return joined.select(
        "run_id", n.alias("n_completed"), F.coalesce("n_failed", F.lit(0).cast("long")).alias("n_failed"), F.col("b.name").alias("best_trial"), F.col("b.dice").alias("best_dice"),
        F.col("b.iou").alias("best_iou"), "max_trials", "run_status", advice.alias("advice"),
    )
