"""The run stream against the batch, over shuffled, repeated and differently cut logs."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from assayer.streaming import runs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SILENCE, GONE, LATE = 15 * 60_000, 60 * 60_000, 10 * 3600_000


def event(run, minute, kind, sequence=None, **more):
    return {"run_id": run, "sequence": sequence, "timestamp": (T0 + timedelta(minutes=minute)).isoformat(), "kind": kind} | more


def log():
    whole = [event("done", i, "artifact", name=n, ok=True) for i, n in enumerate(runs.REQUIRED)] + [event("done", 9, "prediction", name=f"p{i}", ok=True) for i in range(3)]
    out = [event("done", 1, "controller", 1, status="running", pid=7), event("done", 10, "controller", 2, status="completed"), event("done", 9, "declared", number=3), *whole]
    out += [{**e, "run_id": "short"} for e in whole if e.get("name") != "p2"] + [event("short", 10, "controller", status="completed"), event("short", 10, "expected", number=3)]
    out += [{**e, "run_id": "rotten"} for e in whole] + [event("rotten", 12, "prediction", name="p1", ok=False), event("rotten", 12, "declared", number=3), event("rotten", 12, "controller", status="completed")]
    out += [event("failed", 2, "controller", 5, status="failed"), event("failed", 2, "controller", 4, status="completed"), event("code", 3, "launcher", status="started", number=1, pid=3)]
    out += [event("stopped", 3, "launcher", status="interrupted"), event("silent", 3, "launcher", status="started", pid=3), event("silent", 59, "heartbeat")]
    out += [event("quiet", 5, "launcher", status="started", pid=3), event("quiet", 415, "heartbeat"), event("live", 5, "controller", status="running", pid=3), event("live", 475, "heartbeat")]
    out += [event("nothing", 4, "heartbeat"), event("vague", 4, "controller", status="running"), event("tie", 5, "controller", 1, status="failed"), event("tie", 5, "controller", 1, status="interrupted")]
    out += [event(None, 5, "heartbeat"), event("odd", 5, "song"), {"run_id": "no time", "kind": "heartbeat"}]
    return out


CLOCK = event("clock", 1080, "heartbeat")  # the last event: it moves the watermark to minute 480
WANT = {
    "done": "completed", "short": "incomplete_artifacts", "rotten": "incomplete_artifacts", "failed": "failed", "code": "failed", "stopped": "interrupted", "silent": "failed",
    "quiet": "failed", "live": "running", "nothing": "submitted", "vague": "unknown", "tie": "interrupted", "clock": "submitted",
}


def states(facts):
    return {r["run_id"]: r["state"] for r in runs.with_state(facts).collect()}


@pytest.fixture
def stateful(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, folder, parts):
    """Facts after each part has been read by a query that is stopped and started again."""
    (folder / "log").mkdir()
    for i, part in enumerate(parts):
        (folder / "log" / f"{i}.json").write_text("\n".join(map(json.dumps, part)) + "\n")
        stream = spark.readStream.schema(runs.EVENTS).json(str(folder / "log"))
        q = runs.follow(runs.run_facts(stream, f"{LATE} milliseconds", SILENCE, GONE), str(folder / "out"), str(folder / "cp"))
        assert q.awaitTermination(240) and q.exception() is None
    return runs.current(spark, str(folder / "out"))


def test_batch(spark):
    rows = spark.read.schema(runs.EVENTS).json(spark.sparkContext.parallelize([json.dumps(e) for e in [*log(), CLOCK]]))
    assert states(runs.batch_facts(rows, LATE, SILENCE, GONE)) == WANT
    assert states(runs.batch_facts(rows.union(rows), LATE, SILENCE, GONE)) == WANT
    assert runs.batch_facts(rows.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_in_any_order_and_cut(stateful, tmp_path, seed):
    rng = random.Random(seed)
    events = log() + rng.sample(log(), 12)  # some again
    rng.shuffle(events)
    cut = sorted(rng.sample(range(1, len(events)), 2))
    parts = [events[: cut[0]], events[cut[0] : cut[1]], events[cut[1] :] if seed == 1 else [*events[cut[1] :], CLOCK]]
    got = streamed(stateful, tmp_path, parts if seed == 2 else [*parts, [CLOCK]])
    rows = stateful.read.schema(runs.EVENTS).json(str(tmp_path / "log"))
    assert states(got) == WANT
    same = runs.batch_facts(rows, LATE, SILENCE, GONE)
    assert got.exceptAll(same).collect() == [] and same.exceptAll(got).collect() == []


def test_supervision(spark):
    events = [
        event("a", 1, "trial", name="t1", status="completed", dice=0.5, iou=0.4), event("a", 2, "trial", name="t1", status="completed", dice=0.7, iou=0.4),
        event("a", 1, "trial", name="t2", status="completed", dice=0.7, iou=0.5), event("a", 1, "trial", name="t0", status="completed", dice=0.7, iou=0.5),
        event("a", 1, "trial", name="t3", status="failed"), event("a", 1, "limit", number=9), event("b", 1, "controller", status="completed"), event("c", 1, "controller", status="failed"), event("d", 1, "heartbeat"),
    ]
    rows = spark.read.schema(runs.EVENTS).json(spark.sparkContext.parallelize([json.dumps(e) for e in events]))
    got = {r["run_id"]: r for r in runs.supervision(rows).collect()}
    a = got["a"]
    assert (a["n_completed"], a["n_failed"], a["best_trial"], a["best_dice"], a["best_iou"], a["advice"]) == (3, 1, "t0", 0.7, 0.5, "keep_monitoring")
    assert {k: got[k]["advice"] for k in "bcd"} == {"b": "report_results", "c": "inspect_failure", "d": "inspect_ambiguous"}
