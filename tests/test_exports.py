"""Exports: all or nothing, verified, leased, reused."""

import hashlib
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import kernels
from assayer.sources import exports
from assayer.sources.exports import Refused


def sha(data):
    return hashlib.sha256(data).hexdigest()


def visible(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def staged(folder):
    return sorted(p.name for p in folder.iterdir() if p.name.startswith(".staging"))


@pytest.fixture
def sources(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(20):
        (tmp_path / "in" / f"f{i}").write_bytes(bytes([i]) * (i * 1000))
    return tmp_path


def files_of(spark, folder, n=20):
    rows = [(f"d{i % 3}/f{i}", f"{folder}/in/f{i}", None, sha(bytes([i]) * (i * 1000)), json.dumps({"i": i})) for i in range(n)]
    return spark.createDataFrame(rows, exports.FILES)


def test_whole_export_and_reuse(spark, sources):
    files = files_of(spark, sources).unionByName(spark.createDataFrame([("text", None, b"abc", None, None)], exports.FILES))
    out = sources / "out" / "set"
    done = exports.export(spark, files.withColumn("clash", F.lit(1)), str(out), {"a": 1}, {"dataset.json": {"x": 1}, "note.txt": "hello"})
    assert done["status"] == "completed" and done["files"] == 21 and done["bytes"] == 190_003
    rows = exports.manifest(spark, str(out)).collect()
    assert {r["path"] for r in rows} == {f"d{i % 3}/f{i}" for i in range(20)} | {"text"}
    assert all(sha((out / r["path"]).read_bytes()) == r["sha256"] and (out / r["path"]).stat().st_size == r["bytes"] for r in rows)
    assert json.loads((out / "dataset.json").read_text()) == {"x": 1} and (out / "note.txt").read_text() == "hello"
    made = (out / "text").stat().st_mtime_ns
    again = exports.export(spark, files.repartition(7), str(out), {"a": 1})
    assert again["status"] == "already_exists" and again["digest"] == done["digest"] and (out / "text").stat().st_mtime_ns == made
    with pytest.raises(Refused, match="output_must_be_fresh"):
        exports.export(spark, files, str(out), {"a": 2})
    assert visible(sources / "out") == ["set"] and not staged(sources / "out") and not list((sources / "out" / ".leases").glob("*.json"))


def test_refusals(spark, sources):
    files, out = files_of(spark, sources), str(sources / "out")
    for bad, code in (
        (files.limit(0), "export_empty"), (files.union(files), "duplicate_target"), (files.withColumn("source", F.lit(None)), "artifact_binding_incomplete"),
        *[(files.limit(1).withColumn("target", F.lit(t)), "target_leaves_folder") for t in ("../x", "/x", "a/../../x", ".hidden", "a//b", "export.json", None)],
    ):
        with pytest.raises(Refused, match=code):
            exports.export(spark, bad, out, {})
    for inside in ("in", "in/new", ""):
        with pytest.raises(Refused, match="output_overlaps_source|output_must_be_fresh"):
            exports.export(spark, files, f"{sources}/{inside}", {})
    assert visible(sources) == ["in"]


@pytest.mark.parametrize("broken", ["changed", "gone"])
def test_a_failed_export_leaves_nothing(spark, sources, broken):
    files = files_of(spark, sources)
    if broken == "changed":
        (sources / "in" / "f7").write_bytes(b"other")
    else:
        os.remove(sources / "in" / "f7")
    (sources / "out").mkdir()
    with pytest.raises(Exception):
        exports.export(spark, files, str(sources / "out" / "set"), {})
    assert visible(sources / "out") == [] and staged(sources / "out") == []
    (sources / "in" / "f7").write_bytes(bytes([7]) * 7000)
    assert exports.export(spark, files, str(sources / "out" / "set"), {})["status"] == "completed"


def test_leases(spark, sources):
    files, root = files_of(spark, sources, 3), sources / "out"
    sign = exports.signature({}, exports.as_files(files))
    assert sign == exports.signature({}, exports.as_files(files.orderBy(F.desc("target")))) != exports.signature({}, exports.as_files(files.limit(2)))
    held = exports.Lease(spark, str(root), sign, 60)
    assert held.acquire() is None and held.acquire()["until"] > time.time()
    assert exports.export(spark, files, f"{root}/set", {})["status"] == "already_running" and visible(root) == []
    held.release()
    short = exports.Lease(spark, str(root), sign, 0.01)  # a driver that was killed: its lease runs out, its staging stays
    assert short.acquire() is None
    (root / f".staging-set-{sign}-dead").mkdir()
    (root / ".staging-set-other-alive").mkdir()
    time.sleep(0.05)
    assert exports.export(spark, files, f"{root}/set", {})["status"] == "completed"
    assert staged(root) == [".staging-set-other-alive"]


@pytest.fixture
def results(spark, tmp_path):
    folder = tmp_path / "source"
    folder.mkdir()
    rows = []
    for case in ("a", "b"):
        for kind in ("prediction", "overlay"):
            data = f"{case}{kind}".encode()
            (folder / f"{case}_{kind}.png").write_bytes(data)
            rows.append((kind, case, f"{folder}/{case}_{kind}.png", sha(data)))
    text = json.dumps({"metrics_per_case": {"a_0000.png": {"mean_dice": 0.5, "n": 3, "nested": {"x": 1}, "note": "text"}, "b.png": {"mean_dice": None}}, "mean_dice": 0.5})
    (folder / "summary.json").write_text(text)
    rows.append(("summary", None, f"{folder}/summary.json", sha(text.encode())))
    return folder, rows, spark.createDataFrame([(text,)], "text string")


IDS = {"dataset_id": "dataset-A", "run_id": "run-A"}


def test_delivery_is_traceable(spark, results, tmp_path):
    folder, rows, metrics = results
    artifacts = spark.createDataFrame(rows, "kind string, case_id string, path string, sha256 string")
    out = tmp_path / "out"
    done = exports.deliver(spark, artifacts, str(out), IDS, cases=("a",), kinds=("prediction", "summary"), metrics=metrics)
    assert done["status"] == "completed" and done["request"]["run_id"] == "run-A"
    got = {r["path"]: r for r in exports.manifest(spark, str(out)).collect()}
    assert set(got) == {"prediction/a.png", "summary/overall.json"} and got["prediction/a.png"]["source_path"] == f"{folder}/a_prediction.png"
    assert all(sha((out / p).read_bytes()) == r["sha256"] for p, r in got.items())
    table = spark.read.option("header", True).csv(str(out / "per_case_metrics")).collect()
    assert [r.asDict() for r in table] == [{"case_id": "a_0000.png", "mean_dice": "0.5", "n": "3"}]
    assert "dataset-A / run-A" in (out / "report.html").read_text()


def test_delivery_checks(spark, results, tmp_path):
    folder, rows, metrics = results
    schema = "kind string, case_id string, path string, sha256 string"
    out = str(tmp_path / "out")

    def codes(rows=rows, ids=IDS, **more):
        found = exports.deliver(spark, spark.createDataFrame(rows, schema), out, ids, **more)
        assert found["status"] == "block" and not os.path.exists(out)
        return found["reason_codes"]

    assert codes(ids={"dataset_id": "x"}) == ["result_identity_missing"]
    assert codes(expected={"dataset_id": "wrong"}) == ["dataset_identity_mismatch"] and codes(expected={"run_id": "wrong"}) == ["run_identity_mismatch"]
    assert codes([]) == ["result_artifacts_missing"]
    assert codes(rows + rows[:1]) == ["duplicate_case_artifact"]
    assert codes([(*rows[0][:3], "bad")]) == ["artifact_hash_mismatch"]
    assert codes([("image", "a", "/nonexistent/never", "x")]) == ["result_artifact_missing"]
    assert codes([("image", "a", None, "x")]) == ["artifact_binding_incomplete", "result_artifact_missing"]
    assert codes([("film", "a", *rows[0][2:])]) == ["invalid_artifact_kind"] and codes([("image", "a/b", *rows[0][2:])]) == ["invalid_case_id"]
    assert codes(cases=("absent",)) == ["requested_case_missing_or_duplicate"] and codes(cases=("a", "a")) == ["requested_case_missing_or_duplicate"]
    assert codes(kinds=("image",)) == ["requested_artifact_missing"] and codes(kinds=("film",)) == ["invalid_requested_artifact_kinds", "requested_artifact_missing"]
    assert codes(metrics=spark.createDataFrame([('{"mean_dice": 0.5}',)], "text string")) == ["per_case_metrics_missing"]
    both = spark.createDataFrame([('{"metrics_per_case": {"a.png": {"x": 1}, "a_0000.png": {"x": 2}}}',)], "text string")
    assert codes(metrics=both) == ["ambiguous_metric_case_id"]
    (folder / "a_prediction.png").write_bytes(b"changed")  # after it was bound
    assert codes() == ["artifact_hash_mismatch"]
    (folder / "a_prediction.png").write_bytes(b"aprediction")
    for inside in (f"{folder}/new", str(folder)):
        with pytest.raises(Refused):
            exports.deliver(spark, spark.createDataFrame(rows, schema), inside, IDS)


def test_segmentation_and_ready_subset(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(0)
    rows, splits = [], []
    for i in range(6):
        image, label = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (5, 7)).astype(np.uint8)
        (tmp_path / "in" / f"i{i}.png").write_bytes(kernels.encode_png(image)), (tmp_path / "in" / f"l{i}.png").write_bytes(kernels.encode_png(label))
        rows.append((f"c{i}", f"{tmp_path}/in/i{i}.png", [("teeth", f"{tmp_path}/in/l{i}.png"), ("other", "x")]))
        splits.append((f"c{i}", "test" if i == 5 else "train"))
    cases = spark.createDataFrame(rows, "case_id string, image string, labels array<struct<role:string,path:string>>")
    parts = spark.createDataFrame(splits, "case_id string, split string")
    root = tmp_path / "raw"
    number, folder = exports.next_folder(str(root), "Teeth binary!")
    assert (number, folder) == (501, "Dataset501_Teethbinary")
    done = exports.export_segmentation(spark, cases, parts, "teeth", f"{root}/{folder}", "Teeth")
    assert done["status"] == "completed" and done["files"] == 12
    label = kernels.decode_png((root / folder / "labelsTr" / "c0.png").read_bytes())
    assert (label == (kernels.decode_png((tmp_path / "in" / "l0.png").read_bytes()) > 127)).all()
    assert json.loads((root / folder / "dataset.json").read_text())["numTraining"] == 5
    assert exports.export_segmentation(spark, cases, parts, "teeth", f"{root}/{folder}", "Teeth")["status"] == "already_exists"
    assert exports.next_folder(str(root), "Teeth")[0] == 502
    quality = lambda *bad: spark.createDataFrame([(f"c{i}", "manual_review" if i in bad else "Ready ") for i in range(6)], "case_id string, status string")
    sub = exports.export_ready(spark, f"{root}/{folder}", quality(1, 2), f"{root}/Dataset502_Ready", "Ready")
    assert sub["status"] == "completed" and sub["files"] == 8
    assert sorted(p.name for p in (root / "Dataset502_Ready" / "labelsTr").iterdir()) == ["c0.png", "c3.png", "c4.png"]
    about = json.loads((root / "Dataset502_Ready" / "dataset.json").read_text())
    assert about["numTraining"] == 3 and about["description"].endswith("Filtered to QC statuses ['ready'].")
    for bad, code in ((quality(*range(6)), "no_selected_cases"), (quality(*range(5)), "no_training_cases"), (quality().union(spark.createDataFrame([("zz", "ready")], "a string, b string")), "split_unknown")):
        with pytest.raises(Refused, match=code):
            exports.export_ready(spark, f"{root}/{folder}", bad, f"{root}/none", "None")
    (root / folder / "labelsTr" / "c0.png").write_bytes(b"rot")
    with pytest.raises(Exception, match="source_changed_during_delivery"):
        exports.export_ready(spark, f"{root}/{folder}", quality(), f"{root}/none", "None")
    assert not (root / "none").exists()
