"""Detection exports and running numbers."""

import json
import random

import pytest

from assayer.operators.splits import numbered
from assayer.sources import exports, sinks


@pytest.mark.parametrize("stored", [False, True])
def test_numbers_run_within_groups(spark, tmp_path, stored):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "b", None]), rng.choice([f"k{i}" for i in range(60)]) + str(n), n) for n in range(500)]
    df = spark.createDataFrame(rows, "g string, k string, n int").repartition(5)
    before = spark.sparkContext.getCheckpointDir()
    if stored:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = {(r["g"], r["k"]): r["id"] for r in numbered(df, "g", ["k"], "id").collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {(g, k): i for i, k in enumerate(sorted(k for h, k, _ in rows if h == g), 1)}
    assert got == want and (before is not None or not stored or spark.sparkContext.getCheckpointDir())
    assert numbered(df.limit(0), "g", ["k"], "id").collect() == []


def test_coco_tables(spark):
    images = spark.createDataFrame([("train", "b"), ("train", "a"), ("test", "c")], "split string, case_id string")
    boxes = spark.createDataFrame([("b", "3", [0.0, 0.0, 2.0, 3.0]), ("a", "x", [1.0, 1.0, 2.0, 2.0]), ("b", "1", [0.0, 0.0, 1.0, 1.0]), ("c", "x", [0.0, 0.0, 4.0, 4.0])], "case_id string, label string, bbox_xyxy array<double>")
    img, annotations, categories = sinks.coco_tables(boxes, images)
    assert {(r["split"], r["case_id"]): r["image_id"] for r in img.collect()} == {("train", "a"): 1, ("train", "b"): 2, ("test", "c"): 1}
    assert {r["label"]: r["category_id"] for r in categories.collect()} == {"1": 1, "3": 3, "x": 4}
    got = {(r["split"], r["annotation_id"]): (r["image_id"], r["category_id"], r["bbox"], r["area"]) for r in annotations.collect()}
    assert got == {("train", 1): (1, 4, [1.0, 1.0, 1.0, 1.0], 1.0), ("train", 2): (2, 1, [0.0, 0.0, 1.0, 1.0], 1.0), ("train", 3): (2, 3, [0.0, 0.0, 2.0, 3.0], 6.0), ("test", 1): (1, 4, [0.0, 0.0, 4.0, 4.0], 16.0)}


def test_yolo_export(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.png").write_bytes(name.encode())
    images = spark.createDataFrame([("train", "a", f"{tmp_path}/in/a.png", 10, 20), ("val", "b", f"{tmp_path}/in/b.png", 4, 4)], "split string, case_id string, path string, width int, height int")
    rows = [("train", "a", 1, [0.0, 0.0, 5.0, 10.0]), ("train", "a", 0, [-5.0, 10.0, 5.0, 40.0]), ("train", "a", 0, [3.0, 3.0, 3.0, 9.0]), ("train", "a", 0, None), ("val", "lost", 0, [0.0, 0.0, 1.0, 1.0])]
    files, audit = sinks.yolo_files(spark.createDataFrame(rows, "split string, case_id string, class_id int, bbox_xyxy array<double>"), images)
    assert {r["split"]: tuple(r)[1:] for r in audit.collect()} == {"train": (1, 2, 2, 0), "val": (1, 0, 0, 1)}
    done = exports.export(spark, files, f"{tmp_path}/out", {"kind": "yolo"}, {"data.yaml": sinks.yolo_description(["tooth", "é"], ["train", "val"])})
    assert done["files"] == 4 and (tmp_path / "out/labels/val/b.txt").read_text() == "" and (tmp_path / "out/images/train/a.png").read_bytes() == b"a"
    assert (tmp_path / "out/labels/train/a.txt").read_text() == "0 0.25000000 0.75000000 0.50000000 0.50000000\n1 0.25000000 0.25000000 0.50000000 0.50000000"
    text = (tmp_path / "out/data.yaml").read_text()
    assert "train: images/train\nval: images/val\nnc: 2\n" in text and json.loads(text.split("names: ")[1]) == ["tooth", "é"]


def test_reports_say_what_they_leave_out(spark):
    counts = spark.range(5)
    issues = spark.createDataFrame([("error", "t", str(i), "m") for i in range(4)], "severity string, type string, case_id string, message string")
    text = sinks.report_markdown("R", counts, issues, most=3, most_counts=2)
    assert "The first 2 of 5 counts." in text and "The first 3 of 4 issues." in text and "of" not in sinks.report_markdown("R", counts, issues).split("issues")[-1]
