import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import streaming
from assayer.functions import kernels
from assayer.sources import documents, files, rasters, sinks


def test_tree_and_profiles(spark, tmp_path):
    for folder, value in (("imagesTr", 30), ("labelsTr", 1)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.png").write_bytes(kernels.encode_png(np.full((16, 16), value, np.uint8)))
    (tmp_path / "labelsTr" / "bad.png").write_bytes(b"broken")
    t = files.tree(spark, str(tmp_path), content=True)
    rows = {r["rel_path"]: r for r in rasters.image_profiles(t, labels=True).collect()}
    assert rows["imagesTr/a.png"]["image"]["shape"] == [16, 16] and rows["labelsTr/a.png"]["image"]["label_values"] == [1]
    assert rows["labelsTr/bad.png"]["image"]["status"].startswith("unreadable")
    slim = files.tree(spark, str(tmp_path))
    assert {r["folder"]: r["image_file_count"] for r in files.folder_summary(slim).collect()} == {"imagesTr": 1, "labelsTr": 2}
    assert files.primary_folder(files.folder_summary(slim)).first()["folder"] == "imagesTr"
    assert files.tree(spark, str(tmp_path), max_depth=1).count() == 0
    assert sorted(r["line"] for r in rasters.yolo_lines(t.where("rel_path = 'labelsTr/a.png'").withColumn("case_id", F.lit("a"))).collect()) == ["0 0.50000000 0.50000000 1.00000000 1.00000000"]


def test_archive_guard(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("root/sub/a.txt", "1"), z.writestr("root/b.txt", "2"), z.writestr("../evil", "3")
    rows = {r["member"]: r for r in files.archive_members(spark, str(tmp_path / "x.zip")).collect()}
    assert rows["root/b.txt"]["content"] == b"2" and not rows["../evil"]["safe"] and rows["../evil"]["content"] is None
    safe = files.archive_members(spark, str(tmp_path / "x.zip")).where("safe")
    assert {r["target"] for r in files.flattened(safe).collect()} == {"sub/a.txt", "b.txt"}


def test_documents(spark, tmp_path):
    boxes = [{"External ID": "c1.png", "Label": {"objects": [{"title": "3", "bounding box": [1, 2, 3, 4]}, {"title": "4", "bounding box": [1]}]}}]
    df = spark.createDataFrame([(json.dumps(boxes),)], "text string")
    r = documents.box_annotations(df).first()
    assert r["case_id"] == "c1" and [b["label"] for b in r["bbox_annotations"]] == ["3"]
    coco = {"images": [{"id": 1, "file_name": "a.png"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [1, 1, 2, 3]}], "categories": []}
    c = documents.coco_annotations(spark.createDataFrame([(json.dumps(coco),)], "text string")).first()
    assert (c["case_id"], c["label"], c["bbox_xyxy"]) == ("a", "7", [1.0, 1.0, 3.0, 4.0])
    assert documents.json_blocks('x {"a": "}"} y {"b": {"c": 1}}') == ['{"a": "}"}', '{"b": {"c": 1}}']
    out = spark.createDataFrame([("\x1b[31mlog {\"a\": 1}",)], "t string").select(documents.model_output(F.col("t"))).first()[0]
    assert out == '{"a": 1}'
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nnope\n{"a": 2}\n')
    assert documents.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a int", strict=False).count() == 2
    with pytest.raises(Exception):
        documents.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a int").collect()


def test_coco_documents_are_read_once_and_joined_in_place(spark):
    coco = {
        "images": [{"id": 1, "file_name": "a.png"}, {"id": 1, "file_name": "aa.x.png"}, {"id": None, "file_name": "n.png"}, {"id": 2}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [1, 1, 2, 3]}, None, {"id": 2, "image_id": 9, "category_id": 7}, {"id": 3, "category_id": 7}, {"id": 4, "image_id": 2, "category_id": 8, "bbox": [1]}, {"id": 5, "image_id": 1}],
        "categories": [{"id": 7, "name": "x"}, {"id": 7, "name": "y"}, {"id": 8, "name": None}, None, {"name": "none"}],
    }
    other = json.dumps({"images": [{"id": 1, "file_name": "b.png"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [0, 0, 1, 1]}]})
    df = spark.createDataFrame([(1, json.dumps(coco)), (2, other), (3, "nope"), (4, None), (5, '{"images": []}'), (6, other)], "k long, text string")
    zeros = [0.0] * 4
    want = [("a", None, zeros), ("a", "x", [1.0, 1.0, 3.0, 4.0]), ("a", "y", [1.0, 1.0, 3.0, 4.0]), ("aa.x", None, zeros), ("aa.x", "x", [1.0, 1.0, 3.0, 4.0]), ("aa.x", "y", [1.0, 1.0, 3.0, 4.0]), ("b", "7", [0.0, 0.0, 1.0, 1.0])]
    for key, copies in (("k", 2), (None, 1)):
        found = documents.coco_annotations(df, key=key)
        plan = found._jdf.queryExecution().toString()
        assert "Join" not in plan and plan.count("MapInArrow") > 0
        got = sorted(((r["case_id"], r["label"], r["bbox_xyxy"]) for r in found.where("case_id is not null").collect()), key=str)
        assert got == sorted(want + [want[-1]] * (copies - 1), key=str)


def test_kernels():
    mask = np.zeros((6, 6), np.uint8)
    mask[0:2, 0:2], mask[4, 4] = 1, 1
    p = kernels.label_profile(mask)
    assert (p["components"], p["tiny_components"]) == (2, 2)
    assert kernels.hd95(mask > 0, mask > 0) == 0 and kernels.hd95(mask > 0, mask > 9) == pytest.approx(72**0.5)
    assert kernels.majority_mask([np.array([1, 2]), np.array([2, 2]), np.array([3, 1])]).tolist() == [1, 2]
    filled, skipped = kernels.rasterise([(1, [(0, 0), (4, 0), (4, 4), (0, 4)]), (99, [])], 6, 6)
    assert filled.sum() == 16 and skipped == 1
    boxed, how = kernels.letterbox(mask, 12)
    assert (kernels.unletterbox(boxed, how, 6, 6) == mask).all()
    for there, back in kernels.VARIANTS.values():
        assert (back(there(mask)) == mask).all()
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348), struct.pack_into("<8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1), struct.pack_into("<h", head, 70, 2)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.5, 2, 1, 1, 1, 1), struct.pack_into("<f", head, 108, 352)
    voxels, info = kernels.nifti_volume(bytes(head) + bytes(range(24)))
    assert voxels.shape == (2, 3, 4) and info["spacing"] == [0.5, 0.5, 2.0]
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (9, 7)).astype(np.uint8)
    assert (kernels.decode_png(kernels.encode_png(pixels)) == pixels).all()


def test_sinks_and_stream(spark, tmp_path):
    sinks.write_json({"a": 1}, str(tmp_path / "x" / "a.json"))
    assert json.loads((tmp_path / "x" / "a.json").read_text()) == {"a": 1}
    df = spark.createDataFrame([("r1", 1, "2024-01-01 00:00:00", "start", "running"), ("r1", 2, "2024-01-01 00:01:00", "end", "completed")], "run_id string, sequence long, timestamp string, event string, status string")
    assert sinks.write_report_csv(df, str(tmp_path / "r.csv")) == 2 and (tmp_path / "r.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    sinks.append_events(df, str(tmp_path / "log"))
    stream = streaming.event_stream(spark, str(tmp_path / "log"))
    q = streaming.run_once(streaming.deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and streaming.latest_status(got).first()["status"] == "completed"
