from pyspark.sql import functions as F

from assayer.operators import audits


def frame(spark, schema, rows):
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in rows], kind)


GOOD = {"image_path": "i", "image_roles": ["r"], "label_roles": ["m"], "image_ok": True, "dimensions": 2, "shape": [16, 16], "label_path": "l", "label_ok": True, "label_shape": [16, 16], "label_values": [0, 1], "allowed_values": [0, 1], "foreground_ratio": 0.5, "tiny_components": 0, "components_per_class": 1, "labels": ["1"], "boxes": [], "polygons": []}


def test_dataset_issues(spark):
    rows = [
        GOOD | {"case_id": "a", "image_case_id": "a", "split": "train", "pos": 1, "content_sha1": "h"},
        GOOD | {"case_id": "b", "image_case_id": "x", "split": "test", "pos": 2, "content_sha1": "h", "label_values": [0, 255], "labels": ["1", "A", "?"]},
        GOOD | {"case_id": "a_copy", "image_case_id": "a_copy", "split": "val", "pos": 3, "content_sha1": "g", "label_shape": [8, 8], "boxes": [("t", [0.0, 0.0, 99.0, 2.0]), ("t", [1.0])]},
        {"case_id": "d", "pos": 4},
    ]
    found = {(r["case_id"], r["type"]) for r in audits.dataset_issues(frame(spark, audits.CASES, rows)).collect()}
    assert found == {
        ("b", "image_case_id_mismatch"), ("b", "invalid_label_values"), ("b", "mixed_numbering_schema"), ("b", "invalid_annotation_labels"), ("b", "content_leakage"),
        ("a_copy", "image_label_shape_mismatch"), ("a_copy", "bbox_out_of_bounds"), ("a_copy", "invalid_bbox_format"), ("a_copy", "duplicated_bbox_labels"),
        (None, "normalized_identifier_leakage"), ("d", "missing_image"), ("d", "missing_annotation"),
    }


def test_cohort_findings(spark):
    ok = {"n_images": 1, "image_ok": True, "dimensions": 3, "shape": [9, 9, 9], "spacing": [1.0, 1.0, 1.0], "modality": "CT", "dynamic_range": 9.0, "std": 1.0, "foreground_ratio": 0.3, "n_labels": 1}
    rows = [ok | {"case_id": f"c{i}", "split": "train", "file_sha1": f"f{i}", "series_uid": f"s{i}"} for i in range(6)]
    rows += [ok | {"case_id": "far", "spacing": [1.0, 1.0, 40.0], "split": "test", "file_sha1": "f0", "series_uid": "s9"}, {"case_id": "none", "n_images": 0, "n_labels": 0}]
    found = {(r["case_id"], r["code"], r["severity"]) for r in audits.cohort_findings(frame(spark, audits.VOLUMES, rows)).collect()}
    assert found == {
        ("far", "spacing_outlier_axis_2", "moderate"), ("far", "fov_outlier_axis_2", "moderate"), ("none", "missing_image", "severe"), ("none", "missing_annotation_volume", "mild"),
        ("far", "exact_duplicate_scan", "severe"), ("c0", "exact_duplicate_scan", "severe"), ("far", "split_leakage", "severe"), ("c0", "split_leakage", "severe"),
    }


def test_governance(spark):
    rows = [{"case_id": "a", "image_path": "i", "mask_path": "m", "image_ok": True, "mask_ok": True, "shape": [2, 2], "mask_shape": [2, 3], "values": [0, 77], "regions": {77: 2}, "tiny_components": 1}, {"case_id": "b"}]
    splits = spark.createDataFrame([("train", "a"), ("test", "a"), ("val", "zz")], "split string, case_id string")
    found = {(r["case_id"], r["type"]) for r in audits.governance_issues(frame(spark, audits.GOVERNANCE, rows), splits).collect()}
    assert found == {("a", "dimension_mismatch"), ("a", "duplicated_label_regions"), ("a", "unexpected_labels"), ("a", "small_disconnected_components"), ("b", "missing_annotation_mask"), (None, "incomplete_tooth_schema"), ("zz", "case_not_in_dataset"), ("a", "split_leakage")}
