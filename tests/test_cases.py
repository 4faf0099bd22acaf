"""Made trees go through the audits and give the known issues."""

import gzip
import json
import struct

import numpy as np
from pyspark.sql import functions as F

from assayer.functions import kernels
from assayer.operators import audits
from assayer.sources import cases

RNG = np.random.default_rng(0)


def nifti(voxels, spacing=(1.0, 1.0, 1.0), sform=1, kind=4, affine=None):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348), struct.pack_into("<8h", head, 40, voxels.ndim, *voxels.shape, *[1] * (7 - voxels.ndim)), struct.pack_into("<h", head, 70, kind)
    struct.pack_into("<8f", head, 76, 1, *spacing, *[1] * (7 - len(spacing))), struct.pack_into("<f", head, 108, 352), struct.pack_into("<2h", head, 252, 0, sform)
    rows = affine if affine is not None else np.diag(spacing)
    struct.pack_into("<12f", head, 280, *np.c_[rows, np.zeros(3)].ravel())
    return bytes(head) + voxels.astype({4: "<i2", 16: "<f4"}[kind]).ravel(order="F").tobytes()


def block(noise=5.0):
    a = np.zeros((12, 12, 12))
    a[3:9, 3:9, 3:9] = 1000 + RNG.normal(0, noise, (6, 6, 6))
    return a


def test_volumes_to_cohort_findings(spark, tmp_path):
    mask = (block() > 0).astype(int)
    made = {f"imagesTr/c{i}_0000.nii": nifti(block()) for i in range(7)} | {f"labelsTr/c{i}.nii": nifti(mask) for i in range(7)}
    flip = np.array([[-1.0, 0, 0], [0, 1, 0], [0, 0, 1]])
    made |= {
        "imagesTr/c3_0000.nii": nifti(block(), sform=0), "imagesTr/c4_0000.nii": nifti(block(), affine=np.diag([1.0, 1.0, 1.5])), "labelsTr/c5.nii": nifti(mask * 7), "labelsTr/c6.nii": nifti(mask[:6]),
        "imagesTs/broken_0000.nii": b"no volume", "imagesTs/flat_0000.nii.gz": gzip.compress(nifti(np.full((12, 12, 12), 3))), "labelsTs/orphan.nii": nifti(mask * 0), "labelsTs/half.nii": nifti(mask * 0.5, kind=16),
        "imagesTs/half_0000.nii": nifti(block()), "labelsTr/c2.nii": nifti(mask, affine=flip), "notes.txt": b"x", "dataset.json": json.dumps({"labels": {"background": 0, "tooth": 1}}).encode(),
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    table = cases.volume_table(spark, str(tmp_path)).persist()
    rows = {r["case_id"]: r for r in table.collect()}
    assert set(rows) == {*[f"c{i}" for i in range(7)], "broken", "flat", "orphan", "half"} and rows["c1"]["split"] == "train" and rows["half"]["split"] == "test"
    assert rows["c1"]["shape"] == [12, 12, 12] and rows["c1"]["allowed_values"] == [0.0, 1.0] and rows["c1"]["label_values"] == [0.0, 1.0] and rows["c1"]["orientation"] == "RAS" and rows["c2"]["label_orientation"] == "LAS"
    got = {}
    for r in audits.cohort_findings(table).collect():
        got.setdefault(r["case_id"], set()).add(r["code"])
    common = {"missing_modality_metadata"}
    extra = {k: v - common for k, v in got.items()}
    assert extra["c1"] <= {"noise_or_contrast_outlier", "dynamic_range_outlier"}
    assert "missing_spatial_transform_codes" in extra["c3"] and "metadata_inconsistency" in extra["c4"] and "invalid_label_values" in extra["c5"] and "image_label_shape_mismatch" in extra["c6"]
    assert "image_label_orientation_mismatch" in extra["c2"] and "unreadable_image" in extra["broken"] and "empty_or_corrupt_volume" in extra["flat"] and "missing_image" in extra["orphan"]
    assert {"non_integer_label_values", "invalid_label_values"} <= extra["half"] and {"missing_image", "empty_label"} <= extra["orphan"]
    table.unpersist()


def test_rasters_to_dataset_and_governance_issues(spark, tmp_path):
    image = lambda v: kernels.encode_png(np.full((16, 16), v, np.uint8))
    one = np.zeros((16, 16), np.uint8)
    one[2:9, 2:9] = 1
    two = one.copy()
    two[12:16, 12:16] = 1
    made = {f"images/c{i}.png": image(10 * i) for i in range(8)} | {f"teeth_mask/c{i}.png": kernels.encode_png(one) for i in range(8)}
    made |= {"images/c7.png": image(10), "teeth_mask/c2.png": kernels.encode_png(one[:8]), "teeth_mask/c3.png": kernels.encode_png(one * 9), "teeth_mask/c4.png": b"broken", "images/c5.png": b"broken", "teeth_mask/c6.png": kernels.encode_png(two)}
    made |= {"images/c8.png": image(99), "teeth_mask/lonely.png": kernels.encode_png(one), "readme.txt": b"text"}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    splits = spark.createDataFrame([("train", f"c{i}", i) for i in range(7)] + [("test", "c7", 7)], "split string, case_id string, pos int")
    table = cases.raster_cases(spark, str(tmp_path), splits, allowed=[0, 1]).persist()
    assert {r["case_id"] for r in table.collect()} == {f"c{i}" for i in range(9)}
    found = {(r["case_id"], r["type"]) for r in audits.dataset_issues(table).collect()}
    assert found == {
        ("c2", "image_label_shape_mismatch"), ("c3", "invalid_label_values"), ("c4", "unreadable_annotation"), ("c5", "unreadable_image"), ("c8", "missing_annotation"), ("c7", "content_leakage"),
    }
    rules = {(r["case_id"], r["type"]) for r in audits.governance_issues(cases.governance_cases(table), splits.select("split", "case_id"), schema=(0, 1)).collect()}
    assert rules == {("c2", "dimension_mismatch"), ("c3", "unexpected_labels"), ("c4", "mask_unreadable"), ("c5", "image_unreadable"), ("c8", "missing_annotation_mask"), ("c6", "duplicated_label_regions")}
    table.unpersist()


def test_empty_tree(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert cases.volume_table(spark, str(tmp_path)).collect() == [] and cases.raster_cases(spark, str(tmp_path)).collect() == []
    assert cases.discovered(spark.createDataFrame([("scan/a.nii", "/r/scan/a.nii", ".nii"), ("masks/a.nii", "/r/masks/a.nii", ".nii")], "rel_path string, path string, suffix string")).select("n_images", "n_labels", F.isnull("split")).first()[:] == (1, 1, True)
