"""DICOM files built byte by byte, in every encoding that is read."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import kernels
from assayer.operators import audits
from assayer.sources import dicom, files

IMPLICIT, LITTLE, BIG, DEFLATED, JPEG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.4.70"


class Writer:
    def __init__(self, syntax):
        self.order, self.explicit = (">" if syntax == BIG else "<"), syntax != IMPLICIT

    def element(self, group, number, kind, value, undefined=False):
        if isinstance(value, int):
            value = struct.pack(self.order + "H", value)
        if isinstance(value, str):
            value = value.encode("latin-1")
        value += b"" if len(value) % 2 == 0 else (b"\0" if kind == "UI" else b" ")
        size = 0xFFFFFFFF if undefined else len(value)
        head = struct.pack(self.order + "HH", group, number)
        if group == 0xFFFE or not self.explicit:
            return head + struct.pack(self.order + "I", size) + value
        if kind in ("OB", "OW", "SQ", "UN", "UT"):
            return head + kind.encode() + b"\0\0" + struct.pack(self.order + "I", size) + value
        return head + kind.encode() + struct.pack(self.order + "H", size) + value

    def item(self, body, undefined=False):
        return self.element(0xFFFE, 0xE000, "", body, undefined) + (self.element(0xFFFE, 0xE00D, "", b"") if undefined else b"")


def scan(syntax=LITTLE, frames=4, shape=(5, 6), pixels=None, preamble=True, spacing="0.4\\0.5", undefined=False, modality="CT", patient="p1", kind="<i2", patient_raw=None, charset=""):
    w = Writer(syntax)
    e = w.element
    junk = w.item(e(0x0008, 0x1150, "UI", "9.9") + e(0x0010, 0x0020, "LO", "inner"), undefined)
    body = e(0x0008, 0x0005, "CS", charset) if charset else b""
    body += e(0x0008, 0x0020, "DA", "20240102") + e(0x0008, 0x0060, "CS", modality) + e(0x0008, 0x1140, "SQ", junk + (w.element(0xFFFE, 0xE0DD, "", b"") if undefined else b""), undefined)
    body += e(0x0009, 0x0010, "UN", b"x" * 70_000) + (e(0x0010, 0x0020, "LO", patient_raw or patient) if patient or patient_raw else b"")
    body += e(0x0018, 0x0050, "DS", "0.3 ") + e(0x0020, 0x000D, "UI", "1.2.3") + e(0x0020, 0x000E, "UI", "1.2.3.4")
    body += (e(0x0028, 0x0008, "IS", str(frames)) if frames else b"") + e(0x0028, 0x0010, "US", shape[0]) + e(0x0028, 0x0011, "US", shape[1])
    body += (e(0x0028, 0x0030, "DS", spacing) if spacing else b"") + e(0x0028, 0x0100, "US", 16) + e(0x0028, 0x0103, "US", 1)
    if pixels is None:
        pixels = np.arange((frames or 1) * shape[0] * shape[1]).reshape(-1, *shape)
    raw = pixels.astype(kind.replace("<", w.order)).tobytes()
    if syntax == JPEG:
        body += e(0x7FE0, 0x0010, "OB", w.item(b"") + w.item(b"\xff\xd8\xff\xd9") + w.element(0xFFFE, 0xE0DD, "", b""), True)
    else:
        body += e(0x7FE0, 0x0010, "OW", raw)
    meta = Writer(LITTLE).element(0x0002, 0x0001, "OB", b"\0\1") + Writer(LITTLE).element(0x0002, 0x0010, "UI", syntax)
    if syntax == DEFLATED:
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    return (b"\0" * 128 + b"DICM" + meta if preamble else b"") + body


def row(data, max_voxels=0):
    return dicom.header_row(io.BytesIO(data), len(data), max_voxels)


@pytest.mark.parametrize("undefined", [False, True])
@pytest.mark.parametrize("syntax", [IMPLICIT, LITTLE, BIG, DEFLATED])
def test_every_encoding(syntax, undefined):
    got = row(scan(syntax, undefined=undefined), 1000)
    assert got["status"] == "ok" and got["transfer_syntax"] == syntax
    assert (got["shape"], got["spacing"], got["bits"]) == ([4, 5, 6], [0.3, 0.4, 0.5], 16)
    assert (got["patient_id"], got["study_uid"], got["series_uid"], got["modality"], got["study_date"]) == ("p1", "1.2.3", "1.2.3.4", "CT", "20240102")
    want = kernels.intensity_stats(np.arange(120, dtype=np.float32).reshape(4, 5, 6))
    assert got["pixels"]["status"] == "ok" and {k: got["pixels"][k] for k in want} == want


def test_odd_files():
    assert row(scan(preamble=False))["shape"] == [4, 5, 6]
    assert row(scan(IMPLICIT, preamble=False))["transfer_syntax"] == IMPLICIT
    assert row(scan(frames=0), 1000)["shape"] == [5, 6]
    assert row(scan(JPEG), 1000)["pixels"] == {"status": "unsupported"}
    assert row(scan(charset="ISO_IR 192", patient_raw="Zoë".encode()))["patient_id"] == "Zoë"
    assert row(scan(patient=""))["patient_id"] is None
    for broken in (b"", b"x", b"text " * 100, scan()[:400], scan()[:-1], scan(spacing="a\\b"), b"\0" * 128 + b"DICM"):
        assert row(broken, 1000)["status"].startswith("unreadable")
    w = Writer(LITTLE)
    deep = b""
    for _ in range(60):
        deep = w.element(0x0008, 0x1140, "SQ", w.item(deep))
    assert row(deep)["status"] == "unreadable: nests too deep"


def test_spacing_of_functional_groups():
    w = Writer(LITTLE)
    measures = w.element(0x0028, 0x9110, "SQ", w.item(w.element(0x0018, 0x0050, "DS", "2") + w.element(0x0028, 0x0030, "DS", "3\\4")))
    body = w.element(0x0008, 0x0060, "CS", "CT") + w.element(0x0028, 0x0010, "US", 1) + w.element(0x5200, 0x9229, "SQ", w.item(measures))
    assert row(body)["spacing"] == [2.0, 3.0, 4.0]


def test_headers_do_not_read_pixels():
    class Counting(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            data = super().read(n)
            self.seen += len(data)
            return data

    data = scan(frames=100, shape=(50, 60))
    f = Counting(data)
    assert dicom.header_row(f, len(data))["shape"] == [100, 50, 60] and f.seen < 2_000 < len(data)


def test_sampled_pixels_are_every_nth():
    data = np.random.default_rng(1).integers(-1000, 3000, (9, 10, 11))
    found = dicom.read_elements(io.BytesIO(raw := scan(frames=9, shape=(10, 11), pixels=data)), len(raw))
    step = kernels.sample_stride(990, 100)
    assert step == 3 and (dicom.pixel_sample(found, 100) == data[::3, ::3, ::3]).all()


def test_table_and_audit(spark, tmp_path):
    rng = np.random.default_rng(0)
    block = np.zeros((12, 12, 12))
    block[3:9, 3:9, 3:9] = 1000 + rng.normal(0, 5, (6, 6, 6))
    hot = block.copy()
    hot[5, 5, 5] = 30_000  # one voxel is no tail: fewer than one in a thousand
    made = {
        "good": scan(frames=12, shape=(12, 12), pixels=block), "one_hot": scan(frames=12, shape=(12, 12), pixels=hot), "flat": scan(pixels=np.full((4, 5, 6), 7)),
        "slice": scan(frames=0), "other": scan(frames=12, shape=(12, 12), pixels=block, modality="MR", patient=""), "jpeg": scan(JPEG), "no_spacing": scan(frames=12, shape=(12, 12), pixels=block, spacing="0\\1"),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.dcm").write_bytes(data)
    (tmp_path / "broken.dcm").write_bytes(b"no scan")
    listed = files.tree(spark, str(tmp_path)).withColumn("dicom", F.lit("clash")).drop("dicom")
    headers = dicom.dicom_headers(listed, max_voxels=450_000)
    assert {r["name"]: r["dicom"]["status"][:10] for r in headers.collect()} == {f"{n}.dcm": "ok" for n in made} | {"broken.dcm": "unreadable"}
    volumes = audits.header_volumes(headers, F.regexp_replace("name", r"\.dcm$", ""))
    got = {r["case_id"]: (r["status"], set(r["codes"])) for r in audits.header_status(audits.header_findings(volumes)).collect()}
    low = "very_low_foreground_ratio"
    assert got.pop("slice")[0] == "reject"
    assert got == {
        "good": ("usable", set()), "one_hot": ("usable", set()), "broken": ("reject", {"unreadable_image"}), "flat": ("reject", {"empty_or_corrupt_volume", low}),
        "other": ("needs_manual_review", {"missing_key_metadata", "metadata_inconsistency"}), "jpeg": ("needs_manual_review", {low}), "no_spacing": ("reject", {"invalid_spacing"}),
    }
    assert dicom.dicom_headers(listed.limit(0)).collect() == []
    gone = spark.createDataFrame([(None,), (f"{tmp_path}/none.dcm",)], "path string")
    assert all(r["dicom"]["status"].startswith("unreadable") for r in dicom.dicom_headers(gone).collect())
