"""Filters against direct versions, volumes written here, and JSON blocks against the character loop."""

import bz2
import gzip
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions import filters, jsonblocks, kernels, volumes
from assayer.sources import documents, files, rasters

RNG = np.random.default_rng(0)


def plain_equalise(pixels, tiles, clip):
    h, w = pixels.shape
    ny, nx = min(tiles, h), min(tiles, w)
    ys, xs = [int(i * h / ny) for i in range(ny + 1)], [int(i * w / nx) for i in range(nx + 1)]

    def value(i, j, v):
        part = pixels[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
        counts = [int((part == k).sum()) for k in range(256)]
        limit = max(1.0, clip * part.size / 256)
        spare = sum(max(0.0, c - limit) for c in counts) / 256
        return sum(min(c, limit) + spare for c in counts[: v + 1]) * 255 / part.size

    def near(edges, n, at):
        centres = [(edges[k] + edges[k + 1] - 1) / 2 for k in range(n)]
        for k in range(n - 1):
            if centres[k] <= at <= centres[k + 1]:
                return k, k + 1, (at - centres[k]) / (centres[k + 1] - centres[k])
        return (0, 0, 0.0) if at < centres[0] else (n - 1, n - 1, 0.0)

    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            (a, b, f), (c, d, g), v = near(ys, ny, y), near(xs, nx, x), int(pixels[y, x])
            out[y, x] = (value(a, c, v) * (1 - g) + value(a, d, v) * g) * (1 - f) + (value(b, c, v) * (1 - g) + value(b, d, v) * g) * f
    return out


@pytest.mark.parametrize("shape,tiles", [((11, 17), 3), ((5, 4), 8), ((8, 8), 1)])
def test_equalise(shape, tiles):
    pixels = RNG.integers(0, 60, shape).astype(np.uint8)
    assert abs(filters.equalise(pixels, tiles, 2.0).astype(float) - np.clip(plain_equalise(pixels, tiles, 2.0), 0, 255)).max() <= 0.5 + 1e-9


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_median(radius):
    pixels = RNG.integers(0, 256, (9, 13)).astype(np.uint8)
    padded = np.pad(pixels, radius, mode="edge")
    want = [[np.sort(padded[y : y + 2 * radius + 1, x : x + 2 * radius + 1].ravel())[(2 * radius + 1) ** 2 // 2] for x in range(13)] for y in range(9)]
    assert (filters.median(pixels, radius) == want).all()


def test_cubic_is_exact_on_constant_and_linear_images():
    flat = np.full((7, 5), 99.0)
    line = np.add.outer(3 * np.arange(12), 2 * np.arange(9)) + 1.0
    for h, w in ((3, 4), (7, 5), (20, 31), (1, 1)):
        assert np.allclose(filters.resize_cubic(flat, h, w), 99)
        want = np.add.outer(3 * ((np.arange(h) + 0.5) * 12 / h - 0.5), 2 * ((np.arange(w) + 0.5) * 9 / w - 0.5)) + 1
        assert np.allclose(filters.resize_cubic(line, h, w), want)
    assert np.allclose(filters.resize_cubic(np.array([[5.0]]), 3, 3), 5)
    wave = filters.as_pixels(128 + 100 * np.sin(np.add.outer(np.arange(40) / 9, np.arange(30) / 7)))
    assert filters.psnr(wave, filters.restore(filters.degrade(wave, 2), 40, 30)) > 38 and filters.psnr(wave, wave) == float("inf") and filters.ssim(wave, wave) == pytest.approx(1)


def meta(shape, kind, more="", data_file="LOCAL"):
    return f"ObjectType = Image\nNDims = {len(shape)}\nDimSize = {' '.join(map(str, shape))}\nElementSpacing = 0.5 1 2\n{more}ElementType = {kind}\nElementDataFile = {data_file}\n".encode()


def nrrd(shape, kind, encoding, more="", end="\n"):
    return f"NRRD0004\n# comment\ntype: {kind}\ndimension: {len(shape)}\nsizes: {' '.join(map(str, shape))}\nencoding: {encoding}\nkey:=value\n{more}{end}".encode()


def test_volumes():
    cube = RNG.integers(-500, 500, (4, 3, 2))  # z, y, x
    shape = [2, 3, 4]
    for order, big in (("<", "False"), (">", "True")):
        raw = cube.astype(order + "i2").tobytes()
        for packed in (False, True):
            data = meta(shape, "MET_SHORT", f"BinaryDataByteOrderMSB = {big}\n" + ("CompressedData = True\n" if packed else "")) + (zlib.compress(raw) if packed else raw)
            got, head = volumes.attached_volume(data)
            assert (got == cube).all() and head == {"shape": shape, "spacing": [0.5, 1.0, 2.0]}
        endian = f"endian: {'big' if order == '>' else 'little'}\nspace directions: (0.5,0,0) (0,3,4) (0,0,2)\n"
        for encoding, pack in (("raw", bytes), ("gzip", gzip.compress), ("bz2", bz2.compress)):
            got, head = volumes.attached_volume(nrrd(shape, "short", encoding, endian) + pack(raw))
            assert (got == cube).all() and head["spacing"] == [0.5, 5.0, 2.0]
    got, head = volumes.attached_volume(nrrd(shape, "double", "ascii", "spacings: 1 -2 3\n") + b" ".join(str(float(v)).encode() for v in cube.ravel()))
    assert (got == cube).all() and head["spacing"] == [1.0, 2.0, 3.0]
    for bad in (b"", b"x = 1\n", meta(shape, "MET_SHORT") + b"1", nrrd(shape, "short", "gzip") + b"junk", nrrd([2], "short", "raw", "dimension: 3\n") + b"1", nrrd([0, 3, 4], "short", "raw")):
        with pytest.raises(kernels.Unreadable):
            volumes.attached_volume(bad)
    for other in (meta(shape, "MET_LIST"), nrrd(shape, "block", "raw"), nrrd(shape, "short", "hex"), meta(shape, "MET_SHORT", data_file="LIST")):
        with pytest.raises(kernels.Unsupported):
            volumes.attached_volume(other)


def test_detached_volumes_are_joined(spark, tmp_path):
    cube = RNG.integers(0, 500, (4, 3, 2))
    raw = cube.astype("<u2").tobytes()
    (tmp_path / "sub").mkdir()
    made = {
        "a.mhd": meta([2, 3, 4], "MET_USHORT", data_file="sub/a.raw"), "sub/a.raw": raw, "b.mhd": meta([2, 3, 4], "MET_USHORT", "HeaderSize = -1\n", "sub/b.raw"), "sub/b.raw": b"head" + raw,
        "c.nhdr": nrrd([2, 3, 4], "uint16", "gzip", "endian: little\ndata file: ./sub/c.gz\n", ""), "sub/c.gz": gzip.compress(raw), "lost.mhd": meta([2, 3, 4], "MET_USHORT", data_file="none.raw"),
        "d.nhdr": nrrd([2, 3, 4], "uint16", "raw", "endian: little\nline skip: 2\nbyte skip: 1\ndata file: sub/d.raw\n", ""), "sub/d.raw": b"xone\ntwo\n" + raw, "bad.nhdr": b"NRRD0004\n", "own.mha": meta([2, 3, 4], "MET_USHORT") + raw,
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    t = files.tree(spark, str(tmp_path), content=True).withColumn("data_", F.lit(1)).drop("data_")
    got = {r["name"]: r["volume"] for r in rasters.detached_volumes(t.where("suffix in ('.mhd', '.nhdr')"), t.select("path", "content")).collect()}
    want = rasters.volume_summaries(t.where("name = 'own.mha'")).first()["volume"]
    assert want["status"] == "ok" and want["shape"] == [2, 3, 4]
    assert all(got[n]["sample_hash"] == want["sample_hash"] for n in ("a.mhd", "b.mhd", "c.nhdr", "d.nhdr"))
    assert all(got[n]["status"].startswith("unreadable") for n in ("lost.mhd", "bad.nhdr"))


def loop(text):
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, ch in enumerate(text or ""):
        if quoted:
            escaped, quoted = (False, True) if escaped else (ch == "\\", ch != '"')
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start, depth = start if depth else i, depth + 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def test_json_blocks_equal_the_loop(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choices(['{', '}', '"', "\\", "a", "é", "\n", '{"', '"}', '\\"'], k=rng.randint(0, 40))) for _ in range(4000)] + [None, "", '{"a": "' + "x" * 10_000 + '{"}', "{" * 5000 + "}" * 5000]
    assert jsonblocks.blocks(pa.array(texts, pa.string())).to_pylist() == [loop(t) for t in texts]
    assert jsonblocks.blocks(pa.array(texts, pa.string())[100:200]).to_pylist() == [loop(t) for t in texts[100:200]]
    df = spark.createDataFrame(list(enumerate(texts[:300])), "id int, text string")
    got = documents.json_objects(df, "text").select("id", "nth", "object").collect()
    assert sorted(map(tuple, got)) == [(i, k, b) for i, t in enumerate(texts[:300]) for k, b in enumerate(loop(t))]


def test_preprocessing_and_restoration(spark):
    image = RNG.integers(0, 256, (20, 30)).astype(np.uint8)
    df = spark.createDataFrame([("a", kernels.encode_png(image)), ("b", b"no image"), ("c", None)], "case_id string, content binary")
    got = {r["case_id"]: r["content"] for r in rasters.preprocessed(df).collect()}
    assert (kernels.decode_png(got["a"]) == filters.median(filters.equalise(kernels.stretch(image)))).all() and got["b"] is got["c"] is None
    r = {r["case_id"]: r for r in rasters.restoration(df).collect()}
    assert r["a"]["psnr"] == pytest.approx(filters.psnr(image, filters.restore(filters.degrade(image, 2), 20, 30))) and r["b"]["psnr"] is None
