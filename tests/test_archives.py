"""Archives written by the standard library, read in ranges and pieces."""

import bz2
import hashlib
import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.sources import archives, files


def tar(path, members, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def zip_of(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)


def joined(contents):
    rows = {}
    for r in sorted(contents.collect(), key=lambda r: (r["archive"], r["member"], r["at"])):
        assert r["status"] == "ok" and r["at"] == len(rows.get((r["archive"][-5:], r["member"]), b""))
        rows[r["archive"][-5:], r["member"]] = rows.get((r["archive"][-5:], r["member"]), b"") + r["content"]
    return rows


def test_all_formats_in_small_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "PIECE_BYTES", 1000)
    rng = np.random.default_rng(0)
    members = [(f"d{i % 3}/f{i}", rng.integers(0, 9, int(rng.integers(0, 5000))).astype(np.uint8).tobytes()) for i in range(40)] + [("empty", b""), ("x" * 150 + "/long name é", b"1")]
    zip_of(tmp_path / "a.zip", members), zip_of(tmp_path / "b.zip", members, zipfile.ZIP_STORED), zip_of(tmp_path / "c.zip", members, zipfile.ZIP_BZIP2)
    tar(tmp_path / "a.tar", members), tar(tmp_path / "z.tgz", members, "w:gz"), tar(tmp_path / "y.tbz", members, "w:bz2"), tar(tmp_path / "x.txz", members, "w:xz")
    index = archives.archive_index(spark, str(tmp_path))
    assert index.where("status <> 'ok' or not safe").count() == 0 and index.count() == 7 * len(members)
    contents = archives.archive_contents(index, range_bytes=3000)
    want = {(a, n): d for a in ("a.zip", "b.zip", "c.zip", "a.tar", "z.tgz", "y.tbz", "x.txz") for n, d in members}
    assert joined(contents) == want
    assert contents.agg(F.max(F.octet_length("content"))).first()[0] <= 1 << 20


def test_a_large_archive_is_read_by_many_tasks(spark, tmp_path):
    block = np.random.default_rng(0).integers(0, 256, 1 << 20).astype(np.uint8).tobytes()
    zip_of(tmp_path / "a.zip", [(f"f{i}", block) for i in range(40)], zipfile.ZIP_STORED)
    tar(tmp_path / "a.tar", [("one", block * 40)])
    contents = archives.archive_contents(archives.archive_index(spark, str(tmp_path)), range_bytes=4 << 20)
    tasks = contents.withColumn("task", F.spark_partition_id()).groupBy("archive").agg(F.countDistinct("task").alias("n"), F.sum(F.octet_length("content")).alias("bytes")).collect()
    assert all(r["n"] >= 4 and r["bytes"] == 40 << 20 for r in tasks)
    assert contents.agg(F.max(F.octet_length("content"))).first()[0] <= 8 << 20
    one = contents.where("member = 'one'").orderBy("at").select(F.sha1("content").alias("h")).collect()
    assert len(one) >= 10 and one[0]["h"] == hashlib.sha1(block * 4).hexdigest()  # ranges of four blocks


def test_broken_archives_are_rows(spark, tmp_path):
    zip_of(tmp_path / "good.zip", [("a", b"x" * 10_000)])
    data = bytearray((tmp_path / "good.zip").read_bytes())
    data[40] ^= 0xFF
    (tmp_path / "damaged.zip").write_bytes(data)
    (tmp_path / "none.txt").write_text("no archive")
    (tmp_path / "empty").write_bytes(b"")
    tar(tmp_path / "whole.tar", [("a", b"x" * 5000), ("b", b"y" * 5000)])
    (tmp_path / "cut.tar").write_bytes((tmp_path / "whole.tar").read_bytes()[:7000])
    (tmp_path / "cut.tgz").write_bytes(bz2.compress(b"x" * 5000)[:20])
    index = archives.archive_index(spark, str(tmp_path))
    bad = {r["archive"].rsplit("/")[-1] for r in index.where("status <> 'ok'").collect()}
    assert bad == {"none.txt", "cut.tar", "cut.tgz"}  # Spark lists no empty files
    status = {(r["archive"].rsplit("/")[-1], r["member"], r["status"][:10]) for r in archives.archive_contents(index).collect()}
    assert {("good.zip", "a", "ok"), ("damaged.zip", "a", "unreadable"), ("cut.tar", "a", "ok"), ("cut.tar", "b", "unreadable")} <= status


def test_extract_guards_and_report(spark, tmp_path):
    zip_of(tmp_path / "x.zip", [("root/sub/a.txt", b"1"), ("root/b.txt", b"2"), ("root/b.txt", b"3")])
    zip_of(tmp_path / "evil.zip", [("ok", b"1"), ("../evil", b"2")])
    out = tmp_path / "out"
    got = archives.extract(spark, str(tmp_path / "x.zip"), str(out)).first()
    assert (got["format"], got["files"], got["bytes"], got["top_level_entries"]) == ("zip", 2, 2, ["root"])
    assert (out / "root/b.txt").read_text() == "3" and (out / "root/sub/a.txt").read_text() == "1" and len(list(out.rglob("*.*"))) == 2
    with pytest.raises(FileExistsError):
        archives.extract(spark, str(tmp_path / "x.zip"), str(out))
    archives.extract(spark, str(tmp_path / "x.zip"), str(out), overwrite=True)
    with pytest.raises(ValueError, match="unsafe member"):
        archives.extract(spark, str(tmp_path / "evil.zip"), str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists() and not (tmp_path / "evil").exists()
    flat = tmp_path / "flat"
    archives.extract(spark, str(tmp_path / "x.zip"), str(flat), place=files.flattened)
    assert sorted(p.relative_to(flat).as_posix() for p in flat.rglob("*") if p.is_file()) == ["b.txt", "sub/a.txt"]
    tar(tmp_path / "y.tar", [("b.txt", b"9")])
    two = tmp_path / "two"
    archives.extract(spark, [str(tmp_path / "x.zip"), str(tmp_path / "y.tar")], str(two))
    assert (two / "y/b.txt").read_text() == "9" and (two / "x/root/b.txt").read_text() == "3"
