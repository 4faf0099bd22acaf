"""Zip and tar archives as splittable sources.

An archive's own index is read first: a zip's central directory, a tar's chain of headers, by jumping from one to the
next. Its members are then dealt out by byte ranges of the archive, and a task opens the archive at its members' places.
Contents come in pieces of bounded size, so no task holds an archive or a long member. Members that are stored as they
are can be divided between tasks; compressed members are streamed by one. Compressed tars cannot be entered in the
middle: one task streams such an archive.

Defined cases: a file that is no archive, is cut off or encrypted is a row with its ``status`` and no content; empty files
are none to Spark's listing. A member
whose path leaves the target (``..``, absolute, drive letters) is listed as not ``safe`` and never has content; folders,
links and devices are no members. Of members with the same path the last one counts in ``extract``, which refuses a
target that is not empty, unsafe members and broken archives before it writes anything.
"""

from __future__ import annotations

import bz2
import io
import posixpath
import re
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "archive string, member string, ordinal long, kind string, method int, offset long, stored long, size long, crc long, safe boolean, status string"
_INDEX_ARROW = pa.schema([
    ("archive", pa.string()), ("member", pa.string()), ("ordinal", pa.int64()), ("kind", pa.string()), ("method", pa.int32()), ("offset", pa.int64()),
    ("stored", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("safe", pa.bool_()), ("status", pa.string()),
])
#: Bytes of an archive that go to one task, and of content in one row.
RANGE_BYTES, PIECE_BYTES = 128 << 20, 8 << 20
_DRIVE = re.compile(r"^[A-Za-z]:|^[\\/]|(^|[\\/])\.\.($|[\\/])")
_COMPRESSED = {b"\x1f\x8b": "r|gz", b"BZ": "r|bz2", b"\xfd7": "r|xz"}


def _open(path: str) -> pa.NativeFile:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _clean(name: str) -> tuple[str, bool]:
    return posixpath.normpath(name), not _DRIVE.search(name)


def entries(path: str) -> Iterator[dict]:
    """Index rows of one archive, read without its contents."""

    def row(i: int, name: str, **more: object) -> dict:
        member, safe = _clean(name)
        return {"archive": path, "member": member, "ordinal": i, "safe": safe, "status": "ok"} | more

    try:
        with _open(path) as f:
            head = f.read(4)
            f.seek(0)
            if zipfile.is_zipfile(f):
                f.seek(0)
                for i, x in enumerate(zipfile.ZipFile(f).infolist()):
                    if not x.is_dir():
                        status = "encrypted" if x.flag_bits & 1 else "ok" if x.compress_type in (0, 8, 12) else "unsupported compression"
                        yield row(i, x.filename, kind="zip", method=x.compress_type, offset=x.header_offset, stored=x.compress_size, size=x.file_size, crc=x.CRC, status=status)
                return
            f.seek(0)
            mode = _COMPRESSED.get(head[:2])
            with tarfile.open(fileobj=f, mode=mode or "r:") as t:
                for i, m in enumerate(t):
                    t.members = []  # which grows otherwise
                    if m.isfile():
                        yield row(i, m.name, kind="stream" if mode else "tar", method=0, offset=0 if mode else m.offset_data, stored=m.size, size=m.size)
                if not mode:
                    f.seek(0, 2)
                    if t.offset > f.tell():
                        raise tarfile.ReadError("ends too early")
    except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, zlib.error, ValueError, struct.error) as e:
        yield {"archive": path, "safe": True, "status": f"unreadable: {e}"[:200]}


def archive_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The members of all archives at ``paths``, with their places, and a row for each file that is no whole archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                for r in entries(path):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _INDEX_ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _INDEX_ARROW)

    listed = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    return listed.repartition("path").mapInArrow(run, INDEX)


def _inflated(f: pa.NativeFile, row: dict) -> Iterator[bytes]:
    """A zip member's bytes, piece by piece; their number and check sum are checked at the end."""
    f.seek(row["offset"])
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise ValueError("no member here")
    f.seek(row["offset"] + 30 + sum(struct.unpack("<HH", head[26:30])))
    left, crc, size = row["stored"], 0, 0
    unpack = zlib.decompressobj(-15) if row["method"] == 8 else bz2.BZ2Decompressor() if row["method"] == 12 else None
    while left > 0:
        raw = f.read(min(left, 1 << 20))
        if not raw:
            raise ValueError("ends too early")
        left -= len(raw)
        if unpack is None:
            parts: Iterator[bytes] = iter([raw])
        else:
            parts = _bounded(unpack, raw)
        for data in parts:
            crc, size = zlib.crc32(data, crc), size + len(data)
            yield data
    if size != row["size"] or crc != row["crc"]:
        raise ValueError("damaged")


def _bounded(unpack: object, raw: bytes) -> Iterator[bytes]:
    """What ``raw`` unpacks to, in bounded parts: a megabyte can hold a thousand."""
    if isinstance(unpack, bz2.BZ2Decompressor):
        data = unpack.decompress(raw, PIECE_BYTES)
        while data:
            yield data
            data = b"" if unpack.eof or unpack.needs_input else unpack.decompress(b"", PIECE_BYTES)
        return
    data = unpack.decompress(raw, PIECE_BYTES)
    while data:
        yield data
        data = unpack.decompress(unpack.unconsumed_tail, PIECE_BYTES) if unpack.unconsumed_tail else b""


def _stored(f: pa.NativeFile, row: dict) -> Iterator[bytes]:
    f.seek(row["offset"] + row["from"])
    left = row["until"] - row["from"]
    while left > 0:
        data = f.read(min(left, PIECE_BYTES))
        if not data:
            raise ValueError("ends too early")
        left -= len(data)
        yield data


def _members(rows: list[dict]) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """(index row, its bytes in pieces) of members of one archive, in the order of their places."""
    with _open(rows[0]["archive"]) as f:
        if rows[0]["kind"] == "stream":
            wanted, mode = {r["ordinal"]: r for r in rows}, _COMPRESSED[f.read(2)]
            f.seek(0)
            with tarfile.open(fileobj=f, mode=mode) as t:
                for i, m in enumerate(t):
                    t.members = []
                    if i in wanted:
                        body = t.extractfile(m)
                        yield wanted[i], iter(lambda body=body: body.read(PIECE_BYTES), b"")
            return
        for r in rows:
            yield r, _inflated(f, r) if r["kind"] == "zip" else _stored(f, r)


def _dealt(index: DataFrame, range_bytes: int, divide: bool) -> DataFrame:
    """Index rows with ``from`` and ``until``, one partition a range of about ``range_bytes`` of an archive."""
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
    begin = F.explode(F.when(F.lit(divide) & (F.col("kind") == "tar"), parts).otherwise(F.array(F.lit(0).cast("long")))).alias("from")
    rows = index.select("*", begin).withColumn("until", F.when(F.lit(divide) & (F.col("kind") == "tar"), F.least(F.col("from") + range_bytes, "size")).otherwise(F.col("size")))
    rows = rows.withColumn("range", F.when(F.col("kind") == "stream", -1).otherwise(F.floor((F.col("offset") + F.col("from")) / range_bytes)))
    size = index.agg(F.sum("stored")).first()[0] or 0
    return rows.repartition(max(1, -(-size // range_bytes)), "archive", "range").sortWithinPartitions("archive", "offset", "ordinal", "from")


def _by_archive(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one archive: a compressed tar's whole, others' a batch at most."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["archive"] != held[0]["archive"] or (r["kind"] != "stream" and len(held) >= 10_000)):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def archive_contents(index: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, member, at, content, status): the pieces of all safe members; ``at`` is a piece's first byte. Empty members have one empty piece."""
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("content", pa.binary()), ("status", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for rows in _by_archive(batches):
            for r, pieces in _members(rows):
                at = r["from"]
                row = {"archive": r["archive"], "member": r["member"]}
                try:
                    for data in pieces:
                        out.append(row | {"at": at, "content": data, "status": "ok"})
                        at, held = at + len(data), held + len(data)
                        if held >= PIECE_BYTES or len(out) >= 10_000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                    if not r["size"]:
                        out.append(row | {"at": 0, "content": b"", "status": "ok"})
                except (ValueError, OSError, EOFError, zlib.error, tarfile.TarError) as e:
                    out.append(row | {"at": at, "status": f"unreadable: {e}"[:200]})
        yield pa.RecordBatch.from_pylist(out, schema)

    return _dealt(index.where("safe and status = 'ok'"), range_bytes, divide=True).mapInArrow(run, "archive string, member string, at long, content binary, status string")


def top_level(member: Column) -> Column:
    return F.split(member, "/")[0]


def extract(spark: SparkSession, paths: str | list[str], target: str, overwrite: bool = False, place: Callable[[DataFrame], DataFrame] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes all members below ``target``, a folder that executors share, and returns a row an archive: format, files, bytes, top-level entries.

    Several archives get a folder each, by their names. ``place`` may add a column ``target`` to the index (``files.flattened``). A
    member is written beside its place and then moved there, so a task that is run again does no harm.
    """
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(target)
    listed = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    if listed and not overwrite:
        raise FileExistsError(f"not empty: {target}")
    index = archive_index(spark, paths).persist()
    try:
        bad = index.where("status <> 'ok' or not safe").limit(5).collect()
        if bad:
            raise ValueError("; ".join(f"{r['archive']}: {'unsafe member ' + r['member'] if r['status'] == 'ok' else r['status']}" for r in bad))
        many = index.select("archive").distinct().count() > 1
        placed = place(index) if place else index.withColumn("target", F.col("member"))
        folder = F.concat(F.regexp_extract("archive", r"([^/]+?)(\.tar)?(\.[^./]+)?$", 1), F.lit("/")) if many else F.lit("")
        last = placed.withColumn("target", F.concat(folder, "target")).withColumn("last", F.max(F.struct("archive", "ordinal")).over(_same_target()))
        kept = last.where("last.archive = archive and last.ordinal = ordinal").drop("last")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, base = fs.FileSystem.from_uri(target)
            for rows in _by_archive(batches):
                done = []
                for r, pieces in _members(rows):
                    to = f"{base}/{r['target']}"
                    there.create_dir(posixpath.dirname(to), recursive=True)
                    beside = f"{posixpath.dirname(to)}/.{uuid.uuid4().hex}"
                    with there.open_output_stream(beside) as f:
                        for data in pieces:
                            f.write(data)
                    there.move(beside, to)
                    done.append({"archive": r["archive"], "kind": r["kind"], "member": r["member"], "size": r["size"]})
                yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("kind", pa.string()), ("member", pa.string()), ("size", pa.int64())]))

        system.create_dir(root, recursive=True)
        written = _dealt(kept, range_bytes, divide=False).mapInArrow(run, "archive string, kind string, member string, size long")
        rows = written.groupBy("archive").agg(
            F.min(F.when(F.col("kind") == "zip", "zip").otherwise("tar")).alias("format"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
            F.sort_array(F.collect_set(top_level(F.col("member")))).alias("top_level_entries"),
        ).collect()
        return spark.createDataFrame(rows, "archive string, format string, files long, bytes long, top_level_entries array<string>")
    finally:
        index.unpersist()


def _same_target():
    from pyspark.sql import Window

    return Window.partitionBy("target")


def whole_members(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(archive, member, content, safe): members that fit into a row each, unsafe ones without content."""
    index = archive_index(spark, paths)
    pieces = archive_contents(index).where("status = 'ok'").groupBy("archive", "member").agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda whole, x: F.concat(whole, x["content"]))
    safe = pieces.select("archive", "member", joined.alias("content"), F.lit(True).alias("safe"))
    return safe.unionByName(index.where("not safe").select("archive", "member", F.lit(None).cast("binary").alias("content"), "safe"))
