"""DICOM files as a typed table, without a DICOM library.

Spark lists the files and deals them out by size; each task reads its files' elements one after another and jumps
over values that no column needs, so headers cost a few kilobytes of each file, whatever its pixels weigh. Pixels are
read only where they are asked for, and come back as sampled statistics, never as rows.

Defined cases: a file that is no DICOM, ends too early or nests too deep is a row with ``status`` ``unreadable: ...`` and
nulls; Spark lists no empty files. Both value representations (implicit, explicit), both byte orders and deflated files are read;
compressed pixels keep their header, and their ``pixels`` has the status ``unsupported``. Elements of any length are skipped in
place. Repeated tags: the first counts. Missing tags are null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BytesIO
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import kernels

#: The standard's tags, value representations and transfer syntaxes.
TAGS = {
    (0x0008, 0x0020): "study_date", (0x0008, 0x0030): "study_time", (0x0008, 0x0060): "modality", (0x0008, 0x0070): "manufacturer", (0x0008, 0x1090): "manufacturer_model_name",
    (0x0008, 0x103E): "series_description", (0x0010, 0x0020): "patient_id", (0x0020, 0x000D): "study_uid", (0x0020, 0x000E): "series_uid",
}
CHARACTER_SET, TRANSFER_SYNTAX, PIXELS, FRAMES = (0x0008, 0x0005), (0x0002, 0x0010), (0x7FE0, 0x0010), (0x0028, 0x0008)
ROWS, COLUMNS, SAMPLES, BITS, SIGNED = (0x0028, 0x0010), (0x0028, 0x0011), (0x0028, 0x0002), (0x0028, 0x0100), (0x0028, 0x0103)
THICKNESS, SPACING = (0x0018, 0x0050), (0x0028, 0x0030)
ITEM, ITEM_END, SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
WIDE = frozenset([b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"])
NARROW = frozenset([b"AE", b"AS", b"AT", b"CS", b"DA", b"DS", b"DT", b"FD", b"FL", b"IS", b"LO", b"LT", b"PN", b"SH", b"SL", b"SS", b"ST", b"TM", b"UI", b"UL", b"US"])
IMPLICIT, LITTLE, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"
CODECS = {"ISO_IR 192": "utf-8", "GB18030": "gb18030", "ISO_IR 101": "iso8859-2", "ISO_IR 144": "iso8859-5", "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8"}
UNDEFINED, DEPTH, LONGEST = 0xFFFFFFFF, 32, 1 << 16
#: Where spacing lies in files of many frames: inside shared functional groups. Top-level values come first.
_NUMBERS = frozenset([FRAMES, ROWS, COLUMNS, SAMPLES, BITS, SIGNED, THICKNESS, SPACING])
_WANTED = frozenset([*TAGS, *_NUMBERS, CHARACTER_SET, TRANSFER_SYNTAX])


@dataclass
class Elements:
    """Raw values of the wanted tags, and where the pixels begin."""

    syntax: str = IMPLICIT
    order: str = "<"
    values: dict[tuple[int, int], bytes] = field(default_factory=dict)
    nested: dict[tuple[int, int], bytes] = field(default_factory=dict)
    pixels: tuple[BinaryIO, int, int] | None = None

    def text(self, tag: tuple[int, int]) -> str | None:
        raw = self.values.get(tag)
        if raw is None:
            return None
        names = self.values.get(CHARACTER_SET, b"").decode("latin-1").strip(" \0").split("\\")
        return raw.decode(CODECS.get(names[-1], "latin-1"), "replace").strip(" \0") or None

    def whole(self, tag: tuple[int, int]) -> int | None:
        """A number in binary (US) or as text (IS)."""
        raw = self.values.get(tag)
        if not raw:
            return None
        try:
            return struct.unpack(self.order + "H", raw)[0] if tag != FRAMES else int(raw.decode("latin-1").strip(" \0"))
        except (ValueError, struct.error) as e:
            raise kernels.Unreadable(f"bad number in {tag[0]:04x},{tag[1]:04x}") from e

    def decimals(self, tag: tuple[int, int]) -> list[float]:
        raw = self.values.get(tag) or self.nested.get(tag) or b""
        try:
            return [float(x) for x in raw.decode("latin-1").strip(" \0").split("\\") if x.strip()]
        except ValueError as e:
            raise kernels.Unreadable(f"bad number in {tag[0]:04x},{tag[1]:04x}") from e


class _Reader:
    def __init__(self, stream: BinaryIO, size: int, order: str, explicit: bool, found: Elements):
        self.stream, self.size, self.order, self.explicit, self.found = stream, size, order, explicit, found

    def take(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) < n:
            raise kernels.Unreadable("ends too early")
        return data

    def skip(self, n: int) -> None:
        to = self.stream.tell() + n
        if to > self.size:
            raise kernels.Unreadable("ends too early")
        self.stream.seek(to)

    def head(self) -> tuple[tuple[int, int], bytes, int]:
        """Tag, value representation (empty if implicit) and length of the next element."""
        group, element = struct.unpack(self.order + "HH", self.take(4))
        if group == 0xFFFE or not self.explicit:
            return (group, element), b"", struct.unpack(self.order + "I", self.take(4))[0]
        kind, short = struct.unpack("2s2s", self.take(4))
        if kind in WIDE:
            return (group, element), kind, struct.unpack(self.order + "I", self.take(4))[0]
        if kind not in NARROW:
            raise kernels.Unreadable("unknown value representation")
        return (group, element), kind, struct.unpack(self.order + "H", short)[0]

    def elements(self, end: int, depth: int = 0) -> None:
        """Reads up to ``end``, or to the end of an item or sequence of undefined length."""
        if depth > DEPTH:
            raise kernels.Unreadable("nests too deep")
        while self.stream.tell() + 8 <= end:
            tag, kind, length = self.head()
            if tag in (ITEM_END, SEQUENCE_END):
                return
            if tag == PIXELS and depth == 0:
                self.found.pixels = (self.stream, self.stream.tell(), length)
                return  # nothing that is wanted follows the pixels
            if kind == b"SQ" or length == UNDEFINED or tag == ITEM:
                self.nested(tag, kind, length, depth)
            elif tag in _WANTED and length <= LONGEST:
                (self.found.nested if depth else self.found.values).setdefault(tag, self.take(length))
            else:
                self.skip(length)

    def nested(self, tag: tuple[int, int], kind: bytes, length: int, depth: int) -> None:
        """A sequence or item; the spacing of functional groups may lie in it. Unknown contents are always implicit."""
        was = self.explicit
        if kind == b"UN":
            self.explicit = False
        end = self.size if length == UNDEFINED else self.stream.tell() + length
        if end > self.size:
            raise kernels.Unreadable("ends too early")
        self.elements(end, depth + 1)
        self.explicit = was
        if length != UNDEFINED:
            self.stream.seek(end)


def read_elements(stream: BinaryIO, size: int) -> Elements:
    """The wanted elements of a file; the meta group is explicit and little-endian, what follows is as it says."""
    found = Elements()
    start = 0
    if size >= 132:
        stream.seek(128)
        start = 132 if stream.read(4) == b"DICM" else 0
    stream.seek(start)
    first = stream.read(6)
    if len(first) < 6:
        raise kernels.Unreadable("ends too early")
    stream.seek(start)
    if start:
        meta = _Reader(stream, size, "<", True, found)
        while True:
            at = stream.tell()
            ahead = stream.read(2)
            stream.seek(at)
            if ahead != b"\x02\x00":
                break
            tag, _, length = meta.head()
            if tag == TRANSFER_SYNTAX and length <= LONGEST:
                found.syntax = meta.take(length).decode("latin-1").strip(" \0")
            else:
                meta.skip(length)
    elif struct.unpack("<H", first[:2])[0] not in (0x0002, 0x0008):
        raise kernels.Unreadable("no DICOM file")
    else:
        found.syntax = LITTLE if first[4:6] in NARROW | WIDE else IMPLICIT
    if found.syntax == DEFLATED:
        body = zlib.decompressobj(-15).decompress(stream.read())
        stream, size = BytesIO(body), len(body)
    found.order = ">" if found.syntax == BIG else "<"
    _Reader(stream, size, found.order, found.syntax != IMPLICIT, found).elements(size)
    if not found.values:
        raise kernels.Unreadable("no known element")
    return found


def pixel_sample(found: Elements, max_voxels: int) -> np.ndarray | None:
    """Every n-th row, column and frame of uncompressed pixels; None if they are compressed or missing."""
    rows, columns, bits = found.whole(ROWS), found.whole(COLUMNS), found.whole(BITS)
    if found.pixels is None or found.pixels[2] == UNDEFINED or found.syntax not in (IMPLICIT, LITTLE, BIG, DEFLATED) or bits not in (8, 16, 32) or not rows or not columns:
        return None
    stream, at, length = found.pixels
    frames, samples = found.whole(FRAMES) or 1, found.whole(SAMPLES) or 1
    kind = np.dtype(f"{found.order}{'i' if found.whole(SIGNED) else 'u'}{bits // 8}")
    frame = rows * columns * samples
    if samples != 1 or length < frames * frame * kind.itemsize:
        return None
    step = kernels.sample_stride(frames * frame, max_voxels) if found.values.get(FRAMES) else 1
    taken = []
    for i in range(0, frames, step):  # one frame in memory at a time
        stream.seek(at + i * frame * kind.itemsize)
        data = stream.read(frame * kind.itemsize)
        if len(data) < frame * kind.itemsize:
            raise kernels.Unreadable("ends too early")
        taken.append(np.frombuffer(data, kind).reshape(rows, columns)[::step, ::step].astype(np.float32))
    return np.stack(taken) if found.values.get(FRAMES) else taken[0]


STATS = "sample_hash string, quantiles array<double>, dynamic_range double, std double, tail_ratio double, foreground_ratio double, zero_fraction double, slice_delta_p95 double, touch_faces int, empty boolean"
HEADER = f"status string, transfer_syntax string, shape array<int>, spacing array<double>, bits int, {', '.join(f'{n} string' for n in TAGS.values())}, pixels struct<status:string,{STATS.replace(' ', ':').replace(',:', ',')}>"


def header_row(stream: BinaryIO, size: int, max_voxels: int = 0) -> dict:
    """A row of ``HEADER``; pixels are sampled if ``max_voxels`` is not 0."""
    import hashlib

    try:
        found = read_elements(stream, size)
        shape = [n for t in (FRAMES, ROWS, COLUMNS) if (n := found.whole(t)) is not None]
        row = {
            "status": "ok", "transfer_syntax": found.syntax, "shape": shape, "spacing": found.decimals(THICKNESS)[:1] + found.decimals(SPACING)[:2],
            "bits": found.whole(BITS), **{name: found.text(tag) for tag, name in TAGS.items()},
        }
        if max_voxels:
            sample = pixel_sample(found, max_voxels)
            row["pixels"] = {"status": "unsupported" if found.pixels else "missing"} if sample is None else {"status": "ok", "sample_hash": hashlib.sha1(sample.tobytes()).hexdigest(), **kernels.intensity_stats(sample)}
        return row
    except (kernels.Unreadable, struct.error, zlib.error, OverflowError) as e:
        return {"status": f"unreadable: {e}"[:200]}


def dicom_headers(files: DataFrame, path: str = "path", max_voxels: int = 0) -> DataFrame:
    """``files`` (the path column and others, without content) with a struct ``dicom`` of ``HEADER``; see the module for its cases."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    header = _parse_datatype_string(HEADER)
    kind = to_arrow_type(header)
    rows = files.select(F.col(path).alias("path_"), F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"))
    schema: StructType = rows.select("row").schema.add("dicom", header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            read = []
            for name in batch.column("path_").to_pylist():
                if name is None:
                    read.append({"status": "unreadable: no path"})
                    continue
                try:
                    system, inner = fs.FileSystem.from_uri(name)
                    with system.open_input_file(inner) as f:
                        read.append(header_row(f, f.size(), max_voxels))
                except (OSError, pa.ArrowInvalid) as e:
                    read.append({"status": f"unreadable: {e}"[:200]})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(read, kind)], ["row", "dicom"])

    return rows.mapInArrow(run, schema).select("row.*", "dicom")
