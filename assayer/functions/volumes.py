"""MetaImage and NRRD volumes: header grammars and voxels in NumPy; used inside Arrow-batched functions."""

from __future__ import annotations

import bz2
import re
import zlib
from dataclasses import dataclass, field

import numpy as np

from assayer.functions.kernels import Unreadable, Unsupported

#: Element types of both formats.
META_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG_LONG": "i8", "MET_ULONG_LONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NRRD_TYPES = {
    "i1": ("signed char", "int8", "int8_t"), "u1": ("uchar", "unsigned char", "uint8", "uint8_t"), "i2": ("short", "short int", "signed short", "signed short int", "int16", "int16_t"),
    "u2": ("ushort", "unsigned short", "unsigned short int", "uint16", "uint16_t"), "i4": ("int", "signed int", "int32", "int32_t"), "u4": ("uint", "unsigned int", "uint32", "uint32_t"),
    "i8": ("longlong", "long long", "long long int", "signed long long", "int64", "int64_t"), "u8": ("ulonglong", "unsigned long long", "unsigned long long int", "uint64", "uint64_t"), "f4": ("float",), "f8": ("double",),
}


@dataclass
class Header:
    """``shape`` and ``spacing`` by axis from the fastest; ``data_file`` is None if the voxels follow at ``offset``."""

    shape: list[int]
    spacing: list[float]
    kind: str
    order: str
    encoding: str
    data_file: str | None = None
    offset: int = 0
    lines: int = 0
    origin: list[float] = field(default_factory=list)
    direction: list[float] = field(default_factory=list)


def _numbers(text: str, cast=float) -> list:
    try:
        return [cast(x) for x in text.split()]
    except ValueError as e:
        raise Unreadable(f"bad number: {text[:40]}") from e


def meta_header(data: bytes) -> Header:
    """The header of a .mha or .mhd file: lines of ``key = value`` up to ElementDataFile."""
    fields: dict[str, str] = {}
    at = 0
    while at < len(data) and at < 1 << 20:
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        key, mark, value = data[at:end].decode("latin-1").partition("=")
        at = end + 1
        if not mark:
            if key.strip():
                break
            continue
        fields[key.strip().lower()] = value.strip()
        if key.strip().lower() == "elementdatafile":
            break
    if "elementdatafile" not in fields or "dimsize" not in fields:
        raise Unreadable("no MetaImage header")
    kind = META_TYPES.get(fields.get("elementtype", ""))
    if kind is None or fields.get("elementnumberofchannels", "1") != "1" or fields.get("binarydata", "True").lower() == "false":
        raise Unsupported("MetaImage element type")
    where = fields["elementdatafile"]
    if where.split()[0].upper() == "LIST" or "%" in where:
        raise Unsupported("MetaImage data in several files")
    shape = _numbers(fields["dimsize"], int)
    big = fields.get("binarydatabyteordermsb", fields.get("elementbyteordermsb", "False")).lower() == "true"
    spacing = _numbers(fields.get("elementspacing", fields.get("elementsize", " ".join(["1"] * len(shape)))))
    packed = fields.get("compresseddata", "False").lower() == "true"
    skip = _numbers(fields.get("headersize", "0"), int)[0]
    local = where.upper() == "LOCAL"
    return Header(
        shape, spacing, kind, ">" if big else "<", "zlib" if packed else "raw", None if local else where, at if local else skip,
        origin=_numbers(fields.get("offset", fields.get("position", ""))), direction=_numbers(fields.get("transformmatrix", fields.get("orientation", ""))),
    )


def nrrd_header(data: bytes) -> Header:
    """The header of a .nrrd or .nhdr file: ``field: value`` lines up to an empty one; comments and ``key:=value`` are skipped."""
    if not re.match(rb"NRRD000[1-9]\r?\n", data):
        raise Unreadable("no NRRD header")
    end = re.compile(rb"\n\r?\n").search(data)
    head = data[: end.start()] if end else data
    fields: dict[str, str] = {}
    for line in head.decode("latin-1").splitlines()[1:]:
        if not line.startswith("#") and ":=" not in line and ": " in line + " ":
            key, _, value = line.partition(":")
            fields[key.strip().lower().replace(" ", "")] = value.strip()
    kind = next((k for k, names in NRRD_TYPES.items() if fields.get("type", "").lower() in names), None)
    encoding = {"raw": "raw", "gzip": "gzip", "gz": "gzip", "bzip2": "bzip2", "bz2": "bzip2", "ascii": "text", "text": "text", "txt": "text"}.get(fields.get("encoding", "").lower())
    if "sizes" not in fields or not fields.get("dimension", "").isdigit():
        raise Unreadable("incomplete NRRD header")
    if kind is None or encoding is None:
        raise Unsupported("NRRD type or encoding")
    shape = _numbers(fields["sizes"], int)
    if len(shape) != int(fields["dimension"]):
        raise Unreadable("NRRD sizes and dimension differ")
    vectors = [_numbers(v.replace(",", " ")) for v in re.findall(r"\(([^)]*)\)", fields.get("spacedirections", ""))]
    spacing = [float(np.sqrt(sum(x * x for x in v))) for v in vectors] if vectors else [abs(x) for x in _numbers(fields.get("spacings", " ".join(["1"] * len(shape))))]
    where = fields.get("datafile")
    if where and (where.split()[0] == "LIST" or "%" in where):
        raise Unsupported("NRRD data in several files")
    if not where and not end:
        raise Unreadable("NRRD without data")
    origin = _numbers(fields.get("spaceorigin", "").strip("()").replace(",", " "))
    return Header(
        shape, spacing, kind, ">" if fields.get("endian", "little").lower() == "big" else "<", encoding, where, _numbers(fields.get("byteskip", "0"), int)[0] if where else end.end(),
        _numbers(fields.get("lineskip", "0"), int)[0], origin, [x for v in vectors for x in v],
    )


def volume_header(data: bytes) -> Header:
    return nrrd_header(data) if data[:4] == b"NRRD" else meta_header(data)


def voxels(head: Header, data: bytes) -> np.ndarray:
    """Voxels with the fastest axis last; ``data`` is the file that holds them. Of skipped bytes, -1 means all but the voxels."""
    if not head.shape or min(head.shape) < 1:
        raise Unreadable("empty volume")
    count, kind = int(np.prod(head.shape)), np.dtype(head.order + head.kind)
    at = head.offset
    if at < 0:
        if head.encoding != "raw":
            raise Unreadable("skip from the end of packed data")
        at = len(data) - count * kind.itemsize
    for _ in range(head.lines):
        at = data.index(b"\n", at) + 1
    raw = data[at:] if at >= 0 else b""
    try:
        if head.encoding in ("zlib", "gzip"):
            raw = zlib.decompressobj(47).decompress(raw, count * kind.itemsize)
        elif head.encoding == "bzip2":
            raw = bz2.BZ2Decompressor().decompress(raw, count * kind.itemsize)
        elif head.encoding == "text":
            values = np.array(raw.split()[:count], np.float64)
            if len(values) < count:
                raise Unreadable("truncated volume")
            return values.astype(kind.newbyteorder("=")).reshape(head.shape[::-1])
    except (zlib.error, OSError, ValueError) as e:
        raise Unreadable(f"damaged volume: {e}") from e
    if len(raw) < count * kind.itemsize:
        raise Unreadable("truncated volume")
    return np.frombuffer(raw, kind, count).reshape(head.shape[::-1])


def attached_volume(data: bytes) -> tuple[np.ndarray, dict]:
    """Voxels and header facts of a file that holds both."""
    head = volume_header(data)
    if head.data_file is not None:
        raise Unsupported("voxels are in another file")
    return voxels(head, data), {"shape": head.shape, "spacing": head.spacing}
