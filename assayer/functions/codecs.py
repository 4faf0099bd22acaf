"""Decoders of TIFF, baseline JPEG and BMP images in NumPy; used inside Arrow-batched functions.

What is read: TIFF of 1, 8, 16 or 32 bits in strips or tiles, plain, packed (PackBits), LZW or deflated, with or without horizontal
prediction, either byte order, first image of the file; JPEG of 8 bits, baseline or extended sequential, gray or colour of any
sampling, in one scan or several, with restarts; BMP of 8, 24 or 32 bits without compression. Gray images are (h, w), colour
ones (h, w, channels), palettes give their indices. Anything else is ``Unsupported``, damaged bytes are ``Unreadable``.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from assayer.functions.kernels import Unreadable, Unsupported

_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: The tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early, as TIFF has it."""
    start, end = 256, 257
    table: list[bytes] = []
    out = bytearray()
    acc = bits = at = 0
    width, last = 9, None
    while True:
        while bits < width:
            if at >= len(data):
                return bytes(out)
            acc, bits, at = (acc << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == end:
            return bytes(out)
        if code == start:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            if code >= 256:
                raise Unreadable("bad LZW code")
            word = table[code] if table else bytes([code])
            table = table or [bytes([i]) for i in range(256)] + [b"", b""]
        else:
            if code > len(table):
                raise Unreadable("bad LZW code")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


_UNPACK = {1: lambda x: x, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode_tiff(data: bytes) -> np.ndarray:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise Unreadable("no TIFF header")
    try:
        return _tiff(data, order)
    except (struct.error, zlib.error, IndexError, KeyError) as e:
        raise Unreadable(f"damaged TIFF: {e}") from e


def _tiff(data: bytes, order: str) -> np.ndarray:
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        size = _TIFF_SIZES.get(kind, 0) * n
        place = at + 10 + 12 * i
        where = place if size <= 4 else struct.unpack(order + "I", data[place : place + 4])[0]
        if kind in (1, 3, 4):
            tags[tag] = list(struct.unpack(f"{order}{n}{'BHI'[(1, 3, 4).index(kind)]}", data[where : where + size]))
    w, h, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, [1])[0]
    bits, coded, form = tags.get(BITS, [1])[0], tags.get(COMPRESSION, [1])[0], tags.get(FORMAT, [1])[0]
    if coded not in _UNPACK or bits not in (1, 8, 16, 32) or (bits == 1 and samples > 1) or tags.get(PLANAR, [1])[0] != 1 or tags.get(PREDICTOR, [1])[0] > 2:
        raise Unsupported("TIFF compression, depth or layout")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}.get(form, "u") + str(max(1, bits // 8)))
    tiled = TILES in tags
    tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(ROWS, [h])[0]))
    offsets, counts = (tags[TILES], tags[TILE_COUNTS]) if tiled else (tags[STRIPS], tags[COUNTS])
    across = -(-w // tw)
    out = np.zeros((h, w, samples), kind.newbyteorder("="))
    for i, (where, n) in enumerate(zip(offsets, counts, strict=True)):
        y, x = i // across * th, i % across * tw
        rows = th if tiled else min(th, h - y)
        if where + n > len(data) or rows <= 0:
            raise Unreadable("truncated TIFF")
        raw = np.frombuffer(_UNPACK[coded](data[where : where + n]), np.uint8)
        if bits == 1:
            line = -(-tw // 8)
            part = np.unpackbits(raw[: rows * line].reshape(rows, line), axis=1)[:, :tw, None]
        else:
            need = rows * tw * samples * kind.itemsize
            if len(raw) < need:
                raise Unreadable("truncated TIFF")
            part = raw[:need].view(kind).reshape(rows, tw, samples).astype(out.dtype)
            if tags.get(PREDICTOR, [1])[0] == 2:
                part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[y : y + rows, x : x + tw] = part[: h - y, : w - x]
    if tags.get(PHOTOMETRIC, [1])[0] == 0 and form == 1:
        out = (1 if bits == 1 else np.iinfo(out.dtype).max) - out
    return out[..., 0] if samples == 1 else out


#: Places of coefficients in a block, by rule: diagonals in turn, up and down.
ZIGZAG = [8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))]
_COSINE = np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of one restart interval, highest first; beyond the end there are ones, as encoders pad."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            part = self.data[self.at : self.at + 4]
            if not part:
                if self.at > len(self.data) + 64:
                    raise Unreadable("truncated JPEG")
                part, self.at = b"\xff", self.at + 1
            else:
                self.at += len(part)
            self.acc = (self.acc & (1 << self.n) - 1) << 8 * len(part) | int.from_bytes(part, "big")
            self.n += 8 * len(part)

    def take(self, n: int) -> int:
        self.need(n)
        self.n -= n
        return self.acc >> self.n & (1 << n) - 1

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        self.need(16)
        ahead = self.acc >> self.n - 16 & 0xFFFF
        length = table[0][ahead]
        if not length:
            raise Unreadable("bad JPEG code")
        self.n -= length
        return table[1][ahead]

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> size - 1 else v - (1 << size) + 1


def _huffman(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Length and symbol for every 16 bits that can come next."""
    lengths, values, code, k = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            if code >= 1 << n or k >= len(symbols):
                raise Unreadable("bad JPEG table")
            a, b = code << 16 - n, code + 1 << 16 - n
            lengths[a:b], values[a:b] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths.tolist(), values.tolist()


def decode_jpeg(data: bytes) -> np.ndarray:
    try:
        return _jpeg(data)
    except (struct.error, IndexError, KeyError) as e:
        raise Unreadable(f"damaged JPEG: {e}") from e


def _jpeg(data: bytes) -> np.ndarray:
    quant: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    parts: dict[int, dict] = {}
    at, restart, adobe, size = 2, 0, None, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unreadable("no JPEG marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                quant[slot] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise Unsupported("JPEG depth")
            size = struct.unpack(">HH", body[1:5])
            for i in range(body[5]):
                k, sampling, slot = body[6 + 3 * i : 9 + 3 * i]
                parts[k] = {"h": sampling >> 4, "v": sampling & 15, "quant": slot}
            high, wide = max(p["v"] for p in parts.values()), max(p["h"] for p in parts.values())
            if not size[0] or not size[1] or len(parts) not in (1, 3):
                raise Unsupported("JPEG components")
            for p in parts.values():
                p["rows"], p["columns"] = (-(-size[0] // (8 * high)) * p["v"], -(-size[1] // (8 * wide)) * p["h"])
                p["own"] = (-(-size[0] * p["v"] // (8 * high)), -(-size[1] * p["h"] // (8 * wide)))
                p["blocks"] = np.zeros((p["rows"] * p["columns"], 64), np.int64)
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise Unsupported("progressive, lossless or arithmetic JPEG")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            if size is None:
                raise Unreadable("JPEG scan without a frame")
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, at)
            raw = data[at : stop.start() if stop else len(data)]
            at = stop.start() if stop else len(data)
            own = [(parts[body[1 + 2 * i]], codes[0, body[2 + 2 * i] >> 4], codes[1, body[2 + 2 * i] & 15]) for i in range(body[0])]
            _scan([x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff+[\xd0-\xd7]", raw)], own, restart)
    if size is None:
        raise Unreadable("no JPEG frame")
    planes = []
    for p in parts.values():
        block = np.zeros((len(p["blocks"]), 64))
        block[:, ZIGZAG] = p["blocks"] * quant[p["quant"]]
        pixels = _COSINE.T @ block.reshape(-1, 8, 8) @ _COSINE + 128
        plane = pixels.reshape(p["rows"], p["columns"], 8, 8).swapaxes(1, 2).reshape(8 * p["rows"], 8 * p["columns"])
        planes.append(plane.repeat(high // p["v"], 0).repeat(wide // p["h"], 1)[: size[0], : size[1]])
    if len(planes) == 3 and adobe != 0:
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b]
    out = np.clip(np.rint(np.stack(planes, axis=2)), 0, 255).astype(np.uint8)
    return out[..., 0] if len(planes) == 1 else out


def _scan(intervals: list[bytes], own: list[tuple], restart: int) -> None:
    """Fills the components' blocks: in one component's scan its own blocks by rows, else unit by unit."""
    if len(own) == 1:
        rows, columns = own[0][0]["own"]
        units = [[(own[0], y * own[0][0]["columns"] + x)] for y in range(rows) for x in range(columns)]
    else:
        first = own[0][0]
        units = [
            [(c, (y * c[0]["v"] + v) * c[0]["columns"] + x * c[0]["h"] + h) for c in own for v in range(c[0]["v"]) for h in range(c[0]["h"])]
            for y in range(first["rows"] // first["v"]) for x in range(first["columns"] // first["h"])
        ]
    step = restart or len(units)
    for i, start in enumerate(range(0, len(units), step)):
        if i >= len(intervals):
            raise Unreadable("truncated JPEG")
        bits, ahead = _Bits(intervals[i]), [0] * len(own)
        for unit in units[start : start + step]:
            for (part, dc, ac), block in unit:
                which = next(k for k, c in enumerate(own) if c[0] is part)
                ahead[which] += bits.value(bits.symbol(dc))
                row = part["blocks"][block]
                row[0] = ahead[which]
                k = 1
                while k < 64:
                    s = bits.symbol(ac)
                    if not s & 15:
                        if s != 0xF0:
                            break
                        k += 16
                        continue
                    k += s >> 4
                    if k > 63:
                        raise Unreadable("bad JPEG block")
                    row[k] = bits.value(s & 15)
                    k += 1


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise Unreadable("truncated BMP")
    start, _, w, h, _, bits, coded = struct.unpack("<IIiiHHI", data[10:34])
    if coded or bits not in (8, 24, 32):
        raise Unsupported("BMP depth or compression")
    line = (w * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8)[start : start + line * abs(h)]
    if w <= 0 or len(raw) < line * abs(h):
        raise Unreadable("truncated BMP")
    rows = raw.reshape(abs(h), line)[:: -1 if h > 0 else 1, : w * bits // 8]
    return rows.copy() if bits == 8 else rows.reshape(abs(h), w, bits // 8)[..., 2::-1].copy()
