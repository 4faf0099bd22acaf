"""TIFF, JPEG and BMP against encoders written here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import codecs, kernels
from assayer.sources import files, rasters

RNG = np.random.default_rng(0)


def pack_bits(data):
    out, at = b"", 0
    while at < len(data):
        run = 1
        while run < 128 and data[at : at + 1] * (run + 1) == data[at : at + run + 1]:
            run += 1
        out += bytes([257 - run]) + data[at : at + 1] if run > 1 else b"\0" + data[at : at + 1]
        at += run
    return out + b"\x80"


def pack_lzw(data):
    bits, table, word, width = "", {bytes([i]): i for i in range(256)}, b"", 9
    bits += format(256, "09b")
    n = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        bits += format(table[word], f"0{width}b")
        table[word + c] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            bits += format(256, f"0{width}b")
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = c
    bits += (format(table[word], f"0{width}b") if word else "")
    n += 1
    width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    bits += format(257, f"0{width}b")
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32773: pack_bits}


def tiff(pixels, order="<", coded=1, rows=None, tile=None, predictor=1, white=False, bits=None):
    h, w = pixels.shape[:2]
    samples = 1 if pixels.ndim == 2 else pixels.shape[2]
    bits = bits or pixels.dtype.itemsize * 8
    cube = pixels.reshape(h, w, samples)
    parts = []
    th, tw = tile or (rows or h, w)
    for y in range(0, h, th):
        for x in range(0, w, tw):
            part = cube[y : y + th, x : x + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            raw = np.packbits(part[..., 0], axis=1).tobytes() if bits == 1 else part.astype(part.dtype.newbyteorder(order)).tobytes()
            parts.append(PACK[coded](raw))
    tags = {256: (3, [w]), 257: (3, [h]), 258: (3, [bits] * samples), 259: (3, [coded]), 262: (3, [0 if white else 1]), 277: (3, [samples]), 317: (3, [predictor])}
    offsets, at = [], 8
    for p in parts:
        offsets.append(at)
        at += len(p)
    names = (324, 325) if tile else (273, 279)
    tags |= {names[0]: (4, offsets), names[1]: (4, [len(p) for p in parts])} | ({322: (3, [tw]), 323: (3, [th])} if tile else {278: (3, [th])})
    entries, extra = b"", b""
    where = at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            place, extra = struct.pack(order + "I", where + len(extra)), extra + raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + place
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + b"".join(parts) + struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0" + extra


@pytest.mark.parametrize("coded", PACK)
@pytest.mark.parametrize("order", "<>")
def test_tiff(coded, order):
    gray = np.repeat(RNG.integers(0, 9, (37, 12)), 4, axis=1).astype(np.uint8)[:, :45]
    noise = RNG.integers(0, 65536, (61, 70)).astype(np.uint16)
    colour = RNG.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    for pixels, more in ((gray, {}), (gray, {"rows": 8}), (noise, {"rows": 20, "predictor": 2}), (colour, {"predictor": 2}), (noise, {"tile": (16, 32)}), (colour, {"tile": (16, 16)})):
        assert (codecs.decode_tiff(tiff(pixels, order, coded, **more)) == pixels).all()
    flags = RNG.integers(0, 2, (5, 19)).astype(np.uint8)
    assert (codecs.decode_tiff(tiff(flags, order, coded, bits=1)) == flags).all()
    assert (codecs.decode_tiff(tiff(gray, order, coded, white=True)) == 255 - gray).all()


# --- a small JPEG encoder: flat code lengths in place of the usual tables


def huffman(symbols):
    """All codes of eight bits (nine if there are more), none of ones only."""
    n = 8 if len(symbols) < 256 else 9
    return bytes([0] * (n - 1) + [len(symbols)] + [0] * (16 - n)) + bytes(symbols), {s: format(i, f"0{n}b") for i, s in enumerate(symbols)}


def magnitude(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def jpeg(planes, sampling=((1, 1),), restart=0, step=1, several=False, marker=0xC0):
    """Planes of whole units; ``sampling`` (h, v) each."""
    dc, dc_code = huffman(range(12))
    ac, ac_code = huffman([r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)])
    high, wide = max(v for _, v in sampling), max(h for h, _ in sampling)
    h, w = planes[0].shape[0] * high // sampling[0][1], planes[0].shape[1] * wide // sampling[0][0]
    blocks = []
    for p in planes:
        cut = p.astype(float).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2) - 128
        blocks.append(np.rint(codecs._COSINE @ cut @ codecs._COSINE.T / step).astype(int).reshape(*cut.shape[:2], 64)[..., codecs.ZIGZAG])

    def coded(row, before):
        size, bits = magnitude(row[0] - before)
        out, zeros = dc_code[size] + bits, 0
        for v in row[1:].tolist():
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                out, zeros = out + ac_code[0xF0], zeros - 16
            size, bits = magnitude(v)
            out, zeros = out + ac_code[zeros << 4 | size] + bits, 0
        return out + (ac_code[0] if zeros else "")

    def entropy(which):
        s = [(1, 1)] if len(which) == 1 else [sampling[i] for i in which]
        first = blocks[which[0]].shape
        units = [(y, x) for y in range(first[0] // s[0][1]) for x in range(first[1] // s[0][0])]
        out, bits, before = b"", "", [0] * len(which)

        def flush(bits):
            bits += "1" * (-len(bits) % 8)
            return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

        for n, (y, x) in enumerate(units):
            if restart and n and n % restart == 0:
                out, bits, before = out + flush(bits) + bytes([0xFF, 0xD0 + (n // restart - 1) % 8]), "", [0] * len(which)
            for k, i in enumerate(which):
                for v in range(s[k][1]):
                    for u in range(s[k][0]):
                        row = blocks[i][y * s[k][1] + v, x * s[k][0] + u]
                        bits += coded(row, before[k])
                        before[k] = int(row[0])
        return out + flush(bits)

    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([step] * 64)) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac)
    out += seg(marker, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, a << 4 | b, 0]) for i, (a, b) in enumerate(sampling)))
    out += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    for which in [[i] for i in range(len(planes))] if several else [list(range(len(planes)))]:
        out += seg(0xDA, bytes([len(which)]) + b"".join(bytes([i + 1, 0]) for i in which) + b"\0\x3f\0") + entropy(which)
    return out + b"\xff\xd9"


def test_jpeg_gray():
    assert sorted(codecs.ZIGZAG) == list(range(64)) and codecs.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2] and codecs.ZIGZAG[-2:] == [62, 63]
    pixels = RNG.integers(0, 256, (24, 40)).astype(np.uint8)
    for restart in (0, 1, 4):
        got = codecs.decode_jpeg(jpeg([pixels], restart=restart))
        assert got.shape == pixels.shape and abs(got.astype(int) - pixels).max() <= 2
    smooth = np.add.outer(np.arange(64), np.arange(64)).astype(np.uint8)
    assert abs(codecs.decode_jpeg(jpeg([smooth], step=8)).astype(int) - smooth).max() <= 12


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("sampling", [((1, 1),) * 3, ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 2), (1, 2), (1, 1))])
def test_jpeg_colour(sampling, several):
    high, wide = max(v for _, v in sampling), max(h for h, _ in sampling)
    planes = [RNG.integers(60, 200, (32 * v // high, 48 * h // wide)).astype(np.uint8) for h, v in sampling]
    got = codecs.decode_jpeg(jpeg(planes, sampling, several=several, restart=2)).astype(float)
    y, b, r = (p.astype(float).repeat(high // v, 0).repeat(wide // h, 1) for p, (h, v) in zip(planes, sampling, strict=True))
    want = np.clip(np.stack([y + 1.402 * (r - 128), y - 0.344136 * (b - 128) - 0.714136 * (r - 128), y + 1.772 * (b - 128)], axis=2), 0, 255)
    assert got.shape == want.shape and abs(got - want).max() <= 5


def bmp(pixels, down=False):
    h, w = pixels.shape[:2]
    raw = pixels if pixels.ndim == 2 else pixels[..., ::-1]
    raw = raw.reshape(h, -1)[:: 1 if down else -1]
    rows = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 4))).tobytes()
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, w, -h if down else h, 1, 8 if pixels.ndim == 2 else 24, 0, 0, 0, 0, 0, 0) + rows


def test_bmp():
    gray, colour = RNG.integers(0, 256, (5, 7)).astype(np.uint8), RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert all((codecs.decode_bmp(bmp(p, d)) == p).all() for p in (gray, colour) for d in (False, True))


def test_damage_is_told_from_other_kinds(spark, tmp_path):
    gray = RNG.integers(0, 256, (16, 16)).astype(np.uint8)
    good = {"a.png": kernels.encode_png(gray), "a.tif": tiff(gray, coded=5), "a.tiff": tiff(gray, ">", 32773), "a.jpg": jpeg([gray]), "a.jpeg": jpeg([gray]), "a.bmp": bmp(gray)}
    bad = {f"cut.{n}": d[: len(d) // 2] for n, d in good.items()} | {"text.png": b"text", "head.jpg": good["a.jpg"][:30]}
    other = {"p.jpg": jpeg([gray], marker=0xC2), "x.webp": b"RIFF\0\0\0\0WEBPVP8 ", "jpeg.tif": tiff(gray).replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 7))}
    for name, data in (good | bad | other).items():
        (tmp_path / name).write_bytes(data)
    rows = rasters.image_profiles(files.tree(spark, str(tmp_path), content=True)).select("name", F.regexp_extract("image.status", "^[a-z]+", 0)).collect()
    assert dict(map(tuple, rows)) == dict.fromkeys(good, "ok") | dict.fromkeys(bad, "unreadable") | dict.fromkeys(other, "unsupported")
    shuffled = bytearray(good["a.jpg"])
    for _ in range(200):  # whatever the bytes, an image or a stated failure
        shuffled[RNG.integers(2, len(shuffled))] = RNG.integers(0, 256)
        for data in (bytes(shuffled), good["a.tif"][: int(RNG.integers(8, len(good["a.tif"])))]):
            try:
                kernels.decode_image(data)
            except kernels.Unreadable:
                pass
