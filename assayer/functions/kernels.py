"""Pixel and voxel kernels in NumPy and the standard library; used inside Arrow-batched functions."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class Unreadable(ValueError):
    """The bytes are no image that this decoder reads."""


class Unsupported(Unreadable):
    """The bytes are an image of a kind that no decoder reads."""


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grayscale PNG (for exports and tests)."""
    h, w = pixels.shape
    raw = np.zeros((h, w + 1), np.uint8)
    raw[:, 1:] = pixels

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a non-interlaced 8-bit PNG: (h, w) for gray, (h, w, channels) else; palettes give their indices."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Unreadable("no PNG signature")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 3, 4, 6):
        raise Unreadable("unsupported PNG")
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise Unreadable(str(e)) from e
    if raw.size != h * (w * channels + 1):
        raise Unreadable("truncated PNG")
    rows = raw.reshape(h, -1)
    out = np.zeros((h, w * channels), np.uint8)
    before = np.zeros(w * channels, np.uint8)
    for y in range(h):
        out[y] = before = _unfilter(int(rows[y, 0]), rows[y, 1:], before, channels)
    return out.reshape(h, w) if channels == 1 else out.reshape(h, w, channels)


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + up
    if kind == 1:  # a running sum for each channel
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line), np.int64)
    for i in range(len(line)):
        left, above, corner = (out[i - step] if i >= step else 0), int(up[i]), (int(up[i - step]) if i >= step else 0)
        if kind == 3:
            guess = (left + above) // 2
        else:
            p = left + above - corner
            guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
        out[i] = (int(line[i]) + guess) & 255
    return out.astype(np.uint8)


def decode_pgm(data: bytes) -> np.ndarray:
    parts = data.split(None, 4)
    if len(parts) < 4 or parts[0] != b"P5":
        raise Unreadable("no binary PGM")
    w, h = int(parts[1]), int(parts[2])
    pixels = np.frombuffer(data[len(data) - w * h :], np.uint8)
    if pixels.size != w * h:
        raise Unreadable("truncated PGM")
    return pixels.reshape(h, w)


def decode_image(data: bytes) -> np.ndarray:
    """Pixels of an image, by its first bytes."""
    from assayer.functions import codecs

    if data[:2] == b"P5":
        return decode_pgm(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return codecs.decode_tiff(data)
    if data[:3] == b"\xff\xd8\xff":
        return codecs.decode_jpeg(data)
    if data[:2] == b"BM":
        return codecs.decode_bmp(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" or data[:4] in (b"II+\0", b"MM\0+") or data[:3] == b"GIF":
        raise Unsupported("no decoder")
    return decode_png(data)


def nifti_header(data: bytes) -> dict:
    """Shape, spacing and data type of a NIfTI-1 file (gzip is undone)."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompressobj(31).decompress(data, 352)
    for order in "<>":
        if len(data) >= 348 and struct.unpack(order + "i", data[:4])[0] == 348:
            dims = struct.unpack(order + "8h", data[40:56])
            pixdim = struct.unpack(order + "8f", data[76:108])
            n = dims[0]
            return {"shape": list(dims[1 : n + 1]), "spacing": [float(x) for x in pixdim[1 : min(n, 3) + 1]], "datatype": struct.unpack(order + "h", data[70:72])[0], "offset": int(struct.unpack(order + "f", data[108:112])[0]), "order": order}
    raise Unreadable("no NIfTI-1 header")


def nifti_geometry(data: bytes) -> dict:
    """Transform codes, the spacing of the affine and its axis codes, from the s-form, else the q-form, else the spacing alone."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompressobj(31).decompress(data, 352)
    head = nifti_header(data)
    order = head["order"]
    q, s = struct.unpack(order + "2h", data[252:256])
    zooms = np.array((head["spacing"] + [1.0, 1.0, 1.0])[:3])
    if s > 0:
        affine = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)[:, :3]
    elif q > 0:
        b, c, d = struct.unpack(order + "3f", data[256:268])
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine = turn * zooms * np.array([1, 1, -1 if struct.unpack(order + "f", data[76:80])[0] < 0 else 1])
    else:
        affine = np.diag(zooms)
    codes = "".join(("RAS" if column[axis] > 0 else "LPI")[axis] for column in affine.T for axis in [int(np.abs(column).argmax())])
    return {"transform_codes": int(q > 0) + int(s > 0), "header_spacing": np.sqrt((affine**2).sum(axis=0)).tolist()[: len(head["spacing"])], "orientation": codes}


_NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def nifti_volume(data: bytes) -> tuple[np.ndarray, dict]:
    head = nifti_header(data)
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    kind = _NIFTI_TYPES.get(head["datatype"])
    if kind is None:
        raise Unreadable("unsupported NIfTI type")
    count = int(np.prod(head["shape"]))
    return np.frombuffer(data, head["order"] + kind, count, max(352, head["offset"])).reshape(head["shape"], order="F"), head


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the face-connected components of a mask, by propagating minima along runs."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        old = label.copy()
        for axis in range(mask.ndim):
            a, b = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
            a[axis], b[axis] = slice(1, None), slice(None, -1)
            both = mask[tuple(a)] & mask[tuple(b)]
            least = np.minimum(label[tuple(a)], label[tuple(b)])
            label[tuple(a)][both] = np.minimum(label[tuple(a)], least)[both]
            label[tuple(b)][both] = np.minimum(label[tuple(b)], least)[both]
        flat = label.ravel()
        on = flat > 0
        flat[on] = flat[flat[on] - 1]  # a label is a position: jump to that position's label
        if (label == old).all():
            break
    _, dense = np.unique(label, return_inverse=True)
    dense = dense.reshape(mask.shape)
    return dense if not mask.all() else dense + 1


def label_profile(pixels: np.ndarray, tiny: int = 16, most: int = 900_000) -> dict:
    """Values, histogram, foreground ratio, components and tiny components; components of a thinned image if it is large."""
    values, counts = np.unique(pixels, return_counts=True)
    step = max(1, int(np.ceil(np.sqrt(pixels.size / most))))
    small = pixels[tuple(slice(None, None, step) for _ in range(pixels.ndim))]
    total = little = 0
    regions = {}
    for v in values[values != 0].tolist():
        sizes = np.bincount(components(small == v).ravel())[1:]
        regions[v] = int((sizes > 0).sum())
        total, little = total + regions[v], little + int(((sizes > 0) & (sizes < tiny)).sum())
    return {"values": values.tolist(), "histogram": counts.tolist(), "foreground_ratio": float((pixels != 0).mean()) if pixels.size else 0.0, "components": total, "tiny_components": little, "regions": regions}


def foreground_box(mask: np.ndarray) -> list[int] | None:
    """Lower corner and exclusive upper corner of the foreground by axis."""
    if not mask.any():
        return None
    at = np.argwhere(mask)
    return [*at.min(axis=0).tolist(), *(at.max(axis=0) + 1).tolist()]


def touched_faces(mask: np.ndarray) -> list[str]:
    return [f"{axis}{side}" for axis in range(mask.ndim) for side, i in (("-", 0), ("+", -1)) if np.take(mask, i, axis).any()]


def sample_stride(size: int, most: int, dimensions: int = 3) -> int:
    return max(1, int(np.ceil((size / most) ** (1 / dimensions))))


def intensity_stats(sample: np.ndarray) -> dict:
    """Quantiles (0.1, 1, 5, 50, 95, 99, 99.9 %), spread, tail, foreground and slice changes of sampled intensities.

    ``dynamic_range`` is the 99 % less the 1 % quantile, ``tail_ratio`` what lies between 99 and 99.9 % in units of it; foreground
    is what exceeds the 5 % quantile by 0.15 of the way to the 95 % one. Values that are not finite are left out; without any other
    the sample is empty. Slices are those of the last axis of three.
    """
    flat = sample[np.isfinite(sample)]
    if not flat.size:
        return {"empty": True}
    q = np.quantile(flat, [0.001, 0.01, 0.05, 0.5, 0.95, 0.99, 0.999])
    spread, std = float(q[5] - q[1]), float(flat.std())
    on = sample > q[2] + 0.15 * max(1e-6, q[4] - q[2])
    means = sample.mean(axis=(0, 1)) if sample.ndim == 3 else sample[:0]
    return {
        "quantiles": q.tolist(), "dynamic_range": spread, "std": std, "tail_ratio": float(q[6] - q[5]) / max(1e-6, spread), "foreground_ratio": float(on.mean()),
        "zero_fraction": float((flat == 0).mean()), "slice_delta_p95": float(np.quantile(np.abs(np.diff(means)), 0.95)) if len(means) > 1 else 0.0,
        "touch_faces": len(touched_faces(on)), "empty": spread <= 1e-6 and std <= 1e-6,
    }


def threshold(pixels: np.ndarray, at: int = 127, on: int = 1) -> np.ndarray:
    return np.where(pixels > at, on, 0).astype(np.uint8)


def mask_boxes(mask: np.ndarray, least_area: int = 1) -> list[tuple[int, float, float, float, float]]:
    """(class, centre x, centre y, width, height) normalised, with classes from 0, one box a value."""
    h, w = mask.shape
    out = []
    for v in np.unique(mask[mask > 0]).tolist():
        y1, x1, y2, x2 = foreground_box(mask == v)
        if (x2 - x1) * (y2 - y1) >= least_area:
            out.append((v - 1, (x1 + x2) / 2 / w, (y1 + y2) / 2 / h, (x2 - x1) / w, (y2 - y1) / h))
    return out


def _surface(mask: np.ndarray) -> np.ndarray:
    inner = mask.copy()
    for axis in range(mask.ndim):
        for shift in (1, -1):
            moved = np.roll(mask, shift, axis)
            edge = [slice(None)] * mask.ndim
            edge[axis] = 0 if shift == 1 else -1
            moved[tuple(edge)] = False
            inner &= moved
    return np.argwhere(mask & ~inner)


def hd95(a: np.ndarray, b: np.ndarray, block: int = 512) -> float:
    """95th percentile of both directed surface distances; both empty 0, one empty the diagonal."""
    if not a.any() and not b.any():
        return 0.0
    if not a.any() or not b.any():
        return float(np.sqrt(sum(n * n for n in a.shape)))
    x, y = _surface(a), _surface(b)

    def nearest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(((p[i : i + block, None, :] - q[None, :, :]) ** 2).sum(axis=2).min(axis=1)) for i in range(0, len(p), block)])

    return float(np.percentile(np.concatenate([nearest(x, y), nearest(y, x)]), 95))


def majority_mask(masks: list[np.ndarray]) -> np.ndarray:
    """Pixel votes of several masks; ties go to the smallest label."""
    stack = np.stack(masks)
    values = np.unique(stack)
    votes = np.stack([(stack == v).sum(axis=0) for v in values])
    return values[votes.argmax(axis=0)]


def rasterise(polygons: list[tuple[int, list[tuple[float, float]]]], height: int, width: int, classes: int = 32) -> tuple[np.ndarray, int]:
    """Even-odd scan fill at pixel centres, later polygons on top; labels outside 1..classes are skipped and counted."""
    out, skipped = np.zeros((height, width), np.uint8), 0
    xs = np.arange(width) + 0.5
    for label, points in polygons:
        if not 1 <= label <= classes:
            skipped += 1
            continue
        ring = list(zip(points, points[1:] + points[:1], strict=True))
        for y in range(height):
            cy = y + 0.5
            cuts = sorted(x1 + (cy - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in ring if (y1 <= cy) != (y2 <= cy))
            for left, right in zip(cuts[::2], cuts[1::2], strict=False):
                out[y, (xs >= left) & (xs < right)] = label
    return out, skipped


def stretch(pixels: np.ndarray, low: float = 1, high: float = 99) -> np.ndarray:
    a, b = np.percentile(pixels, [low, high])
    return np.clip((pixels.astype(np.float64) - a) / max(b - a, 1e-9) * 255, 0, 255).astype(np.uint8)


def letterbox(pixels: np.ndarray, size: int, fill: int = 0) -> tuple[np.ndarray, tuple[float, int, int]]:
    """Nearest resize into a square with borders; returns what ``unletterbox`` needs."""
    h, w = pixels.shape
    scale = size / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    ys, xs = np.minimum((np.arange(nh) / scale).astype(int), h - 1), np.minimum((np.arange(nw) / scale).astype(int), w - 1)
    top, left = (size - nh) // 2, (size - nw) // 2
    out = np.full((size, size), fill, pixels.dtype)
    out[top : top + nh, left : left + nw] = pixels[np.ix_(ys, xs)]
    return out, (scale, top, left)


def unletterbox(pixels: np.ndarray, how: tuple[float, int, int], height: int, width: int) -> np.ndarray:
    scale, top, left = how
    ys = np.clip((np.arange(height) * scale).astype(int) + top, 0, pixels.shape[0] - 1)
    xs = np.clip((np.arange(width) * scale).astype(int) + left, 0, pixels.shape[1] - 1)
    return pixels[np.ix_(ys, xs)]


#: Test-time variants: name, transform and its inverse.
VARIANTS = {
    "identity": (lambda a: a, lambda a: a), "flip_x": (np.fliplr, np.fliplr), "flip_y": (np.flipud, np.flipud),
    "rot90": (np.rot90, lambda a: np.rot90(a, -1)), "rot180": (lambda a: np.rot90(a, 2), lambda a: np.rot90(a, 2)), "rot270": (lambda a: np.rot90(a, 3), np.rot90),
}


def overlay(gray: np.ndarray, mask: np.ndarray, palette: dict[int, tuple[int, int, int]], alpha: float = 0.4) -> np.ndarray:
    out = np.repeat(gray[..., None], 3, axis=2).astype(np.float64)
    for v, colour in palette.items():
        on = mask == v
        out[on] = (1 - alpha) * out[on] + alpha * np.array(colour)
    return out.round().astype(np.uint8)


def black_boxes(pixels: np.ndarray, boxes: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Blanks fractional boxes (x1, y1, x2, y2)."""
    out = pixels.copy()
    h, w = out.shape[:2]
    for x1, y1, x2, y2 in boxes:
        out[int(y1 * h) : int(np.ceil(y2 * h)), int(x1 * w) : int(np.ceil(x2 * w))] = 0
    return out
