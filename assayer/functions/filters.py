"""Local equalisation, median and cubic resampling of gray images in NumPy; used inside Arrow-batched functions."""

from __future__ import annotations

import numpy as np


def equalise(pixels: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation: each tile's histogram is clipped at ``clip`` times its mean, the excess spread over all values.

    A pixel's value is blended bilinearly between the maps of the four tiles whose centres surround it; beyond the outer centres
    the nearest map counts. Tiles differ by a pixel at most where the sides are no multiple of their number; an image with fewer
    rows or columns than ``tiles`` has as many tiles as those. Images without pixels stay as they are.
    """
    h, w = pixels.shape
    if not pixels.size:
        return pixels.copy()
    ny, nx = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, ny + 1).astype(int), np.linspace(0, w, nx + 1).astype(int)
    maps = np.zeros((ny, nx, 256))
    for i in range(ny):
        for j in range(nx):
            part = pixels[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            counts = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            limit = max(1.0, clip * part.size / 256)
            cut = np.minimum(counts, limit)
            maps[i, j] = np.cumsum(cut + (counts - cut).sum() / 256) * 255 / part.size

    def between(edges: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        centres = (edges[:-1] + edges[1:] - 1) / 2
        at = np.clip(np.interp(np.arange(size), centres, np.arange(n)), 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = between(ys, ny, h)
    x0, x1, fx = between(xs, nx, w)
    top = maps[y0[:, None], x0[None, :], pixels] * (1 - fx) + maps[y0[:, None], x1[None, :], pixels] * fx
    low = maps[y1[:, None], x0[None, :], pixels] * (1 - fx) + maps[y1[:, None], x1[None, :], pixels] * fx
    return np.clip(np.rint(top * (1 - fy[:, None]) + low * fy[:, None]), 0, 255).astype(np.uint8)


def median(pixels: np.ndarray, radius: int = 1) -> np.ndarray:
    """Median of the square around each pixel, borders repeated: column histograms slide down, their sums across give each window's.

    A row costs the same whatever the radius. Memory is 256 counts a column.
    """
    h, w = pixels.shape
    if not pixels.size or radius < 1:
        return pixels.copy()
    padded = np.pad(pixels, radius, mode="edge")
    wide, side = w + 2 * radius, 2 * radius + 1
    columns = np.zeros((wide, 256), np.int32)
    at = np.arange(wide)
    for row in padded[:side]:
        columns[at, row] += 1
    out = np.empty_like(pixels)
    half = (side * side + 1) // 2
    for y in range(h):
        if y:
            columns[at, padded[y - 1]] -= 1
            columns[at, padded[y + side - 1]] += 1
        sums = np.zeros((wide + 1, 256), np.int32)
        np.cumsum(columns, axis=0, out=sums[1:])
        out[y] = (np.cumsum(sums[side:] - sums[:-side], axis=1) >= half).argmax(axis=1)
    return out


def _cubic(size: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new place four old ones, counted from two before the first, and their weights."""
    at = (np.arange(new) + 0.5) * size / new - 0.5
    base = np.floor(at).astype(int)
    t = (at - base)[:, None] - np.array([-1, 0, 1, 2])
    d = np.abs(t)
    near, far = 1.5 * d**3 - 2.5 * d**2 + 1, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return base[:, None] + np.array([-1, 0, 1, 2]) + 2, np.where(d <= 1, near, np.where(d < 2, far, 0.0))


def _extended(rows: np.ndarray) -> np.ndarray:
    """Two rows more at each end, on the line through the last two: linear images stay linear up to their borders."""
    first, last = rows[:1], rows[-1:]
    if len(rows) == 1:
        return np.repeat(rows, 5, axis=0)
    up, down = first - rows[1:2], last - rows[-2:-1]
    return np.concatenate([first + 2 * up, first + up, rows, last + down, last + 2 * down])


def resize_cubic(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Separable cubic convolution (a = -1/2) at pixel centres, as floats; constant and linear images are exact."""
    out = pixels.astype(np.float64)
    for axis, new in ((0, height), (1, width)):
        out = np.moveaxis(out, axis, 0)
        at, weight = _cubic(len(out), new)
        held = _extended(out)
        out = np.moveaxis(np.einsum("nk,nkm->nm", weight, held[np.clip(at, 0, len(held) - 1)]), 0, axis)
    return out


def as_pixels(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def degrade(pixels: np.ndarray, factor: int) -> np.ndarray:
    h, w = pixels.shape
    return as_pixels(resize_cubic(pixels, max(1, h // factor), max(1, w // factor)))


def restore(small: np.ndarray, height: int, width: int) -> np.ndarray:
    return as_pixels(resize_cubic(small, height, width))


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    error = float(((a.astype(np.float64) - b) ** 2).mean())
    return float("inf") if error == 0 else 10 * float(np.log10(255**2 / error))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of whole images (one window)."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my, cov = x.mean(), y.mean(), ((x - x.mean()) * (y - y.mean())).mean()
    return float((2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (x.var() + y.var() + c2)))
