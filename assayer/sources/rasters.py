"""Images, label rasters and volumes as tables: bytes are decoded once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import filters, kernels, volumes
from assayer.sources.dicom import STATS

_PROFILE = "status string, shape array<int>, label_values array<int>, foreground_ratio double, components int, tiny_components int, regions map<int,int>, pixel_sha256 string"
_VOLUME = f"status string, shape array<int>, spacing array<double>, {STATS}"
#: Decoders of volume suffixes; more can be registered where their libraries are installed.
VOLUME_READERS: dict[str, Callable] = {".nii": kernels.nifti_volume, ".nii.gz": kernels.nifti_volume, ".mha": volumes.attached_volume, ".nrrd": volumes.attached_volume}


def _profile(data: bytes, labels: bool) -> dict:
    import hashlib

    try:
        pixels = kernels.decode_image(bytes(data))
    except (kernels.Unreadable, ValueError, TypeError) as e:
        return {"status": f"{'unsupported' if isinstance(e, kernels.Unsupported) else 'unreadable'}: {e}"[:200]}
    out = {"status": "ok", "shape": list(pixels.shape), "pixel_sha256": hashlib.sha256(repr(pixels.shape).encode() + pixels.tobytes()).hexdigest()}
    if labels and pixels.ndim == 2:
        p = kernels.label_profile(pixels)
        out |= {"label_values": p["values"], "foreground_ratio": p["foreground_ratio"], "components": p["components"], "tiny_components": p["tiny_components"], "regions": p["regions"]}
    return out


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object).where(lambda d: d.notna(), None)


def image_profiles(files: DataFrame, labels: bool = False) -> DataFrame:
    """``files`` (with content) plus a struct ``image``: status, shape, values, foreground, components, pixel hash."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield _frame([_profile(x, labels) for x in s], _PROFILE)

    udf = F.pandas_udf(run, _PROFILE, functionType=F.PandasUDFType.SCALAR_ITER)
    return files.withColumn("image", udf("content")).drop("content")


def _summary(voxels: np.ndarray, shape: list[int], spacing: list[float], max_voxels: int) -> dict:
    import hashlib

    step = kernels.sample_stride(voxels.size, max_voxels, voxels.ndim)
    sample = voxels[tuple(slice(None, None, step) for _ in range(voxels.ndim))].astype("float32")
    return {"status": "ok", "shape": shape, "spacing": spacing, "sample_hash": hashlib.sha1(sample.tobytes()).hexdigest(), **kernels.intensity_stats(sample)}


def volume_summaries(files: DataFrame, max_voxels: int = 450_000) -> DataFrame:
    """``files`` (with content and suffix) plus a struct ``volume``; what no decoder reads is unreadable, not an error."""

    def one(data: bytes, suffix: str) -> dict:
        reader = VOLUME_READERS.get(suffix)
        if reader is None:
            return {"status": "unreadable: no decoder"}
        try:
            voxels, head = reader(bytes(data))
            return _summary(voxels, head["shape"], head["spacing"], max_voxels)
        except (kernels.Unreadable, ValueError, TypeError) as e:
            return {"status": f"{'unsupported' if isinstance(e, kernels.Unsupported) else 'unreadable'}: {e}"[:200]}

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, suffix in batches:
            yield _frame([one(d, s) for d, s in zip(data, suffix, strict=True)], _VOLUME)

    udf = F.pandas_udf(run, _VOLUME, functionType=F.PandasUDFType.SCALAR_ITER)
    return files.withColumn("volume", udf("content", "suffix")).drop("content")


def detached_volumes(headers: DataFrame, data: DataFrame, max_voxels: int = 450_000) -> DataFrame:
    """``headers`` (path, content of .mhd and .nhdr files) plus ``volume``; their voxels are joined from ``data`` (path, content) by path.

    A header's data file is named relative to its folder, or absolutely. One that names no file of ``data`` is unreadable. Headers
    that hold their voxels themselves need no partner.
    """

    @F.pandas_udf("string")
    def named(path: pd.Series, content: pd.Series) -> pd.Series:
        import posixpath

        def one(p: str, c: bytes) -> str | None:
            try:
                name = volumes.volume_header(bytes(c)).data_file
            except (kernels.Unreadable, ValueError):
                return None
            return name and posixpath.normpath(posixpath.join(posixpath.dirname(p), name))

        return pd.Series([one(p, c) for p, c in zip(path, content, strict=True)], dtype=object)

    @F.pandas_udf(_VOLUME)
    def summary(content: pd.Series, place: pd.Series, other: pd.Series) -> pd.DataFrame:
        def one(c: bytes, p: str | None, o: bytes | None) -> dict:
            try:
                head = volumes.volume_header(bytes(c))
                if p is not None and o is None:
                    raise kernels.Unreadable("no data file")
                return _summary(volumes.voxels(head, bytes(c if p is None else o)), head.shape, head.spacing, max_voxels)
            except (kernels.Unreadable, ValueError, TypeError) as e:
                return {"status": f"{'unsupported' if isinstance(e, kernels.Unsupported) else 'unreadable'}: {e}"[:200]}

        return _frame([one(*r) for r in zip(content, place, other, strict=True)], _VOLUME)

    placed = headers.withColumn("data_path_", named("path", "content"))
    partner = data.select(F.col("path").alias("data_path_"), F.col("content").alias("data_"))
    return placed.join(partner, "data_path_", "left").withColumn("volume", summary("content", "data_path_", "data_")).drop("content", "data_", "data_path_")


def preprocessed(files: DataFrame, radius: int = 1, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """``files`` with ``content`` as a gray PNG: stretched from 1 to 99 %, equalised locally, then the median; null where it is no image."""

    @F.pandas_udf("binary")
    def run(content: pd.Series) -> pd.Series:
        def one(data: bytes) -> bytes | None:
            try:
                pixels = kernels.decode_image(bytes(data))
            except (kernels.Unreadable, ValueError, TypeError):
                return None
            gray = pixels if pixels.ndim == 2 else pixels[..., :3].mean(axis=2)
            return kernels.encode_png(filters.median(filters.equalise(kernels.stretch(gray), tiles, clip), radius))

        return pd.Series([one(c) for c in content], dtype=object)

    return files.withColumn("content", run("content"))


def restoration(files: DataFrame, factor: int = 2, case: str = "case_id") -> DataFrame:
    """(case, psnr, ssim) of images that were made ``factor`` times smaller and larger again by cubic resampling; null where there is no image."""

    @F.pandas_udf("psnr double, ssim double")
    def run(content: pd.Series) -> pd.DataFrame:
        def one(data: bytes) -> tuple[float | None, float | None]:
            try:
                pixels = kernels.decode_image(bytes(data))
            except (kernels.Unreadable, ValueError, TypeError):
                return None, None
            gray = pixels if pixels.ndim == 2 else np.rint(pixels[..., :3].mean(axis=2)).astype("uint8")
            back = filters.restore(filters.degrade(gray, factor), *gray.shape)
            return filters.psnr(gray, back), filters.ssim(gray, back)

        return pd.DataFrame([one(c) for c in content], columns=["psnr", "ssim"], dtype=object)

    return files.select(case, run("content").alias("r")).select(case, "r.*")


def mask_metrics(pairs: DataFrame, case: str = "case_id", truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Per case and class: dice, iou, hd95 of two encoded label rasters; other shapes give status shape_mismatch."""
    schema = f"{case} string, class_id int, status string, dice double, iou double, hd95 double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, t, p in b.itertuples(index=False):
                try:
                    a, c = kernels.decode_image(bytes(t)), kernels.decode_image(bytes(p))
                except (kernels.Unreadable, ValueError):
                    rows.append((key, None, "unreadable", None, None, None))
                    continue
                if a.shape != c.shape:
                    rows.append((key, None, "shape_mismatch", None, None, None))
                    continue
                for v in sorted({*a.ravel().tolist(), *c.ravel().tolist()} - {0}):
                    x, y = a == v, c == v
                    both = int((x & y).sum())
                    dice = (2 * both + 1e-5) / (int(x.sum()) + int(y.sum()) + 1e-5)
                    rows.append((key, v, "ok", dice, (both + 1e-5) / (int((x | y).sum()) + 1e-5), kernels.hd95(x, y)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pairs.select(F.col(case).cast("string"), truth, predicted).mapInPandas(run, schema)


def yolo_lines(labels: DataFrame, case: str = "case_id", content: str = "content") -> DataFrame:
    """(case_id, line): one text line a class box of every label raster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, "{:d} {:.8f} {:.8f} {:.8f} {:.8f}".format(*box)) for key, data in b.itertuples(index=False) for box in kernels.mask_boxes(kernels.decode_image(bytes(data)))]
            yield pd.DataFrame(rows, columns=["case_id", "line"])

    return labels.select(F.col(case).cast("string"), content).mapInPandas(run, "case_id string, line string")
