"""From file trees to the inputs of the audits: volumes with labels, raster cases, governance rows.

A tree is listed once; files are paired by case in DataFrames, and only the files that a case keeps are read and decoded, in
Arrow batches. What cannot be decoded is a fact of its case, not an error.

Defined cases: an empty tree has no cases. A label without an image makes a volume case (an orphan) and no raster case. Of
several images or labels of one case the first by path is read, and their number is kept. A dataset without the usual image
folders is walked as a whole, folders of labels left out. Extra files are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import case_id, file_name, kernels
from assayer.functions import suffix as suffix_of
from assayer.operators import audits, records
from assayer.sources import dicom, documents, files, rasters

#: Suffixes of volumes, and names of folders with images and labels.
VOLUME_SUFFIXES = (".nii", ".nii.gz", ".mha", ".mhd", ".nrrd", ".dcm")
IMAGE_FOLDERS = ("imagestr", "imagests", "images", "scans", "volumes")
LABEL_FOLDERS = ("labelstr", "labelsts", "labels", "masks", "segmentations", "annotations")
FACTS = (
    "status string, shape array<int>, spacing array<double>, dimensions int, transform_codes int, orientation string, header_spacing array<double>, modality string, patient_id string, "
    f"study_uid string, series_uid string, label_values array<double>, label_nonzero double, label_integer boolean, {dicom.STATS}"
)


def discovered(listed: DataFrame) -> DataFrame:
    """(case_id, split, image_path, n_images, label_path, n_labels) of the volumes in a tree (``files.tree``)."""
    parts = F.split("rel_path", "/")
    top = F.when(F.size(parts) > 1, F.lower(parts[0]))
    rows = listed.where(F.col("suffix").isin(*VOLUME_SUFFIXES)).withColumn("top", top)
    named = not rows.where(F.col("top").isin(*IMAGE_FOLDERS)).limit(1).isEmpty()
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.lower(p))
    is_label = F.col("top").isin(*LABEL_FOLDERS)
    is_image = F.col("top").isin(*IMAGE_FOLDERS) if named else ~F.arrays_overlap(above, F.array(*map(F.lit, LABEL_FOLDERS)))
    split = F.when(F.col("top") == "imagestr", "train").when(F.col("top") == "imagests", "test").when(F.lit(named), parts[0])
    role = F.when(F.coalesce(is_label, F.lit(False)), "label").when(F.coalesce(is_image, F.lit(False)), "image")
    rows = rows.select(case_id(F.col("path"), "literal").alias("case_id"), role.alias("role"), "path", split.alias("split")).where("role IS NOT NULL")
    of = lambda kind, c: F.when(F.col("role") == kind, F.col(c))
    return rows.groupBy("case_id").agg(
        F.min_by("split", of("image", "path")).alias("split"), F.min(of("image", "path")).alias("image_path"), F.count(of("image", "path")).cast("int").alias("n_images"),
        F.min(of("label", "path")).alias("label_path"), F.count(of("label", "path")).cast("int").alias("n_labels"),
    )


def _read(data: bytes, suffix: str) -> tuple[np.ndarray | None, dict]:
    """Voxels (None if they are packed in a way that is not read) and header facts."""
    if suffix == ".dcm":
        found = dicom.read_elements(BytesIO(data), len(data))
        head = dicom.header_row(BytesIO(data), len(data))
        return dicom.pixel_sample(found, 1 << 62), {k: head[k] for k in ("shape", "spacing", "modality", "patient_id", "study_uid", "series_uid")}
    reader = rasters.VOLUME_READERS.get(suffix)
    if reader is None:
        raise kernels.Unsupported("no decoder")
    voxels, head = reader(data)
    facts = {k: head[k] for k in ("shape", "spacing")}
    return voxels, facts | kernels.nifti_geometry(data) if suffix.startswith(".nii") else facts


def _facts(data: bytes | None, suffix: str, label: bool, max_voxels: int) -> dict | None:
    import hashlib

    if data is None:
        return None
    try:
        voxels, head = _read(bytes(data), suffix)
        row = {"status": "ok", "dimensions": len(head["shape"]), **head}
        if label:
            if voxels is None:
                raise kernels.Unsupported("packed labels")
            flat = voxels[..., 0] if voxels.ndim == 4 and voxels.shape[-1] == 1 else voxels
            values = np.unique(flat)
            whole = bool(np.isfinite(values).all() and np.allclose(values, np.round(values)))
            return row | {"label_values": values[:256].astype(float).tolist(), "label_nonzero": float(np.count_nonzero(flat) / flat.size), "label_integer": whole}
        if voxels is not None:
            step = kernels.sample_stride(voxels.size, max_voxels, voxels.ndim) if voxels.ndim == 3 else 1
            sample = voxels[tuple(slice(None, None, step) for _ in range(voxels.ndim))].astype("float32")
            row |= {"sample_hash": hashlib.sha1(sample.tobytes()).hexdigest(), **kernels.intensity_stats(sample)}
        return row
    except (kernels.Unreadable, ValueError, TypeError, OverflowError) as e:
        return {"status": f"{'unsupported' if isinstance(e, kernels.Unsupported) else 'unreadable'}: {e}"[:200]}


def _decoded(rows: DataFrame, path: str, label: bool, max_voxels: int) -> DataFrame:
    """(path, facts, sha1) of the files that ``rows`` names in ``path``."""
    spark = rows.sparkSession

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for data, end in batches:
            yield rasters._frame([_facts(d, s, label, max_voxels) or {} for d, s in zip(data, end, strict=True)], FACTS)

    udf = F.pandas_udf(run, FACTS, functionType=F.PandasUDFType.SCALAR_ITER)
    wanted = rows.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()
    root = rows.select(F.col("root_")).first()
    listed = files.tree(spark, root["root_"], content=True) if root else None
    if listed is None:
        return spark.createDataFrame([], f"path string, facts struct<{FACTS.replace(', ', ',').replace(' ', ':')}>, sha1 string")
    return listed.join(wanted, "path", "left_semi").select("path", udf("content", suffix_of(F.col("path"))).alias("facts"), F.sha1("content").alias("sha1"))


def volume_table(spark: SparkSession, root: str, labels_required: bool = False, max_voxels: int = 450_000) -> DataFrame:
    """The input of ``audits.cohort_findings`` from a folder of volumes, label folders and a ``dataset.json``."""
    found = discovered(files.tree(spark, root)).withColumn("root_", F.lit(root))
    image, label = F.col("i.facts"), F.col("l.facts")
    allowed = _allowed(spark, root)
    joined = (
        found.alias("c").join(_decoded(found, "image_path", False, max_voxels).alias("i"), F.col("c.image_path") == F.col("i.path"), "left")
        .join(_decoded(found, "label_path", True, max_voxels).alias("l"), F.col("c.label_path") == F.col("l.path"), "left")
    )
    same = [image[c].alias(c) for c in ("dimensions", "spacing", "shape", "transform_codes", "orientation", "header_spacing", "patient_id", "study_uid", "series_uid", "modality")]
    stats = [image[c].alias(c) for c in ("foreground_ratio", "dynamic_range", "std", "tail_ratio", "slice_delta_p95", "zero_fraction", "touch_faces")]
    ok = lambda x: F.coalesce(x["status"] == "ok", F.lit(False))
    return joined.select(
        "c.case_id", "split", "n_images", ok(image).alias("image_ok"), *same, *stats, "n_labels", ok(label).alias("label_ok"), label["shape"].alias("label_shape"), label["spacing"].alias("label_spacing"),
        label["orientation"].alias("label_orientation"), label["label_nonzero"].alias("label_nonzero"), label["label_values"].alias("label_values"), label["label_integer"].alias("label_integer"),
        allowed.alias("allowed_values"), F.col("i.sha1").alias("file_sha1"), image["sample_hash"].alias("sample_hash"), image["status"].alias("image_status"),
    )


def _allowed(spark: SparkSession, root: str) -> Column:
    """The label values that the dataset's description allows; null without one."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "dataset.json").text(root)
    r = text.select(documents.label_schema(F.get_json_object("value", "$.labels")).alias("v")).first()
    return F.array(*[F.lit(float(x)) for x in r["v"]]) if r and r["v"] else F.lit(None).cast("array<double>")


def raster_cases(spark: SparkSession, root: str, splits: DataFrame | None = None, allowed: list[int] | None = None) -> DataFrame:
    """The input of ``audits.dataset_issues`` from a folder of images and folders of label rasters.

    The primary folder and the label folders are found by score and overlap (``files``); ``splits`` (split, case_id, pos) assigns
    cases, the last one counts. Label rasters are the roles, named by their folders; the first role's raster is profiled.
    """
    listed = files.tree(spark, root)
    folders = files.folder_summary(listed)
    primary = files.primary_folder(folders).first()
    roles = [r["folder"] for r in files.label_folders(listed, primary["folder"]).collect()] if primary and primary["folder"] is not None else []
    owned = files.cases(listed)
    images = owned.where(F.col("folder") == (primary["folder"] if primary else "")).select("case_id", F.col("path"), F.lit("primary_image").alias("role"))
    labels = owned.where(F.col("folder").isin(*roles) if roles else F.lit(False)).select("case_id", "path", F.col("folder").alias("role"))
    built = records.built_cases(images, labels)
    firsts = F.array_sort(F.map_keys("labels"))
    built = built.select("case_id", F.col("image").alias("image_path"), F.coalesce(firsts, F.array()).alias("label_roles"), F.try_element_at("labels", F.try_element_at(firsts, F.lit(1))).alias("label_path"))
    content = files.tree(spark, root, content=True)
    kept = built.select("image_path").union(built.select("label_path")).where("image_path IS NOT NULL").distinct().withColumnRenamed("image_path", "path")
    read = content.join(kept, "path", "left_semi").withColumn("sha1", F.sha1("content"))
    profiles = rasters.image_profiles(read, labels=True).select("path", "image", "sha1")
    i, l = (profiles.select(F.col("path").alias(f"{k}_path"), F.col("image").alias(k), F.col("sha1").alias(f"{k}_sha1")) for k in ("image", "label"))
    rows = built.join(i, "image_path", "left").join(l, "label_path", "left")
    rows = records.with_split(rows, splits) if splits is not None else rows.withColumn("split", F.lit(None).cast("string"))
    ok = lambda c: F.col(f"{c}.status") == "ok"
    per_class = F.ceil(F.col("label.components") / F.greatest(F.size(F.array_remove("label.label_values", 0)), F.lit(1))).cast("int")
    ordered = rows.repartitionByRange("case_id").sortWithinPartitions("case_id").withColumn("pos", F.monotonically_increasing_id())
    made = ordered.select(
        "case_id", "split", "pos", "image_path", F.array(F.lit("primary_image")).alias("image_roles"), "label_roles", ok("image").alias("image_ok"), case_id(file_name(F.col("image_path"))).alias("image_case_id"),
        F.when(F.col("label_path").isNotNull(), case_id(file_name(F.col("label_path")))).alias("label_case_id"), F.least(F.size("image.shape"), F.lit(2)).alias("dimensions"), F.slice("image.shape", 1, 2).alias("shape"),
        "label_path", ok("label").alias("label_ok"), F.slice("label.shape", 1, 2).alias("label_shape"), F.col("label.label_values").alias("label_values"), F.col("label.foreground_ratio").alias("foreground_ratio"),
        F.col("label.tiny_components").alias("tiny_components"), per_class.alias("components_per_class"), F.col("image_sha1").alias("content_sha1"), F.col("label.regions").alias("regions"),
        (F.array(*map(F.lit, allowed)) if allowed else F.lit(None).cast("array<int>")).alias("allowed_values"),
    )
    return _completed(made, audits.CASES)


def _completed(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks as nulls."""
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string(" ".join(schema.split()))
    return df.select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name not in df.columns])


def governance_cases(cases: DataFrame) -> DataFrame:
    """The input of ``audits.governance_issues`` from ``raster_cases``."""
    return cases.select(
        "case_id", "image_path", F.col("label_path").alias("mask_path"), "image_ok", F.col("label_ok").alias("mask_ok"), "shape", F.col("label_shape").alias("mask_shape"),
        F.col("label_values").alias("values"), "regions", "tiny_components",
    )
