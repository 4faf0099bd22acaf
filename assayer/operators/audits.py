"""The quality-control pipelines as rule tables: dataset QC, cohort audit, governance audit.

Inputs are decoded once into columns; every pipeline evaluates its row rules in one projection,
its group rules in one aggregate or window a key, and its cohort rules in one bounds aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import case_token, numbering_schema
from assayer.operators import cohort, dedup
from assayer.operators.rules import Rule, bbox_invalid, issues, polygon_issue

#: Input of ``dataset_issues``: one row a case.
CASES = """case_id string, split string, pos bigint, image_path string, image_roles array<string>, label_roles array<string>, image_ok boolean,
image_case_id string, label_case_id string, dimensions int, shape array<int>, spacing array<double>, label_path string, label_ok boolean,
label_shape array<int>, label_spacing array<double>, label_values array<int>, allowed_values array<int>, foreground_ratio double,
tiny_components int, components_per_class int, labels array<string>, boxes array<struct<label:string,box:array<double>>>,
polygons array<struct<label:string,points:array<array<double>>>>, content_sha1 string"""


def _doubled(items: Column) -> Column:
    return F.size(items) > F.size(F.array_distinct(items))


def dataset_issues(cases: DataFrame, expected_dimensions: int = 2, needs_spacing: bool = False) -> DataFrame:
    """Issues (case_id, severity, category, type, message) of a dataset; those of the whole dataset have no case."""
    width, height = F.col("shape")[1], F.col("shape")[0]
    has_image = F.col("image_path").isNotNull()
    has_label = F.col("label_path").isNotNull() | F.coalesce(F.size("boxes") > 0, F.lit(False)) | F.coalesce(F.size("polygons") > 0, F.lit(False))
    readable, label_ok = has_image & F.col("image_ok"), F.col("label_path").isNotNull() & F.col("label_ok")
    empty = label_ok & (F.col("foreground_ratio") == 0)
    shape_differs = label_ok & readable & (F.col("shape") != F.col("label_shape"))
    invalid = F.filter(F.coalesce("labels", F.array()), lambda x: ~x.rlike("^(?:[1-9]|[12][0-9]|3[0-2]|[A-T])$"))
    box_format = F.exists("boxes", lambda b: F.size(b["box"]) != 4)
    box_outside = readable & (expected_dimensions == 2) & F.exists("boxes", lambda b: (F.size(b["box"]) == 4) & bbox_invalid(b["box"], width, height))
    few = F.exists("polygons", lambda p: polygon_issue(p["points"], width, height) == "too_few_points")
    outside = F.exists("polygons", lambda p: polygon_issue(p["points"], width, height) == "out_of_bounds")
    rules = [
        Rule("missing_image", "error", "completeness", ~has_image),
        Rule("duplicate_image_roles", "warning", "correspondence", _doubled(F.col("image_roles"))),
        Rule("duplicate_label_roles", "warning", "correspondence", _doubled(F.col("label_roles"))),
        Rule("unreadable_image", "error", "completeness", has_image & ~F.col("image_ok")),
        Rule("image_case_id_mismatch", "warning", "correspondence", has_image & (F.col("image_case_id") != F.col("case_id"))),
        Rule("missing_spacing", "warning", "metadata_consistency", readable & F.lit(needs_spacing) & F.col("spacing").isNull()),
        Rule("unexpected_dimensionality", "warning", "metadata_consistency", readable & (F.col("dimensions") != expected_dimensions)),
        Rule("missing_annotation", "error", "completeness", ~has_label),
        Rule("invalid_annotation_labels", "warning", "annotation_integrity", F.size(invalid) > 0, F.array_join(invalid, ",")),
        Rule("mixed_numbering_schema", "warning", "numbering_schema", numbering_schema(F.col("labels")) == "mixed"),
        Rule("label_case_id_mismatch", "warning", "correspondence", F.col("label_case_id") != F.col("case_id")),
        Rule("unreadable_annotation", "error", "completeness", F.col("label_path").isNotNull() & ~F.col("label_ok")),
        Rule("image_label_shape_mismatch", "error", "correspondence", shape_differs),
        Rule("empty_mask", "warning", "annotation_integrity", empty),
        Rule("invalid_label_values", "warning", "annotation_integrity", label_ok & (F.size(F.array_except("label_values", "allowed_values")) > 0)),
        Rule("implausible_foreground_ratio", "warning", "plausibility", label_ok & (F.col("foreground_ratio") > 0.98)),
        Rule("many_tiny_fragments", "warning", "plausibility", label_ok & (F.col("tiny_components") > 100)),
        Rule("disconnected_components", "warning", "plausibility", label_ok & F.col("allowed_values").isNull() & (F.col("components_per_class") > 4)),
        Rule("spacing_mismatch", "warning", "metadata_consistency", label_ok & readable & (F.col("spacing") != F.col("label_spacing"))),
        Rule("duplicated_bbox_labels", "warning", "annotation_integrity", _doubled(F.transform("boxes", lambda b: b["label"]))),
        Rule("invalid_bbox_format", "error", "annotation_integrity", box_format),
        Rule("bbox_out_of_bounds", "error", "plausibility", box_outside),
        Rule("duplicated_polygon_labels", "warning", "annotation_integrity", _doubled(F.transform("polygons", lambda p: p["label"]))),
        Rule("invalid_polygon", "error", "annotation_integrity", few),
        Rule("polygon_out_of_bounds", "error", "plausibility", readable & outside),
    ]
    by_row = issues(cases, rules, "case_id")
    made = lambda df, severity, code, case, message: df.select(case.cast("string").alias("case_id"), F.lit(severity).alias("severity"), F.lit("split_integrity").alias("category"), F.lit(code).alias("type"), message.cast("string").alias("message"))
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    moved = dedup.split_changes(cases.where("split is not null"), "case_id", "split", "pos")
    leaked = dedup.content_leakage(cases.where("split is not null"), "content_sha1", "split", "case_id", "pos")
    token = dedup.cross_split(cases.where("split is not null").withColumn("token", case_token(F.col("case_id"))), F.col("token"), "split")
    return (
        by_row.unionByName(made(repeated, "warning", "repeated_case_identifier", F.lit(None), F.col("case_id")))
        .unionByName(made(moved, "error", "case_in_multiple_splits", F.col("case_id"), F.col("previous_split")))
        .unionByName(made(leaked, "error", "content_leakage", F.col("case_id"), F.col("owner_case")))
        .unionByName(made(token, "warning", "normalized_identifier_leakage", F.lit(None), F.col("key")))
    )


#: Input of ``cohort_findings``: one row a volume.
VOLUMES = """case_id string, split string, n_images int, image_ok boolean, dimensions int, spacing array<double>, shape array<int>, transform_codes int,
orientation string, header_spacing array<double>, patient_id string, study_uid string, series_uid string, modality string, foreground_ratio double, dynamic_range double, std double,
tail_ratio double, slice_delta_p95 double, zero_fraction double, touch_faces int, n_labels int, label_ok boolean, label_shape array<int>, label_spacing array<double>,
label_orientation string, label_nonzero double, label_values array<double>, label_integer boolean, allowed_values array<double>, file_sha1 string, sample_hash string"""


def _six(a: Column) -> Column:
    return F.transform(a, lambda x: F.round(x, 6))


#: Bounds of the volume rules.
MIN_FOREGROUND, MAX_TAIL, MIN_MOTION, MOTION_SHARE = 0.002, 0.55, 1.0, 0.3
TOUCHED_FACES, ZERO_SHARE, FEW_FOREGROUND, MUCH_FOREGROUND = 5, 0.05, 0.08, 0.95


def cohort_rules(labels_required: bool = False) -> list[tuple[str, str, str, str, str, str, Column]]:
    """(code, domain, severity, confidence, impact, status, condition); conditions that do not apply are null."""
    ok, labelled = F.col("image_ok"), F.col("image_ok") & F.col("label_ok")
    must = ("severe", "major") if labels_required else ("mild", "moderate")
    return [
        ("missing_image", "intake", "severe", "high", "major", "confirmed", F.col("n_images") == 0),
        ("multiple_image_files", "intake", "moderate", "high", "moderate", "confirmed", F.col("n_images") > 1),
        ("unreadable_image", "intake", "severe", "high", "major", "confirmed", (F.col("n_images") > 0) & ~ok),
        ("invalid_spacing", "metadata", "severe", "high", "major", "confirmed", ok & F.exists("spacing", lambda x: (x <= 0) | F.isnan(x))),
        ("unexpected_dimensionality", "volume_consistency", "moderate", "high", "moderate", "confirmed", ok & (F.col("dimensions") != 3)),
        ("missing_spatial_transform_codes", "metadata", "moderate", "medium", "moderate", "confirmed", ok & (F.col("transform_codes") == 0)),
        ("metadata_inconsistency", "metadata", "moderate", "high", "moderate", "confirmed", ok & (_six(F.col("spacing")) != _six(F.col("header_spacing")))),
        ("missing_key_metadata", "metadata", "moderate", "high", "moderate", "confirmed", ok & (F.col("spacing").isNull() | F.col("shape").isNull())),
        ("missing_modality_metadata", "metadata", "moderate", "high", "moderate", "confirmed", ok & F.col("modality").isNull()),
        ("empty_or_corrupt_volume", "volume_consistency", "severe", "high", "major", "confirmed", ok & (F.col("dynamic_range") <= 1e-6) & (F.coalesce("std", F.lit(0.0)) <= 1e-6)),
        ("possible_truncation", "volume_consistency", "moderate", "medium", "moderate", "suspected", ok & (F.col("touch_faces") >= TOUCHED_FACES) & ((F.coalesce("zero_fraction", F.lit(0.0)) > ZERO_SHARE) | ~F.coalesce("foreground_ratio", F.lit(0.0)).between(FEW_FOREGROUND, MUCH_FOREGROUND))),
        ("very_low_foreground_ratio", "volume_consistency", "moderate", "medium", "moderate", "suspected", ok & (F.coalesce("foreground_ratio", F.lit(0.0)) < MIN_FOREGROUND)),
        ("possible_metal_artifact", "image_quality", "moderate", "low", "moderate", "suspected", ok & (F.col("tail_ratio") > MAX_TAIL)),
        ("possible_motion_or_slice_inconsistency", "image_quality", "moderate", "low", "moderate", "suspected", ok & (F.col("slice_delta_p95") > F.greatest(F.lit(MIN_MOTION), MOTION_SHARE * F.coalesce("dynamic_range", F.lit(0.0))))),
        ("missing_annotation_volume", "label_awareness", must[0], "high", must[1], "confirmed", F.col("n_labels") == 0),
        ("multiple_label_files", "label_awareness", "moderate", "high", "moderate", "confirmed", F.col("n_labels") > 1),
        ("unreadable_label", "label_awareness", "severe", "high", "major", "confirmed", (F.col("n_labels") > 0) & ~F.col("label_ok")),
        ("image_label_shape_mismatch", "label_awareness", "severe", "high", "major", "confirmed", labelled & (F.col("shape") != F.col("label_shape"))),
        ("image_label_spacing_mismatch", "label_awareness", "moderate", "high", "moderate", "confirmed", labelled & (_six(F.col("spacing")) != _six(F.col("label_spacing")))),
        ("image_label_orientation_mismatch", "label_awareness", "moderate", "medium", "moderate", "confirmed", labelled & (F.col("orientation") != F.col("label_orientation"))),
        ("empty_label", "label_awareness", "severe", "high", "major", "confirmed", F.col("label_ok") & (F.col("label_nonzero") == 0)),
        ("near_empty_label", "label_awareness", "moderate", "medium", "moderate", "suspected", F.col("label_ok") & (F.col("label_nonzero") > 0) & (F.col("label_nonzero") < 1e-4)),
        ("non_integer_label_values", "label_awareness", "severe", "high", "major", "confirmed", F.col("label_ok") & ~F.col("label_integer")),
        ("invalid_label_values", "label_awareness", "severe", "high", "major", "confirmed", F.col("label_ok") & (F.size(F.array_except("label_values", "allowed_values")) > 0)),
    ]


_FINDING = ("domain", "severity", "confidence", "impact", "status")


def _finding(df: DataFrame, code: Column | str, *values: Column | str) -> DataFrame:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("case_id", col(code).alias("code"), *[col(v).alias(n) for n, v in zip(_FINDING, values, strict=True)])


def cohort_findings(volumes: DataFrame, labels_required: bool = False) -> DataFrame:
    """Findings (case_id, code, domain, severity, confidence, impact, status) of a cohort of volumes."""
    structs = [
        F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), *[F.lit(v).alias(n) for n, v in zip(_FINDING, values, strict=True)]))
        for code, *values, c in cohort_rules(labels_required)
    ]
    out = volumes.select("case_id", F.inline(F.array_compact(F.array(*structs))))
    readable = volumes.where("image_ok")
    fov = F.zip_with("shape", "spacing", lambda n, s: n * s)
    for name, values, domain in (("spacing", F.col("spacing"), "metadata"), ("shape", F.col("shape").cast("array<double>"), "volume_consistency"), ("fov", fov, "volume_consistency")):
        axes = readable.select("case_id", F.posexplode(values).alias("axis", "x"))
        out = out.unionByName(_finding(cohort.outliers(axes, F.col("x"), ["axis"]), F.concat(F.lit(f"{name}_outlier_axis_"), F.col("axis").cast("string")), domain, "moderate", "medium", "moderate", "suspected"))
    one = readable.withColumn("all_", F.lit(1))
    out = out.unionByName(_finding(cohort.outliers(one, F.col("dynamic_range"), ["all_"]), "dynamic_range_outlier", "image_quality", "moderate", "medium", "moderate", "suspected"))
    out = out.unionByName(_finding(cohort.outliers(one, F.col("std"), ["all_"]), "noise_or_contrast_outlier", "image_quality", "mild", "medium", "moderate", "suspected"))
    return out.unionByName(duplicate_findings(volumes))


#: Codes that reject a case of the header audit, and the modality of the cohort.
BLOCKING, MODALITY = ("unreadable_image", "invalid_spacing", "unexpected_dimensionality", "empty_or_corrupt_volume"), "CT"


def header_rules(modality: str = MODALITY) -> list[tuple[str, str, str, str, str, str, Column]]:
    """The rules for scans that come with a header and no labels, over the columns of ``VOLUMES`` and ``empty``."""
    ok, blank = F.col("image_ok"), lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    no_spacing = F.coalesce(F.size("spacing"), F.lit(0)) <= 0
    share = F.coalesce("foreground_ratio", F.lit(0.0))
    cropped = (F.coalesce("zero_fraction", F.lit(0.0)) > ZERO_SHARE) | ~share.between(FEW_FOREGROUND, MUCH_FOREGROUND)
    return [
        ("unreadable_image", "intake", "severe", "high", "major", "confirmed", ~F.coalesce(ok, F.lit(False))),
        ("invalid_spacing", "metadata", "severe", "high", "major", "confirmed", ok & (no_spacing | F.exists("spacing", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)))),
        ("unexpected_dimensionality", "volume_consistency", "severe", "high", "major", "confirmed", ok & (F.coalesce(F.size("shape"), F.lit(0)) != 3)),
        ("missing_key_metadata", "metadata", "moderate", "high", "moderate", "confirmed", ok & (blank("patient_id") | blank("study_uid") | blank("series_uid"))),
        ("missing_modality_metadata", "metadata", "moderate", "high", "moderate", "confirmed", ok & blank("modality")),
        ("metadata_inconsistency", "metadata", "moderate", "high", "moderate", "confirmed", ok & ~blank("modality") & (F.upper(F.trim("modality")) != modality)),
        ("empty_or_corrupt_volume", "volume_consistency", "severe", "high", "major", "confirmed", ok & F.col("empty")),
        ("possible_truncation", "volume_consistency", "moderate", "medium", "moderate", "suspected", ok & (F.col("touch_faces") >= TOUCHED_FACES) & cropped),
        ("very_low_foreground_ratio", "volume_consistency", "moderate", "medium", "moderate", "suspected", ok & (share < MIN_FOREGROUND)),
        ("possible_metal_artifact", "image_quality", "moderate", "low", "moderate", "suspected", ok & (F.col("tail_ratio") > MAX_TAIL)),
        ("possible_motion_or_slice_inconsistency", "image_quality", "moderate", "low", "moderate", "suspected", ok & (F.col("slice_delta_p95") > F.greatest(F.lit(MIN_MOTION), MOTION_SHARE * F.coalesce("dynamic_range", F.lit(0.0))))),
    ]


def header_volumes(headers: DataFrame, case: Column) -> DataFrame:
    """The columns that ``header_rules`` reads from ``dicom_headers`` with pixels; pixels that are not read have no statistics."""
    d, p = F.col("dicom"), F.col("dicom.pixels")
    same = [d[c].alias(c) for c in ("shape", "spacing", "modality", "patient_id", "study_uid", "series_uid")]
    stats = [p[c].alias(c) for c in ("foreground_ratio", "zero_fraction", "tail_ratio", "slice_delta_p95", "dynamic_range", "std", "touch_faces", "empty", "sample_hash")]
    return headers.select(case.alias("case_id"), (d["status"] == "ok").alias("image_ok"), *same, *stats)


def header_findings(volumes: DataFrame, modality: str = MODALITY) -> DataFrame:
    """Findings of every scan by ``header_rules``; one projection, nothing is joined."""
    structs = [
        F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), *[F.lit(v).alias(n) for n, v in zip(_FINDING, values, strict=True)]))
        for code, *values, c in header_rules(modality)
    ]
    return volumes.select("case_id", F.array_compact(F.array(*structs)).alias("findings"))


def header_status(found: DataFrame) -> DataFrame:
    """(case_id, status, codes): rejected by a blocking code, else to be looked at if there is any finding, else usable."""
    codes = F.transform("findings", lambda f: f["code"])
    status = F.when(F.arrays_overlap(codes, F.array(*map(F.lit, BLOCKING))), "reject").when(F.size(codes) > 0, "needs_manual_review").otherwise("usable")
    return found.select("case_id", status.alias("status"), codes.alias("codes"))


def duplicate_findings(volumes: DataFrame) -> DataFrame:
    """Repeated identifiers and scans, and their leaks across splits: one aggregate a key, joined back on it."""
    token = F.nullif(case_token(F.col("case_id"), ("copy", "dup")), F.lit(""))
    near = F.when(F.col("sample_hash").isNotNull(), F.concat_ws("|", "sample_hash", F.col("shape").cast("string"), _six(F.col("spacing")).cast("string")))
    keys = (
        ("duplicate_case_identifier", token, "moderate", "high", "moderate", "confirmed"), ("repeated_patient_identifier", F.col("patient_id"), "moderate", "medium", "moderate", "suspected"),
        ("repeated_study_uid", F.col("study_uid"), "moderate", "high", "moderate", "confirmed"), ("duplicate_series_uid", F.col("series_uid"), "severe", "high", "major", "confirmed"),
        ("exact_duplicate_scan", F.col("file_sha1"), None, "high", None, "confirmed"), ("suspected_near_duplicate_scan", near, "moderate", "medium", "moderate", "suspected"),
    )
    out = None
    for code, key, severity, confidence, impact, status in keys:
        rows = volumes.withColumn("key_", key).where("key_ is not null")
        groups = rows.groupBy("key_").agg(F.count(F.lit(1)).alias("n_"), F.countDistinct("split").alias("splits_"), F.countDistinct("file_sha1").alias("files_")).where("n_ > 1")
        if code == "suspected_near_duplicate_scan":
            groups = groups.where("files_ > 1")  # groups of one content are exact duplicates already
        hit = rows.join(groups, "key_")
        across = F.col("splits_") > 1
        sev = F.when(across, "severe").otherwise("moderate") if severity is None else severity
        imp = F.when(across, "major").otherwise("moderate") if impact is None else impact
        part = _finding(hit, code, "duplicate_risk", sev, confidence, imp, status)
        if code in ("duplicate_case_identifier", "exact_duplicate_scan", "suspected_near_duplicate_scan"):
            leak = ("moderate", "medium", "major", "suspected") if status == "suspected" else ("severe", "high", "major", "confirmed")
            part = part.unionByName(_finding(hit.where(across), "split_leakage", "duplicate_risk", *leak))
        out = part if out is None else out.unionByName(part)
    return out


#: Input of ``governance_issues``: one row a case.
GOVERNANCE = "case_id string, image_path string, mask_path string, image_ok boolean, mask_ok boolean, shape array<int>, mask_shape array<int>, values array<int>, regions map<int,int>, tiny_components int"


def governance_issues(cases: DataFrame, splits: DataFrame, schema: Sequence[int] = tuple(range(0, 49)), most_missing: int = 5) -> DataFrame:
    """The six checks of a governance audit: (case_id, severity, category, type, message); totals count every case."""
    mask = F.col("mask_path").isNotNull() & F.col("mask_ok")
    unexpected = F.array_except("values", F.array(*map(F.lit, schema)))
    rules = [
        Rule("missing_annotation_mask", "critical", "file_integrity", F.col("mask_path").isNull()),
        Rule("image_unreadable", "critical", "file_integrity", F.col("image_path").isNotNull() & ~F.col("image_ok")),
        Rule("mask_unreadable", "critical", "file_integrity", F.col("mask_path").isNotNull() & ~F.col("mask_ok")),
        Rule("dimension_mismatch", "critical", "pairing", F.col("image_ok") & mask & (F.col("shape") != F.col("mask_shape"))),
        Rule("mask_empty", "warning", "annotation_completeness", mask & (F.size(F.array_remove("values", 0)) == 0)),
        Rule("invalid_label_value", "critical", "annotation_completeness", mask & F.exists("values", lambda v: v < 0)),
        Rule("duplicated_label_regions", "warning", "annotation_completeness", mask & F.exists(F.map_values("regions"), lambda n: n > 1)),
        Rule("unexpected_labels", "warning", "labeling_standards", mask & (F.size(unexpected) > 0), F.array_join(unexpected.cast("array<string>"), ",")),
        Rule("small_disconnected_components", "warning", "structural_reasonableness", mask & (F.col("tiny_components") > 0)),
    ]
    out = issues(cases, rules, "case_id")
    seen = cases.where(mask).select(F.explode("values").alias("v")).agg(F.collect_set("v").alias("seen"))  # at most as many as label values
    missing = F.array_except(F.array(*[F.lit(v) for v in schema if v]), "seen")
    gap = seen.where(F.size(missing) > most_missing).select(F.lit(None).cast("string").alias("case_id"), F.lit("warning").alias("severity"), F.lit("labeling_standards").alias("category"), F.lit("incomplete_tooth_schema").alias("type"), F.array_join(missing.cast("array<string>"), ",").alias("message"))
    named = lambda df, code, message: df.select("case_id", F.lit("critical").alias("severity"), F.lit("split_integrity").alias("category"), F.lit(code).alias("type"), message.alias("message"))
    lost = splits.join(cases.select("case_id").distinct(), "case_id", "left_anti")
    return out.unionByName(gap).unionByName(named(lost, "case_not_in_dataset", F.col("split"))).unionByName(named(dedup.split_overlap(splits), "split_leakage", F.col("pair")))


def discovered_cases(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases from image and label files (case_id, folder, path): split by folder name, label-only cases kept as orphans."""
    split = F.when(F.lower("folder").rlike("test|ts$"), "test").when(F.lower("folder").rlike("val"), "val").otherwise("train")
    i = images.groupBy("case_id").agg(F.sort_array(F.collect_list("path")).alias("images"), F.min(split).alias("split"))
    l = labels.groupBy("case_id").agg(F.sort_array(F.collect_list("path")).alias("label_files"))
    return i.join(l, "case_id", "full_outer").withColumn("orphan_label", F.col("images").isNull())


def problem_cases(findings: DataFrame) -> DataFrame:
    return findings.groupBy("domain").agg(F.sort_array(F.collect_set("case_id")).alias("cases"), F.countDistinct("case_id").alias("n_cases"))


def top_findings(findings: DataFrame, n: int = 20, code: str = "code", order: str | None = None) -> DataFrame:
    """The most frequent codes; of equally frequent ones the first by name, or that which was first seen by ``order``."""
    seen = [F.min(order).alias("first_seen")] if order else []
    return findings.groupBy(code).agg(F.count(F.lit(1)).alias("n"), *seen).orderBy(F.desc("n"), "first_seen" if order else code).limit(n)


def corrections(findings: DataFrame, status: DataFrame) -> DataFrame:
    """Corrections that can be applied, and cases that are to be left out."""
    auto = findings.where("auto_correctable").select("case_id", F.col("code").alias("action"))
    return auto.unionByName(status.where("case_status = 'reject'").select("case_id", F.lit("exclude").alias("action")))


def label_coverage(values: DataFrame, case: str = "case_id") -> DataFrame:
    return values.groupBy("value").agg(F.countDistinct(case).alias("n_cases"))


def first_file(files: DataFrame, key: Sequence[str], path: str = "path") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(path)
    return files.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")
