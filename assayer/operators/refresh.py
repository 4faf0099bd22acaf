"""Registries from what lies in the artifact folders: quality reports, datasets, models, runs, lineage, an overview, a data card.

Inputs are a listed tree (``files.tree``: path, rel_path, name, suffix, mtime) and the small JSON documents in it (``documents``).
Every registry is one table, made by joins on folders; nothing is read file by file on the driver.

Defined cases: a document that is no JSON object is left out of the registries that need its fields, as one without the field
is null there; a run without a launcher has null launcher columns. An empty tree has empty registries. Of several reports for
one key the last by path counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import dataset_number
from assayer.sources import exports, files
from assayer.sources.documents import canonical_json_sha256

#: Names of model files and sub-folders of a dataset.
MODEL_FILES = ("checkpoint_best.pth", "checkpoint_final.pth", "model.pth")
PARTS = ("imagesTr", "labelsTr", "imagesTs", "labelsTs", "imagesVal", "labelsVal")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, name, text, mtime) of the JSON objects below ``root``."""
    t = files.tree(spark, root, content=True).where("suffix = '.json'")
    rows = t.select("path", _folder(F.col("path")).alias("folder"), "name", F.decode("content", "UTF-8").alias("text"), "mtime")
    return rows.where(F.col("text").rlike(r"^\s*\{") & F.get_json_object("text", "$").isNotNull())


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _get(path: str, kind: str = "string") -> Column:
    out = F.get_json_object("text", f"$.{path}")
    return (out if kind == "string" else out.try_cast(kind)).alias(path.rsplit(".", 1)[-1])


def quality_reports(docs: DataFrame) -> DataFrame:
    """One row a ``.qc.json``: its key (else the name), dataset, status and counts."""
    key = F.coalesce(F.nullif(F.get_json_object("text", "$.report_key"), F.lit("")), F.regexp_replace("name", r"\.qc\.json$", ""))
    counts = [_get(f"summary.{c}", "long") for c in ("case_count", "ready_case_count", "manual_review_case_count", "blocked_case_count", "error_count", "warning_count")]
    status = F.get_json_object("text", "$.summary.dataset_status").alias("status")
    rows = docs.where(F.col("name").endswith(".qc.json")).select(key.alias("report_key"), _get("dataset_name"), _get("dataset_root"), _get("dataset_mode"), status, *counts, "path", _get("report_md"), _get("generated_at"))
    last = F.struct(*rows.columns)
    return rows.groupBy("report_key").agg(F.max_by(last, "path").alias("r")).select("r.*")


def datasets(listed: DataFrame, docs: DataFrame, reports: DataFrame) -> DataFrame:
    """One row a dataset folder: its description, files by part, delivery and quality status, and whether it can be trained on."""
    parts = F.split("rel_path", "/")
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^Dataset\d{3}_")), True)
    held = listed.withColumn("at", at.cast("int")).where((F.col("at") > 0) & (F.col("at") < F.size(parts)))
    held = held.withColumn("folder_name", F.element_at(parts, F.col("at"))).withColumn("part", F.element_at(parts, F.col("at") + 1)).withColumn("below", F.size(parts) - F.col("at"))
    counts = [F.count_if((F.col("part") == p) & (F.col("below") == 2)).alias(p) for p in PARTS]
    rows = held.groupBy("folder_name").agg(*counts, F.max("mtime").alias("last_modified"))
    own = docs.where("name = 'dataset.json'").withColumn("folder_name", F.regexp_extract("folder", r"([^/]+)$", 1))
    names = F.filter(F.map_keys(F.from_json(F.get_json_object("text", "$.labels"), "map<string,string>")), lambda n: n != "background")
    own = own.select("folder_name", _get("name"), _get("file_ending"), _get("description"), F.size(names).alias("n_labels"), F.slice(names, 1, 16).alias("label_names_preview"), F.lit(True).alias("described"))
    delivery = docs.withColumn("folder_name", F.regexp_extract("name", r"^nnUNet_delivery_(.*?)(?:\.status)?\.json$", 1)).where("folder_name <> ''").withColumn("is_status", F.col("name").endswith(".status.json"))
    delivery = delivery.groupBy("folder_name").agg(
        F.max(F.when(~F.col("is_status"), F.col("path"))).alias("delivery_report"), F.max(F.when(F.col("is_status"), F.get_json_object("text", "$.status"))).alias("delivery_status"),
        F.max(F.when(~F.col("is_status"), F.get_json_object("text", "$.task"))).alias("task"),
    )
    quality = reports.select(F.col("report_key").alias("folder_name"), F.col("status").alias("qc_status"), F.col("path").alias("qc_report"))
    some = F.coalesce("described", F.lit(False)) | (sum((F.col(p) for p in PARTS), F.lit(0)) > 0)  # results have such folders too
    out = rows.join(own, "folder_name", "left").where(some).join(delivery, "folder_name", "left").join(quality, "folder_name", "left")
    ready = F.coalesce("described", F.lit(False)) & (F.col("imagesTr") > 0) & (F.col("labelsTr") > 0)
    return out.select(dataset_number(F.col("folder_name")).alias("dataset_id"), *[c for c in out.columns if c != "described"], ready.alias("ready"))


def models(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """Model files (by name, with the dataset that their path names) and models that run summaries name."""
    number = F.regexp_extract("rel_path", r"Dataset(\d{3})_", 1).try_cast("int")
    fields = {"model_name": F.regexp_replace("name", r"\.[^.]*$", ""), "task_id": F.lit(None).cast("string"), "mean_dice": F.lit(None).cast("double"), "test_mean_dice": F.lit(None).cast("double")}
    found = listed.where(F.col("name").isin(*MODEL_FILES)).select(
        F.lit("artifact").alias("source"), number.alias("dataset_id"), F.col("path").alias("model_path"), F.lit("completed").alias("status"), *[v.alias(k) for k, v in fields.items()], F.col("mtime").alias("last_modified")
    )
    get = lambda p, kind="string": F.get_json_object("text", f"$.{p}").try_cast(kind)
    path = F.coalesce(get("best_model_export_path"), get("best_model.best_model_path"))
    named = docs.where(F.col("name") == "run_summary.json").select(
        F.lit("workspace").alias("source"), F.regexp_extract(path, r"Dataset(\d{3})_", 1).try_cast("int").alias("dataset_id"), path.alias("model_path"), F.coalesce(get("best_model.status"), F.lit("completed")).alias("status"),
        get("best_model.model_name").alias("model_name"), get("best_model.task_id").alias("task_id"), get("best_model.metrics.mean_dice", "double").alias("mean_dice"), get("inference.mean_dice", "double").alias("test_mean_dice"),
        F.col("mtime").alias("last_modified"),
    )
    return found.unionByName(named.where("model_path <> ''"))


def task_runs(docs: DataFrame) -> DataFrame:
    """Runs with their launcher's status by workspace, finished runs by their summaries, and dataset exports."""
    workspace = F.regexp_extract("folder", r"([^/]+)$", 1)
    launcher = docs.where("name = 'launcher_status.json'").select("folder", _get("status").alias("launcher_status"), _get("pid", "long").alias("launcher_pid"))
    run = docs.where("name = 'run_status.json'").join(launcher, "folder", "left").select(
        F.lit("experimentation_run").alias("kind"), workspace.alias("run_id"), _get("status"), _get("stage"), _get("task_id"), _get("dataset_root"), _get("completed_trials", "int"), _get("max_trials", "int"), "path", _get("updated_at"),
        _get("error"), "launcher_status", "launcher_pid",
    )
    time = F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("updated_at")
    summary = docs.where("name = 'run_summary.json'").select(
        F.lit("experimentation_summary").alias("kind"), workspace.alias("run_id"), F.lit("completed").alias("status"), F.lit("completed").alias("stage"), _get("best_model.task_id"),
        F.get_json_object("text", "$.dataset_info.root").alias("dataset_root"), "path", time,
    )
    export = docs.where(F.col("name").rlike(r"^nnUNet_delivery_.*\.status\.json$")).select(
        F.lit("dataset_export").alias("kind"), F.regexp_replace("name", r"\.status\.json$", "").alias("run_id"), _get("status"), _get("stage"), _get("task").alias("task_id"), _get("dataset_root"), "path", _get("updated_at")
    )
    return run.unionByName(summary, allowMissingColumns=True).unionByName(export, allowMissingColumns=True)


def lineage_links(dataset_rows: DataFrame, model_rows: DataFrame) -> DataFrame:
    """(dataset_id, dataset_folder, model_path, model_source) of models whose dataset is known."""
    known = dataset_rows.where("dataset_id IS NOT NULL").groupBy("dataset_id").agg(F.max("folder_name").alias("dataset_folder"))
    return model_rows.join(known, "dataset_id").select("dataset_id", "dataset_folder", "model_path", F.col("source").alias("model_source"))


def overview(tables: dict[str, DataFrame], most: int = 20) -> str:
    """A page with the numbers of all registries and the first ``most`` rows of what needs a look; the tables hold all."""
    n = {k: t.count() for k, t in tables.items()}
    runs = tables["task_runs"]
    count = lambda df, status: df.where(F.col("status") == status).count()
    lines = [
        "# Registry overview", "", f"- Available datasets: {n['datasets']}", f"- Known models: {n['models']}", f"- QC reports: {n['dataset_qc_reports']}", f"- QC failures: {count(tables['dataset_qc_reports'], 'fail')}",
        f"- Running tasks: {count(runs, 'running')}", f"- Failed tasks: {count(runs, 'failed')}",
    ]

    def section(title: str, df: DataFrame, order: str, columns: tuple[str, ...]) -> None:
        rows = df.orderBy(order).limit(most + 1).collect()
        lines.extend(["", f"## {title}", ""])
        lines.extend("- " + " | ".join(f"{c}={r[c]}" for c in columns) for r in rows[:most])
        lines.append("- None" if not rows else f"- ... of {df.count()}, see the table" if len(rows) > most else "")

    section("Datasets", tables["datasets"], "folder_name", ("folder_name", "dataset_id", "n_labels", "imagesTr", "imagesTs", "ready", "qc_status"))
    section("Dataset QC", tables["dataset_qc_reports"], "report_key", ("report_key", "status", "error_count", "warning_count"))
    section("Models", tables["models"].where("status = 'completed'"), "model_path", ("model_path", "source", "test_mean_dice"))
    section("Running tasks", runs.where("status = 'running'"), "run_id", ("kind", "run_id", "stage", "updated_at"))
    section("Failed tasks", runs.where("status = 'failed'"), "run_id", ("kind", "run_id", "error"))
    return "\n".join(lines).rstrip("\n") + "\n"


def refresh(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All registries of the artifacts below ``root``, by name."""
    listed, docs = files.tree(spark, root), documents(spark, root)
    reports = quality_reports(docs)
    known, found = datasets(listed, docs, reports), models(listed, docs)
    return {"dataset_qc_reports": reports, "datasets": known, "models": found, "task_runs": task_runs(docs), "lineage": lineage_links(known, found)}


def write_registry(tables: dict[str, DataFrame], target: str) -> None:
    """Each table as a folder of JSON lines, and the overview beside them."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{target}/{name}")
    exports.put(f"{target}/overview.md", overview(tables))


def data_card(assets: DataFrame, manifest_id: str, dataset_id: str | None = None) -> dict:
    """Aggregate facts of a package (split, case_id, kind, status, shape, label_values, patient_id), without a name of a case or patient.

    Its ``card_sha256`` is the hash of the rest in canonical form.
    """
    by = assets.groupBy("split").agg(F.count_if(F.col("kind") == "image").alias("image_count"), F.count_if(F.col("kind") == "mask").alias("mask_count")).orderBy("split").collect()
    of = lambda kind, name: assets.where(F.col("kind") == kind).groupBy("split", "case_id").agg(F.max("shape").alias(name))
    differ = of("image", "a").join(of("mask", "b"), ["split", "case_id"]).where(~F.col("a").eqNullSafe(F.col("b"))).count()
    values = assets.where("kind = 'mask'").select(F.explode("label_values").alias("v")).agg(F.array_sort(F.collect_set("v")).alias("v")).first()["v"]  # at most 256 values a raster type
    patients = assets.where("patient_id IS NOT NULL").groupBy("patient_id").agg(F.countDistinct("split").alias("n"))
    known, across = patients.count(), patients.where("n > 1").count()
    card = {
        "manifest_id": manifest_id, "data_card_id": f"manifest:{manifest_id}", "dataset_id": dataset_id or f"manifest:{manifest_id}", "image_type": "2d_raster",
        "annotation_description": "pixel masks" if any(r["mask_count"] for r in by) else "no pixel masks observed", "label_values_observed": values or [],
        "split_summary": {r["split"]: {"image_count": r["image_count"], "mask_count": r["mask_count"]} for r in by}, "image_mask_shape_mismatch_count": differ,
        "unreadable_file_count": assets.where("status <> 'ok' OR status IS NULL").count(), "patient_split_check": "not_available" if not known else "fail" if across else "pass", "known_missing_information": [],
    }
    return card | {"card_sha256": canonical_json_sha256(card)}
