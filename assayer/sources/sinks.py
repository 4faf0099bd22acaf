"""Writers: JSON, JSON lines, CSV, layouts and manifests. Large tables stay distributed; one-document reports are written by the driver."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.splits import numbered


def write_json(document: object, path: str) -> None:
    """A small document, written beside its place and then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2, default=str, allow_nan=False)
    os.replace(f.name, target)


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("errorifexists").json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_report_csv(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A bounded report for spreadsheets (UTF-8 with a byte order mark); more rows than ``most`` are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_csv")
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows(rows)
    return len(rows)


def report_markdown(title: str, counts: DataFrame, found: DataFrame, most: int = 20, most_counts: int = 200) -> str:
    """Counts and the first issues in a fixed order; what is left out is said."""
    lines = [f"# {title}", "", "| " + " | ".join(counts.columns) + " |", "|" + "---|" * len(counts.columns)]
    shown = counts.orderBy(*counts.columns).limit(most_counts + 1).collect()
    lines += ["| " + " | ".join(str(v) for v in r) + " |" for r in shown[:most_counts]]
    if len(shown) > most_counts:
        lines += ["", f"The first {most_counts} of {counts.count()} counts."]
    lines += ["", "## Issues", ""]
    lines += [f"- **{r['severity']}** {r['type']} ({r['case_id']}): {r['message']}" for r in found.orderBy(F.desc("severity"), "type", "case_id").limit(most).collect()]
    n = found.count()
    lines += ["", f"The first {most} of {n} issues."] if n > most else []
    return "\n".join(lines) + "\n"


def placed(assets: DataFrame, root: str, case: str = "case_id", role: str = "role", path: str = "path") -> DataFrame:
    """The manifest of a canonical package: every asset's place under its role's folder."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return assets.withColumn("target", F.concat_ws("/", F.lit(root.rstrip("/")), F.col(role), F.concat_ws("_", F.col(case), name)))


def place_files(manifest: DataFrame, how: str = "copy") -> None:
    """Copies or links the manifest's files, in parallel; targets are replaced."""

    def run(rows: Iterable) -> None:
        import shutil

        for r in rows:
            os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
            if os.path.lexists(r["target"]):
                os.remove(r["target"])
            {"copy": shutil.copyfile, "symlink": os.symlink, "hardlink": os.link}[how](r["path"], r["target"])

    manifest.select("path", "target").foreachPartition(run)


def segmentation_manifest(cases: DataFrame, splits: DataFrame, role: str) -> DataFrame:
    """One image and one label of a role for each case with a split; the first label by path."""
    from pyspark.sql import Window

    labels = cases.select("case_id", "image", F.explode("labels").alias("l")).where(F.col("l.role") == role)
    first = F.row_number().over(Window.partitionBy("case_id").orderBy("l.path"))
    rows = labels.withColumn("r_", first).where("r_ = 1").join(splits, "case_id")
    folder = F.when(F.col("split") == "train", "Tr").when(F.col("split") == "val", "Val").otherwise("Ts")
    return rows.select("case_id", "split", F.col("image").alias("image_path"), F.col("l.path").alias("label_path"), F.concat(F.lit("images"), folder, F.lit("/"), "case_id", F.lit("_0000.png")).alias("image_target"), F.concat(F.lit("labels"), folder, F.lit("/"), "case_id", F.lit(".png")).alias("label_target"))


def coco_tables(boxes: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of a detection export: ids from 1 in each split, areas, category ids by label order."""
    from pyspark.sql import Window

    img = numbered(images, "split", ["case_id"], "image_id")
    labels = boxes.select("label").distinct()
    numeric = F.col("label").try_cast("int")
    top = labels.agg(F.coalesce(F.max(numeric), F.lit(0)).alias("top"))
    text = labels.where(numeric.isNull()).withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label"))).crossJoin(F.broadcast(top))  # labels are few; one row
    categories = labels.where(numeric.isNotNull()).select("label", numeric.alias("category_id")).union(text.select("label", (F.col("top") + F.col("n")).cast("int")))
    b = F.col("bbox_xyxy")
    joined = boxes.join(img.select("case_id", "split", "image_id"), "case_id").join(categories, "label")
    annotations = joined.select("split", "image_id", "category_id", F.array(b[0], b[1], b[2] - b[0], b[3] - b[1]).alias("bbox"), ((b[2] - b[0]) * (b[3] - b[1])).alias("area"))
    annotations = numbered(annotations, "split", ["image_id", "category_id", "bbox"], "annotation_id")
    return img, annotations, categories


def yolo_line(class_id: Column, box: Column, width: Column, height: Column) -> Column:
    return F.format_string("%d %.8f %.8f %.8f %.8f", class_id, (box[0] + box[2]) / 2 / width, (box[1] + box[3]) / 2 / height, (box[2] - box[0]) / width, (box[3] - box[1]) / height)


def write_by_case(lines: DataFrame, path: str) -> None:
    lines.write.partitionBy("case_id").text(path)


def verified(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Bindings whose file is missing or has other bytes: an empty result permits the delivery."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    return bindings.join(actual, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("actual")))


def yolo_files(boxes: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A detection export as a table of files for ``exports.export``, and its audit by split.

    ``images`` (split, case_id, path, width, height), ``boxes`` (split, case_id, class_id, bbox_xyxy; classes from 0). Every image gets a text of its
    boxes, one a line by class and place, clipped to the image; boxes without an area inside it are left out and counted, as are boxes of no image.
    """
    key = ["split", "case_id"]
    x1, y1, x2, y2 = (F.col("bbox_xyxy")[i] for i in range(4))
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.col(most).cast("double"))
    box = F.array(cut(x1, "width"), cut(y1, "height"), cut(x2, "width"), cut(y2, "height"))
    met = boxes.join(images.select(*key, "width", "height"), key, "left").withColumn("box_", box)
    ok = F.coalesce(F.col("width").isNotNull() & (F.col("box_")[2] > F.col("box_")[0]) & (F.col("box_")[3] > F.col("box_")[1]) & (F.size("bbox_xyxy") == 4), F.lit(False))
    lines = met.where(ok).select(*key, yolo_line(F.col("class_id").cast("int"), F.col("box_"), F.col("width"), F.col("height")).alias("line"))
    text = lines.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))  # an image's boxes
    end = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    about = lambda kind: F.to_json(F.struct("split", "case_id", F.lit(kind).alias("kind")))
    copies = images.select(F.concat(F.lit("images/"), "split", F.lit("/"), "case_id", end).alias("target"), F.col("path").alias("source"), F.lit(None).cast("binary").alias("content"), about("image").alias("about"))
    labels = images.join(text, key, "left").select(
        F.concat(F.lit("labels/"), "split", F.lit("/"), "case_id", F.lit(".txt")).alias("target"), F.lit(None).cast("string").alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), about("label").alias("about")
    )
    counts = images.groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    audit = met.groupBy("split").agg(F.count_if(ok).alias("boxes"), F.count_if(~ok & F.col("width").isNotNull()).alias("without_area"), F.count_if(F.col("width").isNull()).alias("without_image"))
    return copies.unionByName(labels), counts.join(audit, "split", "full_outer").na.fill(0)


def yolo_description(names: list[str], splits: Iterable[str]) -> str:
    """The ``data.yaml`` of a detection export; names are few and quoted as JSON, which YAML reads."""
    parts = "".join(f"{s}: images/{s}\n" for s in splits)
    return f"path: .\n{parts}nc: {len(names)}\nnames: {json.dumps(names, ensure_ascii=False)}\n"
