"""JSON documents, JSON lines and annotation formats."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import jsonblocks

BOX_ITEMS = "array<struct<`External ID`:string,Label:struct<objects:array<struct<title:string,`bounding box`:array<double>,polygons:array<array<array<double>>>>>>>>"
COCO = "struct<images:array<struct<id:bigint,file_name:string>>,annotations:array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>,categories:array<struct<id:bigint,name:string>>>"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Whole-file JSON documents; strict reading refuses NaN and Infinity and malformed files."""
    reader = spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", not strict)
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines: a malformed line fails the read, or is dropped where reading is tolerant."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def optional_field(document: Column, name: str, kind: str) -> Column:
    """A field of an optional JSON object: null where the document is missing, no JSON, no object, or holds no such value."""
    whole = F.when(F.ltrim(document).startswith("{"), document)
    return F.get_json_object(whole, f"$.{name}").try_cast(kind)


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sniff(text: Column, path: Column) -> Column:
    """Annotation format from the first 4096 characters and the name."""
    head, name = F.left(text, F.lit(4096)), F.lower(path)
    return (
        F.when(head.contains('"External ID"') | head.contains('"bounding box"'), "box_list")
        .when(head.contains('"annotations"') & head.contains('"images"') | name.contains("coco"), "coco")
        .when(head.contains('"shapes"'), "shapes").when(head.rlike(r"^\s*[\[{]"), "json").otherwise("unknown")
    )


def box_annotations(documents: DataFrame, text: str = "text", polygons: bool = False) -> DataFrame:
    """Boxes (exactly four coordinates) and, if asked for, polygons by case; the last item of a case wins."""
    items = documents.select(F.posexplode(F.from_json(text, BOX_ITEMS)).alias("pos", "item"))
    case = F.regexp_replace(F.col("item")["External ID"], r"\.[^.]*$", "")
    last = items.groupBy(case.alias("case_id")).agg(F.max_by("item", "pos").alias("item"))
    objects = F.coalesce(F.col("item.Label.objects"), F.array())
    boxes = F.transform(F.filter(objects, lambda o: F.size(o["bounding box"]) == 4), lambda o: F.struct(o["title"].alias("label"), o["bounding box"].alias("bbox_xyxy")))
    out = [F.col("case_id"), boxes.alias("bbox_annotations")]
    if polygons:
        rings = F.filter(objects, lambda o: F.size(o["polygons"]) > 0)
        out.append(F.transform(rings, lambda o: F.struct(o["title"].alias("label"), o["polygons"].alias("polygons"))).alias("polygon_annotations"))
    return last.select(*out)


def coco_annotations(documents: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Corner boxes of COCO documents; a category without a name is called by its id, a missing box is zeros.

    A row is a document with all its images and categories, so annotations meet theirs where the document is read, by hash joins of Arrow batches.
    Equal texts count once, unless a ``key`` tells them apart.
    """

    def entries(lists: pa.Array, *fields: str) -> tuple[pa.Array, ...]:
        of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        items = lists.flatten()
        return pa.array(of, pa.int64()), pa.array(np.arange(len(items)), pa.int64()), *(pc.struct_field(items, f) for f in fields)

    def met(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, nth, image, category, box = entries(batch.column(0), "image_id", "category_id", "bbox")
        i_doc, i_nth, i_id, files = entries(batch.column(1), "id", "file_name")
        k_doc, k_nth, k_id, names = entries(batch.column(2), "id", "name")
        j = pa.table([doc, nth, image, category], names=["doc", "nth", "image", "category"])
        j = j.join(pa.table([i_doc, i_id, i_nth], names=["doc", "image", "i"]), ["doc", "image"], join_type="inner", use_threads=False)
        j = j.join(pa.table([k_doc, k_id, k_nth], names=["doc", "category", "k"]), ["doc", "category"], join_type="left outer", use_threads=False)
        j = {c: j[c].combine_chunks() for c in ("i", "k", "category", "nth")}
        return pa.RecordBatch.from_arrays([files.take(j["i"]), names.take(j["k"]), j["category"], box.take(j["nth"])], names=["file_name", "name", "category_id", "bbox"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield met(batch.slice(at, 4096))

    d = documents.select(text) if key else documents.select(text).distinct()
    c = d.select(F.from_json(text, COCO).alias("c")).select("c.annotations", "c.images", "c.categories")
    j = c.mapInArrow(run, "file_name string, name string, category_id long, bbox array<double>")
    b = F.coalesce("bbox", F.array(*[F.lit(0.0)] * 4))
    box = F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])
    return j.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("case_id"), F.coalesce("name", F.col("category_id").cast("string")).alias("label"), box.alias("bbox_xyxy"))


def label_schema(document: Column) -> Column:
    """Label values of a dataset description in either form (name to value, value to name); 0 is always one."""
    m = F.from_json(document, "map<string,string>")
    numbers = F.concat(F.transform(F.map_keys(m), lambda x: x.try_cast("int")), F.transform(F.map_values(m), lambda x: x.try_cast("int")))
    return F.array_sort(F.array_distinct(F.concat(F.filter(numbers, lambda x: x.isNotNull()), F.array(F.lit(0)))))


def json_blocks(text: str | None) -> list[str]:
    """Top-level JSON objects inside free text, by balanced braces outside strings."""
    return jsonblocks.blocks(pa.array([text], pa.string()))[0].as_py()


def split_json_blocks(text: Column) -> Column:
    """Braces cannot be balanced by a regular expression: one Arrow-batched function."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return jsonblocks.blocks(texts)

    return run(text)


def json_objects(df: DataFrame, text: str) -> DataFrame:
    """A row for each object inside ``text``: the columns of ``df``, ``nth`` (from 0) and ``object``; texts without any have no row."""
    return df.select("*", F.posexplode(split_json_blocks(F.col(text))).alias("nth", "object"))


def model_output(text: Column) -> Column:
    """The object in a model's output: terminal colours removed, text before the first brace dropped, one nesting of result payloads undone."""
    clean = F.regexp_replace(text, r"\x1b\[[0-9;]*[A-Za-z]", "")
    body = F.regexp_extract(clean, r"(?s)(\{.*)", 1)
    return F.coalesce(F.get_json_object(body, "$.result.payloads[0].text"), body)


def canonical_json_sha256(value: object) -> str:
    """Key-sorted JSON hash, which Spark's writer cannot give."""
    import hashlib

    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def with_canonical_hash(df: DataFrame, column: str, name: str = "canonical_sha256") -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: canonical_json_sha256(json.loads(x)) if x else None)

    return df.withColumn(name, F.pandas_udf(run, "string", functionType=F.PandasUDFType.SCALAR_ITER)(F.col(column)))
