"""Corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's ``docs``. All stages but the last return the columns of ``docs``.

Rows are told apart by id and text, so ids may repeat with different texts or be null. Null and
empty texts have no words and are rejected by the first stage; later stages keep them where they
get them. Very long texts are taken as a whole, equal rows tie and one of them stays, extra columns
are carried along, and an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._work import materialise
from assayer.llm.decontaminate import decontaminate
from assayer.llm.packing import pack
from assayer.llm.pii import personal_data, redact
from assayer.llm.quality import RULES, apply_cascade, plan_cascade
from assayer.llm.setjoin import jaccard_classes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return apply_cascade(docs, plan_cascade(docs, RULES), flag="kept_by_rules").where("kept_by_rules").select(*docs.columns)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_name``: the id (in its order) and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(text, F.lit(1))))
    return docs.withColumn("row_name", name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id."""
    rows = _named(docs)
    first = jaccard_classes(rows, key="row_name").where("row_name = component_id").select("row_name").distinct()
    return rows.join(first, "row_name", "left_semi").dropDuplicates(["row_name"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves: hit words are under 1/20 of all."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _named(docs)
    bad = decontaminate(rows, benchmark, key="row_name").where("contaminated").select("row_name").distinct()
    return rows.join(bad, "row_name", "left_anti").select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and n_chars made to fit."""
    found = personal_data(docs, carry=tuple(docs.columns))
    old = F.col("carried.text")
    text = F.when(F.size("spans") == 0, old).otherwise(redact(old, F.col("spans")))
    out = found.select("carried", text.alias("new_text"))
    made = {"text": F.col("new_text"), "n_chars": F.coalesce(F.length("new_text").cast("long"), F.col("carried.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(made[c] if c in made else F.col("carried")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens in the sources' proportions."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("personal_data", personal),
    ("packing", packing),
]

#: SQL expresses neither the trained span classifier nor the tokenizer; tests/llm holds the stages against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
