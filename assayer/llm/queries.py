"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import sql
from assayer.llm._work import shared_dir, ship
from assayer.llm.decontaminate import decontaminate
from assayer.llm.licenses import license_scan
from assayer.llm.ngram import score_documents
from assayer.llm.packing import pack
from assayer.llm.pages import main_text
from assayer.llm.passages import repeated_passages
from assayer.llm.pii import personal_data, span_report
from assayer.llm.quality import RULES, plan_cascade, quality_report
from assayer.llm.search import ranked_search
from assayer.llm.secrets import secret_findings
from assayer.llm.setjoin import jaccard_classes
from assayer.llm.sharding import balanced_shards
from assayer.llm.upsert import file_report, upsert, write_sorted


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["start"], F.lit(":"), x["stop"])), ",")
    return found.withColumn("spans", spans).drop("items")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(personal_data(_table(spark, sf_dir, "documents")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_report(docs, plan_cascade(docs, RULES))


def op8_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op9_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op11_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, changes = _table(spark, sf_dir, "clients"), _table(spark, sf_dir, "client_changes")
    crc = lambda c: F.crc32(c.cast("string").cast("binary"))
    folder = f"{shared_dir(spark)}/clients-{uuid.uuid4().hex}"
    base = write_sorted(clients.where(crc(F.col("client_id")) % 7 > 3), "client_id", 1 + clients.count() // 700, folder)

    def action(change: Column, first: Column) -> Column:
        h = crc(first) % 12
        return F.when(h > 7, "ignore").when((change["op"] == "D") | (crc(change["change_id"]) % 8 < h), "delete").otherwise("set")

    upsert(base, changes, ["seq", "change_id"], ["source", "segment", "city", "balance"], action)
    cents = F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0))
    parts = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "segment", "city")])
    return file_report(spark, base, cents, crc(parts))


def op12_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op13_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_mixture_packing": op3_mixture_packing,
    "op4_license_sentences": op4_license_sentences,
    "op5_secret_forest": op5_secret_forest,
    "op6_personal_data": op6_personal_data,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_scores": op8_ngram_scores,
    "op9_sampled_splitter_shards": op9_sampled_splitter_shards,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_keyed_upsert": op11_keyed_upsert,
    "op12_tag_path_text": op12_tag_path_text,
    "op13_wand_search": op13_wand_search,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_sentences": sql.license_sentences(),
    "op7_quality_rules": sql.QUALITY_RULES,
    "op13_wand_search": sql.RANKED_SEARCH,
}
