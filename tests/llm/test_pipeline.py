"""The pipeline stage by stage on the smallest tables."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm._work import materialise
from assayer.llm.decontaminate import decontaminate
from assayer.llm.pii import personal_data, span_report
from assayer.llm.quality import quality_report
from assayer.llm.setjoin import jaccard_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    one = materialise(stages["quality_rules"](spark, docs, SF), "t")
    assert one.columns == docs.columns and ids(one) == ids(quality_report(docs).where("kept"))
    two = materialise(stages["ngram_jaccard_join"](spark, one, SF), "t")
    assert two.columns == docs.columns and ids(two) == ids(jaccard_classes(one).where("doc_id = component_id"))
    three = materialise(stages["benchmark_decontamination"](spark, two, SF), "t")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(three) == ids(decontaminate(two, bench).where("not contaminated"))
    four = materialise(stages["personal_data"](spark, three, SF), "t")
    assert four.columns == docs.columns and ids(four) == ids(three)
    left = span_report(personal_data(four))
    assert left.agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    five = stages["packing"](spark, four, SF)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == set(ids(four))


def test_stages_by_brute_force(spark, tmp_path):
    """Repeated and null ids, equal rows, extra columns and empty tables through the first three stages."""
    r = random.Random(3)
    w = lambda n: ["".join(r.choices("abcdefghijkl", k=7)) for _ in range(n)]
    bench, base = w(20), w(60)
    near = [*base[:-1], "other"]
    rows = [
        (1, " ".join(base), "a"), (2, " ".join(near), "b"), (2, " ".join(w(50)), "c"), (None, " ".join(w(40)), "d"), (None, " ".join(w(30) + bench), "e"),
        (5, " ".join(w(40)), "f"), (5, " ".join(w(30) + bench), "g"), (6, " ".join(w(45)), "h"), (6, None, "i"), (7, "", "j"), (8, "too few words", "k"), (9, "same line of words here now\n" * 30, "l"),
    ]
    rows.append(rows[7])
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    spark.createDataFrame([(1, " ".join(bench))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = lambda df: sorted(x["kept"] for x in df.collect())
    one = materialise(stages["quality_rules"](spark, docs, str(tmp_path)), "t")
    assert names(one) == ["a", "b", "c", "d", "e", "f", "g", "h", "h"]
    two = materialise(stages["ngram_jaccard_join"](spark, one, str(tmp_path)), "t")
    assert names(two) == ["a", "c", "d", "e", "f", "g", "h"]
    three = materialise(stages["benchmark_decontamination"](spark, two, str(tmp_path)), "t")
    assert names(three) == ["a", "c", "d", "f", "h"] and three.columns == docs.columns
    none = docs.limit(0)
    for name in ("quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "personal_data"):
        none = stages[name](spark, none, str(tmp_path))
        assert none.columns == docs.columns
    assert none.count() == 0
