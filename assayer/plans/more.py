"""Further operators as queries: set algebra, issue counts, ordered folds, upserts, sampling, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import audits, cohort, dedup, metrics, registry, splits
from assayer.operators.rules import Rule, issue_counts, issues
from assayer.plans.curation import _SPLIT, _split, query


@query(f"""
WITH s AS (SELECT DISTINCT {_SPLIT} AS split, sha1(text) AS case_id FROM documents)
SELECT case_id, 'train-val' AS pair FROM s WHERE split = 'train' AND case_id IN (SELECT case_id FROM s WHERE split = 'val')
UNION ALL SELECT case_id, 'train-test' FROM s WHERE split = 'train' AND case_id IN (SELECT case_id FROM s WHERE split = 'test')""")
def split_overlap(t) -> DataFrame:
    return dedup.split_overlap(t("documents").select(_split().alias("split"), F.sha1(F.col("text").cast("binary")).alias("case_id")))


@query("""
WITH i AS (SELECT 'price' AS category, 'error' AS severity FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'price', 'warning' FROM orders WHERE o_totalprice < 2000
 UNION ALL SELECT 'status', 'warning' FROM orders WHERE o_orderstatus = 'P')
SELECT category, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
 CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'review' ELSE 'pass' END AS status FROM i GROUP BY category""")
def issue_category_counts(t) -> DataFrame:
    rules = [Rule("large", "error", "price", F.col("o_totalprice") > 400000), Rule("small", "warning", "price", F.col("o_totalprice") < 2000), Rule("pending", "warning", "status", F.col("o_orderstatus") == "P")]
    return issue_counts(issues(t("orders"), rules, "o_orderkey"))


@query("""
WITH old AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, lower(c_name) AS name, 'NEW' AS segment FROM customer WHERE c_custkey % 2 = 0)
SELECT k, coalesce(new.name, old.name) AS name, coalesce(old.segment, new.segment) AS segment FROM old FULL OUTER JOIN new USING (k)""")
def registry_upsert(t) -> DataFrame:
    c = t("customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lower("c_name").alias("name"), F.lit("NEW").alias("segment"))
    return registry.upsert(old, new, "k", keep=("segment",))


@query("""
SELECT user_id, event_type, n, triggers FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2)
JOIN (SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS triggers FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1, 2) USING (user_id, event_type)""")
def discovery_counter(t) -> DataFrame:
    e = t("events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("asset"), "event_id")
    d = registry.discoveries(e, "asset", "event_id")
    part = F.split("asset", r"\|")
    return d.select(part[0].cast("long").alias("user_id"), part[1].alias("event_type"), "n", F.array_join(F.transform("triggers", lambda x: x.cast("string")), ",").alias("triggers"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY sha1('42|' || doc_id), doc_id LIMIT 50)")
def cohort_sample(t) -> DataFrame:
    return splits.hash_sample(t("documents").select("doc_id"), "doc_id", 50)


@query("""
SELECT p_partkey, p_brand, nth FROM (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_partkey) AS nth FROM part
 WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)) WHERE nth <= 3""")
def next_candidates(t) -> DataFrame:
    seen = t("part").where("p_size > 49")
    first = registry.unseen_candidates(t("part").select("p_partkey", "p_brand"), seen, "p_brand", "p_partkey", 3)
    rows = first.agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_brand"))).alias("a")).select(F.posexplode("a").alias("i", "x"))  # three rows
    return rows.select("x.p_partkey", "x.p_brand", (F.col("i") + 1).cast("long").alias("nth"))


@query("""
WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS axis FROM embeddings),
q AS (SELECT axis, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM a GROUP BY axis)
SELECT vec_id, round(avg(abs(v - q2) / greatest(q3 - q1, 1e-9)), 6) AS score FROM a JOIN q USING (axis) GROUP BY vec_id""")
def anomaly_scores(t) -> DataFrame:
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return cohort.robust_distance(e, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("""
SELECT round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS baseline, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS platform,
 round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS difference FROM orders""")
def baseline_difference(t) -> DataFrame:
    out = metrics.mean_difference(t("orders"), "o_orderstatus", "o_totalprice", "F", "O")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("""
WITH e AS (SELECT user_id, event_id, floor(value) / 8 AS dice, CAST(event_id % 7 AS DOUBLE) AS hd95 FROM events),
m AS (SELECT user_id, max(dice) AS dice FROM e GROUP BY 1), h AS (SELECT e.user_id, e.dice, min(hd95) AS hd95 FROM e JOIN m ON e.user_id = m.user_id AND e.dice = m.dice GROUP BY 1, 2)
SELECT e.user_id, min(event_id) AS best_epoch, e.dice AS best_dice, e.hd95 AS best_hd95 FROM e JOIN h ON e.user_id = h.user_id AND e.dice = h.dice AND e.hd95 = h.hd95 GROUP BY 1, 3, 4""")
def best_epoch(t) -> DataFrame:
    e = t("events").select("user_id", "event_id", (F.floor("value") / 8).alias("dice"), (F.col("event_id") % 7).cast("double").alias("hd95"))
    return registry.best_epoch(e, "user_id", "event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1")
def first_turns(t) -> DataFrame:
    return audits.first_file(t("conversations"), ["conv_id", "role"], "turn").select("conv_id", "turn", "role")


@query("SELECT greatest(coalesce(max(s_suppkey) + 1, 500), 500) AS next_id FROM supplier")
def next_dataset_id(t) -> DataFrame:
    return registry.next_id(t("supplier"), "s_suppkey", 500)


@query("""
SELECT d.doc_id, CAST(coalesce(len(a.bag), 0) AS BIGINT) AS n_annotations FROM documents d LEFT JOIN (SELECT doc_id, list(x) AS bag FROM
 (SELECT doc_id, 'q' || quality AS x FROM labels UNION ALL SELECT doc_id, 't' || toxic FROM labels WHERE toxic = 1) GROUP BY doc_id) a ON a.doc_id = d.doc_id""")
def annotation_linker(t) -> DataFrame:
    l = t("labels")
    sources = [l.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("annotation")), l.where("toxic = 1").select("doc_id", F.concat(F.lit("t"), F.col("toxic").cast("string")).alias("annotation"))]
    return registry.annotated(t("documents").select("doc_id"), sources, "doc_id").select("doc_id", F.size("annotations").cast("long").alias("n_annotations"))
