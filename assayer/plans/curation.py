"""Curation, quality, evaluation and registry queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import audits, cohort, dedup, metrics, planner, records, registry, splits
from assayer.operators.rules import Rule, invalid_values, issues, row_status
from assayer.sources import documents, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return f

    return register


def _split(col: str = "doc_id"):
    return F.when(F.col(col) % 10 < 8, "train").when(F.col(col) % 10 == 8, "val").otherwise("test")


_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"


@query("""
WITH d AS (SELECT doc_id, text, n_chars, count(*) OVER (PARTITION BY sha1(text)) AS copies FROM documents),
j AS (SELECT d.*, quality, toxic, l.doc_id AS lid FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT CASE WHEN coalesce(n_chars < 50, false) OR coalesce(quality NOT IN (0, 1), false) THEN 'blocked'
  WHEN lid IS NULL OR coalesce(toxic = 1, false) OR copies > 1 THEN 'manual_review' ELSE 'ready' END AS status,
  CAST(coalesce(n_chars < 50, false) AS INT) + CAST(coalesce(quality NOT IN (0, 1), false) AS INT) + CAST(lid IS NULL AS INT)
  + CAST(coalesce(toxic = 1, false) AS INT) + CAST(copies > 1 AS INT) AS n FROM j)
SELECT status, count(*) AS n_cases, CAST(sum(n) AS BIGINT) AS n_issues FROM s GROUP BY status""")
def case_status_summary(t) -> DataFrame:
    """Which cases are ready, need review or are blocked."""
    docs = t("documents").select("doc_id", "n_chars", F.sha1(F.col("text").cast("binary")).alias("h"))
    copies = docs.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    cases = docs.join(t("labels").withColumn("labelled", F.lit(True)), "doc_id", "left").join(copies, "h", "left")
    rules = [
        Rule("empty_content", "error", "content", F.col("n_chars") < 50),
        Rule("invalid_label_value", "error", "label", ~F.col("quality").isin(0, 1)),
        Rule("missing_annotation", "warning", "pairing", F.col("labelled").isNull()),
        Rule("sensitive", "warning", "label", F.col("toxic") == 1),
        Rule("duplicate_content", "warning", "leakage", F.col("copies") > 1),
    ]
    status = row_status(cases, rules, "doc_id")
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n_issues").alias("n_issues"))


@query("""
SELECT coalesce(source, 'none') AS source, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS paired,
  count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS orphan
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def pairing_audit(t) -> DataFrame:
    d, l = t("documents").select("doc_id", "source", F.lit(1).alias("is_case")), t("labels").select("doc_id", F.lit(1).alias("is_label"))
    j = d.join(l, "doc_id", "full_outer")
    case, label = F.col("is_case").isNotNull(), F.col("is_label").isNotNull()
    return j.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count_if(case & label).alias("paired"), F.count_if(case & ~label).alias("missing"), F.count_if(~case & label).alias("orphan"))


@query("""
SELECT field, value, count(*) AS n, value NOT IN (0, 1) AS invalid FROM (
  SELECT 'quality' AS field, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) WHERE value IS NOT NULL GROUP BY ALL""")
def allowed_label_values(t) -> DataFrame:
    rows = t("labels").select(F.inline(F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").alias("value")), F.struct(F.lit("toxic").alias("field"), F.col("toxic").alias("value"))))).where("value is not null")
    return rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("invalid", F.size(invalid_values(F.array("value"), [0, 1])) > 0)


@query(r"""
WITH n AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(lang || ' ' || source || '_copy')), '(?:_copy|-copy|copy|duplicate|dup|aug|augment|flip|rot[0-9]+)$', ''), '[^a-z0-9]', '', 'g') AS token FROM documents)
SELECT token, count(*) AS n_members, min(doc_id) AS first_member FROM n WHERE token <> '' GROUP BY token HAVING count(*) > 1""")
def normalized_identifier_groups(t) -> DataFrame:
    from assayer.functions import case_token

    docs = t("documents").withColumn("token", case_token(F.concat("lang", F.lit(" "), "source", F.lit("_copy"))))
    return dedup.duplicate_groups(docs.where("token <> ''"), F.col("token"), "doc_id").select(F.col("key").alias("token"), "n_members", "first_member")


@query("""
SELECT sha1(text) AS hash, count(*) AS n_members, min(doc_id) AS first_member, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicate_groups(t) -> DataFrame:
    g = dedup.duplicate_groups(t("documents"), F.sha1(F.col("text").cast("binary")), "doc_id")
    return g.select(F.col("key").alias("hash"), "n_members", "first_member", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"""
WITH d AS (SELECT doc_id, sha1(text) AS h, {_SPLIT} AS split FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, first_value(split) OVER (PARTITION BY h ORDER BY doc_id) AS owner_split FROM d)
SELECT doc_id, split, owner_split, owner_case FROM (SELECT *, last_value(CASE WHEN split = owner_split THEN doc_id END IGNORE NULLS)
  OVER (PARTITION BY h ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner_case FROM o) WHERE split <> owner_split""")
def content_leakage(t) -> DataFrame:
    docs = t("documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"), _split().alias("split"))
    return dedup.content_leakage(docs, "h", "split", "doc_id", "doc_id").select("doc_id", "split", "owner_split", "owner_case")


@query("""
SELECT conv_id, count(*) AS n_changes FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
WHERE p <> role GROUP BY conv_id""")
def multi_split_cases(t) -> DataFrame:
    return dedup.split_changes(t("conversations").select("conv_id", "turn", "role"), "conv_id", "role", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_changes"))


@query(f"""
SELECT sha1(text) AS hash, count(DISTINCT {_SPLIT}) AS n_splits, count(*) AS n_rows FROM documents WHERE text IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT {_SPLIT}) > 1""")
def cross_split_hash(t) -> DataFrame:
    return dedup.cross_split(t("documents").withColumn("split", _split()), F.sha1(F.col("text").cast("binary")), "split").withColumnRenamed("key", "hash")


_BOUNDS = """q AS (SELECT {by}, count(*) AS n, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3 FROM {table} WHERE {x} IS NOT NULL GROUP BY {by}),
b AS (SELECT {by}, n, q2 AS median, CASE WHEN q3 - q1 <= 1e-6 THEN q2 - greatest(abs(q2) * 0.1, 1e-3) ELSE q1 - 3 * (q3 - q1) END AS lower,
 CASE WHEN q3 - q1 <= 1e-6 THEN q2 + greatest(abs(q2) * 0.1, 1e-3) ELSE q3 + 3 * (q3 - q1) END AS upper FROM q WHERE n >= 5)"""


@query(f"WITH {_BOUNDS.format(by='l_returnflag', x='l_extendedprice', table='lineitem')} SELECT l_returnflag, n, round(median, 6) AS median, round(lower, 6) AS lower, round(upper, 6) AS upper FROM b")
def robust_bounds(t) -> DataFrame:
    b = cohort.robust_bounds(t("lineitem"), F.col("l_extendedprice"), ["l_returnflag"])
    return b.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("median", "lower", "upper")])


@query(f"WITH {_BOUNDS.format(by='lang', x='CAST(n_chars AS DOUBLE)', table='documents')} SELECT doc_id, lang, n_chars, round(lower, 6) AS lower, round(upper, 6) AS upper FROM documents JOIN b USING (lang) WHERE n_chars < lower OR n_chars > upper")
def cohort_outliers(t) -> DataFrame:
    out = cohort.outliers(t("documents").select("doc_id", "lang", "n_chars"), F.col("n_chars"), ["lang"])
    return out.select("doc_id", "lang", "n_chars", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query("""
WITH a AS (SELECT unnest(embedding) AS v, unnest(range(0, len(embedding))) AS axis FROM embeddings)
SELECT CAST(axis AS INT) AS axis, count(*) AS n, round(quantile_cont(CAST(v AS DOUBLE), 0.5), 5) AS median, round(min(v)::DOUBLE, 5) AS least, round(max(v)::DOUBLE, 5) AS most FROM a GROUP BY axis""")
def axis_statistics(t) -> DataFrame:
    stats = cohort.exact_quantiles(cohort.axis_values(t("embeddings"), "vec_id", "embedding"), F.col("value"), ["axis"], (0.0, 0.5, 1.0))
    return stats.select("axis", "n", *[F.round(F.col("q")[i], 5).alias(name) for i, name in enumerate(("least", "median", "most"))])


@query(r"""
WITH s AS (SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/([^/]*)', 1) AS folder FROM pages)
SELECT folder, count(*) AS n FROM s GROUP BY folder ORDER BY n DESC, folder LIMIT 50""")
def suffix_inventory(t) -> DataFrame:
    folder = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]+/([^/]*)", 1)
    return files.frequent(t("pages").select(folder.alias("folder")), "folder")


@query("""
WITH p AS (SELECT source, doc_id // 1024 AS b, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text) || chr(10), '' ORDER BY doc_id)) AS line FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n_files, sha256(string_agg(line, '' ORDER BY b)) AS digest FROM p GROUP BY source""")
def directory_digest(t) -> DataFrame:
    return dedup.ordered_digest(t("documents").where("text is not null"), "source", "doc_id", F.col("text"))


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('42|' || doc_id)) AS rn, count(*) OVER () AS n FROM documents),
s AS (SELECT *, CASE WHEN rn <= round_even(n * 0.8, 0) THEN 'train' WHEN rn <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM r)
SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM s GROUP BY split""")
def deterministic_split(t) -> DataFrame:
    return splits.deterministic_split(t("documents").select("doc_id"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum"))


@query("SELECT lang, doc_id, CAST(nth AS INT) AS nth FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 10")
def balanced_sample(t) -> DataFrame:
    return splits.balanced_sample(t("documents").select("lang", "doc_id"), "lang", "doc_id", 10)


@query("""
WITH i AS (SELECT o_orderkey, o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS image_id FROM orders)
SELECT split, image_id, l_linenumber AS annotation_nr, p_type AS category, l_quantity * l_extendedprice AS area
FROM i JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""")
def coco_annotations(t) -> DataFrame:
    images = splits.sequential_ids(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), "split", "o_orderkey", "image_id")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    # one document an order: its lines are the annotations, with a box of quantity by price at the line's number
    j = lines.join(parts, "l_partkey").join(images, F.col("l_orderkey") == F.col("o_orderkey"))
    box = F.array(F.col("l_linenumber").cast("double"), F.lit(0.0), F.col("l_quantity"), F.col("l_extendedprice"))
    a = F.struct(F.col("l_linenumber").cast("long").alias("id"), F.col("image_id"), F.col("l_partkey").alias("category_id"), box.alias("bbox"))
    c = F.struct(F.col("l_partkey").alias("id"), F.col("p_type").alias("name"))
    docs = j.groupBy("o_orderkey", "split", "image_id").agg(F.collect_list(a).alias("annotations"), F.collect_set(c).alias("categories"))  # an order's lines
    image = F.array(F.struct(F.col("image_id").alias("id"), F.concat_ws("/", "split", F.col("image_id").cast("string")).alias("file_name")))
    text = docs.select("o_orderkey", F.to_json(F.struct(image.alias("images"), "annotations", "categories")).alias("text"))
    found = documents.coco_annotations(text, key="o_orderkey")
    part, b = F.split("case_id", "/"), F.col("bbox_xyxy")
    return found.select(part[0].alias("split"), part[1].cast("long").alias("image_id"), F.round(b[0]).cast("int").alias("annotation_nr"), F.col("label").alias("category"), ((F.round(b[2] - b[0])) * b[3]).alias("area"))


@query("""
WITH a AS (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS x, len(embedding) AS w FROM embeddings)
SELECT vec_id, label, CAST(min(x) AS INT) AS x1, CAST(max(x) + 1 AS INT) AS x2, round((min(x) + max(x) + 1) / 2.0 / max(w), 8) AS cx, round((max(x) + 1 - min(x)) * 1.0 / max(w), 8) AS bw FROM a WHERE v > 0 GROUP BY vec_id, label""")
def yolo_boxes(t) -> DataFrame:
    a = t("embeddings").select("vec_id", "label", F.size("embedding").alias("w"), F.posexplode("embedding").alias("x", "v")).where("v > 0")
    g = a.groupBy("vec_id", "label").agg(F.min("x").alias("x1"), (F.max("x") + 1).alias("x2"), F.max("w").alias("w"))
    return g.select("vec_id", "label", "x1", "x2", F.round((F.col("x1") + F.col("x2")) / 2.0 / F.col("w"), 8).alias("cx"), F.round((F.col("x2") - F.col("x1")) / F.col("w"), 8).alias("bw"))


@query("""
WITH c AS (SELECT c.c AS class_id, quality = c.c AS t, toxic = c.c AS p FROM labels, (SELECT unnest([0, 1]) AS c) c WHERE quality IS NOT NULL AND toxic IS NOT NULL),
g AS (SELECT class_id, count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM c GROUP BY 1)
SELECT class_id, tp, fp, fn, tn, round((2 * tp + 1e-5) / (2 * tp + fp + fn + 1e-5), 9) AS dice, round((tp + 1e-5) / (tp + fp + fn + 1e-5), 9) AS iou, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 9) AS accuracy FROM g""")
def confusion_metrics(t) -> DataFrame:
    out = metrics.confusion(t("labels"), "quality", "toxic", [0, 1])
    return out.select("class_id", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("dice", "iou", "accuracy")])


@query("""
SELECT user_id, event_type, n_votes FROM (SELECT user_id, event_type, count(*) AS n_votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
FROM events WHERE event_type IS NOT NULL GROUP BY user_id, event_type) WHERE r = 1""")
def majority_vote(t) -> DataFrame:
    return metrics.majority(t("events"), ["user_id"], "event_type")


@query("""
WITH v AS (SELECT l_returnflag, l_extendedprice AS x, floor(l_extendedprice / 10) * 10 AS y FROM lineitem),
g AS (SELECT l_returnflag, avg((x - y) * (x - y)) AS mse, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cov FROM v GROUP BY 1)
SELECT l_returnflag, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(255.0 * 255.0 / mse) END, 6) AS psnr,
 round(((2 * mx * my + 6.5025) * (2 * cov + 58.5225)) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)), 6) AS ssim FROM g""")
def psnr_ssim(t) -> DataFrame:
    x = F.col("l_extendedprice")
    out = metrics.psnr_ssim(t("lineitem"), ["l_returnflag"], x, F.floor(x / 10) * 10.0, 255.0)
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mse", "psnr", "ssim")])


@query("""
SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_trial(t) -> DataFrame:
    return registry.best_record(t("orders"), [F.col("o_totalprice")], "o_orderkey", ["o_orderpriority"]).select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS best_so_far FROM orders")
def running_best(t) -> DataFrame:
    best = records.best_so_far(t("orders"), "o_custkey", "o_orderkey", [F.col("o_totalprice")], "o_totalprice")
    return best.select("o_custkey", "o_orderkey", F.col("best").alias("best_so_far"))


@query("""
SELECT user_id, event_type, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value), 4) AS duration, round(avg(value), 6) AS mean_duration FROM events GROUP BY 1, 2""")
def trace_summary(t) -> DataFrame:
    e = t("events").select("user_id", "event_type", F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("value").alias("duration_ms"))
    out = registry.trace_totals(e, "user_id", "event_type")
    return out.select("user_id", "event_type", "total", "failed", F.round("duration_ms", 4).alias("duration"), F.round("mean_ms", 6).alias("mean_duration"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = p) AS repeats, count(*) AS n FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id""")
def consecutive_repeats(t) -> DataFrame:
    return records.consecutive_repeats(t("events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20")
def finding_topk(t) -> DataFrame:
    return audits.top_findings(t("events"), 20, "event_type", "event_id")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS parsed FROM events GROUP BY 1""")
def json_props(t) -> DataFrame:
    k = documents.optional_field(F.col("props"), "k", "long")
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.count(k).alias("parsed"))


@query("""
SELECT r_name, n_name, count(*) AS n_suppliers, round(sum(s_acctbal), 2) AS balance FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def lineage_join(t) -> DataFrame:
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("n_nationkey", "dataset_id")
    models = t("supplier").select(F.col("s_nationkey").alias("dataset_id"), F.col("s_suppkey").alias("model_id"), "s_acctbal")
    j = registry.lineage(models, places, keep=("r_name", "n_name", "s_acctbal"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""
SELECT p_brand, p_partkey, score FROM (SELECT p_brand, p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 20 ELSE 10 END AS score,
 row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_name LIKE '%ring%' THEN 20 ELSE 10 END DESC, p_partkey) AS r FROM part WHERE p_size BETWEEN 5 AND 30 AND p_type IN ('ECONOMY', 'SMALL', 'STANDARD')) WHERE r = 1""")
def method_selection(t) -> DataFrame:
    kind = F.when(F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD"), "plain")
    table = t("part").select(
        "p_brand", F.col("p_partkey").alias("pos"), F.col("p_name").alias("id"), F.lit("parts").alias("domain"), kind.alias("task_family"), F.lit("2d").alias("modality"), F.lit("active").alias("status"),
        F.when(F.col("p_size").between(5, 30), F.array(F.lit("train"))).otherwise(F.array(F.lit("infer"))).alias("allowed_modes"),
    )
    allowed = planner.methods(table, domain="parts", task="plain", modality="2d", mode="train", bonus="ring")
    return registry.best_record(allowed, [F.col("score")], "pos", ["p_brand"]).select("p_brand", F.col("pos").alias("p_partkey"), "score")


@query(r"""
SELECT role, CASE WHEN regexp_matches(lower(text), '\b(und|der|die)\b') THEN 'de' WHEN regexp_matches(lower(text), '\b(les|des|une)\b') THEN 'fr' WHEN regexp_matches(lower(text), '\b(los|las|que)\b') THEN 'es' WHEN regexp_matches(lower(text), '\b(the|and|of)\b') THEN 'en' ELSE 'unknown' END AS intent, count(*) AS n FROM conversations GROUP BY 1, 2""")
def intent_keywords(t) -> DataFrame:
    from assayer.functions import first_keyword

    intent = first_keyword(F.col("text"), {"de": r"\b(und|der|die)\b", "fr": r"\b(les|des|une)\b", "es": r"\b(los|las|que)\b", "en": r"\b(the|and|of)\b"}, "unknown")
    return t("conversations").groupBy("role", intent.alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH l AS (SELECT DISTINCT lang FROM documents), p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS k FROM pages)
SELECT page_id, k, lang, CASE WHEN k = lang THEN 'exact' ELSE 'prefix' END AS kind FROM (SELECT page_id, k, lang, row_number() OVER (PARTITION BY page_id ORDER BY k <> lang, lang) AS r
FROM p JOIN l ON k = lang OR (k <> '' AND (starts_with(k, lang) OR starts_with(lang, k)))) WHERE r = 1""")
def prefix_match(t) -> DataFrame:
    from assayer.operators.registry import exact_or_prefix

    pages = t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("k"))
    return exact_or_prefix(pages, "page_id", "k", t("documents").select("lang").distinct(), "lang")


@query("""
SELECT doc_id, round((coalesce((quality = 1)::INT * 0.5, 0) + coalesce((toxic = 0)::INT * 0.3, 0) + (n_chars >= 200)::INT * 0.2)
 / (CASE WHEN quality IS NULL THEN 0 ELSE 0.5 END + CASE WHEN toxic IS NULL THEN 0 ELSE 0.3 END + 0.2), 6) AS total FROM documents LEFT JOIN labels USING (doc_id)""")
def rubric_totals(t) -> DataFrame:
    j = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    checks = {"quality": (F.col("quality") == 1, 0.5), "safe": (F.col("toxic") == 0, 0.3), "length": (F.col("n_chars") >= 200, 0.2)}
    return j.select("doc_id", F.round(metrics.weighted_rubric({k: (c.cast("int"), w) for k, (c, w) in checks.items()}), 6).alias("total"))


@query("""
WITH i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'flip_quality' WHEN doc_id % 3 = 1 THEN 'flip_toxic' ELSE 'shift' END AS category,
 CASE WHEN doc_id % 3 = 0 THEN quality + 2 ELSE quality END AS q, CASE WHEN doc_id % 3 = 1 THEN 1 - toxic ELSE toxic END AS x FROM labels)
SELECT category, count(*) AS injected, count(*) FILTER (WHERE q NOT IN (0, 1) OR x = 1) AS detected, round(count(*) FILTER (WHERE q NOT IN (0, 1) OR x = 1) * 1.0 / count(*), 6) AS recall FROM i GROUP BY category""")
def injection_recall(t) -> DataFrame:
    m = F.col("doc_id") % 3
    bad = t("labels").select(F.col("doc_id").alias("case_id"), F.when(m == 0, "flip_quality").when(m == 1, "flip_toxic").otherwise("shift").alias("category"),
        F.when(m == 0, F.col("quality") + 2).otherwise(F.col("quality")).alias("q"), F.when(m == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("x"))
    rules = [Rule("invalid_value", "error", "label", ~F.col("q").isin(0, 1)), Rule("sensitive", "warning", "label", F.col("x") == 1)]
    codes = issues(bad, rules, "case_id").groupBy("case_id").agg(F.collect_set("type").alias("codes"))
    injected = bad.select("case_id", "category", F.array(F.lit("invalid_value"), F.lit("sensitive")).alias("expected"))
    return metrics.recall_by_category(injected, codes).select("category", "injected", "detected", F.round("recall", 6).alias("recall"))


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
 count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id""")
def scalar_pivot(t) -> DataFrame:
    counts = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return records.wide(counts, "user_id", "event_type", "n").na.fill(0)


@query(f"SELECT coalesce(split, 'all') AS split, coalesce(lang, 'all') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT {_SPLIT} AS split, coalesce(lang, '?') AS lang, n_chars FROM documents) GROUP BY ROLLUP (split, lang)")
def rollup_totals(t) -> DataFrame:
    d = t("documents").select(_split().alias("split"), F.coalesce("lang", F.lit("?")).alias("lang"), F.col("n_chars").alias("chars"))
    return records.totals(d, ["split", "lang"], ["chars"])
