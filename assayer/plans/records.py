"""Queries over case, run and trace records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import functions as fn
from assayer.operators import records
from assayer.plans.curation import query


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE lower(trim(o_orderstatus)) IN ('f', 'p')")
def ready_only(t) -> DataFrame:
    return records.with_status(t("orders"), ["F", " p "], "o_orderstatus").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src1'")
def intent_filter(t) -> DataFrame:
    return records.matching(t("documents"), lang="de", source="src1", n_chars=None).select("doc_id")


@query("""SELECT c_custkey AS case_id FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) WHERE NOT EXISTS
 (SELECT 1 FROM events WHERE 'U' || user_id = 'U' || c_custkey)""")
def missing_masks(t) -> DataFrame:
    name = lambda df, c, mark: df.select(F.col(c).alias("case_id"), F.concat(F.lit(mark), F.col(c).cast("string")).alias("name"))
    return records.missing_partners(name(t("orders").select("o_custkey").distinct(), "o_custkey", "u"), name(t("events"), "user_id", "U"), "name").select("case_id")


@query("""
WITH i AS (SELECT conv_id AS case_id, min(md5(text)) AS image FROM conversations WHERE turn = 0 GROUP BY 1),
l AS (SELECT conv_id AS case_id, role, min(md5(text)) AS path FROM conversations WHERE turn > 0 GROUP BY 1, 2)
SELECT i.case_id, image, count(role) AS n_labels, coalesce(string_agg(role || '=' || path, ',' ORDER BY role), '') AS labels FROM i LEFT JOIN l USING (case_id) GROUP BY 1, 2""")
def case_builder(t) -> DataFrame:
    c = t("conversations").select(F.col("conv_id").alias("case_id"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("path"))
    out = records.built_cases(c.where("turn = 0"), c.where("turn > 0"))
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("case_id", "image", F.col("n_labels").cast("long").alias("n_labels"), F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit("")).alias("labels"))


@query("""WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS split FROM events GROUP BY 1)
SELECT coalesce(split, 'none') AS split, count(*) AS n FROM orders LEFT JOIN a ON user_id = o_custkey GROUP BY 1""")
def split_lookup(t) -> DataFrame:
    a = t("events").select(F.col("user_id").alias("o_custkey"), F.col("event_type").alias("split"), F.col("event_id").alias("pos"))
    return records.with_split(t("orders"), a, "o_custkey").groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'no_truth' WHEN d.doc_id IS NULL THEN 'no_prediction' WHEN d.doc_id % 7 = l.quality THEN 'matched' ELSE 'shape_mismatch' END AS state, count(*) AS n
FROM (SELECT * FROM documents WHERE n_chars > 100) d FULL OUTER JOIN (SELECT doc_id, coalesce(quality, -1) AS quality FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1""")
def prediction_truth_join(t) -> DataFrame:
    p = t("documents").where("n_chars > 100").select("doc_id", (F.col("doc_id") % 7).cast("int").alias("shape"))
    truth = t("labels").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("shape"))
    return records.scored_pairs(p, truth, "doc_id", "shape").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH q AS (SELECT source, CAST(count(*) AS VARCHAR) AS issues FROM documents WHERE n_chars < 200 GROUP BY 1)
SELECT d.source, coalesce(issues, 'unknown') AS issues FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN q ON d.source = q.source""")
def dataset_reports(t) -> DataFrame:
    reports = t("documents").where("n_chars < 200").groupBy("source").agg(F.count(F.lit(1)).alias("issues"))
    return records.with_reports(t("documents").select("source").distinct(), reports, "source", ["issues"])


@query("""
WITH s AS (SELECT DISTINCT user_id AS run, unnest(['click', 'view', 'purchase made', 'err']) AS step FROM events),
c AS (SELECT DISTINCT user_id AS run, lower(event_type) AS call FROM events)
SELECT run, step, EXISTS (SELECT 1 FROM c WHERE c.run = s.run AND (contains(call, step) OR contains(step, call))) AS met FROM s""")
def step_agreement(t) -> DataFrame:
    steps = t("events").select(F.col("user_id").alias("run")).distinct().select("run", F.explode(F.array(*map(F.lit, ("click", "view", "purchase made", "err")))).alias("step"))
    return records.agreeing_steps(steps, t("events").select(F.col("user_id").alias("run"), "event_type"), "run", "step", "event_type")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_artifacts(t) -> DataFrame:
    return records.not_available(t("orders"), t("orders").where("o_orderstatus = 'F'"), "o_custkey")


@query("""SELECT doc_id, 'right' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
UNION ALL SELECT DISTINCT doc_id, 'left' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def set_equality(t) -> DataFrame:
    return records.unequal_sets(t("documents"), t("labels"), "doc_id")


@query("""SELECT field, value, count(*) AS n FROM (SELECT unnest(['lang', 'source']) AS field, unnest([coalesce(lang, 'unknown'), coalesce(source, 'unknown')]) AS value FROM documents) GROUP BY ALL""")
def field_histograms(t) -> DataFrame:
    return records.histogram(t("documents"), ["lang", "source"])


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS boxes, o_orderstatus FROM orders)
SELECT o_orderpriority, count(*) AS n_cases, min(boxes) AS min_boxes, max(boxes) AS max_boxes, round(avg(boxes), 6) AS avg_boxes, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS categories FROM c GROUP BY 1""")
def annotation_profile(t) -> DataFrame:
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("boxes"))
    c = t("orders").join(n, "o_orderkey", "left").na.fill(0, ["boxes"])
    out = records.annotation_profile(c, "o_orderpriority", "boxes", "o_orderstatus")
    return out.withColumn("avg_boxes", F.round("avg_boxes", 6)).withColumn("categories", F.array_join("categories", ","))


@query("""SELECT round(avg(l_discount), 6) AS mean_foreground, count(*) AS n_cases, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest([l_linenumber, l_linenumber + 1]) AS v FROM lineitem)) AS label_values FROM lineitem""")
def export_statistics(t) -> DataFrame:
    rows = t("lineitem").withColumn("values", F.array("l_linenumber", F.col("l_linenumber") + 1))
    stats, _ = records.export_stats(rows, "values", "l_discount", "l_linenumber", "l_linenumber")
    return stats.select(F.round("mean_foreground", 6).alias("mean_foreground"), "n_cases", F.array_join("label_values", ",").alias("label_values"))


@query("""SELECT CAST(l_linenumber AS VARCHAR) || 'x' || CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR) AS size, count(*) AS n FROM lineitem GROUP BY 1""")
def export_sizes(t) -> DataFrame:
    rows = t("lineitem").select(F.array("l_linenumber").alias("values"), "l_discount", "l_linenumber", (F.col("l_quantity").cast("int") % 3).alias("h"))
    return records.export_stats(rows, "values", "l_discount", "l_linenumber", "h")[1]


@query("SELECT regexp_extract(url, '([^/]+)/[^/]*$', 1) AS value, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_folders(t) -> DataFrame:
    return records.top_values(t("pages"), F.regexp_extract("url", r"([^/]+)/[^/]*$", 1))


@query("""SELECT count(*) FILTER (WHERE regexp_extract(url, '([^/]+)/[^/]+$', 1) = 'es') AS es, count(*) FILTER (WHERE regexp_extract(url, '([^/]+)/[^/]+$', 1) = 'de') AS de FROM pages""")
def folder_counts(t) -> DataFrame:
    return records.folder_counts(t("pages"), "url", ["es", "de"])


@query("""WITH d AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events)
SELECT user_id, round(coalesce(avg(d), 0), 6) AS mean_delta, round(coalesce(quantile_cont(d, 0.95), 0), 6) AS p95_delta FROM d GROUP BY 1""")
def slice_deltas(t) -> DataFrame:
    out = records.slice_deltas(t("events"), "user_id", "event_id", "value")
    return out.select("user_id", F.round("mean_delta", 6).alias("mean_delta"), F.round("p95_delta", 6).alias("p95_delta"))


@query("SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS rank FROM events WHERE value IS NOT NULL ORDER BY value, event_id LIMIT 10")
def lowest_scores(t) -> DataFrame:
    return records.lowest(t("events").where("value is not null"), "value", "event_id").select("event_id", "value", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT event_id, user_id, coalesce(floor(value / 50), -1) AS dice, coalesce(value, -1) AS iou FROM events)
SELECT event_id, (SELECT x.event_id FROM e x WHERE x.user_id = e.user_id AND x.event_id <= e.event_id ORDER BY x.dice DESC, x.iou DESC, x.event_id LIMIT 1) AS best FROM e""")
def best_tuple_so_far(t) -> DataFrame:
    e = t("events").select("event_id", "user_id", F.coalesce(F.floor(F.col("value") / 50).cast("double"), F.lit(-1.0)).alias("dice"), F.coalesce("value", F.lit(-1.0)).alias("iou"))
    return records.best_so_far(e, "user_id", "event_id", [F.col("dice"), F.col("iou")], "event_id").select("event_id", "best")


@query("""SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 4""")
def balanced_top_up(t) -> DataFrame:
    rows = t("region").select("r_regionkey", "r_name", F.lit("one").alias("category"))
    return records.topped_up(rows, "category", "r_regionkey", 1).select("r_regionkey", "r_name")


@query("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_acctbal, s_suppkey LIMIT 1")
def device_choice(t) -> DataFrame:
    return records.first_by(t("supplier"), [F.col("s_nationkey"), F.col("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "s_nationkey")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def log_tail(t) -> DataFrame:
    return records.tail(t("events").select("event_id", "event_type"), "event_id", 25)


_ORDERED = "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('42|' || doc_id)) AS nr, count(*) OVER () AS n FROM documents)"


@query(f"{_ORDERED} SELECT doc_id, CASE WHEN nr <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM r")
def holdout_split(t) -> DataFrame:
    return records.holdout_split(t("documents").select("doc_id"), "doc_id", 0.2)


@query(f"{_ORDERED} SELECT doc_id, CASE WHEN nr <= round_even(n * 0.7, 0) THEN 'train' WHEN nr <= round_even(n * 0.85, 0) THEN 'val' ELSE 'test' END AS split FROM r")
def injection_split(t) -> DataFrame:
    return records.cumulative_split(t("documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20 THEN 'train' ELSE 'test' END AS split FROM documents")
def first_n_split(t) -> DataFrame:
    return records.first_n_split(t("documents"), "source", "doc_id", 20).select("doc_id", "split")


@query("SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark")
def id_union(t) -> DataFrame:
    return records.distinct_union([t("documents").select(F.col("doc_id").alias("id")), t("labels").select(F.col("doc_id").alias("id")), t("benchmark").select(F.col("item_id").cast("long").alias("id"))], "id")


@query("""WITH c AS (SELECT l_returnflag, l_quantity AS v, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, count(*) AS n_values, bool_and(v = round(v)) AS integer_like, CAST(sum(CASE WHEN v <> 0 THEN n ELSE 0 END) AS BIGINT) AS nonzero, count(*) FILTER (WHERE r <= 256) AS n_listed FROM c GROUP BY 1""")
def label_value_summary(t) -> DataFrame:
    out = records.label_summary(t("lineitem"), "l_returnflag", "l_quantity")
    return out.select("l_returnflag", "n_values", "integer_like", "nonzero", F.size("values").cast("long").alias("n_listed"))


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'person' ELSE role END, ',' ORDER BY turn, role, md5(text)) AS roles FROM conversations GROUP BY 1")
def replaced_ids(t) -> DataFrame:
    rows = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("h")))), lambda s: s["role"]).alias("roles"))
    return rows.select("conv_id", F.array_join(records.replaced(F.col("roles"), "user", "person"), ",").alias("roles"))


@query("""SELECT user_id AS run_id, epoch_us(min(ts) FILTER (WHERE event_type = 'view')) AS started, epoch_us(max(ts) FILTER (WHERE event_type IN ('purchase', 'error'))) AS ended,
 CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN max(ts) FILTER (WHERE event_type IN ('purchase', 'error')) IS NOT NULL THEN 'completed' ELSE 'running' END AS state FROM events GROUP BY 1""")
def run_manifest(t) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "end").otherwise(F.col("event_type"))
    out = records.run_manifest(t("events").select(F.col("user_id").alias("run_id"), kind.alias("event"), "ts"))
    return out.select("run_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("ended").cast("timestamp")).alias("ended"), "state")


@query("""WITH a AS (SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS target, unnest(generate_series(1, len(string_split(n_name, 'A')))) AS i, 'success' AS kind FROM nation),
f AS (SELECT n_nationkey, n_name AS target, len(string_split(n_name, 'A')) + 1 AS i, 'forbidden' AS kind FROM nation)
SELECT n_nationkey, CAST(i AS BIGINT) AS assertion_id, kind, target FROM (SELECT * FROM a UNION ALL SELECT * FROM f)""")
def assertion_rows(t) -> DataFrame:
    rows = t("nation").select("n_nationkey", F.split("n_name", "A", -1).alias("criteria"), F.array("n_name").alias("forbidden"))
    return records.assertions(rows, "n_nationkey", "criteria", "forbidden").withColumn("assertion_id", F.col("assertion_id").cast("long"))


@query("""WITH f AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS found, min(o_orderpriority) AS category FROM orders GROUP BY 1)
SELECT category, count(*) AS n, count(*) FILTER (WHERE list_contains(found, 'F') AND list_contains(found, 'O')) AS detected,
 round(count(*) FILTER (WHERE list_contains(found, 'F') AND list_contains(found, 'O')) / count(*), 6) AS recall FROM f GROUP BY 1""")
def injection_recall_all(t) -> DataFrame:
    f = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("found"), F.min("o_orderpriority").alias("category")).withColumn("wanted", F.array(F.lit("F"), F.lit("O")))
    return records.recall_by_category(f, "category", "wanted", "found", every=True)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def usable_records(t) -> DataFrame:
    files = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.usable(t("orders"), files, "o_orderkey").select("o_orderkey")


@query("SELECT DISTINCT regexp_extract(regexp_replace(url, '[?].*$', ''), '^(.*)/[^/]+$', 1) AS folder FROM pages WHERE regexp_extract(regexp_replace(url, '[?].*$', ''), '([^/]+)$', 1) = '12'")
def run_folders(t) -> DataFrame:
    return records.run_folders(t("pages").withColumn("url", F.regexp_replace("url", "[?].*$", "")), "url", "12")


@query("""WITH p AS (SELECT user_id, round(sum(coalesce(value, 0)), 2) AS seconds FROM events GROUP BY 1), b AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS seconds FROM orders GROUP BY 1)
SELECT user_id, round(p.seconds + coalesce(b.seconds, 0), 2) AS seconds FROM p LEFT JOIN b ON user_id = o_custkey""")
def elapsed_totals(t) -> DataFrame:
    p = t("events").groupBy("user_id").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("seconds"))
    b = t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).cast("double").alias("seconds"))
    return records.elapsed_totals(p, b, "user_id", "seconds").select("user_id", F.round("seconds", 2).alias("seconds"))


@query("SELECT d.doc_id, coalesce(l.quality, l.toxic, d.n_chars % 3) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def merged_spec(t) -> DataFrame:
    labels = t("labels").select("doc_id", F.col("quality").alias("explicit_quality"), F.col("toxic").alias("best_quality"))
    j = t("documents").select("doc_id", (F.col("n_chars") % 3).alias("default_quality")).join(labels, "doc_id", "left")
    return records.merged_spec(j, ["quality"], ["explicit", "best", "default"]).select("doc_id", "quality")


@query("""WITH l AS (SELECT o_custkey, list_sort(list(DISTINCT CAST(o_orderkey % 40 AS VARCHAR))) AS v FROM orders GROUP BY 1)
SELECT o_custkey, 'numeric' AS schema, string_agg(x, ',' ORDER BY CAST(x AS INT)) AS numeric_labels, coalesce(string_agg(x, ',' ORDER BY x) FILTER (WHERE CAST(x AS INT) NOT BETWEEN 1 AND 32), '') AS invalid_labels
FROM (SELECT o_custkey, unnest(v) AS x FROM l) GROUP BY 1""")
def numbering_report(t) -> DataFrame:
    rows = t("orders").groupBy("o_custkey").agg(F.collect_list((F.col("o_orderkey") % 40).cast("string")).alias("labels"))
    s = rows.select("o_custkey", fn.numbering(F.col("labels")).alias("s"))
    return s.select("o_custkey", "s.schema", F.array_join("s.numeric_labels", ",").alias("numeric_labels"), F.array_join("s.invalid_labels", ",").alias("invalid_labels"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS moment, CAST(epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate) AS DOUBLE) / 1e6 AS seconds FROM orders""")
def moments(t) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return t("orders").select("o_orderkey", fn.iso_seconds(at).alias("moment"), fn.elapsed_seconds(at, F.lit("1998-01-01 00:00:00").cast("timestamp")).alias("seconds"))
