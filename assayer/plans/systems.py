"""Header audits, supervision, snapshots and the monitor's best as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import audits, forest, registry, snapshots
from assayer.plans.curation import QUERIES, query
from assayer.streaming import runs


@query("""
WITH v AS (SELECT o_orderkey, o_custkey % 97 <> 0 AS ok, o_totalprice, CASE WHEN o_custkey % 31 = 0 THEN -1 ELSE 0.5 END AS spacing, CASE WHEN o_custkey % 13 = 0 THEN 2 ELSE 3 END AS ndim,
  trim(CASE o_orderstatus WHEN 'F' THEN 'ct ' WHEN 'O' THEN 'CT' ELSE CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE 'MR' END END) AS modality, o_custkey % 11 = 0 AS no_patient,
  o_totalprice / 500000 AS fg, o_custkey % 7 AS faces, (o_orderkey % 10) / 10 AS tail, o_orderkey % 50 AS delta FROM orders),
f AS (SELECT o_orderkey, list_filter([CASE WHEN NOT ok THEN 'unreadable_image' END, CASE WHEN ok AND spacing <= 0 THEN 'invalid_spacing' END, CASE WHEN ok AND ndim <> 3 THEN 'unexpected_dimensionality' END,
  CASE WHEN ok AND no_patient THEN 'missing_key_metadata' END, CASE WHEN ok AND modality = '' THEN 'missing_modality_metadata' END, CASE WHEN ok AND modality <> '' AND upper(modality) <> 'CT' THEN 'metadata_inconsistency' END,
  CASE WHEN ok AND o_totalprice < 5000 THEN 'empty_or_corrupt_volume' END, CASE WHEN ok AND faces >= 5 AND (fg < 0.08 OR fg > 0.95) THEN 'possible_truncation' END,
  CASE WHEN ok AND fg < 0.002 THEN 'very_low_foreground_ratio' END, CASE WHEN ok AND tail > 0.55 THEN 'possible_metal_artifact' END,
  CASE WHEN ok AND delta > greatest(1.0, 0.3 * 100) THEN 'possible_motion_or_slice_inconsistency' END], lambda x: x IS NOT NULL) AS codes FROM v)
SELECT o_orderkey AS case_id, array_to_string(codes, ',') AS codes, CASE WHEN list_has_any(codes, ['unreadable_image', 'invalid_spacing', 'unexpected_dimensionality', 'empty_or_corrupt_volume']) THEN 'reject'
  WHEN len(codes) > 0 THEN 'needs_manual_review' ELSE 'usable' END AS status FROM f""")
def header_audit(t) -> DataFrame:
    """The audit of scans that come with headers: which are usable, to be looked at or rejected."""
    n = F.col("o_custkey")
    modality = F.when(F.col("o_orderstatus") == "F", "ct ").when(F.col("o_orderstatus") == "O", "CT").otherwise(F.when(n % 2 == 0, " ").otherwise("MR"))
    volumes = t("orders").select(
        F.col("o_orderkey").alias("case_id"), (n % 97 != 0).alias("image_ok"), F.array(F.when(n % 31 == 0, -1.0).otherwise(0.5), F.lit(0.5)).alias("spacing"),
        F.when(n % 13 == 0, F.array(F.lit(5), F.lit(5))).otherwise(F.array(F.lit(5), F.lit(5), F.lit(5))).alias("shape"), modality.alias("modality"),
        F.when(n % 11 != 0, n.cast("string")).alias("patient_id"), F.lit("1.2").alias("study_uid"), F.lit("1.3").alias("series_uid"), (F.col("o_totalprice") < 5000).alias("empty"),
        (F.col("o_totalprice") / 500000).alias("foreground_ratio"), F.lit(0.0).alias("zero_fraction"), (n % 7).alias("touch_faces"), ((F.col("o_orderkey") % 10) / 10).alias("tail_ratio"),
        (F.col("o_orderkey") % 50).cast("double").alias("slice_delta_p95"), F.lit(100.0).alias("dynamic_range"),
    )
    return audits.header_status(audits.header_findings(volumes)).select("case_id", F.array_join("codes", ",").alias("codes"), "status")


def _log(t) -> DataFrame:
    """The shop's clicks as a run log: clients are runs, kinds of clicks are kinds of events."""
    c, value = t("clicks").where("client_id IS NOT NULL AND ts IS NOT NULL"), F.floor("value").cast("long")
    kind = F.when(F.col("kind") == "view", "trial").when(F.col("kind") == "cart", "controller").when(F.col("kind") == "buy", "limit").otherwise("heartbeat")
    status = F.when(value % 3 == 0, "completed").when(value % 3 == 1, "failed").otherwise("running")
    return c.select(
        F.concat(F.lit("r"), F.col("client_id").cast("string")).alias("run_id"), F.col("click_id").alias("sequence"), F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("kind"), status.alias("status"),
        (F.col("click_id") % 9).alias("number"), F.concat(F.lit("t"), (F.col("click_id") % 20).cast("string")).alias("name"), ((value % 10) / 10).alias("dice"), ((value % 7) / 7).alias("iou"),
    ).distinct()


@query("""
WITH e AS (SELECT DISTINCT 'r' || client_id AS run_id, click_id AS s, ts, CASE kind WHEN 'view' THEN 'trial' WHEN 'cart' THEN 'controller' WHEN 'buy' THEN 'limit' ELSE 'heartbeat' END AS kind,
  CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status, click_id % 9 AS number, 't' || (click_id % 20) AS name,
  (CAST(floor(value) AS BIGINT) % 10) / 10 AS dice, (CAST(floor(value) AS BIGINT) % 7) / 7 AS iou FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
t AS (SELECT run_id, name, status, dice, iou FROM e WHERE kind = 'trial' QUALIFY row_number() OVER (PARTITION BY run_id, name ORDER BY ts DESC, s DESC NULLS LAST) = 1),
b AS (SELECT run_id, name, dice, iou FROM t WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY coalesce(dice, 0) DESC, coalesce(iou, 0) DESC, name) = 1),
n AS (SELECT run_id, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE status = 'failed') AS bad FROM t GROUP BY 1),
c AS (SELECT run_id, status FROM e WHERE kind = 'controller' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, s DESC NULLS LAST) = 1),
l AS (SELECT run_id, number FROM e WHERE kind = 'limit' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, s DESC NULLS LAST) = 1)
SELECT r.run_id, coalesce(done, 0) AS n_completed, coalesce(bad, 0) AS n_failed, b.name AS best_trial, round(b.dice, 6) AS best_dice, round(b.iou, 6) AS best_iou, l.number AS max_trials, c.status AS run_status,
  CASE WHEN c.status = 'completed' THEN 'report_results' WHEN c.status = 'failed' THEN 'inspect_failure' WHEN coalesce(done, 0) < coalesce(l.number, 0) THEN 'keep_monitoring' ELSE 'inspect_ambiguous' END AS advice
FROM (SELECT DISTINCT run_id FROM e) r LEFT JOIN n USING (run_id) LEFT JOIN b USING (run_id) LEFT JOIN c USING (run_id) LEFT JOIN l USING (run_id)""")
def run_supervision(t) -> DataFrame:
    return runs.supervision(_log(t)).withColumns({c: F.round(c, 6) for c in ("best_dice", "best_iou")})


@query("""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(floor(value), 0) DESC, coalesce(len(event_type), 0) DESC, event_id) AS r FROM events) WHERE r = 1""")
def monitored_best(t) -> DataFrame:
    e = t("events").withColumns({"dice": F.floor("value").cast("double"), "iou": F.length("event_type").cast("double")})
    return registry.monitored_best(e, "event_id", by=["user_id"]).select("user_id", "event_id", "value")


@query(r"""
WITH f AS (SELECT coalesce(lang, 'none') AS a, coalesce(source, 'none') AS b, doc_id || CASE doc_id % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.nii.gz' ELSE '' END AS name, sha256(text) AS d, octet_length(encode(text)) AS n FROM documents WHERE doc_id IS NOT NULL),
l3 AS (SELECT a, b, substr(sha256(name), 1, 3) AS k, 'file ' || coalesce(d, '-') || ' ' || length(name) || ' ' || name AS line, coalesce(n, 0) AS n FROM f),
k3 AS (SELECT a, b, k || ' ' || sha256(string_agg(line, chr(10) ORDER BY line)) AS line, count(*) AS c, sum(n) AS n FROM l3 GROUP BY a, b, k),
l2 AS (SELECT a, substr(sha256(b), 1, 3) AS k, 'folder ' || sha256(string_agg(line, chr(10) ORDER BY line)) || ' ' || length(b) || ' ' || b AS line, sum(c) AS c, sum(n) AS n FROM k3 GROUP BY a, b),
k2 AS (SELECT a, k || ' ' || sha256(string_agg(line, chr(10) ORDER BY line)) AS line, sum(c) AS c, sum(n) AS n FROM l2 GROUP BY a, k),
l1 AS (SELECT substr(sha256(a), 1, 3) AS k, 'folder ' || sha256(string_agg(line, chr(10) ORDER BY line)) || ' ' || length(a) || ' ' || a AS line, sum(c) AS c, sum(n) AS n FROM k2 GROUP BY a),
k1 AS (SELECT k || ' ' || sha256(string_agg(line, chr(10) ORDER BY line)) AS line, sum(c) AS c, sum(n) AS n FROM l1 GROUP BY k),
x AS (SELECT CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.gz' ELSE '<no_ext>' END AS suffix, count(*) AS c FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, CAST(sum(c) AS BIGINT) AS file_count, CAST(sum(n) AS BIGINT) AS total_bytes,
  (SELECT string_agg(suffix || '=' || c, ',' ORDER BY c DESC, suffix) FROM x) AS top_extensions FROM k1""")
def snapshot_fingerprint(t) -> DataFrame:
    """The digest of all documents as files of a tree, with counts and the most frequent suffixes."""
    n = F.col("doc_id")
    name = F.concat(n.cast("string"), F.when(n % 3 == 0, ".TXT").when(n % 3 == 1, ".nii.gz").otherwise(""))
    text = F.col("text").cast("binary")
    files = t("documents").select(F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), name).alias("rel_path"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("size_bytes"), n)
    f = snapshots.fingerprint(snapshots.tree_nodes(files.where("doc_id IS NOT NULL")))
    listed = F.transform("top_extensions", lambda x: F.concat_ws("=", x["suffix"], x["count"].cast("string")))
    return f.select("digest", "file_count", "total_bytes", F.array_join(listed, ",").alias("top_extensions"))


def isolation_scores(spark, sf_dir: str) -> DataFrame:
    """Anomalies by an isolation forest; a random forest has no SQL, and is tested against its own trees read one by one."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return forest.isolation_scores(e, "vec_id", "embedding").select("vec_id", F.round("score", 9).alias("score"), "anomaly")


QUERIES["isolation_scores"] = isolation_scores
