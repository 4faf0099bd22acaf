"""A small fail-closed control plane: requests, methods, gates and decisions. Unknown input never becomes permission."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed key sets of a decision.
DECISION_KEYS = frozenset({"decision", "route_id", "clarification_fields", "parameters", "confidence", "reasoning", "requirements"})
DECISIONS = frozenset({"execute", "clarify", "reject", "external_proposal"})
BAD_PATH = ("..", "\x00", "\n", "`", "$", ";", "|", "&")


@dataclass(frozen=True)
class Gate:
    """Outcome of a preflight: permission only where no reason speaks against it."""

    reasons: tuple[str, ...] = field(default_factory=tuple)

    @property
    def permitted(self) -> bool:
        return not self.reasons


def validate_decision(decision: dict) -> list[str]:
    """Problems of a decision document; booleans are no numbers, unknown keys are problems."""
    if not isinstance(decision, dict):
        return ["not_an_object"]
    out = [f"unknown_key:{k}" for k in sorted(set(decision) - DECISION_KEYS)]
    if decision.get("decision") not in DECISIONS:
        out.append("unknown_decision")
    confidence = decision.get("confidence")
    if type(confidence) not in (int, float) or not 0 <= confidence <= 1:
        out.append("bad_confidence")
    for k, v in (decision.get("parameters") or {}).items():
        if isinstance(v, str) and any(b in v for b in BAD_PATH):
            out.append(f"bad_path:{k}")
    if decision.get("decision") == "execute" and not decision.get("route_id"):
        out.append("no_route")
    return out


def methods(registry: DataFrame, *, domain: str, task: str, modality: str, mode: str, dataset: str | None = None, bonus: str = "tta|ensemble") -> DataFrame:
    """Methods that a request may use, best first (a bonus for ids that match ``bonus``, as ensembles; ties in registry order)."""
    ok = (F.col("domain") == domain) & (F.col("task_family") == task) & (F.col("modality") == modality) & F.array_contains("allowed_modes", mode)
    if dataset is not None:
        ok = ok & F.array_contains("datasets", dataset)
    score = F.lit(10) + F.when(F.lower("id").rlike(bonus), 10).otherwise(0)
    return registry.where(ok & (F.col("status") == "active")).withColumn("score", score).orderBy(F.desc("score"), "pos")


def package_gate(package_issues: DataFrame, allowed: tuple[str, ...] = ()) -> Gate:
    """Codes that block a route (few, by construction of the rule set)."""
    rows = package_issues.where(~F.col("code").isin(*allowed)) if allowed else package_issues
    return Gate(tuple(sorted(r["code"] for r in rows.select("code").distinct().collect())))


def normalised_action(plans: DataFrame) -> DataFrame:
    """Adds run_status, action, route and errors: what a plan and its preflight allow, in the order of the rules.

    Columns: run_status, online_required and online_ok, native_preflight and preflight (texts that must agree
    if both are there), selected_id, selected_status, executable, dataset, task, gate_route, gate_status, gate_permission,
    lookup_done, lookup_match. Nothing but an agreeing, ready gate gives a route; a proposal counts as "no route" only
    after a lookup without a match.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != "unknown"
    clarify, runs = F.col("selected_id") == "platform_clarification", yes("executable") & (F.col("selected_status") == "executable")
    fields = F.array_compact(F.array(F.when(~named("dataset"), "dataset_id"), F.when(~named("task"), "task")))
    no_route = yes("lookup_done") & F.col("lookup_match").isNull() & named("dataset") & named("task") & (F.col("executable") == F.lit(False))
    verdict = (
        F.when(F.coalesce("run_status", F.lit("error")) != "ok", F.coalesce("run_status", F.lit("error")))
        .when(yes("online_required") & ~yes("online_ok"), "required_online_call_failed")
        .when(F.col("preflight").isNotNull() & F.col("native_preflight").isNotNull() & (F.col("preflight") != F.col("native_preflight")), "preflight_conflicts_with_native_plan")
        .when(clarify & (F.size(fields) == 0), "clarification_fields_not_structured").when(clarify, "clarify")
        .when(runs & ~F.col("gate_route").eqNullSafe(F.col("selected_id")), "preflight_route_mismatch")
        .when(runs & F.col("gate_status").isin("route_ready", "clarify", "block"), F.col("gate_status")).when(runs, "preflight_not_established")
        .when(no_route, "no_registered_route").otherwise("no_unambiguous_primary_action")
    )
    v, actions = F.col("verdict_"), ("route_ready", "clarify", "block", "no_registered_route")
    status = F.when(F.coalesce("run_status", F.lit("error")) != "ok", v).when(v == "required_online_call_failed", "error").when(v.isin(*actions), "ok").otherwise("invalid")
    permission = F.when(v == "no_registered_route", False).when(clarify & (v == "clarify"), False).when(v.isin(*actions), F.col("gate_permission"))
    out = plans.withColumn("verdict_", verdict).withColumn("result_status", status)
    return (
        out.withColumn("action", F.when(v.isin(*actions) & (F.col("result_status") == "ok"), v)).withColumn("route_id", F.when(F.col("action") == "route_ready", F.col("selected_id")))
        .withColumn("permission", F.when(F.col("result_status") == "ok", permission)).withColumn("clarification_fields", F.when(clarify & (v == "clarify"), fields).otherwise(F.array().cast("array<string>")))
        .withColumn("error", F.when(F.col("result_status").isin("invalid", "error") & ~v.isin(*actions) & (F.coalesce("run_status", F.lit("error")) == "ok"), v)).drop("verdict_")
    )


def coverage_reasons(required: Column, route: Column) -> Column:
    """Flags (map name to boolean) that a request needs and its route lacks."""
    return F.map_keys(F.map_filter(required, lambda k, v: v & ~F.coalesce(F.try_element_at(route, k), F.lit(False))))


def run_state(status: Column, launcher: Column, launcher_code: Column, pid: Column, alive: Column, missing: Column, declared: Column, expected: Column, readable: Column) -> Column:
    """submitted, running, completed, incomplete_artifacts, failed, interrupted or unknown.

    A finished run is completed only if nothing is ``missing``, some prediction is readable, and the declared and the
    expected number of predictions, where known, equal the readable ones. A run whose process is gone has failed;
    ``alive`` is null where that cannot be found out.
    """
    whole = (F.coalesce(missing, F.lit(0)) == 0) & (readable > 0) & F.coalesce(declared == readable, F.lit(True)) & F.coalesce((expected == 0) | (expected == readable), F.lit(True))
    return (
        F.when(status.isin("failed", "interrupted"), status).when((status == "completed") & whole, "completed").when(status == "completed", "incomplete_artifacts")
        .when(launcher == "interrupted", "interrupted").when((F.coalesce(launcher_code, F.lit(0)) != 0) | (launcher == "failed"), "failed")
        .when(pid.isNotNull() & alive.isNull(), "unknown").when(pid.isNotNull() & alive, "running").when(pid.isNotNull(), "failed")
        .when(status.isNotNull() | launcher.isNotNull(), "unknown").otherwise("submitted")
    )


#: Suffixes of 2D files that can be decoded, of files beside the data, and the codes of package issues.
RASTERS, BESIDE = (".png", ".jpg", ".jpeg", ".tif", ".tiff"), (".json", ".txt", ".xml")


def package_issues(assets: DataFrame, allowed_values: tuple[int, ...] = (0, 1), mode: str = "private_train", accepted: tuple[str, ...] = (*RASTERS, ".nii.gz"), layouts: Column | None = None) -> DataFrame:
    """(code, detail) of a split package from its assets (split, case_id, kind, path, status, shape, label_values, pixel_sha256, patient_id)."""
    from assayer.functions import file_name, suffix

    key, end = ["split", "case_id"], suffix(F.col("path"))
    issue = lambda df, code, detail: df.select(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    known = assets.where(end.isin(*accepted))
    per = known.groupBy(*key).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("image", "mask")],
        *[F.min(F.when(F.col("kind") == k, F.struct(file_name(F.col("path")).alias("name"), F.col("shape").alias("shape")))).alias(k) for k in ("image", "mask")],
    )
    name = F.concat_ws("/", *key)
    split = per.groupBy("split").agg(F.sum("n_image").alias("images"), F.sum("n_mask").alias("masks"), F.count_if((F.col("n_image") > 0) & (F.col("n_mask") > 0)).alias("paired"), F.count_if((F.col("n_image") > 0) & (F.col("n_mask") == 0)).alias("missing"), F.count_if((F.col("n_image") == 0) & (F.col("n_mask") > 0)).alias("orphans"))
    must = (F.lit(mode == "private_train")) & (F.col("split").isin("train", "val") | (F.col("masks") > 0)) & (F.col("missing") > 0)
    total = split.agg(F.coalesce(F.sum("images"), F.lit(0)).alias("images"), F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("paired"))), F.lit(0)).alias("train_pairs"))
    both = per.where("n_image > 0 and n_mask > 0")
    decodable = known.where(end.isin(*RASTERS))
    masks, images = decodable.where("kind = 'mask'"), decodable.where("kind = 'image'")
    across = lambda c, code: issue(images.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("split").alias("n")).where("n > 1"), code, F.col(c))
    flat = F.size("shape") != 2
    parts = [
        issue(assets.where(~end.isin(*accepted, *BESIDE)), "unsupported_file", F.col("path")),
        issue(known.where(~end.isin(*RASTERS)), "unsupported_2d_format", F.col("path")),
        issue(decodable.where("status <> 'ok'"), "unreadable_file", F.col("path")),
        issue(images.where("status = 'ok'").where(flat), "invalid_image_dimension", F.col("path")), issue(masks.where("status = 'ok'").where(flat), "invalid_mask_dimension", F.col("path")),
        issue(split.where(must & (F.col("masks") == 0)), "missing_masks", F.col("split")), issue(split.where(must & (F.col("masks") > 0)), "incomplete_pairing", F.col("split")),
        issue(split.where("orphans > 0"), "orphan_masks", F.col("split")),
        issue(per.where("n_image > 1 or n_mask > 1").select("split").distinct(), "duplicate_case_id", F.col("split")),
        issue(both.where(~F.col("image.shape").eqNullSafe(F.col("mask.shape"))), "image_mask_shape_mismatch", name),
        issue(both.where((F.lit(mode == "private_train")) & (F.col("image.name") != F.col("mask.name"))), "backend_filename_mismatch", name),
        issue(masks.where(F.size(F.array_except("label_values", F.array(*map(F.lit, allowed_values)))) > 0), "invalid_label_values", F.col("path")),
        issue(total.where("images = 0"), "missing_images", F.col("images")), issue(total.where((F.lit(mode == "private_train")) & (F.col("train_pairs") == 0)), "missing_training_pairs", F.col("train_pairs")),
        across("pixel_sha256", "cross_split_image_duplicate"), across("patient_id", "cross_split_patient_duplicate"),
    ]
    if layouts is not None:  # a condition over paths that names both layouts at once
        parts.append(issue(assets.agg(F.bool_or(layouts).alias("x")).where("x"), "ambiguous_layout", F.lit("two layouts")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
