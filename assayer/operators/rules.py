"""Declarative rules: one rule is one struct expression, all row rules of a pipeline are one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY_RANK = {"info": 0, "warning": 1, "error": 2}


@dataclass(frozen=True)
class Rule:
    """An issue of ``code`` where ``when`` is true; a null condition means the rule does not apply.

    ``unless`` names rules of the same pipeline whose hit suppresses this one (an unreadable asset is
    not also empty): early exits are part of the meaning and are kept as guards.
    """

    code: str
    severity: str
    category: str
    when: Column
    message: Column | str = ""
    unless: tuple[str, ...] = ()


def _hits(rules: Sequence[Rule]) -> Column:
    """The issues of a row as an array."""
    conditions = {r.code: F.coalesce(r.when, F.lit(False)) for r in rules}
    structs = []
    for r in rules:
        hit = conditions[r.code]
        for other in r.unless:
            hit = hit & ~conditions[other]
        message = F.lit(r.message) if isinstance(r.message, str) else r.message
        structs.append(F.when(hit, F.struct(F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.code).alias("type"), message.cast("string").alias("message"))))
    return F.array_compact(F.array(*structs))


def issues(df: DataFrame, rules: Sequence[Rule], case_id: str) -> DataFrame:
    """Rows (case_id, severity, category, type, message), one for every rule that a row hits, in one scan."""
    return df.select(F.col(case_id).alias("case_id"), F.inline(_hits(rules)))


def severity_rank(severity: Column) -> Column:
    out = F.lit(-1)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def case_status(cases: DataFrame, found: DataFrame, case_id: str = "case_id") -> DataFrame:
    """ready, manual_review or blocked for every case; issues without a case never change one."""
    worst = found.where("case_id is not null").groupBy("case_id").agg(F.max(severity_rank(F.col("severity"))).alias("worst"), F.count(F.lit(1)).alias("n_issues"))
    status = F.when(F.col("worst") == 2, "blocked").when(F.col("worst") == 1, "manual_review").otherwise("ready")
    joined = cases.select(F.col(case_id).alias("case_id")).join(worst, "case_id", "left")
    return joined.select("case_id", status.alias("status"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def row_status(df: DataFrame, rules: Sequence[Rule], case_id: str) -> DataFrame:
    """``case_status`` where a case is one row and all its issues come from ``rules``: a projection, without a join. A null id is a case."""
    found = df.select(F.col(case_id).alias("case_id"), _hits(rules).alias("hits"))
    has = lambda s: F.exists("hits", lambda h: h["severity"] == s)
    status = F.when(has("error"), "blocked").when(has("warning"), "manual_review").otherwise("ready")
    return found.select("case_id", status.alias("status"), F.size("hits").cast("long").alias("n_issues"))


def issue_counts(found: DataFrame) -> DataFrame:
    """Errors and warnings by category, and fail, review or pass."""
    count = lambda s: F.count_if(F.col("severity") == s)
    out = found.groupBy("category").agg(count("error").alias("errors"), count("warning").alias("warnings"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "review").otherwise("pass"))


def cohort_status(findings: DataFrame, mode: str = "volume", blocking: Sequence[str] = ()) -> DataFrame:
    """Status from findings (case_id, code, severity, impact, status, auto_correctable).

    ``volume``: a severe, major, confirmed finding that cannot be corrected rejects; suspected,
    moderate or severe ones need review; any other finding warns. ``series``: blocking codes reject.
    """
    g = findings.groupBy("case_id")
    if mode == "series":
        return g.agg(F.when(F.bool_or(F.col("code").isin(*blocking)), "reject").when(F.count(F.lit(1)) > 0, "needs_manual_review").alias("case_status"))
    fatal = (F.col("severity") == "severe") & (F.col("impact") == "major") & (F.col("status") == "confirmed") & ~F.col("auto_correctable")
    doubt = (F.col("status") == "suspected") | F.col("severity").isin("moderate", "severe")
    return g.agg(F.when(F.bool_or(fatal), "reject").when(F.bool_or(doubt), "needs_manual_review").otherwise("usable_with_warnings").alias("case_status"))


def invalid_values(values: Column, allowed: Sequence) -> Column:
    """Distinct values outside the allowed ones."""
    return F.array_except(F.array_distinct(values), F.array(*map(F.lit, allowed)))


def bbox_invalid(box: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Four coordinates, inside the image where its size is known, with positive area."""
    x1, y1, x2, y2 = (F.try_element_at(box, F.lit(i)) for i in (1, 2, 3, 4))
    bad = (F.size(box) != 4) | (x1 < 0) | (y1 < 0) | (x2 <= x1) | (y2 <= y1)
    if width is not None:
        bad = bad | (x2 > width)
    if height is not None:
        bad = bad | (y2 > height)
    return bad


def polygon_issue(polygon: Column, width: Column, height: Column) -> Column:
    """'too_few_points', 'out_of_bounds' (edges are inside) or null, one for a polygon."""
    outside = F.exists(polygon, lambda p: (p[0] < 0) | (p[0] > width) | (p[1] < 0) | (p[1] > height))
    return F.when(F.size(polygon) < 3, "too_few_points").when(outside, "out_of_bounds")


def mask_plausibility(label: Column, has_allow_list: Column) -> Column:
    """First plausibility issue of a label struct (foreground_ratio, tiny_components, components_per_class)."""
    return (
        F.when(label["foreground_ratio"] == 0, "empty_mask").when(label["foreground_ratio"] > 0.98, "mask_covers_image")
        .when(label["tiny_components"] > 100, "many_tiny_components").when(~has_allow_list & (label["components_per_class"] > 4), "fragmented_classes")
    )


def spacing_issue(image: Column, label: Column, digits: int | None = None) -> Column:
    """Spacing must be positive; image and label must agree exactly, or after rounding to ``digits``."""
    r = (lambda a: F.transform(a, lambda x: F.round(x, digits))) if digits is not None else (lambda a: a)
    return F.when(F.exists(image, lambda x: x <= 0), "invalid_spacing").when(image.isNotNull() & label.isNotNull() & (r(image) != r(label)), "spacing_mismatch")
