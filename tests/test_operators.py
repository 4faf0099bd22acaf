import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer import functions as fn
from assayer.operators import audits, cohort, dedup, planner, registry, splits
from assayer.operators.rules import Rule, bbox_invalid, case_status, cohort_status, issues, polygon_issue, row_status


def test_rules_guard_and_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 0, 5), ("c", None, 0)], "id string, ok int, n int")
    rules = [Rule("broken", "error", "x", F.col("ok") == 0), Rule("empty", "warning", "x", F.col("n") == 0), Rule("large", "warning", "x", F.col("n") > 3, unless=("broken",))]
    found = {(r["case_id"], r["type"]) for r in issues(df, rules, "id").collect()}
    assert found == {("b", "broken"), ("c", "empty")}
    assert {r["case_id"]: r["status"] for r in case_status(df, issues(df, rules, "id"), "id").collect()} == {"a": "ready", "b": "blocked", "c": "manual_review"}
    status = {r["case_id"]: (r["status"], r["n_issues"]) for r in row_status(df, rules, "id").collect()}
    assert status == {"a": ("ready", 0), "b": ("blocked", 1), "c": ("manual_review", 1)}


def test_cohort_status(spark):
    rows = [("a", "x", "severe", "major", "confirmed", False), ("b", "y", "mild", "minor", "suspected", True), ("c", "z", "mild", "minor", "confirmed", True)]
    df = spark.createDataFrame(rows, "case_id string, code string, severity string, impact string, status string, auto_correctable boolean")
    assert {r[0]: r[1] for r in cohort_status(df).collect()} == {"a": "reject", "b": "needs_manual_review", "c": "usable_with_warnings"}


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0],), ([0.0, 0.0, 0.0, 2.0],), ([0.0, 0.0, 9.0, 2.0],), ([1.0],)], "b array<double>")
    assert [r[0] for r in df.select(bbox_invalid(F.col("b"), F.lit(5), F.lit(5))).collect()] == [False, True, True, True]
    p = spark.createDataFrame([([[0.0, 0.0], [5.0, 5.0], [0.0, 5.0]],), ([[0.0, 0.0]],), ([[0.0, 0.0], [6.0, 5.0], [0.0, 5.0]],)], "p array<array<double>>")
    assert [r[0] for r in p.select(polygon_issue(F.col("p"), F.lit(5), F.lit(5))).collect()] == [None, "too_few_points", "out_of_bounds"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["train", "val", "test"])), min_size=1, max_size=12))
def test_leakage_is_a_fold(spark, rows):
    df = spark.createDataFrame([(i, f"h{h}", s) for i, (h, s) in enumerate(rows)], "pos int, h string, split string")
    got = {(r["pos"], r["owner_split"], r["owner_case"]) for r in dedup.content_leakage(df, "h", "split", "pos", "pos").collect()}
    owner, case, want = {}, {}, set()
    for i, (h, s) in enumerate(rows):
        if h in owner and owner[h] != s:
            want.add((i, owner[h], case[h]))
        elif h not in owner:
            owner[h] = s
        if owner[h] == s:
            case[h] = i
    assert got == want


def test_split_is_disjoint_and_exact(spark):
    ids = spark.range(105).withColumnRenamed("id", "k")
    counts = {r["split"]: r["count"] for r in splits.deterministic_split(ids, "k", (0.7, 0.15)).groupBy("split").count().collect()}
    assert counts == {"train": round(105 * 0.7), "val": round(105 * 0.15), "test": 105 - round(105 * 0.7) - round(105 * 0.15)}


def test_sequential_ids(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in random.Random(1).sample(range(20000), 300)], "k long, s string")
    for s in "ab":
        own = [r["i"] for r in splits.sequential_ids(df, "s", "k", "i").where(F.col("s") == s).orderBy("k").collect()]
        assert own == list(range(1, len(own) + 1))


def test_bounds(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 5.0)] * 6 + [("c", 1.0)], "g string, v double")
    b = {r["g"]: r for r in cohort.robust_bounds(df, F.col("v"), ["g"]).collect()}
    assert set(b) == {"a", "b"} and b["a"]["upper"] == 10.0 and abs(b["b"]["lower"] - 4.5) < 1e-9
    assert [r["v"] for r in cohort.outliers(df, F.col("v"), ["g"]).collect()] == [100.0]


def test_paths(spark):
    df = spark.createDataFrame([("/x/Case1_0000.nii.gz",), ("/x/b_12.PNG",)], "p string")
    p = F.col("p")
    rows = df.select(fn.suffix(p), fn.stem(p), fn.case_id(p), fn.case_id(p, "prefix"), fn.file_kind(p), fn.contained(p, "/x")).collect()
    assert tuple(rows[0]) == (".nii.gz", "Case1_0000", "Case1", "Case1", "volume", True)
    assert tuple(rows[1]) == (".png", "b_12", "b_12", "b", "image", True)


def test_scalars(spark):
    df = spark.createDataFrame([("Scan-12 copy", ["1", "A"]), ("不要 x", [])], "t string, l array<string>")
    rows = df.select(fn.case_token(F.col("t")), fn.numbering_schema(F.col("l")), fn.is_chinese(F.col("t")), fn.sanitize(F.col("t"))).collect()
    assert tuple(rows[0]) == ("scan12", "mixed", False, "Scan-12_copy") and tuple(rows[1]) == ("x", "none", True, "不要_x")
    assert df.limit(1).select(fn.without_negated(F.lit("train but do not run inference please now"))).first()[0].split() == ["train", "but", "now"]


def test_registry(spark):
    old = spark.createDataFrame([("a", "1", "then"), ("b", "2", "then")], "source_id string, version string, registered_at string")
    new = spark.createDataFrame([("a", "9", "now"), ("c", "3", "now")], "source_id string, version string, registered_at string")
    assert {tuple(r) for r in registry.upsert(old, new, "source_id").collect()} == {("a", "9", "then"), ("b", "2", "then"), ("c", "3", "now")}
    e = spark.createDataFrame([("r", 1, 0.5, 9.0), ("r", 2, 0.5, 3.0), ("r", 3, 0.4, 1.0)], "run string, epoch int, dice double, hd95 double")
    assert registry.best_epoch(e, "run").first()["best_epoch"] == 2
    best = registry.best_record(e.withColumn("pos", F.col("epoch")), [F.col("dice")], "pos").first()
    assert best["epoch"] == 1


def test_planner_fails_closed(spark):
    assert planner.validate_decision({"decision": "execute", "confidence": True}) == ["bad_confidence", "no_route"]
    assert planner.validate_decision({"decision": "execute", "route_id": "r", "confidence": 0.5, "parameters": {"p": "../x"}}) == ["bad_path:p"]


PLAN = dict(run_status="ok", online_required=False, online_ok=None, native_preflight=None, preflight=None, selected_id="r1", selected_status="executable", executable=True, dataset="d", task="t", gate_route="r1", gate_status="route_ready", gate_permission=True, lookup_done=False, lookup_match=None)
PLAN_SCHEMA = "run_status string, online_required boolean, online_ok boolean, native_preflight string, preflight string, selected_id string, selected_status string, executable boolean, dataset string, task string, gate_route string, gate_status string, gate_permission boolean, lookup_done boolean, lookup_match string"


@pytest.mark.parametrize("change, want", [
    ({}, ("ok", "route_ready", True, None)), ({"gate_status": "block", "gate_permission": False}, ("ok", "block", False, None)), ({"gate_status": "clarify", "gate_permission": False}, ("ok", "clarify", False, None)),
    ({"gate_status": "ready"}, ("invalid", None, None, "preflight_not_established")), ({"gate_route": "r2"}, ("invalid", None, None, "preflight_route_mismatch")), ({"gate_route": None}, ("invalid", None, None, "preflight_route_mismatch")),
    ({"preflight": "a", "native_preflight": "b"}, ("invalid", None, None, "preflight_conflicts_with_native_plan")), ({"run_status": "timeout"}, ("timeout", None, None, None)),
    ({"online_required": True}, ("error", None, None, "required_online_call_failed")), ({"selected_id": "platform_clarification", "dataset": "unknown"}, ("ok", "clarify", False, None)),
    ({"selected_id": "platform_clarification"}, ("invalid", None, None, "clarification_fields_not_structured")),
    ({"executable": False, "lookup_done": True}, ("ok", "no_registered_route", False, None)), ({"executable": False}, ("invalid", None, None, "no_unambiguous_primary_action")),
    ({"executable": False, "lookup_done": True, "task": "unknown"}, ("invalid", None, None, "no_unambiguous_primary_action")),
])
def test_plan_actions(spark, change, want):
    row = planner.normalised_action(spark.createDataFrame([tuple((PLAN | change).values())], PLAN_SCHEMA)).first()
    assert (row["result_status"], row["action"], row["permission"], row["error"]) == want
    assert row["route_id"] == ("r1" if want[1] == "route_ready" else None)


def test_run_states(spark):
    names = "status string, launcher string, code int, pid int, alive boolean, missing int, declared int, expected int, readable int"
    cases = [
        ((None, None, 0, None, None, 0, None, 0, 0), "submitted"), (("failed", None, 0, 1, True, 0, None, 0, 0), "failed"), (("interrupted", None, 0, 1, True, 0, None, 0, 0), "interrupted"),
        (("completed", None, 0, None, None, 2, None, 0, 0), "incomplete_artifacts"), (("completed", None, 0, None, None, 0, None, 0, 3), "completed"), (("completed", None, 0, None, None, 0, 4, 0, 3), "incomplete_artifacts"),
        (("completed", None, 0, None, None, 0, 2, 0, 3), "incomplete_artifacts"), (("completed", None, 0, None, None, 0, 3, 5, 3), "incomplete_artifacts"), (("running", None, 0, 7, True, 0, None, 0, 0), "running"),
        (("running", None, 0, 7, False, 0, None, 0, 0), "failed"), (("running", None, 0, 7, None, 0, None, 0, 0), "unknown"), (("running", None, 0, None, None, 0, None, 0, 0), "unknown"),
        ((None, "submitted", 1, None, None, 0, None, 0, 0), "failed"), ((None, "interrupted", 0, None, None, 0, None, 0, 0), "interrupted"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], names)
    state = planner.run_state(*[F.col(n.split()[0]) for n in names.split(", ")])
    assert [r[0] for r in df.select(state).collect()] == [w for _, w in cases]


ASSETS = "split string, case_id string, kind string, path string, status string, shape array<int>, label_values array<int>, pixel_sha256 string, patient_id string"
PAIR = [("train", "a", "image", "imagesTr/a.png", "ok", [16, 16], None, "h1", None), ("train", "a", "mask", "labelsTr/a.png", "ok", [16, 16], [0, 1], "m", None)]
OTHER = ("test", "a", "image", "imagesTs/a.png", "ok", [16, 16], None, "h2", None)


@pytest.mark.parametrize("rows, codes", [
    ([*PAIR, OTHER], set()), ([PAIR[0]], {"missing_masks", "missing_training_pairs"}), ([PAIR[0], (*PAIR[1][:4], "unreadable", None, None, None, None)], {"unreadable_file", "image_mask_shape_mismatch"}),
    ([PAIR[0], (*PAIR[1][:5], [8, 8], [1], "m", None)], {"image_mask_shape_mismatch"}), ([PAIR[0], (*PAIR[1][:6], [255], "m", None)], {"invalid_label_values"}),
    ([*PAIR, ("train", "b", "image", "imagesTr/b.png", "ok", [16, 16], None, "h3", None)], {"incomplete_pairing"}), ([*PAIR, (*OTHER[:7], "h1", None)], {"cross_split_image_duplicate"}),
    ([(*PAIR[0][:8], "P1"), PAIR[1], (*OTHER[:8], "P1")], {"cross_split_patient_duplicate"}), ([*PAIR, ("train", "a", "image", "imagesTr/a_0000.nii.gz", "ok", None, None, None, None)], {"unsupported_2d_format", "duplicate_case_id"}),
    ([(*PAIR[0][:3], "imagesTr/a_0000.png", *PAIR[0][4:]), PAIR[1]], {"backend_filename_mismatch"}), ([*PAIR, ("val", "c", "mask", "labelsVal/c.png", "ok", [4, 4], [0], "x", None)], {"orphan_masks"}),
    ([], {"missing_images", "missing_training_pairs"}), ([*PAIR, ("train", "z", "image", "imagesTr/z.exe", "ok", None, None, None, None)], {"unsupported_file"}),
])
def test_package_codes(spark, rows, codes):
    assert {r["code"] for r in planner.package_issues(spark.createDataFrame(rows, ASSETS)).collect()} == codes


def test_long_keys_match(spark):
    long = "k" * 300
    left = spark.createDataFrame([(1, long), (2, long + "x"), (3, "ab"), (4, ""), (5, None)], "i long, l string")
    right = spark.createDataFrame([(long,), ("abc",), ("",)], "r string")
    got = {(r["i"], r["r"], r["kind"]) for r in registry.exact_or_prefix(left, "i", "l", right, "r").collect()}
    assert got == {(1, long, "exact"), (2, long, "prefix"), (3, "abc", "prefix")}


def test_names_and_numbers(spark):
    df = spark.createDataFrame([(" Case-7_duplicate ", ["45", " 3", "B", "x"]), ("carrot", ["10", "9"]), ("a_rot90", [])], "t string, l array<string>")
    rows = df.select(fn.case_token(F.col("t")).alias("t"), fn.numbering(F.col("l")).alias("s")).collect()
    assert [r["t"] for r in rows] == ["case7", "carrot", "a"]
    assert tuple(rows[0]["s"]) == ("mixed", ["3", "45"], ["B"], ["45", "x"]) and tuple(rows[1]["s"]) == ("numeric", ["9", "10"], [], []) and rows[2]["s"]["schema"] == "none"


def test_volume_bounds(spark):
    base = dict(case_id="c", n_images=1, image_ok=True, foreground_ratio=0.5, tail_ratio=0.55, dynamic_range=10.0, slice_delta_p95=3.0, touch_faces=5, zero_fraction=0.05)
    names = {"very_low_foreground_ratio", "possible_metal_artifact", "possible_motion_or_slice_inconsistency", "possible_truncation"}
    for change, want in (({}, set()), ({"foreground_ratio": 0.0019}, {"very_low_foreground_ratio", "possible_truncation"}), ({"tail_ratio": 0.56}, {"possible_metal_artifact"}), ({"slice_delta_p95": 3.01}, {"possible_motion_or_slice_inconsistency"}),
                         ({"zero_fraction": 0.051}, {"possible_truncation"}), ({"zero_fraction": 0.5, "touch_faces": 4}, set()), ({"foreground_ratio": 0.96}, {"possible_truncation"}), ({"dynamic_range": 1.0, "slice_delta_p95": 1.0}, set())):
        columns = [c.split()[0] for c in audits.VOLUMES.replace("\n", " ").split(",")]
        rows = spark.createDataFrame([tuple((base | change).get(c) for c in columns)], audits.VOLUMES)
        hits = [code for code, *_, c in audits.cohort_rules() if code in names and rows.select(F.coalesce(c, F.lit(False))).first()[0]]
        assert set(hits) == want, change


def test_exact_quantiles_by_rounds(spark):
    rng = random.Random(3)
    values = {"a": [rng.lognormvariate(0, 8) for _ in range(3000)], "b": [1.0] * 2500 + [2.0], None: [float(i) for i in range(1500)], "c": [5.0], "d": [float("-inf"), 1.0, 2.0, float("inf")] * 400}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("c", None), ("c", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = (0.0, 0.25, 0.5, 0.95, 1.0)
    for most in (50, 1_000_000):  # with and without rounds
        got = {r["g"]: r for r in cohort.exact_quantiles(df, F.col("v"), ["g"], shares, sorted_values=most).collect()}
        assert set(got) == set(values)
        for g, vs in values.items():
            assert got[g]["n"] == len(vs)
            want = sorted(vs)
            for p, q in zip(shares, got[g]["q"], strict=True):
                at = (len(want) - 1) * p
                low, high = want[int(at)], want[min(len(want) - 1, -int(-at // 1))]
                assert q == pytest.approx(low if low == high else low * (1 - at % 1) + high * (at % 1), rel=1e-9)
    assert cohort.exact_quantiles(df.limit(0), F.col("v"), ["g"], shares).count() == 0


def test_keywords_have_ascii_edges_as_in_sql(spark):
    import duckdb

    from assayer.plans import ORACLE_SQL, QUERIES

    texts = ["queñ", "eauêque", "ê que x", "undé", "und\u0301", "und\u0660", "und_", "DİE", "dİe und", "THE\u212a", "sun\nthe", "", None]
    rows = [(i, 0, f"r{i}", x) for i, x in enumerate(texts)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)

    class Tables:
        class read:
            parquet = staticmethod(lambda path: spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))

    got = {tuple(r) for r in QUERIES["intent_keywords"](Tables, "").select("role", "intent", "n").collect()}
    assert got == set(duck.execute(ORACLE_SQL["intent_keywords"]).fetchall())
    assert [fn.ascii_edges(p) for p in (r"\\b", r"\d")] == [r"\\b", r"\d"]


def test_quantile_rounds_shuffle_no_group(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v")).union(spark.createDataFrame([(7, 1.0), (None, 2.0)], "g long, v double"))
    q = cohort.exact_quantiles(df, F.col("v"), ["g"], (0.0, 0.5, 1.0), sorted_values=100)
    assert "SortMergeJoin" not in q._jdf.queryExecution().toString()
    assert {r["g"]: (r["n"], r["q"]) for r in q.collect()} == {0: (2500, [0.0, 2499.0, 4998.0]), 1: (2500, [1.0, 2500.0, 4999.0]), 7: (1, [1.0] * 3), None: (1, [2.0] * 3)}
    assert cohort.exact_quantiles(df, F.col("v"), [], (0.0,), sorted_values=100).collect()[0]["q"] == [0.0]
