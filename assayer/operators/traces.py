"""Rubrics over agent traces: all runs at once, as joins and aggregates by run.

Events are rows (run_id, sequence, event, call_id, agent, tool_name, action, decision_summary, arguments); runs have an intent,
the names of their files and, where a planner took part, its decision; intents say what was asked for. A reference workflow is
a few steps, so calls and actions meet steps by run after they were made distinct.

Defined cases: a run without events has scores of zero calls. A run whose intent is unknown (neither its id nor a prefix either
way) is judged against an empty one. Null agents, tools and summaries are empty texts, and an empty agent agrees with any, as in
substring tests elsewhere. Calls without an id count once a run. Arguments that are no JSON object, or hold nulls only, are incomplete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.registry import exact_or_prefix, first_events

EVENTS = "run_id string, sequence bigint, event string, call_id string, agent string, tool_name string, action string, decision_summary string, arguments string"
RUNS = "run_id string, intent_id string, status string, files array<string>, platform struct<supported:boolean,executable:boolean,method:string>"
INTENTS = (
    "intent_key string, reference array<string>, artifacts array<string>, expected_status string, category string, dataset string, task_family string, "
    "expected struct<supported:boolean,executable:boolean,method:string,should_execute:boolean>"
)
#: Weights, names of agents, files of a run and words of the rubric.
WEIGHTS = {
    "task_planning": 0.25, "tool_correctness": 0.20, "qc_detection": 0.15, "intent_parsing": 0.15, "ambiguity_handling": 0.10, "boundary_identification": 0.10, "artifact_completeness": 0.05,
}
AGENTS = {"main": "MainAgent", "data_curator": "DataCurationAgent", "experimentation": "ExperimentationAgent", "clinical_result": "ClinicalResultAgent", "research": "ResearchAgent"}
RUN_FILES = ("tool_trace.jsonl", "run_manifest.json", "final_response.txt", "workflow_config.json")
CLARIFYING = ("澄清", "确认", "clarify", "confirm", "ambiguous")


def read_intents(lines: DataFrame, text: str = "value") -> DataFrame:
    """``INTENTS`` from request lines: the id is ``id``, else ``intent_id``; of several with one id the last by ``pos``, if there is such a column, wins."""
    get = lambda c: F.get_json_object(text, f"$.{c}")
    array = lambda c: F.from_json(get(c), "array<string>")
    ordered = F.filter(F.from_json(get("assertions"), "array<struct<type:string,target:struct<must_include:array<string>>>>"), lambda a: (a["type"] == "ordered_subsequence") & (F.size(a["target"]["must_include"]) > 0))
    full = lambda c: F.when(F.size(c) > 0, c)
    reference = F.coalesce(full(array("reference_workflow")), full(array("reference_workflow_path")), F.try_element_at(ordered, F.lit(1))["target"]["must_include"], F.array())
    rows = lines.select(
        F.coalesce(F.nullif(get("id"), F.lit("")), get("intent_id")).alias("intent_key"), reference.alias("reference"), F.coalesce(array("reference_artifacts"), F.array()).alias("artifacts"),
        get("expected_terminal_status").alias("expected_status"), get("intent_category").alias("category"), get("dataset").alias("dataset"), get("task_family").alias("task_family"),
        F.from_json(get("expected_platform_result"), "supported boolean, executable boolean, method string, should_execute boolean").alias("expected"), *(["pos"] if "pos" in lines.columns else []),
    )
    rows = rows.where("intent_key <> ''")
    if "pos" not in lines.columns:
        return rows
    last = F.struct(*[c for c in rows.columns if c != "pos"])
    return rows.groupBy("intent_key").agg(F.max_by(last, "pos").alias("i")).select("i.*")


def agent_name(name: Column) -> Column:
    """An agent's full name: its own, else that of the first agent whose name is part of it or the other way round."""
    out, low = None, F.lower(name)
    for short, full in AGENTS.items():
        hit = (name == short) | (name == full)
        out = F.when(hit, full) if out is None else out.when(hit, full)
    for short, full in AGENTS.items():
        out = out.when(low.contains(short.lower()) | F.lit(short.lower()).contains(low), full)
    return out.otherwise(name)


def reference_steps(intents: DataFrame) -> DataFrame:
    """(intent_key, nth, step_agent, step_action) of the reference workflows, in lower case."""
    rows = intents.select("intent_key", F.posexplode("reference").alias("nth", "step"))
    own = F.regexp_extract("step", r"^(\w+)\.", 1)
    rest = F.when(own == "", F.col("step")).otherwise(F.substring("step", F.length(own) + 2, F.length("step")))
    word = F.regexp_extract(rest, r"^([\w./-]+)", 1)
    action = F.regexp_replace(F.when(word == "", rest).otherwise(word), r"\(.*?\)", "")
    action = F.trim(F.substring_index(action, ".", -1))
    return rows.select("intent_key", "nth", F.lower(agent_name(F.when(own == "", F.lit("unknown")).otherwise(own))).alias("step_agent"), F.lower(action).alias("step_action"))


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def _either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def planning(runs: DataFrame, steps: DataFrame, calls: DataFrame, actions: DataFrame) -> DataFrame:
    """(run_id, agent_f1, action_coverage, task_planning): how far calls and actions cover a run's reference steps."""
    own = runs.select("run_id", "intent_key").join(steps, "intent_key")
    made = calls.select("run_id", _low("agent").alias("agent"), _low("tool_name").alias("name"), _low("decision_summary").alias("summary"), F.lit(True).alias("called"))
    made = made.union(actions.select("run_id", _low("agent"), _low("action"), _low("decision_summary"), F.lit(False))).distinct()
    actual = calls.select("run_id", _low("agent").alias("agent")).union(actions.select("run_id", _low("agent")).where("agent <> ''")).distinct()
    agents = own.select("run_id", "step_agent").distinct()
    right = agents.join(actual, "run_id").where(_either(F.col("step_agent"), F.col("agent"))).select("run_id", "step_agent").distinct()
    n = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    names = F.col("step_action"), F.col("name")
    agrees = _either(F.col("step_agent"), F.col("agent")) & (names[1].contains(names[0]) | (F.col("called") & names[0].contains(names[1])) | F.col("summary").contains(names[0]))
    covered = own.join(made, "run_id").where(agrees).select("run_id", "nth").distinct()
    out = runs.select("run_id")
    for df, name in ((own, "n_steps"), (agents, "n_ref"), (actual, "n_actual"), (right, "n_right"), (covered, "n_covered")):
        out = out.join(n(df, name), "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    precision, recall = F.coalesce(zero("n_right") / F.nullif(zero("n_actual"), F.lit(0)), F.lit(0.0)), F.coalesce(zero("n_right") / F.nullif(zero("n_ref"), F.lit(0)), F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    coverage = F.coalesce(zero("n_covered") / F.nullif(zero("n_steps"), F.lit(0)), F.lit(0.0))
    return out.select("run_id", f1.alias("agent_f1"), coverage.alias("action_coverage"), (0.4 * f1 + 0.6 * coverage).alias("task_planning"))


def _share(checks: list[tuple[Column, Column]], empty: float) -> Column:
    """The share of checks that hold among those that apply."""
    made = F.array_compact(F.array(*[F.when(F.coalesce(applies, F.lit(False)), F.coalesce(holds, F.lit(False))) for applies, holds in checks]))
    return F.when(F.size(made) == 0, empty).otherwise(F.size(F.filter(made, lambda x: x)) / F.size(made))


def platform_scores(expected: Column, actual: Column, dataset: Column, task: Column, category: Column) -> dict[str, Column]:
    """The five dimensions that a planner's decision is judged by instead of a trace."""
    method, should = expected["method"], expected["should_execute"]
    ran = F.when(actual["executable"], actual["supported"]).otherwise(actual["executable"])
    held = F.coalesce(~actual["supported"], F.lit(False)) | F.coalesce(~actual["executable"], F.lit(False))
    said = lambda c: expected[c].isNotNull() & actual[c].isNotNull()
    plan = _share([
        (said("supported"), expected["supported"] == actual["supported"]), (said("executable"), expected["executable"] == actual["executable"]),
        (method.isNotNull(), F.when(method != "", method.eqNullSafe(actual["method"])).otherwise(actual["method"].isNull())), (should.isNotNull(), should.eqNullSafe(ran)),
    ], 0.0)
    must = F.coalesce(should, F.lit(True))
    core = F.when(~must, held).when(~F.coalesce(expected["supported"], F.lit(True)), F.coalesce(~actual["supported"], F.lit(False))).otherwise(F.coalesce(actual["supported"], F.lit(False)))
    quality = _share([(F.lit(True), core), (~expected["executable"] & actual["supported"] & ~actual["executable"], F.lit(True))], 0.0)
    unknown = lambda c: F.coalesce(c, F.lit("unknown")) == "unknown"
    named = F.coalesce(method, F.lit("")) != ""
    parsing = _share([(named, ~unknown(dataset)), (named, ~unknown(task)), (named & (unknown(dataset) | unknown(task)), F.coalesce(~should, F.lit(False)))], 0.5)
    kind = F.coalesce(category, F.lit("standard"))
    ambiguity = F.when((kind == "ambiguous") & F.coalesce(actual["supported"], F.lit(True)), 0.0).otherwise(1.0)
    boundary = F.when((kind.isin("boundary", "trap") | ~must) & ~held, 0.0).otherwise(1.0)
    return {"task_planning": plan, "qc_detection": quality, "intent_parsing": parsing, "ambiguity_handling": ambiguity, "boundary_identification": boundary}


def _name_pattern(path: Column) -> Column:
    """A regular expression for the names that a path pattern's last part stands for."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(name, r"([\\.+?^$|()\[\]{}])", r"\\$1"), r"\*", ".*"), F.lit("$"))


def trace_scores(runs: DataFrame, events: DataFrame, intents: DataFrame) -> DataFrame:
    """A row a run: its intent, seven dimensions, efficiency, total score, numbers of calls and errors.

    A run that a planner decided, with an intent that says what it should decide, is judged by ``platform_scores``; all others by their
    trace, without the dimension of parsing, so their total is at most 0.85. Scores have three decimals.
    """
    matched = exact_or_prefix(runs.select("run_id", "intent_id"), "run_id", "intent_id", intents, "intent_key").select("run_id", "intent_key")
    r = runs.join(matched, "run_id", "left").join(intents, "intent_key", "left")
    calls = first_events(events.where("event = 'tool_call_start'").withColumn("key_", F.struct("run_id", "call_id")), "key_").drop("key_")
    actions = events.where("event = 'orchestrator_action'")
    args = F.from_json("arguments", "map<string,string>")
    complete = F.coalesce(F.size(F.map_filter(args, lambda _, v: v.isNotNull())) > 0, F.lit(False))
    per_call = calls.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tool_count"), F.count_if(complete).alias("complete"), F.count_if(_low("tool_name").contains("qc") | _low("tool_name").contains("validate")).alias("qc")
    )
    errors = events.where("event = 'tool_call_error'").groupBy("run_id").agg(F.count(F.lit(1)).alias("error_count"))
    summary = _low("decision_summary")
    clear = F.lit(False)
    for word in CLARIFYING:
        clear = clear | summary.contains(word)
    per_action = actions.groupBy("run_id").agg(F.count_if(clear).alias("clear"), F.count_if(_low("action").contains("unsupported")).alias("unsupported"))
    plans = planning(r, reference_steps(intents), calls, actions)
    j = r.join(per_call, "run_id", "left").join(errors, "run_id", "left").join(per_action, "run_id", "left").join(plans, "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    n = F.nullif(zero("tool_count"), F.lit(0))
    tool = F.coalesce(zero("complete") / n * (1 - zero("error_count") / n), F.lit(0.0))
    names = F.coalesce("files", F.array())
    base = F.transform(names, lambda f: F.regexp_extract(f, r"([^/]*)$", 1))
    wanted = F.coalesce("artifacts", F.array())
    found = F.size(F.filter(F.array(*map(F.lit, RUN_FILES)), lambda f: F.array_contains(names, f))) + F.size(F.filter(wanted, lambda p: F.exists(base, lambda f: F.rlike(f, _name_pattern(p)))))
    planner = F.col("expected").isNotNull() & F.col("platform").isNotNull()
    refuse = F.coalesce("expected_status", F.lit("")).contains("unsupported")
    traced = {
        "task_planning": F.col("task_planning"), "qc_detection": F.when(zero("qc") > 0, 1.0).otherwise(0.0), "intent_parsing": F.lit(None).cast("double"),
        "ambiguity_handling": F.when(zero("clear") > 0, 1.0).otherwise(0.5), "boundary_identification": F.when(refuse & (zero("unsupported") == 0), 0.0).otherwise(1.0),
    }
    decided = platform_scores(F.col("expected"), F.col("platform"), F.col("dataset"), F.col("task_family"), F.col("category"))
    both = {"tool_correctness": tool, "artifact_completeness": found / (F.size(wanted) + len(RUN_FILES))}
    scores = {d: F.round(both[d] if d in both else F.when(planner, decided[d]).otherwise(traced[d]), 3) for d in WEIGHTS}
    efficiency = F.when(planner, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - zero("tool_count") / 20) + 0.5))
    total = sum((F.coalesce(scores[d], F.lit(0.0)) * w for d, w in WEIGHTS.items()), F.lit(0.0))
    return j.select(
        "run_id", "intent_id", "intent_key", "status", "expected_status", planner.alias("platform_mode"), *[c.alias(d) for d, c in scores.items()], F.round(efficiency, 3).alias("trajectory_efficiency"),
        F.round(total, 3).alias("total_score"), zero("tool_count").alias("tool_count"), zero("error_count").alias("error_count"),
    )
