"""Trace rubrics against a version that goes from run to run."""

import json
import random
import re

import pytest

from assayer.operators import traces


def agent(name):
    for a, b in traces.AGENTS.items():
        if name in (a, b):
            return b
    for a, b in traces.AGENTS.items():
        if a in name.lower() or name.lower() in a:
            return b
    return name


def steps(reference):
    out = []
    for s in reference:
        m = re.match(r"^(\w+)\.", s)
        rest = s[len(m[1]) + 1 :] if m else s
        w = re.match(r"([\w./-]+)", rest)
        action = re.sub(r"\(.*?\)", "", w[1] if w else rest).split(".")[-1].strip()
        out.append((agent(m[1] if m else "unknown").lower(), action.lower()))
    return out


def share(checks, empty):
    return sum(checks) / len(checks) if checks else empty


def judged(run, events, intents):
    key = run["intent_id"]
    intent = intents.get(key) or next((intents[k] for k in sorted(intents) if key.startswith(k) or k.startswith(key)), {})
    calls, seen = [], set()
    for e in events:
        if e["event"] == "tool_call_start" and e.get("call_id") not in seen:
            seen.add(e.get("call_id"))
            calls.append(e)
    acts = [e for e in events if e["event"] == "orchestrator_action"]
    errors = sum(e["event"] == "tool_call_error" for e in events)
    low = lambda e, c: (e.get(c) or "").lower()
    near = lambda a, b: a in b or b in a
    nodes = steps(intent.get("reference", []))
    actual, ref = {low(c, "agent") for c in calls} | {low(a, "agent") for a in acts if a.get("agent")}, {a for a, _ in nodes}
    right = {a for a in ref if any(near(a, b) for b in actual)}
    p, r = (len(right) / len(actual) if actual else 0), (len(right) / len(ref) if ref else 0)
    f1 = 2 * p * r / (p + r) if p + r else 0
    hit = lambda a, x: any(near(a, low(c, "agent")) and (near(x, low(c, "tool_name")) or x in low(c, "decision_summary")) for c in calls) or any(near(a, low(c, "agent")) and (x in low(c, "action") or x in low(c, "decision_summary")) for c in acts)
    coverage = sum(hit(a, x) for a, x in nodes) / len(nodes) if nodes else 0
    n = len(calls)
    full = sum(any(v is not None for v in json.loads(c.get("arguments") or "{}").values()) for c in calls)
    s = {"task_planning": 0.4 * f1 + 0.6 * coverage, "tool_correctness": full / n * (1 - errors / n) if n else 0}
    s["qc_detection"] = float(any("qc" in low(c, "tool_name") or "validate" in low(c, "tool_name") for c in calls))
    s["ambiguity_handling"] = 1.0 if any(w in low(a, "decision_summary") for a in acts for w in traces.CLARIFYING) else 0.5
    s["boundary_identification"] = float(any("unsupported" in low(a, "action") for a in acts)) if "unsupported" in intent.get("expected_status", "") else 1.0
    wanted = intent.get("artifacts", [])
    got = sum(f in run["files"] for f in traces.RUN_FILES) + sum(any(re.fullmatch(".*".join(map(re.escape, w.split("/")[-1].split("*"))), f.split("/")[-1]) for f in run["files"]) for w in wanted)
    s["artifact_completeness"] = got / (len(wanted) + 4)
    e, a = intent.get("expected"), run["platform"]
    if e and a:
        sup, ex, method = a
        esup, eex, emethod, should = e
        checks = [esup == sup] * (esup is not None and sup is not None) + [eex == ex] * (eex is not None and ex is not None)
        checks += [(emethod == method) if emethod else method is None] * (emethod is not None) + [should == (ex and sup)] * (should is not None)
        s["task_planning"] = share(checks, 0.0)
        held = sup is False or ex is False
        core = held if should is False else sup is False if esup is False else sup is True
        s["qc_detection"] = share([core] + [True] * (eex is False and sup is True and ex is False), 0)
        data, task = intent.get("dataset", "unknown"), intent.get("task_family", "unknown")
        unknown = "unknown" in (data, task)
        s["intent_parsing"] = share([data != "unknown", task != "unknown"] + [should is False] * unknown if emethod else [], 0.5)
        s["ambiguity_handling"] = 0.0 if intent.get("category") == "ambiguous" and sup is not False else 1.0
        s["boundary_identification"] = 0.0 if (intent.get("category") in ("boundary", "trap") or should is False) and not held else 1.0
    s = {k: round(v, 3) for k, v in s.items()}
    return s | {"total_score": sum(v * traces.WEIGHTS[k] for k, v in s.items()), "tool_count": n, "error_count": errors}


def made(seed):
    rng = random.Random(seed)
    maybe = lambda *x: rng.choice(x)
    reference = lambda: rng.sample(["main.parse_intent(dataset=A,task=B)", "data_curator.qc.scripts/run_qc.py --x 1", "experimentation.train", "research.search(q)", "plain step", "x.y.z"], rng.randint(0, 4))
    intents = {}
    for k in ("I1", "I2", "I30", "J"):
        e = maybe(None, (maybe(True, False, None), maybe(True, False, None), maybe(None, "", "m1"), maybe(True, False, None)))
        i = {"reference": reference(), "artifacts": rng.sample(["out/*.json", "report(1).md", "a/b.png"], rng.randint(0, 3)), "expected_status": maybe("completed", "rejected_unsupported"), "category": maybe("standard", "ambiguous", "trap")}
        i |= {"dataset": maybe("unknown", "tdd"), "task_family": maybe("unknown", "seg")} | ({"expected": e} if e else {})
        intents[k] = i
    runs, events = [], []
    for n in range(12):
        run = {"run_id": f"r{n}", "intent_id": maybe("I1", "I2", "I3", "J-extra", "none"), "files": rng.sample([*traces.RUN_FILES, "out/x.json", "deep/report(1).md", "report(1)xmd"], rng.randint(0, 6)), "platform": maybe(None, (maybe(True, False, None), maybe(True, False, None), maybe(None, "m1")))}
        runs.append(run)
        for s in range(rng.randint(0, 9)):
            events.append({
                "run_id": run["run_id"], "sequence": s, "event": maybe("tool_call_start", "tool_call_start", "orchestrator_action", "tool_call_error", "other"), "call_id": maybe(None, "c1", "c2", f"c{s}"),
                "agent": maybe(None, "MainAgent", "main", "DataCurationAgent", "ExperimentationAgent"), "tool_name": maybe(None, "parse_intent", "run_qc", "train", "validate_x"), "action": maybe(None, "delegate", "unsupported_request", "train"),
                "decision_summary": maybe(None, "Please confirm", "we train now", ""), "arguments": maybe(None, "{}", '{"a": null}', '{"a": 1}', '{"a": {"b": null}}'),
            })
    return runs, events, intents


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_a_run_by_run_version(spark, seed):
    runs, events, intents = made(seed)
    names = [c.split()[0] for c in traces.EVENTS.split(", ")]
    r = spark.createDataFrame([(x["run_id"], x["intent_id"], "done", x["files"], x["platform"]) for x in runs], traces.RUNS)
    e = spark.createDataFrame([tuple(x.get(c) for c in names) for x in events], traces.EVENTS)
    lines = [json.dumps({"id": k, "reference_workflow": i["reference"], "reference_artifacts": i["artifacts"], "expected_terminal_status": i["expected_status"], "intent_category": i["category"], "dataset": i["dataset"], "task_family": i["task_family"]} | ({"expected_platform_result": dict(zip(("supported", "executable", "method", "should_execute"), i["expected"]))} if "expected" in i else {})) for k, i in intents.items()]
    i = traces.read_intents(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {x["run_id"]: x for x in traces.trace_scores(r, e, i).collect()}
    assert set(got) == {x["run_id"] for x in runs}
    for run in runs:
        want = judged(run, [x for x in events if x["run_id"] == run["run_id"]], intents)
        row = got[run["run_id"]]
        assert {k: row[k] for k in want if row[k] is None} == {}
        assert {k: float(row[k]) for k in want} == pytest.approx({k: float(v) for k, v in want.items()}, abs=1.01e-3), (run, intents)


def test_intent_lines(spark):
    lines = [(0, '{"intent_id": "a", "reference_workflow_path": ["main.x"]}'), (1, '{"id": "a", "assertions": [{"type": "other"}, {"type": "ordered_subsequence", "target": {"must_include": ["s"]}}]}'), (2, '{"id": ""}'), (3, "broken"), (4, '{"id": "b", "dataset": "d"}')]
    got = {r["intent_key"]: r for r in traces.read_intents(spark.createDataFrame(lines, "pos int, value string")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["reference"] == ["s"] and got["b"]["dataset"] == "d" and got["b"]["expected"] is None
