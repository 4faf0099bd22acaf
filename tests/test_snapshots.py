"""Merkle trees over folders against a recursive version, and differences against set algebra."""

import hashlib
import random

import pytest

from assayer.operators import snapshots


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest_of(files, prefix=""):
    """By recursion over a map from path to (digest, size)."""
    children = {}
    for path, (d, _) in files.items():
        if path.startswith(prefix):
            head, slash, _ = path[len(prefix) :].partition("/")
            children[head, "folder" if slash else "file"] = None if slash else d
    buckets = {}
    for (name, kind), d in children.items():
        d = digest_of(files, f"{prefix}{name}/") if kind == "folder" else d
        buckets.setdefault(sha(name)[:3], []).append(f"{kind} {d or '-'} {len(name)} {name}")
    return sha("\n".join(sorted(f"{b} " + sha("\n".join(sorted(lines))) for b, lines in buckets.items())))


def frame(spark, files):
    return spark.createDataFrame([(p, d, s) for p, (d, s) in files.items()], "rel_path string, sha256 string, size_bytes long")


TREE = {"a/b/c.png": ("1", 10), "a/b/d.PNG": ("2", 20), "a/e.nii.gz": (None, 3), "f": ("4", 4), "g/h/i/j/k.txt": ("5", 5), "a/.hidden": ("6", 6)}


def test_nodes_and_fingerprint(spark):
    nodes = snapshots.tree_nodes(frame(spark, TREE))
    rows = {((r["parent"] + "/") if r["parent"] else "") + r["name"]: r for r in nodes.collect() if r["kind"] == "folder"}
    assert set(rows) == {"", "a", "a/b", "g", "g/h", "g/h/i", "g/h/i/j"}
    assert all(r["digest"] == digest_of(TREE, f"{p}/" if p else "") for p, r in rows.items())
    assert (rows["a"]["files"], rows["a"]["bytes"], rows["a"]["depth"]) == (4, 39, 1)
    f = snapshots.fingerprint(nodes, 2).first()
    assert (f["digest"], f["file_count"], f["total_bytes"]) == (digest_of(TREE), 6, 48)
    assert [(x["suffix"], x["count"]) for x in f["top_extensions"]] == [(".png", 2), ("<no_ext>", 2)]


def test_odd_paths_and_empty_tree(spark):
    rows = [("/a//b", "1", 1), ("a/b", "2", 5), (None, "9", 9), ("", "9", 9), ("/", "9", 9)]
    nodes = snapshots.tree_nodes(spark.createDataFrame(rows, "rel_path string, sha256 string, size_bytes long"))
    assert nodes.where("depth = 0").first()["digest"] == digest_of({"a/b": ("2", 5)})
    empty = snapshots.tree_nodes(frame(spark, TREE).limit(0))
    assert [tuple(r) for r in empty.collect()] == [(0, None, "", "folder", sha(""), 0, 0)]
    assert snapshots.fingerprint(empty).first()["top_extensions"] == []


def test_diff_reads_only_what_differs(spark, tmp_path):
    old = {f"d{i}/s{j}/f{k}": (f"{i}{j}{k}", 1) for i in range(4) for j in range(4) for k in range(4)}
    new = {p: v for p, v in old.items() if p != "d1/s2/f3"} | {"d1/s2/f0": ("x", 1), "d9/new/deep/file": ("y", 1), "d2": ("z", 1)}
    for name, files in (("old", old), ("new", new)):
        snapshots.write_snapshot(snapshots.tree_nodes(frame(spark, files)), f"{tmp_path}/{name}")
    a, b = (snapshots.read_snapshot(spark, f"{tmp_path}/{n}") for n in ("old", "new"))
    want = {("d1/s2/f3", "removed"), ("d1/s2/f0", "changed"), ("d9/new/deep/file", "added"), ("d2", "added")}
    assert {tuple(r) for r in snapshots.snapshot_diff(a, b).collect()} == want
    assert snapshots.snapshot_diff(a, a).collect() == []
    plan = snapshots.level_changes(a, b, 2, ["d1", "d9"])._jdf.queryExecution().toString()
    assert "In(parent, [d1,d9])" in plan and "PartitionFilters: [isnotnull(depth" in plan  # other folders' row groups are not read


def random_tree(rng):
    paths = {"/".join(rng.choices(["a", "b", "c d", "é", "\n"], k=rng.randint(1, 4))) for _ in range(12)}
    kept = [p for p in sorted(paths) if not any(q.startswith(p + "/") for q in paths)]
    return {p: (rng.choice(["1", "2", None]), rng.randint(0, 9)) for p in kept}


@pytest.mark.parametrize("seed", [1, 2])
def test_diff_equals_set_algebra(spark, seed):
    rng = random.Random(seed)
    old = random_tree(rng)
    new = {p: v for p, v in old.items() if rng.random() < 0.8} | {"a new/\n": ("1", 1), "\n\n": (None, 0)}
    a, b = (snapshots.tree_nodes(frame(spark, x)) for x in (old, new))
    assert a.where("depth = 0").first()["digest"] == digest_of(old)
    got = {tuple(r) for r in snapshots.snapshot_diff(a, b).collect()}
    want = {(p, "removed") for p in old.keys() - new.keys()} | {(p, "added") for p in new.keys() - old.keys()} | {(p, "changed") for p in old.keys() & new.keys() if old[p][0] != new[p][0]}
    assert got == want
