"""The keyed upsert against a brute-force version that holds all rows in lists."""

import hashlib
import math
import os
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import upsert as up
from assayer.llm.queries import op11_keyed_upsert

COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def crc(x) -> int:
    return zlib.crc32(str(x).encode())


def expected_files(clients: list[dict], changes: list[dict]) -> list[tuple[bool, list[dict]]]:
    """(rewritten, rows) of each file, by the contract's words."""
    m = 1 + len(clients) // 700
    start = sorted((r for r in clients if crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [start[i : i + m] for i in range(0, len(start), m)]
    firsts = [f[0]["client_id"] for f in files]
    best: dict[int, dict] = {}
    for c in changes:
        b = best.get(c["client_id"])
        if b is None or (c["seq"], c["change_id"]) > (b["seq"], b["change_id"]):
            best[c["client_id"]] = c
    now = [{r["client_id"]: r for r in f} for f in files]
    for k, c in best.items():
        home = max([i for i, f in enumerate(firsts) if f <= k], default=0)
        h = crc(firsts[home]) % 12
        if h > 7:
            continue
        if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
            now[home].pop(k, None)
        else:
            old = now[home].get(k) or dict.fromkeys(COLUMNS) | {"client_id": k}
            now[home][k] = old | {x: c[x] for x in ("source", "segment", "city", "balance")}
    out: list[list] = []
    for before, after in zip(files, now, strict=True):
        rows = sorted(after.values(), key=lambda r: r["client_id"])
        if rows == before:
            out.append([False, before])
            continue
        n = len(rows)
        pieces = -(-n // m)
        at = 0
        for i in range(pieces):
            size = n // pieces + (i < n % pieces)
            out.append([True, rows[at : at + size]])
            at += size
    merged: list[list] = []
    for new, rows in out:
        if new and merged and merged[-1][0] and len(merged[-1][1]) + len(rows) <= m:
            merged[-1][1] = merged[-1][1] + rows
        else:
            merged.append([new, rows])
    return [(a, b) for a, b in merged]


def digest(rows: list[dict]) -> tuple:
    cents = sum(math.floor(100 * r["balance"] + 0.5) for r in rows if r["balance"] is not None)
    crcs = sum(crc("|".join(r[c] or "" for c in ("source", "segment", "city"))) for r in rows)
    ids = ",".join(str(r["client_id"]) for r in rows)
    return rows[0]["client_id"], len(rows), cents, crcs, hashlib.sha256(ids.encode()).hexdigest()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    table = lambda t: duckdb.sql(f"SELECT * FROM '/root/testdata/{sf}/{t}.parquet'").to_arrow_table().to_pylist()
    want = expected_files(table("clients"), table("client_changes"))
    got = sorted(op11_keyed_upsert(spark, f"/root/testdata/{sf}").collect(), key=lambda r: r["first_id"])
    assert [(tuple(r)[:5], r["rewritten"]) for r in got] == [(digest(rows), new) for new, rows in want]
    assert {r["columns"] for r in got} == {",".join(COLUMNS)}
    folder = os.path.dirname(got[0]["path"])
    assert sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part-")) == sorted(r["path"] for r in got)
    for r, (_, rows) in zip(got, want, strict=True):
        file = pq.ParquetFile(r["path"]).read()
        assert file.column_names == COLUMNS and file.to_pylist() == rows


def folder_rows(spark, base) -> list[tuple]:
    return sorted(map(tuple, base.rows(spark).collect()), key=str)


def test_plan_joins_left_neighbours():
    # (home, rows, dirty), files of 4: 3 + 1 join, a clean file parts, 9 rows are 3 + 3 + 3, an empty home is no neighbour
    assert up._plan([(0, 3, True), (1, 1, True), (2, 4, False), (3, 9, True), (4, 0, True), (5, 1, True), (6, 1, True)], 4) == ({0: 0, 1: 0, 3: 1, 5: 3, 6: 4}, 5)


def test_nulls_repeats_clashes_and_strings(spark, tmp_path):
    base = spark.createDataFrame([("b", 1, "x"), ("b", 2, "x"), (None, 3, "y"), ("d", None, None), ("f", 5, "z" * 100_000)], "id string, change int, k string")
    files = up.write_sorted(base, "id", 2, f"{tmp_path}/a")
    assert [f for f, _ in files.files] == ["b", "f"]
    rows = [("a", 1, 9, "p"), ("a", 1, 9, "p"), ("b", None, 7, "q"), ("b", 0, 8, None), ("d", 5, 1, "gone"), (None, 9, 9, "r"), ("z", 1, 1, "gone")]
    changes = spark.createDataFrame(rows, "id string, seq int, change int, k string")
    act = lambda change, first: F.when(change["k"] == "gone", "delete").otherwise("set")
    gone = up.upsert(files, changes, ["seq"], ["k"], act)
    assert gone == [files.files[0][1]]  # the file of f has no change
    assert folder_rows(spark, files) == [("a", None, "p"), ("b", 2, None), ("f", 5, "z" * 100_000)]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v string")
    files = up.write_sorted(none, "id", 5, f"{tmp_path}/a")
    assert files.files == []
    changes = spark.createDataFrame([(i, 1, "new") for i in range(11)], "id long, seq int, v string")
    act = lambda change, first: F.lit("set")
    assert up.upsert(files, changes.limit(0), ["seq"], ["v"], act) == []
    up.upsert(files, changes, ["seq"], ["v"], act)
    assert folder_rows(spark, files) == sorted([(i, "new") for i in range(11)], key=str)
    report = up.file_report(spark, files, F.lit(0).cast("long"), F.lit(0).cast("long")).collect()
    assert sorted(r["n_rows"] for r in report) == [3, 4, 4] and all(r["rewritten"] for r in report)


def test_unchanged_rows_rewrite_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 2 else float(i)) for i in range(10)], "id long, v double")
    files = up.write_sorted(rows, "id", 3, f"{tmp_path}/a")
    same = rows.withColumn("seq", F.lit(1))
    assert up.upsert(files, same, ["seq"], ["v"], lambda change, first: F.lit("set")) == []
