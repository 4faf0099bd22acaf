"""Ranked search against the contract's formula over all documents, and against DuckDB."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.llm import search
from assayer.llm.queries import ORACLE_SQL, op13_wand_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute_force(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    held = [(k, Counter(t), len(t)) for k, x in docs if (t := terms_of(x))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for k, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scored.append((-s, k is None, k if k is not None else 0, k))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force_and_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = op13_wand_search(spark, f"/root/testdata/{sf}")
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(con.execute(ORACLE_SQL["op13_wand_search"]).fetchall(), key=str)
    if sf == "sf0.001":
        table = lambda t, k: con.execute(f"SELECT {k}, text FROM {t}").fetchall()
        assert rows == brute_force(table("documents", "doc_id"), table("benchmark", "item_id"), 50)


def test_ties_nulls_repeats_blocks_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_COUNTS", 3)  # many shards a task
    texts = ["alpha beta", "Alpha, BETA!", "alpha", None, "", "...", "gamma été 1x", "ÉTÉ alpha " * 3000, "beta " * 7 + "alpha"]
    docs = [(i if i % 5 else None, texts[i % len(texts)]) for i in range(120)] + [(7, "gamma été 1x")] * 3
    items = [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "!!"), (None, "été 1X gamma"), (4, "nowhere"), (5, "ALPHA")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "rank": F.lit(1), "n": F.lit(2), "item_id": F.lit(3)}).repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    want = brute_force(docs, items, 9)
    for block_bytes in (4 << 20, 20):
        got = search.ranked_search(d, q, 9, block_bytes=block_bytes)
        assert sorted(map(tuple, got.collect()), key=str) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert search.ranked_search(empty, q).collect() == []
    assert search.ranked_search(d, q.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 50)), max_size=5), min_size=1, max_size=12), st.integers(1, 160), st.sets(st.integers(0, 5), min_size=1))
def test_wand_skips_nothing_that_reaches_the_threshold(docs, threshold, asked):
    docs = [sorted(dict(d).items()) for d in docs]
    flat = [(t, i, x) for i, d in enumerate(docs) for t, x in d]
    columns = [np.array([f[k] for f in flat], np.int64) for k in range(3)]
    shard = search.Shard(list(range(len(docs))), *columns, 6)
    found, score = shard.search(np.array(sorted(asked)), threshold)
    sums = {i: sum(x for t, x in d if t in asked) for i, d in enumerate(docs)}
    assert dict(zip(found.tolist(), score.tolist(), strict=True)) == {i: s for i, s in sums.items() if s >= threshold}


def test_impacts_beyond_64_bits_of_the_product():
    n, tf, w = np.array([10**7, 3]), np.array([5, 1]), np.array([9000, 9000])
    got = search.impacts(w, tf, n, 5 * 10**10, 2 * 10**13)
    assert got.tolist() == [9000 * (10**9 * t // (1000 * t + 20 * (50 + 50 * int(k) * 5 * 10**10 // (2 * 10**13)))) for k, t in zip(n, tf.tolist(), strict=True)]
