"""Copy-on-write keyed upsert: a folder of sorted files takes changes and rewrites only the files whose rows differ.

Join-free tagging: base rows and changes are united, one group-by over the key keeps the base struct and
``max_by`` of the change structs, and the two are compared. Ranks inside a file's key range cut what is to
be rewritten into even files. No step joins base and changes, and no key, file or range of keys is one task's
alone: the group-by combines before its shuffle, ranks are counts of range partitions plus a place within one.

The number of starting files is a parameter's (``file_rows`` is a share of the rows), so the list of files, one
row each, is small whatever the input is; it is all that the driver sees.

Defined cases: rows without a key take no part, in base and changes alike. A key that the base repeats keeps its
greatest row. Changes that tie on ``order`` are settled by their other columns, repeated changes count once.
Empty tables leave no files. Extra columns of the base are carried in every file; those of the changes are
ignored, whatever their names. Very long texts are cells like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm._work import discard, materialise, ship

#: Of ``monotonically_increasing_id``: the row's place within its partition.
PLACE_BITS = 33


@dataclass
class SortedFolder:
    """A folder of Parquet files, each a sorted range of keys; ``files``: (first key, name), ascending."""

    path: str
    schema: StructType
    key: str
    file_rows: int
    files: list[tuple[object, str]]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _names(spark: SparkSession, folder: str) -> set[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return {name for x in listed if (name := x.getPath().getName()).startswith("part-")}


def _remove(spark: SparkSession, folder: str, names: list[str]) -> None:
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def _in_order(rows: DataFrame, name: str, key: str, *within: str | Column) -> DataFrame:
    """``rows`` stored with ``part`` (a range of ``key``) and ``at`` (the place in it, by ``within``)."""
    placed = rows.repartitionByRange(key).sortWithinPartitions(*within).withColumn("at", F.monotonically_increasing_id())
    return materialise(placed.withColumn("part", F.shiftright("at", PLACE_BITS).cast("int")), name)


def _write(rows: DataFrame, row: str, target: Column, n: int, folder: str) -> None:
    """Appends each struct ``row`` to file number ``target`` of 0 to n - 1: one task streams one file, sorted by ``k``."""
    if n:
        dealt = rows.select("k", row, target.cast("int").alias("target")).repartitionById(n, "target")
        dealt.sortWithinPartitions("k").select(f"{row}.*").write.mode("append").parquet(folder)


def write_sorted(rows: DataFrame, key: str, file_rows: int, folder: str) -> SortedFolder:
    """``rows``, sorted by ``key``, as files of ``file_rows`` rows (the last: the rest) in the new ``folder``."""
    spark, schema = rows.sparkSession, rows.schema
    ship(spark)
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keyed = rows.select(F.col(key).alias("k"), whole.alias("row")).where("k IS NOT NULL").groupBy("k").agg(F.max("row").alias("row"))
    stored = _in_order(keyed, "upsert-start", "k", "k")
    counts = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each shuffle partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    if total:
        offsets = spark.createDataFrame(list(before.items()), "part int, before long")
        placed = stored.join(F.broadcast(offsets), "part")
        target = F.floor((F.col("before") + F.col("at").bitwiseAND((1 << PLACE_BITS) - 1)) / F.lit(file_rows))
        _write(placed, "row", target, -(-total // file_rows), folder)
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    discard(stored)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    firsts = spark.read.schema(schema).parquet(folder).groupBy(name.alias("name")).agg(F.min(key).alias("first")).collect()
    return SortedFolder(folder, schema, key, file_rows, sorted((r["first"], r["name"]) for r in firsts))


def home_of(firsts: list) -> Callable[[Column], Column]:
    """Number of the last file that begins at or below a key, else 0. ``firsts`` is the list of files, not data."""
    sorted_firsts = np.array(firsts, dtype=None if firsts and isinstance(firsts[0], int) else object)

    @F.pandas_udf("int")
    def home(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(sorted_firsts, keys.to_numpy(), side="right") - 1, 0).astype(np.int32))

    return home


def _plan(homes: list, file_rows: int) -> tuple[dict[int, int], int]:
    """From (home, rows, dirty), ascending: the number of each dirty home's first new file, and of all new files.

    A dirty home becomes the fewest files that hold its rows. Its first one joins the file at its left, as grown,
    if that is new too and both fit; its others cannot, since two neighbours of one home hold more than a file.
    """
    first, made, room = {}, 0, None
    for home, n, dirty in homes:
        if not dirty:
            room = None
        elif n:
            k = -(-n // file_rows)
            largest, last = -(-n // k), n // k
            joins = room is not None and largest <= room
            first[home] = made - joins
            room = (room - largest) if joins and k == 1 else file_rows - last
            made += k - joins
    return first, made


def upsert(base: SortedFolder, changes: DataFrame, order: list[str], sets: list[str], action: Callable[[Column, Column], Column]) -> list[str]:
    """Applies ``changes`` to the files of ``base`` and returns the names of the files that were rewritten away.

    Of each key the change that is greatest by ``order`` wins. ``action(change, first)`` says what it does, given the
    change's struct and the first key of the key's home: ``set`` the columns ``sets`` (nulls too; an absent key is
    inserted with its other columns null), ``delete`` or anything else, which leaves the row.
    """
    spark, key = changes.sparkSession, base.key
    ship(spark)
    rows = base.rows(spark)
    used = list(dict.fromkeys([*order, *[c for c in changes.columns if c != key and c not in order]]))
    change = F.struct(*[F.col(f"`{c}`") for c in used])
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    new = changes.select(F.col(key).cast(base.schema[key].dataType).alias("k"), change.alias("change"))
    tagged = rows.select(F.col(key).alias("k"), row.alias("base")).unionByName(new.where("k IS NOT NULL"), allowMissingColumns=True)
    merged = tagged.groupBy("k").agg(F.max("base").alias("base"), F.max_by("change", "change").alias("change"))

    firsts = [f for f, _ in base.files]
    home = home_of(firsts)(F.col("k")) if firsts else F.lit(0)
    first = F.element_at(F.array(*[F.lit(f) for f in firsts]), F.col("home") + 1) if firsts else F.lit(None).cast(base.schema[key].dataType)
    held = merged.withColumn("home", home).withColumn("does", F.when(F.col("change").isNull(), "keep").otherwise(action(F.col("change"), first)))
    old = lambda c: F.col("base")[c]
    fill = {c: F.col("change")[c] for c in sets} | {key: F.col("k")}
    made = F.struct(*[(fill[c] if c in fill else old(c)).cast(base.schema[c].dataType).alias(c) for c in rows.columns])
    after = F.when(F.col("does") == "set", made).when(F.col("does") == "delete", F.lit(None)).otherwise(F.col("base"))
    held = held.select("k", "home", after.alias("after"), F.col("base")).withColumn("differs", ~F.col("after").eqNullSafe(F.col("base"))).drop("base")
    stored = _in_order(held.where("after IS NOT NULL OR differs"), "upsert-rows", "k", "home", F.col("after").isNull(), "k")

    # a row for each range partition and each home that it meets: both are ranges of keys
    alive = F.col("after").isNotNull()
    meets = stored.groupBy("part", "home").agg(
        F.count_if(alive).alias("n"), F.min(F.when(alive, F.col("at"))).alias("start"), F.bool_or("differs").alias("dirty")
    ).collect()
    meets.sort(key=lambda r: (r["home"], r["part"]))
    count: dict[int, int] = {}
    dirty: dict[int, bool] = {}
    before = []
    for r in meets:
        before.append(count.get(r["home"], 0))
        count[r["home"]] = count.get(r["home"], 0) + r["n"]
        dirty[r["home"]] = dirty.get(r["home"], False) or r["dirty"]
    target_of, made_files = _plan([(h, count[h], dirty[h]) for h in sorted(count)], base.file_rows)
    places = []
    for r, b in zip(meets, before, strict=True):
        if dirty[r["home"]] and r["n"]:
            k = -(-count[r["home"]] // base.file_rows)
            size, larger = divmod(count[r["home"]], k)
            places.append((r["part"], r["home"], b - r["start"], size, larger, target_of[r["home"]]))
    if places:
        table = spark.createDataFrame(places, "part int, home int, shift long, size long, larger long, target long")
        ranked = stored.where(alive).join(F.broadcast(table), ["part", "home"]).withColumn("rank", F.col("at") + F.col("shift"))
        wide = F.col("larger") * (F.col("size") + 1)
        piece = F.when(F.col("rank") < wide, F.floor(F.col("rank") / (F.col("size") + 1))).otherwise(F.col("larger") + F.floor((F.col("rank") - wide) / F.greatest("size", F.lit(1))))
        _write(ranked, "after", F.col("target") + piece, made_files, base.path)
    gone = [base.files[h][1] for h in sorted(count) if dirty[h] and base.files]
    _remove(spark, base.path, gone)
    discard(stored)
    return gone


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal ``name``, with running sums and a running hash: a file is never held."""
    name, state = None, None

    def close() -> dict:
        return {"name": name, "first_id": state[0], "n_rows": state[1], "cents": state[2], "rows_crc": state[3], "ids_sha256": state[4].hexdigest()}

    out: list[dict] = []
    for batch in batches:
        names = batch.column("name")
        cuts = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)] if len(batch) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            ids = part.column("id").to_pylist()
            if (here := names[a].as_py()) != name:
                if state:
                    out.append(close())
                name, state = here, [ids[0], 0, 0, 0, hashlib.sha256()]
            state[4].update((("," if state[1] else "") + ",".join(map(str, ids))).encode())
            state[1] += len(ids)
            state[2] += pc.sum(part.column("cents")).as_py()
            state[3] += pc.sum(part.column("crc")).as_py()
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, _DIGEST)
            out = []
    if state:
        out.append(close())
    yield pa.RecordBatch.from_pylist(out, _DIGEST)


_DIGEST = pa.schema([("name", pa.string()), ("first_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())])


def file_report(spark: SparkSession, base: SortedFolder, cents: Column, crc: Column) -> DataFrame:
    """A row for each data file in the folder, read back from it: sums of ``cents`` and ``crc``, a hash of its ids, its columns."""
    found = spark.read.schema(base.schema).parquet(base.path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    rows = found.select(name.alias("name"), F.col(base.key).alias("id"), cents.alias("cents"), crc.alias("crc"))
    out = rows.repartition("name").sortWithinPartitions("name", "id").mapInArrow(_digests, "name string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")
    started = F.array(*[F.lit(n) for _, n in base.files]) if base.files else F.array().cast("array<string>")
    return out.select(
        "first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(found.columns)).alias("columns"),
        F.concat(F.lit(base.path + "/"), "name").alias("path"), (~F.array_contains(started, F.col("name"))).alias("rewritten"),
    )
