"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: What a Python worker keeps from task to task, by owner.
CACHES: dict[str, dict] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where none is set and all runs on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="assayer-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they run on this machine and find it by PYTHONPATH or the working folder.

    Arrow batches get a bound in bytes, unless the session has one: 10,000 long texts are no bound.
    """
    for name, value in ARROW_BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    root = Path(__file__).resolve().parents[2]
    found = {Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    context = spark.sparkContext
    if (root in found and context.master.startswith("local")) or getattr(context, "_assayer_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="assayer-")) / "assayer.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "assayer").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    context._assayer_shipped = True


def materialise(df: DataFrame, name: str, by: str | None = None, buckets: int = 0) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that lost executors cost no recomputation.

    With ``by`` the table is bucketed and sorted by that column, and joins on it read it in place.
    """
    spark = df.sparkSession
    ship(spark)
    table = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    if by:
        table = table.replace("-", "_")
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(table)
        out = spark.table(table)
        out._stored_as = table
    else:
        df.write.parquet(path, compression="zstd")
        out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``materialise`` which nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        if getattr(df, "_stored_as", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._stored_as}")
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        spark_gc(df.sparkSession)


def spark_gc(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of frames that are gone, and gives the driver's freed memory back."""
    import gc

    gc.collect()
    release()
    spark._jvm.System.gc()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on, and would hold their largest task's for all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, without other owners' ``CACHES`` and with ``release`` at its end."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())  # which returns what ``release`` trims
        for owner, cache in CACHES.items():
            if owner != keeps:
                cache.clear()
        try:
            yield from run(batches)
        finally:
            release()

    return task
