"""Event logs as streams: the batch summaries, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "run_id string, intent_id string, sequence bigint, timestamp timestamp, event string, agent string, tool_name string, call_id string, status string, duration_ms double"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, max_files: int = 1000) -> DataFrame:
    """Appended JSON-line files; lines that do not parse are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", max_files).json(path)


def windowed_totals(events: DataFrame, window: str = "10 minutes", late: str = "1 hour", by: str = "agent") -> DataFrame:
    """Totals of each agent and window; state older than the watermark is dropped."""
    g = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), by)
    return g.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("duration_ms").alias("duration_ms"))


def latest_status(events: DataFrame) -> DataFrame:
    """The status of each run's latest event."""
    return events.where("status is not null").groupBy("run_id").agg(F.max_by("status", F.struct("timestamp", "sequence")).alias("status"), F.count(F.lit(1)).alias("n_events"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["run_id", "sequence"])


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Handles what has arrived and stops."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
