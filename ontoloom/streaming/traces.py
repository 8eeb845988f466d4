"""Trace assignment in batches and streams, replays, windowed counts and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ontoloom.operators import trace_sets
from ontoloom.operators.trace_sets import HOUR_MS, TRACES

__all__ = ["HOUR_MS", "assign_traces", "assign_traces_stream", "ingest", "windowed_counts", "without_replays"]

#: The batch form: agent_id, event_id, ts_ms, session_id, trace_id, created. The rules are those of operators.trace_sets.
assign_traces = trace_sets.assign


def _read(spark, path: str) -> DataFrame:
    """The table at path, or one without rows where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(TRACES).parquet(path)
    return spark.createDataFrame([], TRACES)


def assign_traces_stream(events: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that assigns a stream's events by micro-batches: rows go to <folder>/assigned, by batch, and what later batches need to <folder>/state.

    A micro-batch is resolved as a set after the traces of all before it, so batches in order of time give what assign_traces gives for all rows at
    once. The state has a row per session and one per agent of the last hour, in place of a state per key: a session's trace depends on its
    agents' traces and these on other sessions, so no single key holds both. A replayed batch reads the state before it and writes
    its own rows and state anew. Set a checkpoint and a trigger, then start it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _read(spark, f"{folder}/state/{number - 1}")
        assigned, new = trace_sets.resolve(batch, before)
        assigned.write.mode("overwrite").parquet(f"{folder}/assigned/batch={number}")
        trace_sets.carried(before, new).coalesce(8).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return events.writeStream.foreachBatch(write)


def without_replays(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream without repeated log ids within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["log_id"])


def windowed_counts(events: DataFrame, width: str, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def ingest(events: DataFrame, path: str, checkpoint: str, seconds: int = 10):
    """Appends a stream of events to a table, by micro-batches; offsets advance only when a batch is written."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
