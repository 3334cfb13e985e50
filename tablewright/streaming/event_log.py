"""The event log as a file stream: the same rollup as in batch, kept up to date as events are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.runtime import scratch_path
from tablewright.sources.reports import EVENT_SCHEMA, EVENT_TIME, run_rollup


def follow_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("timestampFormat", EVENT_TIME)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def rollup_to_table(events: DataFrame, out: str, checkpoint: str | None = None, run: str = "event_type", agent: str = "agent"):
    """Start a query that reads what the log holds, rewrites the rollup at ``out`` per batch, and stops.

    Counts and time limits per run and agent are the whole state. Restarting with the same ``checkpoint`` goes on
    after the last finished batch.
    """
    checkpoint = checkpoint or scratch_path(events.sparkSession, "rollup-state")

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream = run_rollup(events, run, agent, "timestamp").writeStream.outputMode("complete").foreachBatch(replace)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_windows(events: DataFrame, delay: str = "1 hour", length: str = "1 day", event_id: str | None = None) -> DataFrame:
    """Events per window, event type and agent, each window once it has closed.

    A window closes when the watermark, the latest time seen less ``delay``, passes its end; its state is dropped then. Events that come later than that
    are left out. With ``event_id`` a repeated event counts once, as long as its copies are no further apart than ``delay``.
    """
    timed = events.withWatermark("timestamp", delay)
    if event_id is not None:
        timed = timed.dropDuplicatesWithinWatermark([event_id])
    windows = timed.groupBy(F.window("timestamp", length).alias("w"), "event_type", "agent")
    counted = windows.agg(F.count("*").alias("n_events"), F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "agent", "n_events", "started", "ended")


FIRST_SEEN = "key string, first_time timestamp, last_time timestamp, n_seen long"


def first_occurrences_stream(events: DataFrame, key: str, delay: str = "1 hour", idle: str = "1 day") -> DataFrame:
    """``(key, first_time, last_time, n_seen)`` of each spell of a key; a spell ends when the key is not seen for ``idle``.

    A spell is handed on once the watermark has passed its end, and its state, two times and a count, is dropped. Events behind the watermark are left out; the order
    of the others, and the batches they come in, do not matter.
    """
    timed = events.withWatermark("timestamp", delay)
    spells = timed.groupBy(F.session_window("timestamp", idle).alias("s"), F.col(key).cast("string").alias("key"))
    times = F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")
    return spells.agg(*times, F.count("*").alias("n_seen")).select("key", "first_time", "last_time", "n_seen")


def append_to_table(stream: DataFrame, out: str, checkpoint: str | None = None):
    """Start a query that reads what there is, appends finished rows to parquet files at ``out`` exactly once, and stops."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream-state")
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(out)
