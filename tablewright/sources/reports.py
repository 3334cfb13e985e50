"""Small result tables as JSON, and the run's event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "timestamp timestamp, agent string, event_type string, payload string"
# Fixed value: ISO time with microseconds; Spark's default keeps milliseconds only.
EVENT_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_report(report: DataFrame, path: str) -> None:
    """One JSON file; for reports of a few rows such as leaderboards and gates."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    stamped = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    stamped.write.mode("append").option("timestampFormat", EVENT_TIME).json(path)


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", EVENT_TIME).json(path)


def run_rollup(events: DataFrame, run: str, agent: str, time: str) -> DataFrame:
    """Per run and agent: number of events, first and last time, seconds between."""
    spans = events.groupBy(run, agent).agg(
        F.count("*").alias("n_events"), F.min(time).alias("started"), F.max(time).alias("ended")
    )
    seconds = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return spans.withColumn("seconds", F.round(seconds / 1e6, 4))


def first_occurrences(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return rows.groupBy(key).agg(F.min(sequence).alias("first_seen"))
