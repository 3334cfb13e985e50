"""A stored table that grows by upsert: rows lie in buckets by the hash of their key, and a batch rewrites the buckets it touches.

A batch is merged into its buckets beside the table first; a pending marker then names the merged rows, the buckets are replaced by dynamic partition
overwrite, and the commit marker takes the pending one's place. A job that dies in between leaves the pending marker, and the next
batch, or :func:`recover`, replaces the same buckets once more before anything else happens.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.runtime import scratch_path
from tablewright.sources.chunks import upsert

BUCKETS = 256
_LAYOUT, _PENDING, _COMMIT = "about/layout.json", "about/pending.json", "about/commit.json"


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _read(spark: SparkSession, path: str) -> dict | None:
    files, place = _file(spark, path)
    if not files.exists(place):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _write(spark: SparkSession, path: str, content: dict) -> None:
    files, place = _file(spark, path)
    out = files.create(place, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def _bucket(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def recover(spark: SparkSession, path: str) -> None:
    """Finish a batch that was interrupted while its buckets were replaced."""
    pending = _read(spark, f"{path}/{_PENDING}")
    if pending is None:
        return
    merged = spark.read.parquet(pending["merged"])
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    _write(spark, f"{path}/{_COMMIT}", {"batch": pending["batch"], "buckets": pending["buckets"]})
    files, place = _file(spark, f"{path}/{_PENDING}")
    files.delete(place, False)


def last_commit(spark: SparkSession, path: str) -> dict | None:
    """Number of the last batch and the buckets it rewrote."""
    return _read(spark, f"{path}/{_COMMIT}")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows as of the last batch; one that was interrupted is finished first."""
    recover(spark, path)
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def merged_rows(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key of rows with their buckets."""
    return upsert(batch.repartition("bucket"), key, sequence, ["bucket"])


def upsert_stored(rows: DataFrame, path: str, key: str, sequence: str, buckets: int = BUCKETS) -> dict:
    """Merge rows into the table at ``path``: the last written row per key stays (see :func:`upsert`).

    The number of buckets is fixed by the first batch. Rows with a null key are one key. An empty batch changes nothing.
    """
    spark = rows.sparkSession
    recover(spark, path)
    layout = _read(spark, f"{path}/{_LAYOUT}")
    if layout is None:
        layout = {"buckets": buckets, "key": key}
        _write(spark, f"{path}/{_LAYOUT}", layout)
    elif layout["key"] != key:
        raise ValueError(f"the table at {path} is keyed by {layout['key']}")
    last = last_commit(spark, path)
    batch = rows.withColumn("bucket", _bucket(key, layout["buckets"]))
    touched = sorted(r[0] for r in batch.select("bucket").distinct().collect())  # at most the number of buckets
    if not touched:
        return last or {"batch": 0, "buckets": []}
    if last is not None:
        held = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(touched))
        batch = batch.unionByName(held.select(batch.columns))
    merged = scratch_path(spark, "merged")
    # One shuffle: keys are merged, and written, where their buckets lie.
    merged_rows(batch, key, sequence).write.parquet(merged)
    _write(spark, f"{path}/{_PENDING}", {"batch": 1 + (last["batch"] if last else 0), "buckets": touched, "merged": merged})
    recover(spark, path)
    return last_commit(spark, path)
