"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.runtime import scratch_path

#: A side of a join is sent to every task only up to this many bytes.
BROADCAST_BYTES = 64_000_000
#: Long texts go through numpy in pieces of this many bytes.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder, read it back, and let Spark drop the shuffle files behind it.

    A step that is written is never computed again, whichever executors are lost later.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(table._written_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_or_plain(df: DataFrame, rows: int, width: int = 32) -> DataFrame:
    """Mark ``df`` for a broadcast if its rows, which the caller has counted, are few enough for their width; else leave it to a shuffle."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def within_bytes(df: DataFrame, size: F.Column, limit: int, key: str = "doc_id") -> list:
    """Rows of a table of a bounded number of rows, in the order of a hash of ``key``, as long as their sizes add up to ``limit`` at most."""
    hashed = df.withColumns({"__h": F.xxhash64(key), "__size": size.cast("long")})
    sizes = sorted((r["__h"], r["__size"] or 0) for r in hashed.select("__h", "__size").collect())
    total = 0
    for h, n in sizes:
        total += n
        if total > limit:
            # Rows with the hash at which the limit is passed stay behind together.
            return hashed.where(F.col("__h") < h).drop("__h", "__size").collect()
    return df.collect()


def map_batches(
    df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, limit: int | None = None, column: str = "text"
) -> DataFrame:
    """``mapInArrow`` with a function of one batch; with ``limit``, batches are cut so that their texts (or another column) hold about so many bytes."""

    def run(batches):
        for batch in portions(batches, limit, column) if limit else batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, pa.Table):
                    yield from out.combine_chunks().to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def portions(batches, limit: int = 8_000_000, column: str = "text"):
    """Record batches cut so that the texts of each hold about ``limit`` bytes at most, or are one text."""
    for batch in batches:
        size = batch.column(column).nbytes
        rows = batch.num_rows if size <= limit else max(1, batch.num_rows * limit // size)
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def extended(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by damped Newton steps on smoothed targets."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margins + b)
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margins**2).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
