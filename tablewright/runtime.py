"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES = 4 * 1024**3
_LOCAL_SHARED: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def local_session(cpus: str | int = "*", app: str = "tablewright") -> SparkSession:
    """A single-machine session, for tests and the bench."""
    parallel = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABLEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read and write, as the session names it.

    Only a local master may go without ``spark.checkpoint.dir``; it then gets a temporary folder that is
    dropped when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        folder = tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_SHARED[app] = folder
    return _LOCAL_SHARED[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Long boosting runs cut their lineage at checkpoints, for which Spark wants a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that a later one has replaced."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    if path in written:
        written.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written, once nothing reads them any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Unlike a cache this survives lost executors, and later reads still prune columns and row groups.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give heavy row-by-row work on a small input one task per core.

    A file of one row group is one task however many cores there are. Only small inputs in a few splits are moved; an input that
    already lies in half as many splits as there are cores, or is larger than ``SPREAD_BYTES``, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() <= cores // 2 else df
