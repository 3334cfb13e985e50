"""Samples, hold-outs and folds from a hash of the row key.

The same key always lands on the same side, whatever the partitioning, so splits agree between jobs.
Different ``salt`` values give independent splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import key_bucket
from tablewright.operators.groups import small_side
from tablewright.operators.ordering import ROWS_PER_BUCKET, with_hash_rank

_PARTS = 10_000


def sample_fraction(df: DataFrame, key: str | None, fraction: float = 0.2, salt: str = "sample") -> DataFrame:
    """Row sample by key hash, which leaves rows with a null key out.

    Without a key it is Spark's own seeded sample, which depends on how the rows are stored.
    """
    if key is None:
        return df.sample(fraction, seed=42)
    return df.where(key_bucket(F.col(key), _PARTS, salt) < round(fraction * _PARTS))


def holdout_split(
    df: DataFrame, key: str, fraction: float = 0.2, out: str = "is_valid", salt: str = "holdout"
) -> DataFrame:
    """Mark about ``fraction`` of the rows for validation; rows with a null key train."""
    marked = key_bucket(F.col(key), _PARTS, salt) < round(fraction * _PARTS)
    return df.withColumn(out, F.coalesce(marked, F.lit(False)))


def stratified_split(
    df: DataFrame, key: str, stratum: str, fraction: float = 0.2, out: str = "is_valid",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mark exactly ``floor(fraction * rows)`` rows of every stratum for validation."""
    ranked = with_hash_rank(df, [stratum], key, "__rank", rows_per_bucket)
    sizes = small_side(df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n")))
    return (
        ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("__s")))
        .withColumn(out, F.col("__rank") <= F.floor(F.col("__n") * fraction))
        .drop("__rank", "__s", "__n")
    )


def fold_count(rows: int) -> int:
    """3 folds below 200 rows, 4 below 250, then 5."""
    return min(5, max(3, rows // 50 if rows >= 150 else 3))


def kfold_assign(df: DataFrame, key: str, folds: int | None = None, out: str = "fold") -> DataFrame:
    """Add a fold number from the key hash; rows with a null key are in fold 0."""
    folds = fold_count(df.count()) if folds is None else folds
    return df.withColumn(out, F.coalesce(key_bucket(F.col(key), folds).cast("int"), F.lit(0)))


def stratified_kfold(
    df: DataFrame, key: str, stratum: str, folds: int = 5, out: str = "fold", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Deal the rows of every stratum to the folds in turn."""
    ranked = with_hash_rank(df, [stratum], key, "__rank", rows_per_bucket)
    return ranked.withColumn(out, ((F.col("__rank") - 1) % folds).cast("int")).drop("__rank")
