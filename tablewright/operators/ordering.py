"""Ranks, running totals and fills over a total order, without one task seeing the whole table.

A plain window with no partition key (or with a hot one) sorts everything in one task. Here the order is first
cut into buckets of bounded size, per-bucket totals give each bucket its offset, and windows run per bucket.
Bucket limits are fixed values on the driver, so a recomputed task always puts a row in the same bucket.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import key_hash
from tablewright.operators.groups import small_side

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 20_000
SAMPLED_TEXTS_PER_BUCKET = 20


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, min(MAX_BUCKETS, -(-rows // rows_per_bucket)))


def _numeric_limits(df: DataFrame, key: Column, buckets: int) -> list[float]:
    shares = [i / buckets for i in range(1, buckets)]
    known = F.when(~F.isnan(key), key)
    found = df.agg(F.approx_percentile(known, shares, max(10_000, 10 * buckets)).alias("q")).first()["q"]
    return sorted(set(found or []))


def _text_limits(df: DataFrame, key: str, buckets: int, rows: int) -> list[str]:
    wanted = SAMPLED_TEXTS_PER_BUCKET * buckets
    sampled = df.select(key).where(F.col(key).isNotNull()).sample(min(1.0, wanted / max(rows, 1)), seed=42)
    keys = sorted(r[0] for r in sampled.limit(2 * wanted).collect())
    step = max(1, len(keys) // buckets)
    return sorted(set(keys[step::step]))


def _as_number(key: str, dtype: T.DataType) -> Column:
    """A double that never decreases as the key grows; null and NaN stay what they are."""
    c = F.col(key)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_date(c.cast("date")) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    raise TypeError(f"cannot order by {key} of type {dtype.simpleString()}")


def with_order_bucket(df: DataFrame, key: str, rows: int, rows_per_bucket: int, out: str) -> tuple[DataFrame, int]:
    """Add ``out``: a bucket number that never decreases as ``key`` grows; null keys come first, in bucket 0."""
    dtype = df.schema[key].dataType
    text = isinstance(dtype, T.StringType)
    as_double = None if text else _as_number(key, dtype)
    buckets = bucket_count(rows, rows_per_bucket)
    if buckets == 1:
        return df.withColumn(out, F.lit(0)), 1
    limits = _text_limits(df, key, buckets, rows) if text else _numeric_limits(df, as_double, buckets)
    if not limits:
        return df.withColumn(out, F.lit(0)), 1
    if text:

        @F.pandas_udf("int")
        def reached(keys: pd.Series) -> pd.Series:
            return keys.map(lambda k: 0 if k is None else 1 + bisect_right(limits, k)).astype("int32")

        return df.withColumn(out, reached(F.col(key))), len(limits) + 2
    tmp = f"{out}_key"
    splits = [float("-inf"), *limits, float("inf")]  # NaN, the largest of all, has a bucket of its own after them
    placed = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep").transform(
        df.withColumn(tmp, as_double)
    )
    return placed.drop(tmp).withColumn(out, F.coalesce(F.col(out).cast("int") + 1, F.lit(0))), len(limits) + 3


def with_running_totals(
    df: DataFrame, key: str, totals: dict[str, str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add one running total per ``{new column: source column}``, over rows in ``key`` order, own row included.

    ``key`` must be unique.
    """
    placed, buckets = with_order_bucket(df, key, df.count(), rows_per_bucket, "__b")
    inside = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({out: F.sum(src).over(inside) for out, src in totals.items()})
    if buckets == 1:
        return running.drop("__b")
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__b")
        .agg(*[F.sum(src).alias(f"__{out}") for out, src in totals.items()])
        .select("__b", *[F.coalesce(F.sum(f"__{out}").over(earlier), F.lit(0)).alias(f"__{out}") for out in totals])
    )
    joined = running.join(F.broadcast(offsets), "__b")  # at most MAX_BUCKETS rows
    return joined.withColumns({out: F.col(out) + F.col(f"__{out}") for out in totals}).drop(
        "__b", *[f"__{out}" for out in totals]
    )


def with_row_index(
    df: DataFrame, key: str, name: str = "index", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """0-based position of each row in ``key`` order; ``key`` must be unique."""
    counted = with_running_totals(df.withColumn("__one", F.lit(1).cast("bigint")), key, {name: "__one"}, rows_per_bucket)
    return counted.withColumn(name, (F.col(name) - 1).cast("bigint")).drop("__one")


def with_hash_rank(
    df: DataFrame, groups: Sequence[str], key: str, name: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """1-based rank of each row inside its group, in order of the hash of ``key``.

    Groups may be huge: a group is cut by the leading part of the hash, which spreads unique keys evenly.
    """
    hashed = df.withColumn("__h", F.coalesce(key_hash(F.col(key)), F.lit(0)))  # null keys come first
    buckets = bucket_count(df.count(), rows_per_bucket)
    placed = hashed.withColumn("__b", F.floor(F.col("__h") * buckets / F.lit(2**32)).cast("int"))
    inside = Window.partitionBy(*groups, "__b").orderBy("__h", key)
    ranked = placed.withColumn(name, F.row_number().over(inside).cast("bigint"))
    if buckets > 1:
        earlier = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            placed.groupBy(*groups, "__b")
            .agg(F.count("*").alias("__n"))
            .select(*groups, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
        )
        keyed = small_side(offsets).select(
            *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__b").alias("__ob"), "__before"
        )
        same = F.col("__b") == F.col("__ob")
        for i, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
        ranked = (
            ranked.join(keyed, same)
            .withColumn(name, F.col(name) + F.col("__before"))
            .drop("__before", "__ob", *[f"__g{i}" for i in range(len(groups))])
        )
    return ranked.drop("__h", "__b")


def fill_forward(
    df: DataFrame, group: str, order: str, value: str, out: str, rows_per_chunk: int = 10_000
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, inside its group.

    ``order`` is an integer position. A long group is cut into chunks of positions: a chunk starts from the last
    value of the chunks before it, so no window sorts more than a chunk (or the short list of chunk ends).
    """
    chunked = df.withColumn("__c", F.floor(F.col(order) / rows_per_chunk))
    inside = Window.partitionBy(group, "__c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__g").orderBy("__gc").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        chunked.groupBy(F.col(group).alias("__g"), F.col("__c").alias("__gc"))
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
        .withColumn("__carry", F.last("__end", ignorenulls=True).over(earlier))
        .where(F.col("__carry").isNotNull())
        .drop("__end")
    )
    own = chunked.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    same = F.col(group).eqNullSafe(F.col("__g")) & F.col("__c").eqNullSafe(F.col("__gc"))
    return (
        own.join(ends, same, "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("__carry")))
        .drop("__c", "__g", "__gc", "__carry")
    )
