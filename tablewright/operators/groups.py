"""Group aggregates, joins of aggregates, token lists and key lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col, number, per_column

MAX_FLAG_COLUMNS = 5000
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: eight for a plain value, its own length for a text, its JSON for anything nested."""
    parts = [F.lit(8 * len(df.columns))]
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(col(f.name)), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.octet_length(F.to_json(F.struct(col(f.name)))))
    return reduce(Column.__add__, parts).cast("bigint")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``df`` holds at most ``rows`` rows and about ``size`` bytes; otherwise leave the choice to Spark."""
    found = df.limit(rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["rows"] <= rows and found["size"] <= size else df


def group_mean(df: DataFrame, key: str, value: str, out: str = "mean_value") -> DataFrame:
    return df.groupBy(col(key)).agg(F.avg(number(df, value)).alias(out)).orderBy(out, key)


def group_count(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(col(key)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def joined_group_stats(df: DataFrame, key: str, means: dict[str, str], ratio: tuple[str, str, str]) -> DataFrame:
    """Per-key means of several columns and the quotient of two of them.

    Inner joins of one aggregate per column over the same table and key are one aggregate; keys that are null are
    dropped as an inner join would.
    """
    out, top, bottom = ratio
    grouped = df.where(col(key).isNotNull()).groupBy(col(key)).agg(
        *[F.avg(number(df, source)).alias(name) for name, source in means.items()]
    )
    return grouped.withColumn(out, F.try_divide(col(top), col(bottom)))


def _items(name: str, separator: str) -> Column:
    return F.split(col(name), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))


def token_counts(df: DataFrame, name: str, separator: str = ",") -> DataFrame:
    """Frequency of each item of a separated list."""
    items = df.select(F.explode(_items(name, separator)).alias("item"))
    return items.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item")


def distinct_items(df: DataFrame, name: str, separator: str = ",") -> list[str]:
    """Sorted distinct non-empty items of a separated list, refused beyond ``MAX_FLAG_COLUMNS``."""
    items = df.select(F.explode(_items(name, separator)).alias("item")).where("item <> ''").distinct()
    found = [r["item"] for r in items.limit(MAX_FLAG_COLUMNS + 1).collect()]
    if len(found) > MAX_FLAG_COLUMNS:
        raise ValueError(f"{name} holds more than {MAX_FLAG_COLUMNS} distinct items; use token_counts instead")
    return sorted(found)


def multi_hot(
    df: DataFrame, name: str, separator: str = ",", remove: bool = True, items: Sequence[str] | None = None
) -> DataFrame:
    """One 0/1 column per distinct item of a separated list.

    Rows are flagged in place: the item names are known first, so nothing is exploded or shuffled back together.
    """
    trimmed = df.withColumn(name, F.btrim(col(name), F.lit(" \t\n\r")))
    items = distinct_items(trimmed, name, separator) if items is None else items
    held = _items(name, separator)
    flags = trimmed.withColumns(
        {i: F.coalesce(F.array_contains(held, i), F.lit(False)).cast("int") for i in items}
    )
    return flags.drop(name) if remove else flags


def mean_by_flag(df: DataFrame, target: str, flags: Sequence[str]) -> DataFrame:
    """Mean target over the rows where each flag is 1, highest first."""
    goal = number(df, target)
    means = per_column(df, list(flags), lambda c: {"mean_target": F.avg(F.when(col(c) == 1, goal))})
    return means.withColumnRenamed("column_name", "flag").orderBy(F.desc_nulls_last("mean_target"), "flag")


def _keys(other: DataFrame, key: str) -> DataFrame:
    return small_side(other.select(col(key).alias("__k")).distinct())


def present_in(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(_keys(other, other_key), col(key) == F.col("__k"), "left_semi")


def absent_from(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return df.join(_keys(other, other_key), col(key) == F.col("__k"), "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, out: str, default=None) -> DataFrame:
    """Add the table's value for each key, or ``default`` where the key is unknown."""
    pairs = small_side(table.groupBy(col(table_key).alias("__k")).agg(F.max(col(value)).alias("__v")))
    found = F.col("__v") if default is None else F.coalesce(F.col("__v"), F.lit(default))
    return df.join(pairs, col(key) == F.col("__k"), "left").withColumn(out, found).drop("__k", "__v")
