"""Column-level helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGG_COLUMNS_PER_PASS = 500


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numbers and booleans; everything else counts as categorical."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude
    ]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric and c not in exclude]


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(df: DataFrame, name: str) -> Column:
    """Column as double; text that is no number, and NaN, become NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = col(name).cast("double")
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col(name).cast("double")
    elif isinstance(dtype, T.StringType):
        value = col(name).try_cast("double")
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(value), value)


def strict_number(df: DataFrame, name: str) -> Column:
    """Column as double; text that is no number fails the query."""
    return col(name).cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def per_column(df: DataFrame, names: Sequence[str], stats: Callable[[str], dict[str, Column]]) -> DataFrame:
    """One row ``(column_name, <stats>)`` per column.

    All statistics of a pass come from a single global aggregate with map-side partials; very wide tables are
    handled in passes so that generated code stays bounded.
    """
    if not names:
        raise ValueError("no columns to aggregate")
    passes = []
    for start in range(0, len(names), AGG_COLUMNS_PER_PASS):
        rows = [
            F.struct(F.lit(n).alias("column_name"), *[c.alias(s) for s, c in stats(n).items()])
            for n in names[start : start + AGG_COLUMNS_PER_PASS]
        ]
        passes.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    return reduce(DataFrame.unionByName, passes)


def key_hash(key: Column, salt: str = "") -> Column:
    """Unsigned 32-bit hash of a row key: the first eight hex digits of its md5."""
    text = key.cast("string")
    if salt:
        text = F.concat(F.lit(salt + "|"), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def key_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    return key_hash(key, salt) % F.lit(buckets)
