"""Row cleaning and simple derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, is_missing, number


def clean_rows(
    df: DataFrame,
    fill: Mapping[str, object] | None = None,
    required: Sequence[str] = (),
    keep: Column | None = None,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Fill constants, drop rows missing a required column or failing ``keep``, drop columns, sort the rest by name."""
    filled = df.fillna(dict(fill)) if fill else df
    for name in required:
        filled = filled.where(~is_missing(filled, name))
    if keep is not None:
        filled = filled.where(keep)
    return filled.select(*[col(c) for c in sorted(set(filled.columns) - set(drop))])


def coerce_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace columns by their value as double; text that is no number becomes null."""
    return df.withColumns({n: number(df, n) for n in names})


def map_flags(df: DataFrame, name: str, values: Mapping[str, int]) -> DataFrame:
    """Map listed values to numbers; unlisted values become null."""
    mapped = None
    for text, flag in values.items():
        hit = col(name) == F.lit(text)
        mapped = F.when(hit, F.lit(flag)) if mapped is None else mapped.when(hit, F.lit(flag))
    return df.withColumn(name, mapped)


def add_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``{new: (top, bottom)}`` quotients; a zero bottom gives null."""
    return df.withColumns(
        {new: F.try_divide(number(df, top), number(df, bottom)) for new, (top, bottom) in ratios.items()}
    )


def capped_bins(df: DataFrame, name: str, out: str, width: float = 1.5, cap: int = 5) -> DataFrame:
    """Bin number ``ceil(x / width)``, at most ``cap``."""
    return df.withColumn(out, F.least(F.ceil(number(df, name) / width), F.lit(cap)).cast("double"))


def replace_value(df: DataFrame, name: str, old: str, new: str) -> DataFrame:
    return df.withColumn(name, F.when(col(name) == old, F.lit(new)).otherwise(col(name)))
