"""Code blocks, error lines and excerpts in text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.sources.chunks import stripped

# The patterns of a fenced code block and of an error line.
FENCE = r"(?s)```(?:python)?\s*\n(.*?)\n```"
ERROR = r"(?Ud)(\w+Error|\w+Exception):\s*(.+)"
UNMATCHED_CHARS = 500


def extract_code(df: DataFrame, name: str, out: str = "code") -> DataFrame:
    """All fenced blocks joined by a blank line; text without any is kept, trimmed."""
    blocks = F.regexp_extract_all(col(name), F.lit(FENCE), F.lit(1))
    return df.withColumn(out, F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")).otherwise(stripped(col(name))))


def with_error(df: DataFrame, name: str) -> DataFrame:
    """Add ``error_type`` and ``error_message``; without a match the type is null and the message the first 500 characters."""
    kind = F.regexp_extract(col(name), ERROR, 1)
    matched = kind != ""
    message = F.when(matched, stripped(F.regexp_extract(col(name), ERROR, 2))).otherwise(
        F.when(col(name) != "", F.left(col(name), F.lit(UNMATCHED_CHARS)))
    )
    return df.withColumns({"error_type": F.when(matched, kind), "error_message": message})


def error_counts(df: DataFrame, name: str) -> DataFrame:
    return with_error(df, name).groupBy("error_type").agg(F.count("*").alias("n"))


def excerpt(df: DataFrame, name: str, head: int = 2000, tail: int = 2000) -> DataFrame:
    """Add the first ``head`` and last ``tail`` characters."""
    return df.withColumns({"head": F.left(col(name), F.lit(head)), "tail": F.right(col(name), F.lit(tail))})
