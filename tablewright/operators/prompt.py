"""Search hits as text: prompt context and listings, one text per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording and layout of both texts.
CONTEXT_TITLE = "=== RELEVANT CODE EXAMPLES ===\n"
CONTEXT_EMPTY = "No relevant code examples found."
CONTEXT_EXAMPLE = "### Example %d: [%s%s] (score: %s)\n```python\n%s\n```\n"
CONTEXT_CUT = "\n... (truncated)"
LISTING_TITLE = "=== RAG Search Results (query: %s) ===\nFound: %d results\n"
LISTING_HIT = "[%d] Source: %s | Score: %s\n    Code: %s\n"


def _three_decimals(name: str) -> Column:
    return F.format_string("%.3f", F.col(name))


def _in_rank_order(hits: DataFrame, line: Column) -> DataFrame:
    """One row per query with its lines in rank order; a query has at most ``k`` hits."""
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("h"))
    return listed.select(F.col("query_id").alias("__q"), F.transform("h", lambda h: h["line"]).alias("lines"))


def prompt_context(queries: DataFrame, hits: DataFrame, max_chunks: int = 5, max_chars: int = 500) -> DataFrame:
    """``(query_id, context)`` for every query, also those without hits."""
    cut = F.concat(F.left("code", F.lit(max_chars)), F.lit(CONTEXT_CUT))
    shown = F.when(F.length("code") > max_chars, cut).otherwise(F.col("code"))
    heading = F.when(F.col("heading") != "", F.concat(F.lit(" - "), "heading")).otherwise("")
    line = F.format_string(CONTEXT_EXAMPLE, "rank", "source", heading, _three_decimals("score"), shown)
    listed = _in_rank_order(hits.where(F.col("rank") <= max_chunks), line)
    text = F.concat(F.lit(CONTEXT_TITLE + "\n"), F.array_join("lines", "\n"))
    joined = queries.join(listed, F.col("query_id") == F.col("__q"), "left")
    return joined.select("query_id", F.coalesce(text, F.lit(CONTEXT_EMPTY)).alias("context"))


def result_listing(queries: DataFrame, hits: DataFrame, preview_chars: int = 200, text: str = "q") -> DataFrame:
    """``(query_id, listing, results_count)`` for every query."""
    cut = F.concat(F.left("code", F.lit(preview_chars)), F.lit("..."))
    preview = F.when(F.length("code") > preview_chars, cut).otherwise(F.col("code"))
    listed = _in_rank_order(hits, F.format_string(LISTING_HIT, "rank", "source", _three_decimals("score"), preview))
    joined = queries.join(listed, F.col("query_id") == F.col("__q"), "left")
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    title = F.format_string(LISTING_TITLE, F.col(text), F.size(lines))
    return joined.select(
        "query_id",
        F.array_join(F.concat(F.array(title), lines), "\n").alias("listing"),
        F.size(lines).cast("bigint").alias("results_count"),
    )
