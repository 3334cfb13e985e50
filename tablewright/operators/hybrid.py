"""Hybrid, vector-only and BM25-only retrieval with chunk fields and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.bm25 import Bm25Index, bm25_search
from tablewright.operators.groups import small_side
from tablewright.operators.ranking import RRF_K, rrf_fuse
from tablewright.operators.vectors import vector_search
from tablewright.runtime import scratch_table

TOP_K = 5


def _wanted(source_filter: str | None, type_filter: str | None) -> Column:
    keep = F.lit(True)
    if source_filter:
        keep = keep & F.coalesce(F.col("source").contains(source_filter), F.lit(False))
    if type_filter:
        keep = keep & F.coalesce(F.col("cell_type") == type_filter, F.lit(False))
    return keep


def _with_chunks(
    hits: DataFrame, chunks: DataFrame, k: int, source_filter: str | None, type_filter: str | None, order: list[Column]
) -> DataFrame:
    """Join chunk fields to hits, filter after the search cut-off, and keep ``k`` per query.

    The hits (at most three times ``k`` per query and list) are written first and counted, so that they go to the
    chunk texts and the texts stay where they are. Fewer than ``k`` rows may be left.
    """
    found = small_side(scratch_table(hits, "hits"))
    joined = chunks.withColumnRenamed("chunk_id", "__id").join(found, F.col("chunk_id") == F.col("__id"))
    kept = joined.where(_wanted(source_filter, type_filter))
    best = Window.partitionBy("query_id").orderBy(*order)
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    fields = ["code", "source", "cell_index", "cell_type", "heading"]
    return ranked.select("query_id", "rank", "chunk_id", "score", "bm25_score", "semantic_score", *fields)


def hybrid_search(
    index: Bm25Index,
    vectors: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    source_filter: str | None = None,
    type_filter: str | None = None,
    rrf_k: int = RRF_K,
) -> DataFrame:
    """BM25 and vector lists fused by reciprocal rank.

    ``queries`` has ``query_id, q, embedding``; ``vectors`` has ``chunk_id, embedding``. Equal scores are ordered by
    BM25 rank, then vector rank, then id.
    """
    wide = k * 3 if source_filter or type_filter else k * 2
    fused = rrf_fuse(bm25_search(index, queries, wide), vector_search(vectors, queries, wide), rrf_k)
    fused = fused.withColumns(
        {
            "bm25_score": F.coalesce("bm25_score", F.lit(0.0)),
            "semantic_score": F.coalesce("semantic_score", F.lit(0.0)),
            "tied": F.round("score", 12),
        }
    )
    order = [F.desc("tied"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("semantic_rank"), F.asc("chunk_id")]
    return _with_chunks(fused, chunks, k, source_filter, type_filter, order)


def semantic_search(
    vectors: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    source_filter: str | None = None,
    type_filter: str | None = None,
) -> DataFrame:
    wide = k * 2 if source_filter or type_filter else k
    hits = vector_search(vectors, queries, wide).withColumnRenamed("rank", "found")
    scored = hits.withColumns({"bm25_score": F.lit(0.0), "semantic_score": F.col("score")})
    return _with_chunks(scored, chunks, k, source_filter, type_filter, [F.asc("found")])


def bm25_only_search(
    index: Bm25Index,
    chunks: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    source_filter: str | None = None,
    type_filter: str | None = None,
) -> DataFrame:
    wide = k * 2 if source_filter or type_filter else k
    hits = bm25_search(index, queries, wide).withColumnRenamed("rank", "found")
    scored = hits.withColumns({"bm25_score": F.col("score"), "semantic_score": F.lit(0.0)})
    return _with_chunks(scored, chunks, k, source_filter, type_filter, [F.asc("found")])
