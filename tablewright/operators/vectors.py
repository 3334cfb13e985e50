"""Exact inner-product search over a vector table, for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.operators.ranking import STEP_CELLS, RunningTopK, hit_schema, per_query_block, top_k


def fill_vectors(df: DataFrame, name: str, dim: int) -> DataFrame:
    """Zero vector where the embedding is missing."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.withColumn(name, F.coalesce(col(name), zeros))


def vector_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "chunk_id",
    embedding: str = "embedding",
    query_key: str = "query_id",
    query_embedding: str = "embedding",
) -> DataFrame:
    """Top ``k`` rows per query by inner product with the L2-normalised rows: ``(query_id, chunk_id, rank, score)``.

    Every score is computed, as the exact search asks; but as a matrix product inside each task, which hands on its
    best ``k`` per query and never a pair per query and row. Query vectors are used as they are. A null vector fails the job:
    fill it first, or leave its row out.
    """

    def known(name: str) -> Column:
        missing = F.raise_error(F.lit(f"{name} holds a null vector")).cast("array<float>")
        return F.when(col(name).isNull(), missing).otherwise(col(name).cast("array<float>")).alias("v")

    corpus = vectors.select(col(key).alias("chunk_id"), known(embedding))
    asked = queries.select(col(query_key).alias("query_id"), known(query_embedding))
    types = dict(asked.dtypes)["query_id"], dict(corpus.dtypes)["chunk_id"]

    def search(block: pd.DataFrame) -> DataFrame:
        if not len(block):
            return corpus.sparkSession.createDataFrame([], hit_schema(*types))
        return corpus.mapInArrow(_scorer(block, k), hit_schema(*types))

    return top_k(per_query_block(asked, "query_id", search), k)


def _scorer(block: pd.DataFrame, k: int):
    query_ids = block["query_id"].to_numpy()
    weights = np.stack([np.asarray(v, dtype=np.float64) for v in block["v"]]).T

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = RunningTopK(k, positive_only=False)
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, STEP_CELLS // max(1, weights.shape[1]))
            for low in range(0, batch.num_rows, step):
                some = batch.slice(low, step)
                ids = some.column("chunk_id").to_numpy(zero_copy_only=False)
                flat = pc.list_flatten(some.column("v")).to_numpy(zero_copy_only=False).astype(np.float64)
                rows = flat.reshape(len(ids), weights.shape[0])
                norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                best.add((rows / np.where(norm > 0, norm, 1.0)) @ weights, ids)
        for rows in best.rows(query_ids):
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return score
