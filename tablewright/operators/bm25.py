"""Okapi BM25 over a chunk table, for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import raw_tokens, tokenize
from tablewright.operators.ranking import STEP_TOKENS, QueryTerms, RunningTopK, hit_schema, per_query_block, steps, top_k
from tablewright.runtime import scratch_table, spread

# Term saturation, length normalisation, and the share of the mean idf given to very common tokens.
K1 = 1.5
B = 0.75
EPSILON = 0.25


def term_index(chunks: DataFrame, key: str = "chunk_id", text: str = "code") -> DataFrame:
    """``(chunk_id, tokens)``: the tokens of each chunk, in order. Row-local; write it once and search it often."""
    texts = spread(chunks.select(F.col(key).alias("chunk_id"), F.col(text).alias("text")))
    return texts.select("chunk_id", tokenize(F.col("text")).alias("tokens"))


def term_frequencies(index: DataFrame) -> DataFrame:
    """``(chunk_id, token, tf)``."""
    return index.select("chunk_id", F.explode("tokens").alias("token")).groupBy("chunk_id", "token").agg(
        F.count("*").alias("tf")
    )


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: number of chunks and mean length."""
    return index.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_length"))


def document_frequencies(index: DataFrame) -> DataFrame:
    """``(token, df)``. Each chunk sends a token once, and counts are combined before the shuffle."""
    return index.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def with_idf(words: DataFrame, n_docs: int) -> DataFrame:
    """Add ``idf``; a negative value becomes a share of the mean over all tokens. ``words`` is read twice."""
    raw = F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    floor = words.agg(F.avg(raw)).first()[0]
    return words.withColumn("idf", F.when(raw < 0, F.lit(EPSILON * (floor or 0.0))).otherwise(raw))


@dataclass
class Bm25Index:
    """Token lists, vocabulary and corpus size, as written tables."""

    terms: DataFrame
    words: DataFrame
    n_docs: int
    avg_length: float

    @classmethod
    def build(cls, chunks: DataFrame, key: str = "chunk_id", text: str = "code") -> Bm25Index:
        terms = scratch_table(term_index(chunks, key, text), "terms")
        size = corpus_stats(terms).first()
        words = with_idf(scratch_table(document_frequencies(terms), "words"), size["n_docs"])
        return cls(terms, words, size["n_docs"], size["avg_length"] or 0.0)

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        size = self.terms.sparkSession.createDataFrame(
            [(self.n_docs, float(self.avg_length))], "n_docs bigint, avg_length double"
        )
        size.write.mode("overwrite").parquet(f"{path}/size")

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        size = spark.read.parquet(f"{path}/size").first()
        return cls(
            spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/words"), size["n_docs"], size["avg_length"]
        )


def bm25_search(index: Bm25Index, queries: DataFrame, k: int, key: str = "query_id", text: str = "q") -> DataFrame:
    """Top ``k`` chunks with a positive score per query: ``(query_id, chunk_id, rank, score)``.

    Chunks are scored where they lie: a task gets the weights of the query tokens, multiplies them with the term
    frequencies of its chunks and keeps its best ``k`` per query. Neither postings nor (query, chunk) pairs are
    shuffled, so a token that occurs in a third of all chunks costs no more than any other.
    """
    weighted = (
        queries.select(F.col(key).alias("query_id"), F.explode(raw_tokens(F.col(text))).alias("token"))
        .select("query_id", F.lower("token").alias("token"))
        .groupBy("query_id", "token")
        .agg(F.count("*").alias("uses"))
        .join(index.words.select("token", "idf"), "token")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("token", (F.col("idf") * F.col("uses")).alias("w"))).alias("weights"))
    )
    types = dict(weighted.dtypes)["query_id"], dict(index.terms.dtypes)["chunk_id"]

    def search(block: pd.DataFrame) -> DataFrame:
        return index.terms.mapInArrow(_scorer(block, k, index.avg_length), hit_schema(*types))

    return top_k(per_query_block(weighted, "query_id", search, F.size("weights")), k)


def _scorer(block: pd.DataFrame, k: int, avg_length: float):
    query_ids = block["query_id"].to_numpy()
    asked = QueryTerms([{t["token"]: t["w"] for t in row} for row in block["weights"]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known = RunningTopK(k, positive_only=True), pa.array(asked.terms, pa.string())
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False)
            for low, high in steps(sizes, STEP_TOKENS, asked.rows_per_step()):
                some, lengths = batch.slice(low, high - low), sizes[low:high]
                lists, ids = some.column("tokens"), some.column("chunk_id").to_numpy(zero_copy_only=False)
                damp = K1 * (1 - B + B * lengths / (avg_length or 1.0))
                owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                word = pc.fill_null(pc.index_in(pc.list_flatten(lists), known), -1).to_numpy(zero_copy_only=False)
                pair = owner[word >= 0].astype(np.int64) * len(known) + word[word >= 0]
                pair, tf = np.unique(pair, return_counts=True)
                owner, word = np.divmod(pair, max(len(known), 1))
                value = tf * (K1 + 1) / (tf + damp[owner])
                best.add(asked.scores(len(ids), owner, word, value), ids)
        for rows in best.rows(query_ids):
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return score
