"""Shared parts of batch search: query blocks, running top-k inside a task, final top-k, rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import key_bucket

QUERIES_PER_BLOCK = 500
TERMS_PER_BLOCK = 1_000_000
SCORE_DIGITS = 6
# Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60
_CELLS = 4_000_000
_ENTRIES = 2_000
#: Tokens or characters of chunks that a task looks at in one step, and cells of a dense product.
STEP_TOKENS = 500_000
STEP_CHARS = 2_000_000
STEP_CELLS = 250_000


def steps(sizes: np.ndarray, bound: int, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most ``rows`` rows and about ``bound`` in all, one row at least."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = min(low + rows, int(np.searchsorted(ends, before + bound, side="right")))
        high = max(high, low + 1)
        yield low, high
        low = high


def per_query_block(
    queries: DataFrame,
    key: str,
    search: Callable[[pd.DataFrame], DataFrame],
    terms: Column | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Run ``search`` on blocks of queries small enough to be sent to every task, and union the results.

    A block is bounded by rows and, with ``terms`` (a query's number of terms), by terms. The corpus is read once per
    block. One block is the usual case; more only for very large query batches.
    """
    block_rows = block_rows or QUERIES_PER_BLOCK
    size = queries.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), F.sum(F.lit(0) if terms is None else terms).alias("terms")
    ).first()
    if size["ids"] < size["rows"]:
        raise ValueError(f"{size['rows'] - size['ids']} rows of the queries have a null or repeated {key}")
    blocks = max(-(-size["rows"] // block_rows), -(-(size["terms"] or 0) // TERMS_PER_BLOCK))
    if blocks <= 1:
        return search(queries.toPandas())
    blocks *= 2  # hashing fills blocks unevenly
    parts = []
    for b in range(blocks):
        block = queries.where(key_bucket(F.col(key), blocks, "query-block") == b).limit(2 * block_rows + 1).toPandas()
        if len(block) > 2 * block_rows:
            raise ValueError(f"query keys in {key} repeat too often to be split into blocks")
        if len(block):
            parts.append(search(block))
    return reduce(DataFrame.unionAll, parts)


class QueryTerms:
    """Weights of the terms of a block of queries, kept sparse."""

    def __init__(self, weights: Sequence[Mapping[str, float]]):
        self.terms = sorted({t for per_query in weights for t in per_query})
        place = {t: i for i, t in enumerate(self.terms)}
        entries = sorted((place[t], q, w) for q, per_query in enumerate(weights) for t, w in per_query.items())
        self.query = np.array([e[1] for e in entries], dtype=np.int64)
        self.weight = np.array([e[2] for e in entries], dtype=np.float64)
        self.start = np.searchsorted([e[0] for e in entries], np.arange(len(self.terms) + 1))
        self.queries = len(weights)

    def _rows(self, used: np.ndarray) -> np.ndarray:
        """A row per used term and a column per query."""
        out = np.zeros((len(used), self.queries))
        many = self.start[used + 1] - self.start[used]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[used], many)
        out[np.repeat(np.arange(len(used)), many), self.query[at]] = self.weight[at]
        return out

    def scores(self, rows: int, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """``rows`` by queries: for each chunk, the sum over its terms of value times query weight.

        ``owner`` (ascending) and ``term`` name each value's chunk and term. Products are taken in small dense blocks.
        """
        out = np.zeros((rows, self.queries))
        low = 0
        while low < len(owner):
            high = low + _ENTRIES
            if high < len(owner):  # end with a whole chunk
                high = np.searchsorted(owner, owner[high])
                high = high if high > low else np.searchsorted(owner, owner[low], "right")
            chunks, row = np.unique(owner[low:high], return_inverse=True)
            used, column = np.unique(term[low:high], return_inverse=True)
            block = np.zeros((len(chunks), len(used)))
            block[row, column] = value[low:high]
            out[chunks] = block @ self._rows(used)
            low = high
        return out

    def rows_per_step(self) -> int:
        return max(1, _CELLS // max(self.queries, 1))


class RunningTopK:
    """Best ``k`` chunks per query seen by one task; memory stays at queries times ``k``."""

    def __init__(self, k: int, positive_only: bool):
        self.k, self.positive_only = k, positive_only
        self.best: pd.DataFrame | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row per chunk and a column per query."""
        scores = np.round(scores, SCORE_DIGITS)
        n = scores.shape[0]
        if n > self.k:  # all that reach the k-th best value, ties included
            floor = np.partition(scores, n - self.k, axis=0)[n - self.k]
            hits = scores >= floor[None, :]
        else:
            hits = np.ones_like(scores, dtype=bool)
        if self.positive_only:
            hits &= scores > 0
        rows, cols = np.nonzero(hits)
        found = pd.DataFrame({"q": cols, "chunk_id": ids[rows], "score": scores[rows, cols]})
        self.best = self._cut(found if self.best is None else pd.concat([self.best, found], ignore_index=True))

    def _cut(self, found: pd.DataFrame) -> pd.DataFrame:
        ordered = found.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
        return ordered.groupby("q", sort=False).head(self.k).reset_index(drop=True)

    def rows(self, query_ids: np.ndarray) -> Iterator[pd.DataFrame]:
        if self.best is not None and len(self.best):
            out = self.best
            yield pd.DataFrame({"query_id": query_ids[out["q"]], "chunk_id": out["chunk_id"], "score": out["score"]})


def hit_schema(query_type: str, chunk_type: str) -> str:
    return f"query_id {query_type}, chunk_id {chunk_type}, score double"


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """``(query_id, chunk_id, rank, score)`` with 0-based ranks; ids break ties.

    Spark cuts each partition to ``k`` rows per query before the shuffle.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = hits.withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") <= k)
    return ranked.select("query_id", "chunk_id", (F.col("__rn") - 1).alias("rank"), "score")


def rrf_fuse(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: a place adds ``1 / (k + rank + 1)``.

    The single-list scores and ranks stay as columns.
    """
    both = lexical.select("query_id", "chunk_id", "rank", "score", F.lit(True).alias("lex")).unionAll(
        semantic.select("query_id", "chunk_id", "rank", "score", F.lit(False))
    )
    lex = F.col("lex")
    return both.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k + 1) + F.col("rank"))).alias("score"),
        F.max(F.when(lex, F.col("score"))).alias("bm25_score"),
        F.max(F.when(~lex, F.col("score"))).alias("semantic_score"),
        F.max(F.when(lex, F.col("rank"))).alias("bm25_rank"),
        F.max(F.when(~lex, F.col("rank"))).alias("semantic_rank"),
    )
