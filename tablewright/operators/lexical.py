"""Plain substring scoring, the search that needs no index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.groups import small_side
from tablewright.operators.ranking import STEP_CHARS, QueryTerms, RunningTopK, hit_schema, per_query_block, steps, top_k
from tablewright.runtime import scratch_table, spread

PREVIEW_CHARS = 300


def _finder(tokens: list[str]):
    """``text -> [(token number, occurrences)]``, occurrences of a token not overlapping each other."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [(i, text.count(t)) for i, t in enumerate(tokens) if t in text]

    machine = ahocorasick.Automaton()
    for i, t in enumerate(tokens):
        machine.add_word(t, i)
    machine.make_automaton()
    length = [len(t) for t in tokens]

    def find(text: str) -> list[tuple[int, int]]:
        count: dict[int, int] = {}
        free: dict[int, int] = {}  # first position the next occurrence may start at
        for end, i in machine.iter(text):
            if end - length[i] + 1 >= free.get(i, 0):
                count[i], free[i] = count.get(i, 0) + 1, end + 1
        return list(count.items())

    return find


def lexical_search(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 3,
    type_filter: str | None = None,
    key: str = "query_id",
    text: str = "q",
) -> DataFrame:
    """Top ``k`` chunks per query by how often its blank-separated words occur in them, as substrings.

    Each text is scanned once for the words of all queries together; a task keeps its best ``k`` per query.
    """
    pool = chunks.where(F.col("cell_type") == type_filter) if type_filter else chunks
    texts = spread(pool.select("chunk_id", "code")).select("chunk_id", F.lower(F.coalesce("code", F.lit(""))).alias("body"))
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    asked = queries.select(F.col(key).alias("query_id"), words.alias("words")).where(F.size("words") > 0)
    types = dict(asked.dtypes)["query_id"], dict(texts.dtypes)["chunk_id"]

    def search(block: pd.DataFrame) -> DataFrame:
        return texts.mapInArrow(_scorer(block, k), hit_schema(*types))

    hits = small_side(scratch_table(top_k(per_query_block(asked, "query_id", search, F.size("words")), k), "hits"))
    joined = pool.withColumnRenamed("chunk_id", "__id").join(hits, F.col("chunk_id") == F.col("__id"))
    preview = F.left(F.coalesce("code", F.lit("")), F.lit(PREVIEW_CHARS)).alias("preview")
    return joined.select(
        "query_id", (F.col("rank") + 1).alias("rank"), "chunk_id", "source", "cell_index", "cell_type", "heading", "score",
        preview,
    )


def _scorer(block: pd.DataFrame, k: int):
    query_ids = block["query_id"].to_numpy()
    asked = QueryTerms([Counter(words) for words in block["words"]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, find = RunningTopK(k, positive_only=True), _finder(asked.terms)
        for batch in batches:
            # Only the texts of one step are Python strings at a time, and only its hits Python numbers.
            sizes = pc.utf8_length(batch.column("body")).to_numpy(zero_copy_only=False)
            for low, high in steps(sizes, STEP_CHARS, asked.rows_per_step()):
                some = batch.slice(low, high - low)
                hits = [(row, *hit) for row, body in enumerate(some.column("body").to_pylist()) for hit in find(body)]
                owner, term, n = np.array(hits, dtype=np.int64).reshape(-1, 3).T
                best.add(asked.scores(some.num_rows, owner, term, n), some.column("chunk_id").to_numpy(zero_copy_only=False))
        for rows in best.rows(query_ids):
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return score
