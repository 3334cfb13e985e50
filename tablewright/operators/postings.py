"""BM25 over blocks of postings with upper bounds: a search reads the blocks that can still change its result.

A posting holds a chunk's impact for a token, its share of the score without the idf. Postings of a token are cut by impact into levels and, in a level, into
blocks of about ``BLOCK_ROWS``, each with its highest impact; a frequent token has many blocks, which lie in many files and tasks. A
search adds up the best blocks of each token first: the ``k``-th best of these sums is a score that the result reaches in any case. A block
is skipped if its highest impact, with the highest of all other tokens of the query, stays below it: no chunk in the block can be among the best ``k``. The
corpus is tokenised once for the index, whatever the number of queries.

Tokens and bounds are joins and aggregates. The blocks that are left are added up as matrix products, for a counted part of the queries at a time, so a
posting moves once for all of them. Chunk ids are unique; null queries have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.text import raw_tokens
from tablewright.operators.bm25 import B, K1, Bm25Index
from tablewright.operators.groups import small_side
from tablewright.operators.ranking import SCORE_DIGITS, STEP_TOKENS, QueryTerms, RunningTopK, hit_schema, per_query_block, steps, top_k
from tablewright.runtime import scratch_table

BLOCK_ROWS = 1024
LEVELS = 32
#: Scores are rounded to six decimals, so a block must be this far below the bound.
_MARGIN = 1e-5


@dataclass
class PostingIndex:
    """Blocks ``(token, level, part, top, n, postings)``, their heads without the postings, and words ``(token, idf, top)``."""

    blocks: DataFrame
    heads: DataFrame
    words: DataFrame

    @classmethod
    def build(cls, index: Bm25Index, block_rows: int = BLOCK_ROWS) -> PostingIndex:
        """From token lists; frequent tokens are dealt to parts by a hash of the chunk, so no task gathers a token."""
        lists = index.terms.select("chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
        counted = lists.groupBy("chunk_id", "token").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
        damp = K1 * (1 - B + B * F.col("length") / F.lit(index.avg_length or 1.0))
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + damp)
        level = F.floor(impact * F.lit(LEVELS / (K1 + 1))).cast("int")
        postings = scratch_table(counted.select("token", "chunk_id", impact.alias("impact"), level.alias("level")), "postings")
        sizes = postings.groupBy("token", "level").agg(F.ceil(F.count("*") / block_rows).alias("parts")).where("parts > 1")
        dealt = postings.join(small_side(scratch_table(sizes, "large_levels")), ["token", "level"], "left")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1))))
        blocks = dealt.groupBy("token", "level", "part").agg(
            F.max("impact").alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("chunk_id", "impact")).alias("postings")
        )
        # Neighbouring tokens share files, so a search skips row groups by their statistics.
        blocks = scratch_table(blocks.repartitionByRange("token", "level", "part").sortWithinPartitions("token", "level", "part"), "blocks")
        heads = blocks.select("token", "level", "part", "top", "n")
        tops = heads.groupBy("token").agg(F.max("top").alias("top"))
        return cls(blocks, heads, scratch_table(index.words.join(tops, "token").select("token", "idf", "top"), "word_tops"))


def asked_tokens(index: PostingIndex, queries: DataFrame, key: str = "query_id", text: str = "q") -> DataFrame:
    """``(query_id, token, w, reach, others)``: weight of each token, what it adds at most, and what the other tokens add at most."""
    tokens = queries.select(F.col(key).alias("query_id"), F.explode(raw_tokens(F.col(text))).alias("token"))
    uses = tokens.select("query_id", F.lower("token").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("uses"))
    weighted = uses.join(index.words, "token").withColumn("w", F.col("idf") * F.col("uses"))
    weighted = weighted.withColumn("reach", F.greatest(F.lit(0.0), F.col("w") * F.col("top")))
    whole = weighted.groupBy("query_id").agg(F.sum("reach").alias("whole"))
    return weighted.join(whole, "query_id").select("query_id", "token", "w", "reach", (F.col("whole") - F.col("reach")).alias("others"))


def _sums(index: PostingIndex, wanted: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score)`` over the wanted blocks ``(query_id, w, token, level, part)``."""
    rows = index.blocks.select("token", "level", "part", "postings").join(wanted, ["token", "level", "part"])
    parts = rows.select("query_id", "w", F.explode("postings").alias("p"))
    scores = parts.select("query_id", F.col("p.chunk_id").alias("chunk_id"), (F.col("w") * F.col("p.impact")).alias("s"))
    return scores.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score")).where("score > 0")


def kept_blocks(index: PostingIndex, asked: DataFrame, k: int) -> DataFrame:
    """``(query_id, w, token, level, part)``: the blocks that may hold one of a query's best ``k``."""
    heads = scratch_table(index.heads.join(small_side(asked), "token"), "asked_heads")
    best = Window.partitionBy("query_id", "token").orderBy(F.desc("top"), "level", "part")
    before = F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1))
    seeds = heads.where("w > 0").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    first = top_k(_sums(index, seeds.select("query_id", "w", "token", "level", "part")), k)
    # Parts of a score are lower bounds only while no token takes anything away.
    honest = asked.groupBy("query_id").agg(F.min("w").alias("least")).where("least >= 0").select("query_id")
    bounds = first.where(F.col("rank") == k - 1).join(honest, "query_id").select("query_id", F.col("score").alias("bound"))
    bounded = heads.join(small_side(bounds), "query_id", "left")
    reached = F.col("bound").isNull() | (F.col("w") * F.col("top") + F.col("others") >= F.col("bound") - _MARGIN)
    return bounded.where(reached).select("query_id", "w", "token", "level", "part")


def _scorer(block: pd.DataFrame, k: int):
    query_ids = block["query_id"].to_numpy()
    asked = QueryTerms([{t["token"]: t["w"] for t in row} for row in block["weights"]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known = RunningTopK(k, positive_only=True), pa.array(asked.terms, pa.string())
        for batch in batches:
            sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
            for low, high in steps(sizes, STEP_TOKENS, asked.rows_per_step()):
                some = batch.slice(low, high - low)
                owner = pc.list_parent_indices(some.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
                word = pc.fill_null(pc.index_in(pc.list_flatten(some.column("tokens")), known), -1).to_numpy(zero_copy_only=False)
                value = pc.list_flatten(some.column("impacts")).to_numpy(zero_copy_only=False)
                # Tokens in one order for every chunk, so that chunks alike have equal sums.
                order = np.lexsort((word, owner))
                order = order[word[order] >= 0]
                scores, ids = asked.scores(some.num_rows, owner[order], word[order], value[order]), some.column("chunk_id")
                nameless = np.flatnonzero(pc.is_null(ids).to_numpy(zero_copy_only=False))
                if len(nameless):  # the one chunk without an id, kept for all queries
                    found = np.round(scores[nameless[0]], SCORE_DIGITS)
                    hit = np.flatnonzero(found > 0)
                    if len(hit):
                        columns = [pa.array(query_ids[hit]), pa.nulls(len(hit), ids.type), pa.array(found[hit])]
                        yield pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "score"])
                    scores, ids = np.delete(scores, nameless, axis=0), ids.drop_null()
                if len(ids):
                    best.add(scores, ids.to_numpy(zero_copy_only=False))
        for rows in best.rows(query_ids):
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return score


def postings_search(index: PostingIndex, queries: DataFrame, k: int, key: str = "query_id", text: str = "q") -> DataFrame:
    """Top ``k`` chunks with a positive score per query: ``(query_id, chunk_id, rank, score)``, as ``bm25_search`` gives them.

    A block that any query of a part wants is moved once, to the tasks of its chunks, and multiplied with the weights of all queries of the part. A
    query that could do without the block only sees sums below its bound in it.
    """
    asked = scratch_table(asked_tokens(index, queries, key, text), "asked")
    wanted = scratch_table(kept_blocks(index, asked, k), "wanted")
    weighted = asked.groupBy("query_id").agg(F.collect_list(F.struct("token", "w")).alias("weights"))
    types = dict(weighted.dtypes)["query_id"], dict(index.blocks.select(F.explode("postings.chunk_id").alias("c")).dtypes)["c"]

    def search(block: pd.DataFrame) -> DataFrame:
        mine = wanted.where(F.col("query_id").isin(block["query_id"].tolist())).select("token", "level", "part").distinct()
        rows = index.blocks.select("token", "level", "part", "postings").join(small_side(mine), ["token", "level", "part"], "left_semi")
        parts = rows.select("token", F.explode("postings").alias("p")).select("token", "p.chunk_id", "p.impact")
        chunks = parts.groupBy("chunk_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("impact").alias("impacts"))
        return chunks.mapInArrow(_scorer(block, k), hit_schema(*types))

    return top_k(per_query_block(weighted, "query_id", search, F.size("weights")), k)
