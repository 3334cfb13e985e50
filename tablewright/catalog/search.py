"""Retrieval over documents, for every benchmark text as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import query, rounded, table, using, view
from tablewright.operators import bm25 as B
from tablewright.operators import hybrid as H
from tablewright.operators.lexical import lexical_search
from tablewright.operators.postings import PostingIndex, postings_search
from tablewright.operators.prompt import prompt_context, result_listing
from tablewright.operators.ranking import rrf_fuse
from tablewright.operators.vectors import fill_vectors, vector_search

DIM = 64


def _tokens_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name(key, token)``. RE2 has no lookahead, so word limits are marked by blanks first."""
    words = (
        "regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(p, '[A-Z]([0-9])', '\\1', 'g'), "
        "'([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+')"
    )
    return f"""{name} as (select {key}, lower(unnest(case when len(f) = 0 then [p] else f end)) as token from (
        select {key}, p, {words} as f from (select {key}, unnest(string_split_regex({text}, '[^a-zA-Z0-9]+')) as p
        from {source}) where p <> ''))"""


_POSTINGS = (
    using("fx_chunks", "fx_queries")
    + ", "
    + _tokens_sql("tok", "fx_chunks", "chunk_id", "code")
    + """, post as (select chunk_id, token, count(*) as tf from tok group by chunk_id, token),
    dl as (select chunk_id, sum(tf) as dl from post group by chunk_id),
    size as (select (select count(*) from fx_chunks) as n, (select count(*) from tok) / (select count(*) from fx_chunks) as avgdl),
    raw as (select token, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as r from post, size group by token),
    words as (select token, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw)"""
)


def _bm25_sql(k: int) -> str:
    return (
        ", "
        + _tokens_sql("qtok", "fx_queries", "query_id", "q")
        + f""", bm as (select query_id, chunk_id, round(sum(idf * uses * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
        from (select query_id, token, count(*) as uses from qtok group by query_id, token) join words using (token)
        join post using (token) join dl using (chunk_id), size group by query_id, chunk_id),
        lex as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id
          order by score desc, chunk_id) - 1 as rank from bm where score > 0) where rank < {k})"""
    )


def _vector_sql(k: int) -> str:
    zero = f"list_value({', '.join(['0.0'] * DIM)})"
    return f""", vec as (select doc_id as chunk_id, coalesce(cast(embedding as double[]), {zero}) as v from documents
        left join embeddings on vec_id = doc_id),
        qvec as (select item_id as query_id, coalesce(cast(embedding as double[]), {zero}) as v from benchmark
        left join embeddings on vec_id = item_id),
        ip as (select query_id, chunk_id, round(list_dot_product(vec.v, qvec.v) / case when list_dot_product(vec.v, vec.v) > 0
          then sqrt(list_dot_product(vec.v, vec.v)) else 1 end, 6) as score from vec, qvec),
        sem as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id
          order by score desc, chunk_id) - 1 as rank from ip) where rank < {k})"""


_FUSED = """, fused as (select query_id, chunk_id, sum(1.0 / (61 + rank)) as score, max(case when l then s end) as bs,
    max(case when not l then s end) as ss, max(case when l then rank end) as br, max(case when not l then rank end) as sr
    from (select query_id, chunk_id, rank, score as s, true as l from lex union all
          select query_id, chunk_id, rank, score, false from sem) group by query_id, chunk_id)"""
_FIELDS = "code, source, cell_index, cell_type, heading"


def _hits_sql(source: str, order: str, keep: str, k: int, bm: str, sem: str) -> str:
    return f""", hits as (select * from (select query_id, row_number() over (partition by query_id order by {order}) as rank,
        chunk_id, score, {bm} as bm25_score, {sem} as semantic_score, {_FIELDS}
        from {source} join fx_chunks using (chunk_id) where {keep}) where rank <= {k})"""


def _index(spark, sf_dir) -> B.Bm25Index:
    return B.Bm25Index.build(view(spark, sf_dir, "fx_chunks"))


def _vectors(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"))
    return fill_vectors(docs.join(embeddings, F.col("chunk_id") == F.col("vec_id"), "left"), "embedding", DIM)


def _queries(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = view(spark, sf_dir, "fx_queries")
    found = queries.join(embeddings, F.col("query_id") == F.col("vec_id"), "left").drop("vec_id")
    return fill_vectors(found, "embedding", DIM)  # a query without a vector has the zero vector


@query(
    "tokenize",
    _POSTINGS + " select chunk_id, token, tf from post",
)
def tokens(spark, sf_dir):
    return B.term_frequencies(B.term_index(view(spark, sf_dir, "fx_chunks")))


@query(
    "bm25_stats",
    _POSTINGS + " select token, df, round(idf, 6) as idf, n as n_docs, round(avgdl, 6) as avg_length from words, size",
)
def stats(spark, sf_dir):
    index = _index(spark, sf_dir)
    words = index.words.select("token", "df", "idf").withColumns(
        {"n_docs": F.lit(index.n_docs).cast("bigint"), "avg_length": F.lit(index.avg_length)}
    )
    return rounded(words)


@query("bm25_search", _POSTINGS + _bm25_sql(10) + " select query_id, chunk_id, cast(rank as int) as rank, score from lex")
def bm25(spark, sf_dir):
    return B.bm25_search(_index(spark, sf_dir), view(spark, sf_dir, "fx_queries"), 10)


@query("postings_search", _POSTINGS + _bm25_sql(10) + " select query_id, chunk_id, cast(rank as int) as rank, score from lex")
def postings(spark, sf_dir):
    """The same search over blocks of postings, of which those that cannot reach a query's tenth score are skipped."""
    return postings_search(PostingIndex.build(_index(spark, sf_dir)), view(spark, sf_dir, "fx_queries"), 10)


@query(
    "vector_topk",
    using("fx_queries") + _vector_sql(10) + " select query_id, chunk_id, cast(rank as int) as rank, score from sem",
)
def vectors(spark, sf_dir):
    return vector_search(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10)


@query(
    "rrf_fuse",
    _POSTINGS + _bm25_sql(10) + _vector_sql(10) + _FUSED + " select query_id, chunk_id, round(score, 9) as score from fused",
)
def fuse(spark, sf_dir):
    queries = _queries(spark, sf_dir)
    lexical = B.bm25_search(_index(spark, sf_dir), queries, 10)
    fused = rrf_fuse(lexical, vector_search(_vectors(spark, sf_dir), queries, 10))
    return rounded(fused.select("query_id", "chunk_id", "score"), 9)


_HYBRID_ORDER = "round(score, 12) desc, br asc nulls last, sr asc nulls last, chunk_id"
_HITS = "select query_id, cast(rank as int) as rank, chunk_id, round(score, 9) as score, bm25_score, semantic_score, "


@query(
    "hybrid_search",
    _POSTINGS
    + _bm25_sql(15)
    + _vector_sql(15)
    + _FUSED
    + _hits_sql("fused", _HYBRID_ORDER, "contains(source, 'src1') and cell_type = 'en'", 5, "coalesce(bs, 0.0)", "coalesce(ss, 0.0)")
    + _HITS
    + _FIELDS
    + " from hits",
)
def hybrid(spark, sf_dir):
    hits = H.hybrid_search(
        _index(spark, sf_dir), _vectors(spark, sf_dir), view(spark, sf_dir, "fx_chunks"), _queries(spark, sf_dir),
        source_filter="src1", type_filter="en",
    )
    return rounded(hits, 9)


@query(
    "semantic_search",
    using("fx_chunks", "fx_queries")
    + _vector_sql(10)
    + _hits_sql("sem", "sem.rank", "cell_type = 'en'", 5, "0.0", "score")
    + _HITS
    + _FIELDS
    + " from hits",
)
def semantic(spark, sf_dir):
    return H.semantic_search(
        _vectors(spark, sf_dir), view(spark, sf_dir, "fx_chunks"), _queries(spark, sf_dir), type_filter="en"
    )


@query(
    "bm25_only_search",
    _POSTINGS
    + _bm25_sql(10)
    + _hits_sql("lex", "lex.rank", "contains(source, 'src')", 5, "score", "0.0")
    + _HITS
    + _FIELDS
    + " from hits",
)
def bm25_only(spark, sf_dir):
    return H.bm25_only_search(
        _index(spark, sf_dir), view(spark, sf_dir, "fx_chunks"), view(spark, sf_dir, "fx_queries"), source_filter="src"
    )


@query(
    "lexical_search",
    using("fx_chunks", "fx_queries")
    + """, w as (select query_id, w, count(*) as uses from (select query_id, unnest(string_split_regex(lower(q), '\\s+')) as w
      from fx_queries) where w <> '' group by query_id, w),
    n as (select w, chunk_id, (length(lower(code)) - length(replace(lower(code), w, ''))) / length(w) as n
      from (select distinct w from w), fx_chunks where cell_type = 'en' and contains(lower(code), w)),
    s as (select query_id, chunk_id, cast(sum(uses * n) as double) as score from w join n using (w) group by query_id, chunk_id)
    select query_id, cast(rank as int) as rank, chunk_id, source, cell_index, cell_type, heading, score,
      left(code, 300) as preview from (select *, row_number() over (partition by query_id order by score desc, chunk_id)
      as rank from s) join fx_chunks using (chunk_id) where rank <= 3""",
)
def lexical(spark, sf_dir):
    return lexical_search(view(spark, sf_dir, "fx_chunks"), view(spark, sf_dir, "fx_queries"), 3, "en")


_CONTEXT_HITS = (
    _POSTINGS
    + _bm25_sql(10)
    + _vector_sql(10)
    + _FUSED
    + _hits_sql("fused", _HYBRID_ORDER, "true", 5, "coalesce(bs, 0.0)", "coalesce(ss, 0.0)")
)


def _context_hits(spark, sf_dir):
    return H.hybrid_search(
        _index(spark, sf_dir), _vectors(spark, sf_dir), view(spark, sf_dir, "fx_chunks"), _queries(spark, sf_dir)
    )


@query(
    "prompt_context",
    _CONTEXT_HITS
    + """, t as (select query_id, string_agg(concat('### Example ', cast(rank as varchar), ': [', source,
        case when heading <> '' then concat(' - ', heading) else '' end, '] (score: ', printf('%.3f', score), ')', chr(10),
        '```python', chr(10), case when length(code) > 500 then concat(left(code, 500), chr(10), '... (truncated)') else code end,
        chr(10), '```', chr(10)), chr(10) order by rank) as body from hits group by query_id)
    select query_id, coalesce(concat('=== RELEVANT CODE EXAMPLES ===', chr(10), chr(10), body),
        'No relevant code examples found.') as context from fx_queries left join t using (query_id)""",
)
def context(spark, sf_dir):
    return prompt_context(view(spark, sf_dir, "fx_queries"), _context_hits(spark, sf_dir))


@query(
    "result_listing",
    _CONTEXT_HITS
    + """, t as (select query_id, count(*) as n, string_agg(concat('[', cast(rank as varchar), '] Source: ', source, ' | Score: ',
        printf('%.3f', score), chr(10), '    Code: ', case when length(code) > 200 then concat(left(code, 200), '...') else code end,
        chr(10)), chr(10) order by rank) as body from hits group by query_id)
    select query_id, concat('=== RAG Search Results (query: ', q, ') ===', chr(10), 'Found: ', cast(coalesce(n, 0) as varchar),
        ' results', chr(10), coalesce(concat(chr(10), body), '')) as listing, coalesce(n, 0) as results_count
    from fx_queries left join t using (query_id)""",
)
def listing(spark, sf_dir):
    return result_listing(view(spark, sf_dir, "fx_queries"), _context_hits(spark, sf_dir))


@query(
    "vector_fill",
    f"""select doc_id as chunk_id, cast(coalesce(embedding, list_value({', '.join(['0.0'] * DIM)})) as float[]) as embedding
    from documents left join embeddings on vec_id = doc_id""",
)
def filled(spark, sf_dir):
    return _vectors(spark, sf_dir).select("chunk_id", "embedding")
