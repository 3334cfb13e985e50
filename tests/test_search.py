import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.text import tokenize
from tablewright.operators import bm25, lexical, ranking
from tablewright.operators.hybrid import hybrid_search
from tablewright.operators.lexical import lexical_search
from tablewright.operators.prompt import prompt_context
from tablewright.operators.vectors import fill_vectors, vector_search


TOKENS = [
    ("snake_case CamelCase", ["snake", "case", "camel", "case"]),
    ("HTTPServer", ["http", "server"]),
    ("sha256", ["sha"]),
    ("A1", ["a1"]),
    ("12 x", ["12", "x"]),
    ("ABc aB1C 1a2B", ["a", "bc", "a", "c", "a", "b"]),
    ("x9Y", ["x", "y"]),
    ("B2B 3D", ["b", "d"]),
    ("A1B2", ["a1b2"]),
    ("a.b-c\nd", ["a", "b", "c", "d"]),
    ("é0", ["0"]),
    ("", []),
    (None, []),
]


def test_tokenize_column(spark):
    df = spark.createDataFrame([(t,) for t, _ in TOKENS], "t string")
    assert [r[0] for r in df.select(tokenize(F.col("t"))).collect()] == [words for _, words in TOKENS]


def okapi(docs, query):
    lists = [d.split() for d in docs]
    n, mean = len(docs), np.mean([len(x) for x in lists])
    df = {w: sum(w in x for x in lists) for x in lists for w in x}
    raw = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * np.mean(list(raw.values()))
    idf = {w: floor if r < 0 else r for w, r in raw.items()}
    return [
        sum(idf[q] * x.count(q) * 2.5 / (x.count(q) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for q in query.split() if q in idf)
        for x in lists
    ]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(6)
    vocab = [f"w{chr(97 + i)}" for i in range(20)]
    docs = [" ".join(rng.choice(vocab, rng.integers(0, 30), p=np.r_[0.3, np.full(19, 0.7 / 19)])) for _ in range(60)]
    queries = [" ".join(rng.choice(vocab, 4)) for _ in range(9)]
    return docs, queries


@pytest.mark.parametrize("block_rows", [2, 1000])
def test_bm25_matches_formula(spark, corpus, monkeypatch, block_rows):
    monkeypatch.setattr(ranking, "QUERIES_PER_BLOCK", block_rows)
    docs, queries = corpus
    chunks = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "chunk_id long, code string").repartition(4)
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, q string")
    got = bm25.bm25_search(bm25.Bm25Index.build(chunks), asked, 5).orderBy("query_id", "rank").collect()
    want = []
    for i, q in enumerate(queries):
        scored = sorted((-round(s, 6), d) for d, s in enumerate(okapi(docs, q)) if round(s, 6) > 0)[:5]
        want += [(f"q{i}", d, r, -s) for r, (s, d) in enumerate(scored)]
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in got] == [w[:3] for w in want]
    assert [r["score"] for r in got] == pytest.approx([w[3] for w in want], abs=2e-6)


@pytest.mark.parametrize("ids", [[1, 1], [1, None]])
def test_queries_need_ids(spark, ids):
    queries = spark.createDataFrame([(i,) for i in ids], "query_id int")
    for block_rows in (1, 100):
        with pytest.raises(ValueError, match="null or repeated"):
            ranking.per_query_block(queries, "query_id", lambda block: None, block_rows=block_rows)


def test_sparse_products():
    rng = np.random.default_rng(10)
    weights = [{f"t{t}": float(rng.random()) for t in rng.choice(900, 300, replace=False)} for _ in range(6)]
    asked = ranking.QueryTerms(weights)
    dense = np.array([[w.get(t, 0.0) for w in weights] for t in asked.terms])
    values = np.where(rng.random((50, len(asked.terms))) < 0.3, rng.random((50, len(asked.terms))), 0)
    values[7] = 1.0  # one chunk with nearly every term
    values[20] = 0.0
    owner, term = np.nonzero(values)
    got = asked.scores(50, owner, term, values[owner, term])
    assert got == pytest.approx(values @ dense)
    assert asked.scores(3, owner[:0], term[:0], values[0, :0]).tolist() == [[0.0] * 6] * 3


def test_bm25_index_saves(spark, corpus, tmp_path):
    docs, queries = corpus
    chunks = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "chunk_id long, code string")
    asked = spark.createDataFrame([(0, queries[0])], "query_id int, q string")
    index = bm25.Bm25Index.build(chunks)
    index.save(str(tmp_path))
    again = bm25.Bm25Index.load(spark, str(tmp_path))
    assert bm25.bm25_search(again, asked, 3).collect() == bm25.bm25_search(index, asked, 3).collect()


def test_bm25_without_known_words(spark, corpus):
    chunks = spark.createDataFrame([(0, "alpha beta")], "chunk_id int, code string")
    asked = spark.createDataFrame([(0, "gamma"), (1, "")], "query_id int, q string")
    assert bm25.bm25_search(bm25.Bm25Index.build(chunks), asked, 3).count() == 0


@pytest.mark.parametrize("k", [3, 500])
def test_vector_search(spark, k):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(200, 8)).astype("float32")
    rows[5] = 0
    asked = rng.normal(size=(3, 8)).astype("float32")
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "chunk_id int, embedding array<float>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "query_id int, embedding array<float>")
    got = vector_search(table.repartition(3), queries, k).orderBy("query_id", "rank").collect()
    x = rows.astype(float)
    x = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    scores = np.round(x @ asked.astype(float).T, 6)
    for q in range(3):
        order = sorted(range(200), key=lambda d: (-scores[d, q], d))[:k]
        assert [r["chunk_id"] for r in got if r["query_id"] == q] == order


def test_null_vectors_are_refused(spark):
    table = spark.createDataFrame([(1, [1.0]), (2, None)], "chunk_id int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>")
    with pytest.raises(Exception, match="null vector"):
        vector_search(table, queries, 1).collect()
    assert vector_search(fill_vectors(table, "embedding", 1), queries, 2).count() == 2


def test_fill_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 2.0])], "id int, v array<float>")
    assert [r["v"] for r in fill_vectors(df, "v", 2).orderBy("id").collect()] == [[0.0, 0.0], [1.0, 2.0]]


def test_fusion_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, "a", 0, 9.0), (1, "b", 1, 8.0)], "query_id int, chunk_id string, rank int, score double")
    b = spark.createDataFrame([(1, "b", 0, 0.5), (1, "c", 1, 0.4)], a.schema)
    one = {r["chunk_id"]: r["score"] for r in ranking.rrf_fuse(a, b).collect()}
    two = {r["chunk_id"]: r["score"] for r in ranking.rrf_fuse(b, a).collect()}
    assert one == two == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


def test_hybrid_filters_after_the_cut(spark):
    rows = [(i, f"word{i % 3} same", f"s{i}", "code" if i == 9 else "markdown", i, None) for i in range(10)]
    chunks = spark.createDataFrame(rows, "chunk_id int, code string, source string, cell_type string, cell_index int, heading string")
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.col("chunk_id").cast("double")).alias("embedding"))
    asked = spark.createDataFrame([(0, "word", [1.0, 0.0])], "query_id int, q string, embedding array<float>")
    index = bm25.Bm25Index.build(chunks)
    assert hybrid_search(index, vectors, chunks, asked, k=1, type_filter="code").count() == 0
    assert hybrid_search(index, vectors, chunks, asked, k=4, type_filter="code").count() == 1
    assert hybrid_search(index, vectors, chunks, asked, k=2, source_filter="s0").first()["chunk_id"] == 0


@pytest.mark.parametrize("machine", [True, False])
def test_lexical_counts(machine, monkeypatch):
    if not machine:
        monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
    tokens = ["aa", "a", "aba", "b", "ab"]
    find = lexical._finder(tokens)
    for text in ["aaaaa", "ababa", "", "abaabab", "xyz"]:
        assert {i: n for i, n in find(text) if n} == {i: text.count(t) for i, t in enumerate(tokens) if t in text}


def test_lexical_search(spark):
    rows = [(1, "Pandas pandas", "a", "code"), (2, "pandas", "b", "markdown"), (3, "none", "c", "code"), (4, None, "d", "code")]
    chunks = spark.createDataFrame(rows, "chunk_id int, code string, source string, cell_type string").withColumns(
        {"cell_index": F.lit(0), "heading": F.lit(None).cast("string")}
    )
    asked = spark.createDataFrame([(0, "pandas  PANDAS"), (1, " ")], "query_id int, q string")
    got = lexical_search(chunks, asked, 3, "code").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(1, 4.0)]


def test_prompt_without_hits(spark):
    queries = spark.createDataFrame([(1, "q")], "query_id int, q string")
    hits = spark.createDataFrame([], "query_id int, rank int, source string, heading string, score double, code string")
    assert prompt_context(queries, hits).first()["context"] == "No relevant code examples found."


def test_local_top_k_keeps_the_same_rows_in_any_order():
    rng = np.random.default_rng(8)
    scores, ids = np.round(rng.random((500, 4)), 2), rng.permutation(500)
    whole, parts = ranking.RunningTopK(7, True), ranking.RunningTopK(7, True)
    whole.add(scores, ids)
    for low in range(0, 500, 13):
        parts.add(scores[low : low + 13], ids[low : low + 13])
    pd.testing.assert_frame_equal(whole.best, parts.best)


def test_steps_cover_all_rows_within_their_bounds():
    sizes = np.array([5, 0, 3, 40, 1, 1, 1, 9])
    got = list(ranking.steps(sizes, 8, 3))
    assert got == [(0, 3), (3, 4), (4, 7), (7, 8)]
    assert list(ranking.steps(np.zeros(0), 8, 3)) == []


@pytest.mark.parametrize("search", ["lexical", "bm25", "vectors"])
def test_large_batches_are_scored_in_small_steps(monkeypatch, search):
    """No product of a whole batch is held at a time, and the hits are the same."""
    import pyarrow as pa

    from tablewright.operators import bm25, lexical, vectors

    ids = pa.array(range(40), pa.int64())
    words = [["red"] * (i % 7) + ["blue"] * (i % 3) + ["x"] for i in range(40)]
    weights = {"red": 1.0, "blue": 2.5}
    if search == "lexical":
        score = lexical._scorer(pd.DataFrame({"query_id": [1], "words": [["red", "blue"]]}), 4)
        batch, place, bound = pa.RecordBatch.from_arrays([ids, pa.array([" ".join(w) for w in words])], ["chunk_id", "body"]), lexical, "STEP_CHARS"
    elif search == "bm25":
        score = bm25._scorer(pd.DataFrame({"query_id": [1], "weights": [[{"token": t, "w": w} for t, w in weights.items()]]}), 4, 4.0)
        batch, place, bound = pa.RecordBatch.from_arrays([ids, pa.array(words)], ["chunk_id", "tokens"]), bm25, "STEP_TOKENS"
    else:
        score = vectors._scorer(pd.DataFrame({"query_id": [1], "v": [[1.0, 0.5]]}), 4)
        batch, place, bound = pa.RecordBatch.from_arrays([ids, pa.array([[float(i % 7), 1.0] for i in range(40)])], ["chunk_id", "v"]), vectors, "STEP_CELLS"
    whole = pa.Table.from_batches(score(iter([batch]))).to_pylist()
    added, add = [], ranking.RunningTopK.add
    monkeypatch.setattr(place, bound, 10)
    monkeypatch.setattr(ranking.RunningTopK, "add", lambda self, scores, ids: (added.append(len(ids)), add(self, scores, ids))[1])
    assert pa.Table.from_batches(score(iter([batch]))).to_pylist() == whole and len(whole) == 4
    assert len(added) > 3 and max(added) <= 10
