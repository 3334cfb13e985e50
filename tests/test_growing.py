"""Tables and indexes that grow: postings with bounds, stored upserts, streams with bounded state, ordered statistics."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.operators.bm25 import Bm25Index, bm25_search
from tablewright.operators.postings import PostingIndex, asked_tokens, kept_blocks, postings_search
from tablewright.plans.boosting import Boosting
from tablewright.plans.target_stats import fit_on_categories, ordered_target_statistics, target_statistics, with_target_statistics
from tablewright.runtime import scratch_path
from tablewright.sources.chunks import upsert
from tablewright.sources.reports import append_events
from tablewright.sources.stored import last_commit, read_stored, recover, upsert_stored
from tablewright.streaming import event_log as E


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(5)]
    rows = [(i, " ".join(r.choices(words, [1 / (1 + n) for n in range(60)], k=r.randint(0, 40)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "wa")]
    queries = [(q, " ".join(r.choices(words, k=1 + q % 5))) for q in range(30)] + [(77, "unheard"), (78, None), (79, f"{words[0]} {words[0]} {words[40]}")]
    chunks = spark.createDataFrame(rows, "chunk_id long, code string")
    return Bm25Index.build(chunks), spark.createDataFrame(queries, "query_id int, q string")


@pytest.mark.parametrize("block_rows, k", [(3, 1), (5, 10), (1024, 10), (7, 500)])
def test_postings_find_what_a_full_search_finds(corpus, block_rows, k):
    index, queries = corpus
    postings = PostingIndex.build(index, block_rows)
    want = sorted(map(tuple, bm25_search(index, queries, k).select("query_id", "chunk_id", "rank", "score").collect()))
    got = sorted(map(tuple, postings_search(postings, queries, k).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-6)


def test_blocks_below_the_bound_are_not_read(corpus):
    index, queries = corpus
    postings = PostingIndex.build(index, 4)
    single = asked_tokens(postings, queries.where("query_id % 5 = 0 and query_id < 30"))
    assert kept_blocks(postings, single, 3).count() < 0.5 * postings.heads.join(single, "token").count()
    asked = asked_tokens(postings, queries)
    every = postings.heads.join(asked, "token").count()
    assert kept_blocks(postings, asked, 3).count() < every
    assert kept_blocks(postings, asked, 10**6).count() == every


ROWS = "id string, value int, seq int"


def files_of(path):
    import pathlib

    return {(p.parent.name, p.name) for p in pathlib.Path(path, "rows").rglob("*.parquet")}


def test_a_batch_rewrites_only_its_buckets(spark):
    path = scratch_path(spark, "stored")
    first = spark.createDataFrame([(f"k{i}", i, 0) for i in range(200)] + [(None, 1, 0)], ROWS)
    assert upsert_stored(first, path, "id", "seq", 16)["batch"] == 1
    before = files_of(path)
    second = spark.createDataFrame([("k3", 33, 1), ("k3", 34, 2), ("new", 5, 1), (None, 2, 1), ("k4", 0, -1)], ROWS)
    commit = upsert_stored(second, path, "id", "seq", 999)
    assert commit["batch"] == 2 and 0 < len(commit["buckets"]) <= 4
    after = files_of(path)
    touched = {f"bucket={b}" for b in commit["buckets"]}
    assert {b for b, _ in before - after} == touched & {b for b, _ in before}
    assert {b for b, _ in after - before} == touched
    want = upsert(first.unionByName(second), "id", "seq")
    assert sorted(map(str, read_stored(spark, path).select("id", "value", "seq").collect())) == sorted(map(str, want.collect()))
    assert upsert_stored(second.limit(0), path, "id", "seq") == commit
    with pytest.raises(ValueError, match="keyed by id"):
        upsert_stored(second, path, "value", "seq")


def test_an_interrupted_batch_is_finished(spark, monkeypatch):
    from tablewright.sources import stored

    path = scratch_path(spark, "stored")
    upsert_stored(spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], ROWS), path, "id", "seq", 8)
    held, calls = stored.recover, []

    def die(spark, path):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        held(spark, path)

    monkeypatch.setattr(stored, "recover", die)
    with pytest.raises(RuntimeError):
        upsert_stored(spark.createDataFrame([("a", 9, 1)], ROWS), path, "id", "seq")
    monkeypatch.setattr(stored, "recover", held)
    assert last_commit(spark, path)["batch"] == 1
    recover(spark, path)
    assert last_commit(spark, path)["batch"] == 2
    assert {(r["id"], r["value"]) for r in read_stored(spark, path).collect()} == {("a", 9), ("b", 2)}


EVENTS = "timestamp timestamp, agent string, event_type string, payload string"


def log(spark, path, rows):
    df = spark.createDataFrame(rows, "t string, agent string, event_type string, payload string")
    append_events(df.select(F.to_timestamp("t").alias("timestamp"), "agent", "event_type", "payload").coalesce(1), path)


def test_windows_close_late_events_stay_out_and_copies_count_once(spark):
    path, out, state = (scratch_path(spark, n) for n in ("log", "windows", "state"))

    def run():
        stream = E.closed_windows(E.follow_events(spark, path), "1 hour", "1 day", "payload")
        E.append_to_table(stream, out, state).awaitTermination()
        return {(str(r["window_start"])[:10], r["agent"]): r["n_events"] for r in spark.read.parquet(out).collect()}

    log(spark, path, [("2024-01-01 10:00:00", "a", "x", "1"), ("2024-01-01 10:10:00", "a", "x", "1"), ("2024-01-01 23:00:00", "a", "x", "2"), ("2024-01-02 00:30:00", "a", "x", "3")])
    assert run() == {}  # the first day may still get events
    log(spark, path, [("2024-01-01 23:45:00", "a", "x", "4"), ("2024-01-02 02:00:00", "b", "x", "5")])
    assert run() == {("2024-01-01", "a"): 3}
    log(spark, path, [("2024-01-01 12:00:00", "a", "x", "6"), ("2024-01-03 09:00:00", "a", "x", "7")])
    assert run() == {("2024-01-01", "a"): 3, ("2024-01-02", "a"): 1, ("2024-01-02", "b"): 1}


def test_first_occurrences_drop_their_state(spark):
    path, out, state = (scratch_path(spark, n) for n in ("log", "spells", "state"))

    def run():
        stream = E.first_occurrences_stream(E.follow_events(spark, path), "payload", "1 hour", "2 hours")
        query = E.append_to_table(stream, out, state)
        query.awaitTermination()
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        rows = {(r["key"], str(r["first_time"])[11:16], str(r["last_time"])[11:16], r["n_seen"]) for r in spark.read.schema(E.FIRST_SEEN).parquet(out).collect()}
        return kept, rows

    log(spark, path, [("2024-01-01 10:30:00", "a", "x", "p"), ("2024-01-01 10:00:00", "a", "x", "p"), ("2024-01-01 11:00:00", "a", "x", "q")])
    assert run() == (2, set())
    log(spark, path, [("2024-01-01 14:00:00", "a", "x", "r")])
    kept, rows = run()
    assert ("p", "10:00", "10:30", 2) in rows and kept <= 2
    log(spark, path, [("2024-01-01 18:00:00", "a", "x", "p"), ("2024-01-01 09:00:00", "a", "x", "late")])
    kept, rows = run()
    assert rows == {("p", "10:00", "10:30", 2), ("q", "11:00", "11:00", 1), ("r", "14:00", "14:00", 1)} and kept == 1


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 20])
def test_ordered_statistics_see_only_rows_before(spark, rows_per_bucket):
    import hashlib

    r = random.Random(1)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), float(r.random() < 0.4)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, kind string, y double")
    got = {x["id"]: x["t"] for x in ordered_target_statistics(df, "id", "kind", "y", "t", rows_per_bucket=rows_per_bucket).collect()}
    mean, seen, want = sum(y for *_, y in rows) / 150, defaultdict(list), {}
    for i, kind, y in sorted(rows, key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest()[:8], x[0])):
        want[i] = (sum(seen[kind]) + mean) / (len(seen[kind]) + 1)
        seen[kind].append(y)
    assert got == pytest.approx(want)
    stats = target_statistics(df, "kind", "y")
    scored = with_target_statistics(spark.createDataFrame([("hot",), (None,), ("new",)], "kind string"), stats, "kind", "t", 0.5)
    found = {x["kind"]: x["t"] for x in scored.collect()}
    assert found["new"] == 0.5
    for kind in ("hot", None):
        assert found[kind] == pytest.approx((sum(seen[kind]) + mean) / (len(seen[kind]) + 1))


def test_a_classifier_learns_from_a_category(spark):
    r = random.Random(2)
    rows = [(i, (k := r.choice("abcdef")), r.random(), int((k in "ace") != (r.random() < 0.05))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, kind string, noise double, y int")
    small = Boosting(60, 3, 0.2, penalty=3.0, loss="logistic", symmetric=True)
    odds, accuracy = fit_on_categories(df, "id", "y", ["kind", "noise"], small)
    row = accuracy.first()
    assert row["valid_accuracy"] > 0.85 and row["n_train"] + row["n_valid"] == 600
    assert odds.count() == 600


def test_sparse_vectors_equal_the_list_form(spark):
    from tablewright.operators.dictionary import as_vector, fit_sparse_preprocessor
    from tablewright.operators.prep import fit_preprocessor

    rows = [(i, None if i % 7 == 0 else float(i % 13), ["a", "b", "b", None, "é", "A"][i % 6], f"v{i % 11}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n double, c string, d string")
    test = spark.createDataFrame([(1, 4.0, "new", "v3"), (2, None, None, "v10"), (3, 1.0, "b", None), (4, 2.0, "\x0012", "v1")], "id long, n double, c string, d string")
    features = ["n", "c", "d"]
    plain, sparse = fit_preprocessor(df, features), fit_sparse_preprocessor(df, features, rows_per_bucket=4)
    for table in (df, test):
        want = {r["id"]: r["features"].toArray().tolist() for r in plain.transform(table).select("id", "features").collect()}
        made = sparse.transform(table).withColumn("v", as_vector(sparse.width)("indices", "values"))
        assert made.columns == [*table.columns, "indices", "values", "v"]
        got = {r["id"]: r["v"].toArray().tolist() for r in made.collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_a_column_of_a_million_values(spark):
    from tablewright.operators.dictionary import fit_dictionary, with_place

    ids = spark.range(0, 1_000_000, 1, 8)
    rows = ids.select(F.col("id"), F.lpad(F.col("id").cast("string"), 7, "0").alias("c")).unionByName(ids.select("id", F.lit("hot").alias("c")))
    dictionary = fit_dictionary(rows, "c", rows_per_bucket=200_000)
    assert dictionary.size == 1_000_001
    assert dictionary.values.where("frequent").select("value", "place").collect() == [("hot", 1_000_000)]
    found = with_place(rows, dictionary, "c", "p")
    assert found.where("p <> if(c = 'hot', 1000000, id)").count() == 0 and found.where("p is null").count() == 0


def test_postings_move_once_for_all_queries(spark, corpus, monkeypatch):
    """What is moved for the search does not grow with the number of queries that ask for the same tokens."""
    from tablewright.operators import postings as P

    index, queries = corpus
    seen = []
    scorer = P._scorer

    def counted(block, k):
        seen.append(len(block))
        return scorer(block, k)

    monkeypatch.setattr(P, "_scorer", counted)
    monkeypatch.setattr(P, "kept_blocks", lambda index, asked, k, kept=P.kept_blocks: kept(index, asked, 10**6))
    same = spark.range(50).selectExpr("cast(id as int) as query_id", "'waa wab wac' as q")
    postings = PostingIndex.build(index)
    sums = []
    monkeypatch.setattr(P, "_sums", lambda index, wanted, add=P._sums: (sums.append(wanted), add(index, wanted))[1])
    got = postings_search(postings, same, 5).collect()
    assert seen == [50] and len(sums) == 1  # sums by query and chunk are for the seeds alone
    assert len({tuple(r)[1:] for r in got}) == 5 and len(got) == 250


def test_postings_take_a_chunk_without_an_id(spark):
    chunks = spark.createDataFrame([(1, "red blue"), (None, "red red"), (3, "green"), (4, "sky"), (5, "sea")], "chunk_id long, code string")
    queries = spark.createDataFrame([(7, "red"), (None, "green")], "query_id int, q string")
    got = postings_search(PostingIndex.build(Bm25Index.build(chunks)), queries, 3).collect()
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in got} == {(7, None, 0), (7, 1, 1)}  # a query without an id has no tokens


def test_a_batch_is_shuffled_once(spark):
    from tablewright.sources import stored

    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), (None, 3, 0), (None, 4, 2)], ROWS).withColumn("bucket", stored._bucket("id", 4))
    merged = stored.merged_rows(rows, "id", "seq")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert {tuple(r)[:3] for r in merged.collect()} == {("a", 2, 1), (None, 4, 2)}
