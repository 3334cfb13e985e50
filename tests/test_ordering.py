import numpy as np
import pandas as pd
import pytest

from tablewright.operators.groups import small_side
from tablewright.operators.metrics import roc_auc
from tablewright.operators.ordering import fill_forward, with_hash_rank, with_row_index, with_running_totals
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.split import fold_count, holdout_split, kfold_assign, sample_fraction, stratified_split


@pytest.mark.parametrize("values", ["spread", "few", "third", "constant"])
@pytest.mark.parametrize("one_task_rows", [10, 1_000_000])
def test_quantiles_match_numpy(spark, values, one_task_rows):
    rng = np.random.default_rng(1)
    data = {
        "spread": rng.normal(size=4001),
        "few": rng.integers(0, 4, size=4000).astype(float),
        "third": np.where(rng.random(4000) < 0.34, 0.5, rng.random(4000)),
        "constant": np.full(300, 7.0),
    }[values]
    df = spark.createDataFrame(pd.DataFrame({"a": data}))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = exact_quantiles(df, ["a"], shares, one_task_rows)["a"]
    assert found == pytest.approx(np.quantile(data, shares).tolist())


def test_quantiles_leave_missing_out(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


def test_running_totals_over_buckets(spark):
    rng = np.random.default_rng(2)
    keys = rng.permutation(5000)
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": keys % 7})).repartition(5)
    got = with_running_totals(df, "k", {"upto": "v"}, rows_per_bucket=300).orderBy("k").toPandas()
    assert got["upto"].tolist() == np.cumsum(got["v"]).tolist()


@pytest.mark.parametrize("text", [False, True])
def test_row_index_over_buckets(spark, text):
    keys = [f"k{i:05d}" for i in range(2000)] if text else list(range(0, 6000, 3))
    df = spark.createDataFrame(pd.DataFrame({"k": keys})).repartition(4)
    got = with_row_index(df, "k", rows_per_bucket=100).orderBy("k").toPandas()
    assert got["index"].tolist() == list(range(2000))


@pytest.mark.parametrize("rows_per_bucket", [1, 100, 1_000_000])
@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,3)", "date", "timestamp", "timestamp_ntz", "string"])
def test_null_key_and_any_type_at_every_size(spark, kind, rows_per_bucket):
    made = {
        "date": "date_add(date'2020-01-01', cast(id * 3 as int))",
        "timestamp": "timestamp_micros(id * 977000001)",
        "timestamp_ntz": "cast(timestamp_micros(id * 977000001) as timestamp_ntz)",
        "string": "concat('key é', lpad(cast(id * 7 as string), 6, '0'))",
        "double": "case when id = 399 then double('nan') else id * 0.5 end",
    }.get(kind, f"cast(id * 5 as {kind})")
    df = spark.range(400).selectExpr("id", f"case when id = 0 then null else {made} end as k").repartition(3)
    got = with_row_index(df, "k", rows_per_bucket=rows_per_bucket).orderBy("id").collect()
    assert [r["index"] for r in got] == list(range(400))
    ranked = with_hash_rank(df.selectExpr("*", "id % 2 as g"), ["g"], "k", "r", rows_per_bucket)
    base = with_hash_rank(df.selectExpr("*", "id % 2 as g"), ["g"], "k", "r")
    assert sorted(map(tuple, ranked.select("id", "r").collect())) == sorted(map(tuple, base.select("id", "r").collect()))
    split = stratified_split(df.selectExpr("*", "id % 2 as g"), "k", "g", 0.25, rows_per_bucket=rows_per_bucket)
    assert split.count() == 400 and split.where("is_valid").count() == 100


def test_null_keys_have_a_place(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    assert holdout_split(df, "k").where("is_valid is null").count() == 0
    assert kfold_assign(df, "k", 3).where("k is null").first()["fold"] == 0
    filled = spark.createDataFrame([(None, i, "a" if i == 0 else None) for i in range(50)], "g string, i int, v string")
    assert fill_forward(filled, "g", "i", "v", "out", rows_per_chunk=10).where("out = 'a'").count() == 50


def test_hash_rank_does_not_depend_on_buckets(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(3000)], "id long, g string")
    one = with_hash_rank(df, ["g"], "id", "r").orderBy("id").collect()
    many = with_hash_rank(df, ["g"], "id", "r", rows_per_bucket=50).orderBy("id").collect()
    assert one == many


def test_fill_forward_over_chunks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["a"] * 900 + ["b"] * 100, "i": [*range(900), *range(100)]})
    pdf["v"] = [f"h{i}" if rng.random() < 0.02 else None for i in range(1000)]
    got = fill_forward(spark.createDataFrame(pdf), "g", "i", "v", "out", rows_per_chunk=16)
    got = got.orderBy("g", "i").toPandas()
    want = pdf.groupby("g")["v"].ffill()
    assert got["out"].fillna("-").tolist() == want.fillna("-").tolist()


def test_roc_auc_over_buckets(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 2000)
    score = np.where(rng.random(2000) < 0.34, 0.5, np.round(rng.random(2000) + 0.2 * y, 3))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": score}))
    pos, neg = score[y == 1], score[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    for rows in (50, 1_000_000):
        assert roc_auc(df, "y", "s", rows).first()["roc_auc"] == pytest.approx(want)


def test_folds_part_the_rows(spark):
    df = spark.range(1000)
    folds = [r["count"] for r in kfold_assign(df, "id", 4).groupBy("fold").count().collect()]
    assert len(folds) == 4 and sum(folds) == 1000 and min(folds) > 150
    assert [fold_count(n) for n in (10, 149, 150, 199, 200, 249, 250, 10**6)] == [3, 3, 3, 3, 4, 4, 5, 5]


def test_splits_with_different_salt_are_independent(spark):
    df = spark.range(20000)
    sampled = sample_fraction(df, "id", 0.2)
    assert sampled.count() == pytest.approx(4000, rel=0.1)
    assert holdout_split(sampled, "id").where("is_valid").count() == pytest.approx(800, rel=0.2)


def test_stratified_split_keeps_shares(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else str(i % 3)) for i in range(900)], "id long, s string")
    got = stratified_split(df, "id", "s", 0.2, rows_per_bucket=100)
    assert got.count() == 900
    for row in got.groupBy("s").agg({"*": "count", "is_valid": "max"}).collect():
        n_valid = got.where(got.s.eqNullSafe(row["s"]) & got.is_valid).count()
        assert n_valid == int(row["count(1)"] * 0.2)


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.sql("select id, repeat('x', 100) as t, array(id) as a, map('k', id) as m from range(1000)")

    def hinted(side):
        return "ResolvedHint" in side._jdf.queryExecution().analyzed().toString()

    assert hinted(small_side(df)) and hinted(small_side(df.limit(0)))
    assert not hinted(small_side(df, rows=999)) and not hinted(small_side(df, size=100_000))
