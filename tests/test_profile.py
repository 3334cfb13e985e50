import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions.columns import per_column
from tablewright.functions.stats import two_sided_t
from tablewright.operators import clean as C
from tablewright.operators import groups as G
from tablewright.operators import profile as P
from tablewright.operators.validate import duplicate_rows, require_valid, validate_table


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, "a", None, 5), (2, None, "a", None, 5), (3, 3.0, "b", None, 5), (3, 3.0, "b", None, 5)]
    return spark.createDataFrame(rows, "id int, goal double, kind string, gone double, same int")


def checks(df, target=None):
    return {r["check"]: (r["value"], r["passed"]) for r in validate_table(df, target).collect()}


def test_validate(small):
    got = checks(small, "goal")
    assert got["not_empty"] == (4, True)
    assert got["enough_rows"] == (4, False)
    assert got["no_empty_columns"] == (1, False)
    assert got["no_duplicate_rows"] == (1, False)
    assert got["target_varies"] == (3, True)
    assert require_valid(small, "goal") == ["enough_rows", "no_duplicate_rows", "no_empty_columns"]


def test_validate_finds_errors(spark, small):
    assert checks(small, "nope")["target_present"] == (0, False)
    with pytest.raises(ValueError, match="target_varies"):
        require_valid(small, "same")
    empty = checks(small.limit(0), "goal")
    assert empty["not_empty"] == (0, False) and empty["target_varies"][1] is False
    twice = small.select("id", F.col("same").alias("id"))
    assert checks(twice)["unique_names"] == (1, False)


def test_constant_columns_count_null_as_a_value(spark):
    df = spark.createDataFrame([(1, None, 1.0, "x"), (1, None, None, "x")], "a int, b string, c double, d string")
    assert {r[0] for r in P.constant_columns(df).collect()} == {"a", "b", "d"}


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")
    assert duplicate_rows(df).first()[0] == 1
    swapped = spark.createDataFrame([(None, 1.0), (1.0, None), (0.0, 2.0), (-0.0, 2.0), (float("nan"), 3.0)] * 2, "a double, b double")
    assert duplicate_rows(swapped).first()[0] == 10 - swapped.distinct().count() == 6


def test_leakage(spark):
    rows = [(1.0, "1", 1, 2.0, 1.0), (2.0, "2", 2, 2.0, None)]
    df = spark.createDataFrame(rows, "goal double, text string, whole int, other double, day_price double")
    got = {r["column_name"]: (r["name_flag"], r["equals_target"]) for r in P.leakage_report(df, "goal").collect()}
    assert got == {"text": (False, True), "whole": (False, True), "other": (False, False), "day_price": (True, False)}
    strict = {r["column_name"]: r["equals_target"] for r in P.leakage_report(df, "goal", same_type=True).collect()}
    assert strict["whole"] is False
    assert P.name_flags(["qty", "y", "type_y"], whole_word=True) == ["y", "type_y"]


def test_missing_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2)], "a double, b int")
    assert [tuple(r) for r in P.missing_top(df).collect()] == [("a", 2)]


def test_target_balance(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    assert {r["value"]: r["share"] for r in P.target_balance(df, "t").collect()} == pytest.approx({"a": 2 / 3, "b": 1 / 3})


def test_regression_line(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, 2, 3, 4, 5], "y": [2.1, 3.9, 6.2, 7.8, 10.1], "flat": [1.0] * 5}))
    got = {r["column_name"]: r for r in P.with_p_value(P.univariate_regression(df, "x")).collect()}
    assert got["y"]["slope"] == pytest.approx(1.99) and got["y"]["intercept"] == pytest.approx(0.05)
    assert got["y"]["stderr"] == pytest.approx(0.05972, abs=1e-4) and 0 < got["y"]["pvalue"] < 1e-4
    assert got["flat"]["slope"] == 0 and got["flat"]["rvalue"] is None


def test_t_distribution():
    # quantiles from published tables
    for t, dof, p in [(12.706, 1, 0.05), (2.228, 10, 0.05), (2.660, 60, 0.01), (0.0, 5, 1.0)]:
        assert two_sided_t(t, dof) == pytest.approx(p, rel=2e-3)
    assert math.isnan(two_sided_t(1.0, 0))


def test_per_column_in_passes(spark, monkeypatch):
    monkeypatch.setattr("tablewright.functions.columns.AGG_COLUMNS_PER_PASS", 2)
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert per_column(df, df.columns, lambda c: {"s": F.sum(c)}).count() == 3


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(500)], "v double")
    got = P.kde_grid(df, "v", 400).orderBy("point").toPandas()
    step = got["x"].diff().iloc[1]
    assert got["density"].sum() * step == pytest.approx(1.0, abs=0.01)


def test_cleaning(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, 2.0, "y"), (3, 3.0, None)], "b int, a double, c string")
    got = C.clean_rows(df, fill={"c": "none"}, required=["b"], keep=F.coalesce("a", F.lit(0.0)) < 9)
    assert got.columns == ["a", "b", "c"]
    assert sorted(r["c"] for r in got.collect()) == ["none", "x"]
    assert C.map_flags(df, "c", {"x": 1, "z": 0}).where("c = 1").count() == 1
    assert C.add_ratios(df, {"r": ("a", "b")}).where("r is null").count() == 2
    bins = spark.createDataFrame([(0.1,), (1.6,), (100.0,)], "v double")
    assert [r["bin"] for r in C.capped_bins(bins, "v", "bin").collect()] == [1.0, 2.0, 5.0]
    texts = spark.createDataFrame([("1.5",), ("x",), ("nan",), (None,)], "v string")
    assert [r[0] for r in C.coerce_numbers(texts, ["v"]).collect()] == [1.5, None, None, None]


def test_multi_hot(spark):
    df = spark.createDataFrame([(1, " a,b "), (2, "b, c"), (3, None)], "id int, items string")
    got = {r["id"]: r for r in G.multi_hot(df, "items").collect()}
    assert got[1].asDict() == {"id": 1, " c": 0, "a": 1, "b": 1}
    assert got[2][" c"] == 1 and got[3]["b"] == 0


def test_lookups(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 10)], "id int, v int")
    assert sorted(r["out"] for r in G.lookup(left, right, "k", "id", "v", "out", 0).collect()) == [0, 0, 10]
    assert G.present_in(left, right, "k", "id").count() == 1
    assert G.absent_from(left, right, "k", "id").count() == 2
