import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import metrics as M
from tablewright.operators import prep as P
from tablewright.plans import models as R
from tablewright.plans.bundle import load_bundle, save_bundle
from tablewright.plans.crossval import best_of, leaderboard, run_regression_cv
from tablewright.plans.training_loop import plan_round, train_until_ready
from tablewright.sources.submissions import align_submission, check_submission, score_batch


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.uniform(0, 9, n), "kind": rng.choice(["x", "y's", "z"], n)})
    pdf["goal"] = 3 * pdf["a"] + np.sin(pdf["b"]) * 5 + (pdf["kind"] == "z") * 2 + rng.normal(size=n) * 0.1
    pdf.loc[::20, "a"] = np.nan
    pdf.loc[::30, "kind"] = None
    return spark.createDataFrame(pdf.astype({"kind": object})).withColumn("kind", F.col("kind"))


def vectors(data):
    filled = data.fillna(0.0, subset=["a"]).withColumn("a", F.nanvl("a", F.lit(0.0))).withColumn("label", F.col("goal"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(filled).select("features", "label")


def test_ridge_matches_normal_equations(data):
    pdf = data.toPandas()
    x = np.nan_to_num(pdf[["a", "b"]].to_numpy())
    y = pdf["goal"].to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(2), xc.T @ yc)
    model = R.fit_ridge(vectors(data), R.Settings(alpha=2.0))
    assert list(model.coefficients) == pytest.approx(want.tolist(), abs=1e-9)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ want)


@pytest.mark.parametrize("name", ["ridge", "extratrees"])
def test_bundle_scores_tables_that_lack_features(spark, data, tmp_path, name):
    features = ["a", "b", "kind"]
    model = R.fit_pipeline(data, "goal", features, name, R.SMALL)
    save_bundle(model, str(tmp_path), data, "goal", name, features, ["id"])
    loaded, types, about = load_bundle(spark, str(tmp_path))
    assert types == {"a": "double", "b": "double", "kind": "string"} and about["dropped"] == ["id"]
    test = data.select("id", "b").withColumn("more", F.lit(1))
    one = score_batch(model, test, types, ["id"]).orderBy("id").collect()
    assert one == score_batch(loaded, test, types, ["id"]).orderBy("id").collect() and len(one) == 400


def test_preprocessor(spark):
    train = spark.createDataFrame([(1.0, "a", True), (None, "b", False), (5.0, None, True), (9.0, "b", None)], "n double, c string, f boolean")
    prep = P.fit_preprocessor(train, ["n", "c", "f"])
    assert prep.medians == {"n": 5.0, "f": 1.0} and prep.modes == {"c": "b"}
    test = spark.createDataFrame([(5.0, "new", True), (None, "a", None)], "n double, c string, f boolean")
    got = [r["features"].toArray().tolist() for r in prep.transform(test).collect()]
    assert got[0][2:] == [0.0, 0.0] and got[1][2:] == [1.0, 0.0]
    assert got[0][0] == got[1][0] == 0.0  # 5 is also the mean
    raw = P.fit_preprocessor(train, ["n"], standardize=False)
    assert raw.transform(test).first()["features"].toArray().tolist() == [5.0]


def test_modes_break_ties_by_value(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "s string, e string")
    assert P.fit_modes(df, ["s", "e"]) == {"s": "a", "e": None}


def test_scale_of_a_constant_column(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert [r["a"] for r in P.standard_scale(df, P.fit_scale(df, ["a"])).collect()] == [0.0, 0.0]


def test_one_hot_rows_sum_to_at_most_one(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("new",)], "c string")
    rows = P.one_hot(df, "c", ["a", "b"]).collect()
    assert [sum(r) for r in rows] == [1, 1, 0, 0]


def test_feature_subset_threshold(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, None, 1.0)], "e int, h int, t double")
    assert P.kept_features(df, "t", threshold=0.98) == ["h"]
    assert P.kept_features(df, "t", threshold=0.5) == []


def test_missing_target_fails(spark, data):
    broken = data.withColumn("goal", F.when(F.col("id") > 3, F.col("goal")))
    with pytest.raises(Exception, match="missing values"):
        R.with_label(broken, "goal").agg(F.sum("label")).collect()


def test_metrics_edges(spark):
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    row = M.regression_metrics(flat, "y", "p").first()
    assert row["r2"] == 1.0 and row["rmse"] == 0.0
    wrong = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "y double, p double")
    assert M.regression_metrics(wrong, "y", "p").first()["r2"] == 0.0
    classes = spark.createDataFrame([(0, 0), (1, 2), (1, 1)], "y int, p int")
    row = M.classification_metrics(classes, "y", "p").first()
    assert row["accuracy"] == pytest.approx(2 / 3) and row["f1_macro"] == pytest.approx((1 + 2 / 3 + 0) / 3)


def test_drift_of_a_table_with_itself(data):
    assert M.mean_shift(data, data).first()[0] == 0.0
    assert M.mean_shift(data, None).first()[0] == 0.0


def test_gates(spark):
    rows = [(1, 0.5, 0.7, 1.0, 0.01, 0), (2, 0.95, 0.1, 1.0, 0.01, 0), (3, 0.5, 0.7, 1.0, 0.5, 11)]
    df = spark.createDataFrame(rows, "i int, relative_rmse double, r2 double, target_std double, mean_prediction_shift double, n_missing int")
    got = {r["i"]: (r["readiness"], r["focus"]) for r in M.quality_gates(df).collect()}
    assert got == {1: ("ready", None), 2: ("needs_iteration", "quality"), 3: ("needs_iteration", "stability")}


def test_schema_table(spark):
    train = spark.createDataFrame([(1, "x", 2.0)], "b int, a string, c double")
    test = spark.createDataFrame([(1, 2.0, 3)], "b long, c double, d int")
    rows = {r["column"]: (r["in_train"], r["in_test"], r["train_type"], r["test_type"]) for r in M.schema_table(train, test).collect()}
    assert rows == {
        "b": (True, True, "int", "bigint"),
        "a": (True, False, "string", None),
        "c": (True, True, "double", "double"),
        "d": (False, True, None, "int"),
    }
    assert tuple(M.schema_summary(train, test).first()) == ("a", "d", "b", 1, "ok")
    assert tuple(M.schema_summary(train, None).first()) == ("", "", "", 0, "test_absent")


def test_rounds():
    assert plan_round(None, None, False) == (["ridge", "rf", "gb"], 0.98)
    assert plan_round(None, None, True)[0][0] == "extratrees"
    assert plan_round("stability", "ridge", True) == (["rf"], 0.95)
    assert plan_round("quality", "extratrees", True) == (["rf", "gb", "ridge", "extratrees"], 0.99)
    assert plan_round("quality", "gb", False)[0] == ["extratrees", "rf", "ridge"]


def test_cross_validation_and_leaderboard(data):
    rows = [run_regression_cv(data, "id", "goal", ["a", "b", "kind"], n, R.SMALL, 3) for n in ("ridge", "rf")]
    board = leaderboard(data, rows).collect()
    assert board[0]["model"] == best_of(rows) == "rf" and board[0]["is_best"]
    tie = [{**rows[0], "model": m} for m in ("one", "two")]
    assert best_of(tie) == "one"


@pytest.mark.parametrize("features", [["a", "b", "kind"], ["b"], ["a"], ["kind"], ["b", "flat"]])
def test_ridge_sums_match_a_fit_per_fold(data, monkeypatch, features):
    rows = data.withColumn("flat", F.lit(3.5))
    quick = run_regression_cv(rows, "id", "goal", features, "ridge", R.Settings(alpha=3.0), 4)
    monkeypatch.setattr("tablewright.plans.ridge_cv.MAX_WIDTH", 0)
    slow = run_regression_cv(rows, "id", "goal", features, "ridge", R.Settings(alpha=3.0), 4)
    for m in ("rmse", "mae", "r2"):
        assert quick[m] == pytest.approx(slow[m], rel=1e-9)


def test_train_classifier(data):
    rows = data.withColumn("label", F.when(F.col("goal") > 5, "high").otherwise("low")).drop("goal")
    model, accuracy = R.train_classifier(rows, "id", 1.0, R.SMALL)
    row = accuracy.first()
    assert row["target"] == "label" and row["n_train"] + row["n_valid"] == 400
    assert row["train_accuracy"] > 0.8 and row["valid_accuracy"] > 0.6
    assert {r["predicted"] for r in model.transform(data.drop("goal")).collect()} == {"high", "low"}


def test_loop_with_test_table(data):
    test = data.drop("kind").withColumn("extra", F.lit(1))
    rounds, model = train_until_ready(data, "id", "goal", test, settings=R.SMALL, leak_tokens=["target"])
    row = rounds.first()
    assert row["readiness"] == "ready" and row["n_missing"] == 1 and row["schema_status"] == "ok"
    assert model.transform(data).count() == 400


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert {r["label"]: r["weight"] for r in R.class_weights(df, "y").collect()} == pytest.approx({0: 4 / 6, 1: 2.0})
    assert R.with_class_weight(df, "y").where("y = 1").first()["weight"] == 2.0
    assert R.label_column(df.withColumn("target", F.lit(1))) == "target"
    assert R.label_column(df.withColumn("last", F.lit(1)).withColumnRenamed("y", "z")) == "last"


def test_submissions(spark):
    sample = spark.createDataFrame([(2, 0.0), (1, 0.0)], "id int, goal double")
    scored = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id int, prediction double")
    got = align_submission(scored, "id", sample=sample)
    assert got.columns == ["id", "goal"] and {tuple(r) for r in got.collect()} == {(1, 0.1), (2, 0.2)}
    assert all(r["passed"] for r in check_submission(got, sample).collect())
    assert not any(r["passed"] for r in check_submission(scored, sample).collect())
    assert align_submission(scored.withColumnRenamed("id", "row"), "row").columns == ["row", "prediction"]
    wide = sample.withColumn("note", F.lit("n"))
    assert align_submission(scored, "id", sample=wide, sample_target="goal").columns == ["id", "goal", "note"]
    with pytest.raises(ValueError, match="name its target"):
        align_submission(scored, "id", sample=wide)
