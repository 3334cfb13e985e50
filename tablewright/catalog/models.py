"""Models, cross-validation and the training loop on the modelling view."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.catalog.registry import bucket_sql, query, rounded, table, using, view
from tablewright.operators.metrics import binary_f1, classification_metrics, regression_metrics, roc_auc
from tablewright.operators.prep import fit_preprocessor
from tablewright.operators.split import holdout_split
from tablewright.plans import models as M
from tablewright.plans.binning import with_row_id
from tablewright.plans.bundle import load_bundle, save_bundle
from tablewright.plans.crossval import leaderboard, run_classification_cv, run_regression_cv
from tablewright.plans.target_stats import fit_on_categories, ordered_target_statistics
from tablewright.plans.training_loop import train_until_ready
from tablewright.runtime import scratch_path, scratch_table
from tablewright.sources.csvfiles import read_csv
from tablewright.sources.submissions import score_batch, write_predictions

_FEATURES = ["n_lines", "sum_qty", "avg_disc", "avg_tax", "priority"]
_LEAKS = ["target", "label", "revenue"]


def _model_table(spark, sf_dir):
    return scratch_table(view(spark, sf_dir, "fx_model"), "model")


# Ridge on two standardised features has a closed form; {g} names the group, {w} the rows.
_TWO = """select {g} as g, count(*) as n, avg(n_lines) as m1, stddev_pop(n_lines) as s1, avg(sum_qty) as m2,
    stddev_pop(sum_qty) as s2, avg(revenue) as my, corr(n_lines, sum_qty) as r, covar_pop(n_lines, revenue) as c1,
    covar_pop(sum_qty, revenue) as c2 from {w} group by {g}"""
_SOLVE = """select g, m1, s1, m2, s2, my, ((n * c1 / s1) * (n + 1) - n * r * (n * c2 / s2)) / ((n + 1) * (n + 1) - n * r * n * r) as w1,
    ((n * c2 / s2) * (n + 1) - n * r * (n * c1 / s1)) / ((n + 1) * (n + 1) - n * r * n * r) as w2 from two"""
_PREDICT = "my + w1 * (n_lines - m1) / s1 + w2 * (sum_qty - m2) / s2"


@query(
    "ridge_fit",
    using("fx_model")
    + f""", two as ({_TWO.format(g="1", w="fx_model")}), fit as ({_SOLVE})
      select 'n_lines' as term, round(w1, 4) as weight from fit union all select 'sum_qty', round(w2, 4) from fit
      union all select 'intercept', round(my, 4) from fit""",
)
def ridge(spark, sf_dir):
    rows = _model_table(spark, sf_dir)
    names = ["n_lines", "sum_qty"]
    prep = fit_preprocessor(rows, names)
    model = M.fit_ridge(prep.transform(M.with_label(rows, "revenue")).select("features", "label"))
    found = [*zip(names, map(float, model.coefficients)), ("intercept", float(model.intercept))]
    return rounded(spark.createDataFrame(found, "term string, weight double"), 4)


@query(
    "regression_cv",
    using("fx_model")
    + f""", placed as (select *, {bucket_sql('row_id')} % 5 as fold from fx_model),
      wide as (select f, placed.* from placed, range(5) r(f) where fold <> f),
      two as ({_TWO.format(g="f", w="wide")}), fit as ({_SOLVE}),
      scored as (select fold, revenue as y, {_PREDICT} as p from placed join fit on g = fold),
      per as (select fold, sqrt(avg((y - p) ** 2)) as rmse, avg(abs(y - p)) as mae,
        1 - avg((y - p) ** 2) / var_pop(y) as r2 from scored group by fold)
      select 'ridge' as model, round(avg(rmse), 4) as rmse, round(avg(mae), 4) as mae, round(avg(r2), 6) as r2 from per""",
)
def ridge_cv(spark, sf_dir):
    rows = _model_table(spark, sf_dir)
    result = run_regression_cv(rows, "row_id", "revenue", ["n_lines", "sum_qty"], "ridge")
    board = leaderboard(rows, [result]).select("model", "rmse", "mae", "r2")
    return rounded(board, 4, r2=6)


def _fitted(spark, sf_dir, name, features=_FEATURES):
    _, metrics = M.fit_and_score(_model_table(spark, sf_dir), "row_id", "revenue", features, name)
    return rounded(metrics, 2)


_HOLDOUT = f"""placed as (select *, {bucket_sql('row_id', 'holdout')} % 10000 < 2000 as v from fx_model),
    train as (select * from placed where not v), two as ({_TWO.format(g='1', w='train')}), fit as ({_SOLVE}),
    scored as (select revenue as y, {_PREDICT} as p from placed, fit where v)"""


@query(
    "ridge_holdout",
    using("fx_model")
    + f""", {_HOLDOUT} select 'ridge' as model, count(*) as n, round(sqrt(avg((y - p) ** 2)), 4) as rmse,
      round(avg(abs(y - p)), 4) as mae, round(1 - avg((y - p) ** 2) / var_pop(y), 4) as r2,
      round(stddev_samp(y), 4) as target_std, round(stddev_samp(p), 4) as prediction_std, round(avg(y - p), 4) as
      mean_residual, round(sqrt(avg((y - p) ** 2)) / stddev_samp(y), 4) as relative_rmse from scored""",
)
def ridge_holdout(spark, sf_dir):
    rows = _model_table(spark, sf_dir)
    return rounded(M.fit_and_score(rows, "row_id", "revenue", ["n_lines", "sum_qty"], "ridge")[1], 4)


@query("rf_fit")
def forest(spark, sf_dir):
    return _fitted(spark, sf_dir, "rf")


@query("gbt_fit")
def boosting(spark, sf_dir):
    return _fitted(spark, sf_dir, "gb")


@query("extra_trees_fit")
def extra(spark, sf_dir):
    return _fitted(spark, sf_dir, "extratrees")


@query("leaderboard")
def board(spark, sf_dir):
    rows = _model_table(spark, sf_dir)
    results = [run_regression_cv(rows, "row_id", "revenue", _FEATURES, n) for n in ("ridge", "rf", "gb")]
    return rounded(leaderboard(rows, results).drop("fit_time", "score_time"), 2)


_CLASS_FEATURES = ["n_chars", "source_len", "score"]


def _class_table(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_classes").select("row_id", "y", *_CLASS_FEATURES)
    assembled = VectorAssembler(inputCols=_CLASS_FEATURES, outputCol="features").transform(M.with_label(rows, "y"))
    return with_row_id(holdout_split(assembled.select("row_id", "features", "label"), "row_id"))


def _class_scores(model, rows):
    scored = model.transform(rows.where("is_valid"))
    metrics = classification_metrics(scored, "label", "prediction")
    from pyspark.ml.functions import vector_to_array

    chance = scored.withColumn("chance", vector_to_array("probability")[1])
    auc = roc_auc(chance, "label", "chance").select("roc_auc").scalar()
    return rounded(
        metrics.withColumns({"roc_auc": auc, "f1": binary_f1(scored, "label", "prediction").scalar()}), 4
    )


@query("classifier_fit")
def classifier(spark, sf_dir):
    rows = scratch_table(view(spark, sf_dir, "fx_classes").drop("pred", "toxic"), "classes")
    return rounded(M.train_classifier(rows, "row_id", fraction=1.0)[1])


@query(
    "ordered_target_stats",
    using("fx_classes")
    + f"""select row_id, lang, round((coalesce(sum(y) over w, 0) + (select avg(y) from fx_classes)) / (count(*) over w + 1), 6) as lang_y
      from fx_classes window w as (partition by lang order by {bucket_sql('row_id')}, row_id rows between unbounded preceding and 1 preceding)""",
)
def ordered_stats(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_classes").select("row_id", "lang", F.col("y").cast("double").alias("y"))
    return rounded(ordered_target_statistics(rows, "row_id", "lang", "y", "lang_y").drop("y"))


@query("category_boost_fit")
def category_boost(spark, sf_dir):
    """A boosted classifier that takes a category as it is."""
    return rounded(fit_on_categories(view(spark, sf_dir, "fx_classes"), "row_id", "y", [*_CLASS_FEATURES, "lang"])[1])


@query(
    "class_weights",
    using("fx_classes")
    + """select y as label, count(*) as n, round((select count(*) from fx_classes) / ((select count(distinct y) from fx_classes)
      * count(*)), 6) as weight from fx_classes group by y""",
)
def weights(spark, sf_dir):
    return rounded(M.class_weights(view(spark, sf_dir, "fx_classes"), "y"))


@query("balanced_logistic_fit")
def logistic(spark, sf_dir):
    rows = scratch_table(M.with_class_weight(_class_table(spark, sf_dir), "label"), "classes")
    return _class_scores(M.fit_balanced_logistic(rows.where("not is_valid")), rows)


@query("balanced_forest_fit")
def balanced_forest(spark, sf_dir):
    rows = scratch_table(_class_table(spark, sf_dir), "classes")
    return _class_scores(M.fit_balanced_forest(rows.where("not is_valid")), rows)


@query("classification_cv")
def class_cv(spark, sf_dir):
    rows = scratch_table(view(spark, sf_dir, "fx_classes").select("row_id", "y", *_CLASS_FEATURES, "lang"), "classes")
    found = [
        run_classification_cv(rows, "row_id", "y", [*_CLASS_FEATURES, "lang"], name) for name in ("logreg", "rf")
    ]
    rows_out = [(r["model"], r["roc_auc"], r["f1"]) for r in found]
    return rounded(spark.createDataFrame(rows_out, "model string, roc_auc double, f1 double"), 4)


def _regression_vectors(spark, sf_dir):
    rows = M.with_label(view(spark, sf_dir, "fx_model"), "revenue")
    vectors = VectorAssembler(inputCols=_FEATURES[:-1], outputCol="features").transform(rows)
    return scratch_table(with_row_id(holdout_split(vectors.select("row_id", "features", "label"), "row_id")), "vectors")


@query("gbt_early_stop")
def early_stop(spark, sf_dir):
    rows = _regression_vectors(spark, sf_dir)
    model = M.fit_boosting_with_stop(rows, "is_valid")
    scored = regression_metrics(model.transform(rows.where("is_valid")), "label", "prediction")
    return rounded(scored.select("rmse", "mae", "r2").withColumn("trees", F.lit(model.getNumTrees)), 2)


@query("capacity_sweep")
def sweep(spark, sf_dir):
    rows = _regression_vectors(spark, sf_dir)
    found = M.capacity_sweep(rows, "is_valid")
    return rounded(spark.createDataFrame(found, "max_leaves int, mae double, is_best boolean"), 2)


@query(
    "score_batch",
    using("fx_model")
    + f""", {_HOLDOUT} select round(p, 4) as prediction from scored""",
)
def score(spark, sf_dir):
    """Fit on the training side, save, load, score a table that lacks nothing the model needs, write and read back."""
    split = holdout_split(_model_table(spark, sf_dir), "row_id")
    features = ["n_lines", "sum_qty"]
    train = split.where("not is_valid")
    path = scratch_path(spark, "bundle")
    save_bundle(M.fit_pipeline(train, "revenue", features, "ridge"), path, train, "revenue", "ridge", features)
    model, types, _ = load_bundle(spark, path)
    out = scratch_path(spark, "predictions")
    write_predictions(rounded(score_batch(model, split.where("is_valid").drop("revenue"), types), 4), out)
    return read_csv(spark, out, "prediction double")


@query("score_batch_absent_features")
def score_absent(spark, sf_dir):
    """The test table lacks two features the model was trained with; their fitted fill values stand in."""
    split = holdout_split(_model_table(spark, sf_dir), "row_id")
    train = split.where("not is_valid")
    model = M.fit_pipeline(train, "revenue", _FEATURES, "ridge")
    types = {c: t for c, t in train.dtypes if c in _FEATURES}
    test = split.where("is_valid").drop("revenue", "avg_tax", "priority")
    return rounded(score_batch(model, test, types, ["row_id"]), 2)


@query(
    "score_batch_absent_feature",
    using("fx_model")
    + f""", placed as (select *, {bucket_sql('row_id', 'holdout')} % 10000 < 2000 as v from fx_model),
    train as (select * from placed where not v), two as ({_TWO.format(g='1', w='train')}), fit as ({_SOLVE}),
    fill as (select median(sum_qty) as q from train)
    select row_id, round({_PREDICT.replace('sum_qty', 'q')}, 4) as prediction from placed, fit, fill where v""",
)
def score_one_absent(spark, sf_dir):
    """The test table lacks one of the two features; its fitted median stands in."""
    split = holdout_split(_model_table(spark, sf_dir), "row_id")
    train, features = split.where("not is_valid"), ["n_lines", "sum_qty"]
    model = M.fit_pipeline(train, "revenue", features, "ridge")
    types = {c: t for c, t in train.dtypes if c in features}
    return rounded(score_batch(model, split.where("is_valid").drop("revenue", "sum_qty"), types, ["row_id"]), 4)


@query("robustness_shift_trees")
def tree_shift(spark, sf_dir):
    from tablewright.plans.training_loop import prediction_shift

    split = holdout_split(_model_table(spark, sf_dir), "row_id")
    model = M.fit_pipeline(split.where("not is_valid"), "revenue", _FEATURES, "rf")
    shift = prediction_shift(model, split.where("is_valid"), _FEATURES)
    return rounded(spark.createDataFrame([(shift,)], "mean_prediction_shift double"), 4)


@query("train_until_ready")
def loop(spark, sf_dir):
    rounds, _ = train_until_ready(
        view(spark, sf_dir, "fx_model"), "row_id", "revenue", leak_tokens=_LEAKS
    )
    return rounded(rounds, 2)


@query("train_until_ready_with_test")
def loop_with_test(spark, sf_dir):
    """The loop with a test table that lacks a feature and has moved a little."""
    rows = view(spark, sf_dir, "fx_model")
    test = rows.drop("revenue", "avg_tax").withColumn("sum_qty", F.col("sum_qty") * 1.01)
    rounds, _ = train_until_ready(rows, "row_id", "revenue", test, leak_tokens=_LEAKS)
    return rounded(rounds, 2)


@query("train_until_given_up")
def loop_unready(spark, sf_dir):
    """A target the features say nothing about: every round fails its gates and leaves a model out."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("mean_qty"), F.avg("l_discount").alias("mean_disc"), F.max("l_extendedprice").alias("goal")
    )
    rounds, _ = train_until_ready(
        lines.withColumn("goal", F.col("goal") % 997), "l_orderkey", "goal", leak_tokens=_LEAKS
    )
    return rounded(rounds, 2)
