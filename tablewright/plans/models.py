"""Candidate models. Each takes a table with ``features`` and ``label`` and returns a fitted Spark model."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col, is_missing, number, numeric_columns, strict_number
from tablewright.operators.metrics import regression_metrics
from tablewright.operators.prep import fit_preprocessor
from tablewright.operators.split import holdout_split, sample_fraction
from tablewright.plans.binning import ROW_ID, with_row_id
from tablewright.plans.boosting import Boosting, fit_boosted
from tablewright.plans.forest import Forest, ForestModel, budget_errors, fit_forest_model

_NORMAL_EQUATION_FEATURES = 4096
LABEL_NAMES = ("target", "label", "y")


@dataclass(frozen=True)
class Settings:
    """Model sizes. The defaults are the full-size ones, which all queries use; tests pass smaller ones. A depth of None has no limit."""

    alpha: float = 1.0
    forest_trees: int = 300
    forest_depth: int | None = None
    min_leaf: int = 2
    boost_rounds: int = 100
    boost_depth: int = 3
    boost_rate: float = 0.1
    extra_trees: int = 300
    extra_depth: int | None = None
    seed: int = 42
    extras: dict = field(default_factory=dict)


SMALL = Settings(forest_trees=10, forest_depth=6, boost_rounds=10, extra_trees=5, extra_depth=6)


def fit_ridge(data: DataFrame, s: Settings = Settings()) -> Model:
    """Least squares plus ``alpha`` times the squared weights, the intercept left free.

    Spark scales its penalty by the row count and the label deviation; the factor here undoes that.
    """
    row = data.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("pop"), F.stddev_samp("label").alias("samp")).first()
    width = data.schema["features"].metadata.get("ml_attr", {}).get("num_attrs") or data.select("features").first()[0].size
    normal = width <= _NORMAL_EQUATION_FEATURES
    spread = row["pop"] if normal else row["samp"]
    return LinearRegression(
        solver="normal" if normal else "l-bfgs",
        standardization=False,
        elasticNetParam=0.0,
        regParam=s.alpha * (spread or 1.0) / row["n"],
        maxIter=500,
        tol=1e-10,
    ).fit(data)


def forest_of(s: Settings) -> Forest:
    return Forest(s.forest_trees, s.min_leaf, s.forest_depth, seed=s.seed)


def extra_of(s: Settings) -> Forest:
    """Every tree sees all rows; thresholds are drawn at random."""
    return Forest(s.extra_trees, s.min_leaf, s.extra_depth, bootstrap=False, random_cuts=True, seed=s.seed)


def boosting_of(s: Settings) -> Boosting:
    return Boosting(s.boost_rounds, s.boost_depth, s.boost_rate, seed=s.seed)


def fit_forest(data: DataFrame, s: Settings = Settings()) -> ForestModel:
    return fit_forest_model(data, forest_of(s))


def fit_boosting(data: DataFrame, s: Settings = Settings()) -> ForestModel:
    return fit_boosted(data, boosting_of(s))


def fit_extra(data: DataFrame, s: Settings = Settings()) -> ForestModel:
    return fit_forest_model(data, extra_of(s))


CANDIDATES: dict[str, Callable[[DataFrame, Settings], Model]] = {
    "ridge": fit_ridge,
    "rf": fit_forest,
    "gb": fit_boosting,
    "extratrees": fit_extra,
}


def with_label(df: DataFrame, target: str) -> DataFrame:
    """Add ``label``, the target as double; text that is no number, and missing values, fail the job."""
    value = strict_number(df, target)
    broken = F.raise_error(F.lit(f"target {target} has missing values")).cast("double")
    return df.withColumn("label", F.when(is_missing(df, target), broken).otherwise(value))


def fit_pipeline(
    train: DataFrame,
    target: str,
    features: Sequence[str],
    name: str,
    settings: Settings = Settings(),
    standardize: bool = True,
    complete: Collection[str] = (),
    checked: bool = False,
) -> PipelineModel:
    """Preprocessor and model, both fitted on ``train``."""
    prep = fit_preprocessor(train, features, standardize, complete, checked)
    ready = prep.transform(with_label(with_row_id(train), target)).select("features", "label", ROW_ID)
    return PipelineModel([*prep.stages, CANDIDATES[name](ready, settings)])


def fit_and_score(
    df: DataFrame, key: str, target: str, features: Sequence[str], name: str, settings: Settings = Settings()
) -> tuple[PipelineModel, DataFrame]:
    """Fit on four fifths; returns the model and its metrics on the rest."""
    split = holdout_split(df, key, 0.2, "__valid")
    model = fit_pipeline(split.where("not __valid"), target, features, name, settings)
    scored = model.transform(split.where("__valid"))
    return model, regression_metrics(scored, target, "prediction").select(F.lit(name).alias("model"), "*")


def fit_boosting_with_stop(
    rows: DataFrame,
    valid_flag: str,
    rounds: int = 1648,
    depth: int = 8,
    rate: float = 0.05,
    share: float = 0.8,
    seed: int = 42,
    patience: int = 50,
    penalty: float = 1.0,
) -> ForestModel:
    """Long boosting run that ends once the squared error on the flagged rows has not fallen for ``patience`` rounds; rounds up to the best are kept."""
    wanted = Boosting(rounds, depth, rate, share, penalty=penalty, patience=patience, seed=seed)
    return fit_boosted(rows.withColumn("valid", F.col(valid_flag)), wanted)


#: The leaf budgets that are compared.
LEAF_BUDGETS = (100, 125, 150, 175, 200, 225, 300, 350, 400, 3500, 3750, 4000, 4250, 4500, 12500, 13000, 13500, 14000)


def capacity_sweep(
    rows: DataFrame, valid_flag: str, budgets: Sequence[int] = LEAF_BUDGETS, trees: int = 100, seed: int = 23
) -> list[tuple[int, float, bool]]:
    """Mean absolute error of a forest on the flagged rows by number of leaves: ``(max_leaves, mae, is_best)``; the first best wins.

    All sizes come from one forest that is grown best-first.
    """
    found = budget_errors(rows, valid_flag, budgets, Forest(trees, seed=seed))
    best = min(found, key=lambda d: d[1])[0]
    return [(b, e, b == best) for b, e in found]


def label_column(df: DataFrame) -> str:
    """The usual label names first, else the last column."""
    return next((c for c in LABEL_NAMES if c in df.columns), df.columns[-1])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight per class that makes all classes count the same: rows / (classes * rows of the class)."""
    counts = df.where(~is_missing(df, label)).groupBy(col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.withColumn("weight", totals["rows"] / (totals["classes"] * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight", max_classes: int = 10_000) -> DataFrame:
    """Weights ride in a literal map: classes are few, and the count is checked."""
    found = class_weights(df, label).limit(max_classes + 1).collect()
    if len(found) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    pairs = [F.lit(x) for r in found for x in (r["label"], r["weight"])]
    return df.withColumn(out, F.create_map(*pairs)[col(label)])


class ClassOfOdds:
    """A boosted model of log-odds, followed by probability and class."""

    @staticmethod
    def after(model: ForestModel) -> PipelineModel:
        model._set(predictionCol="__odds")
        chance = "1 / (1 + exp(-__odds))"
        classes = SQLTransformer(
            statement=f"SELECT * EXCEPT (__odds), {chance} AS chance, CASE WHEN __odds > 0 THEN 1.0D ELSE 0.0D END AS prediction FROM __THIS__"
        )
        return PipelineModel([model, classes])


def fit_classifier(data: DataFrame, settings: Settings = Settings()) -> Model:
    """Boosted trees for two classes, a forest for more; labels are 0, 1, ..."""
    top = data.agg(F.max("label")).first()[0]
    if top is not None and top <= 1:
        return ClassOfOdds.after(fit_boosted(data, replace(boosting_of(settings), loss="logistic")))
    return fit_forest_model(data, replace(forest_of(settings), min_leaf=1, tries="sqrt", classes=int(top or 0) + 1))


def train_classifier(
    df: DataFrame, key: str, fraction: float = 0.2, settings: Settings = Settings(), target: str | None = None
) -> tuple[PipelineModel, DataFrame]:
    """Numeric features only, four fifths of a row sample for training; returns the model and one row of accuracies.

    The target is given, or inferred by :func:`label_column`. A missing feature value counts as below all others. The
    model runs on the raw table and adds the predicted class as ``predicted``.
    """
    target = label_column(df.drop(key)) if target is None else target
    rows = sample_fraction(df, key, fraction) if fraction < 1 else df
    features = numeric_columns(df, exclude=[key, target])
    known = rows.where(~is_missing(rows, target)).withColumn("__target", col(target).cast("string"))
    split = holdout_split(known, key, 0.2, "__valid")
    lows = split.agg(
        *[F.min(number(split, c)).alias(f"a{i}") for i, c in enumerate(features)],
        *[F.max(number(split, c)).alias(f"b{i}") for i, c in enumerate(features)],
    ).first()
    values = []
    for i, c in enumerate(features):
        low, high = lows[f"a{i}"] or 0.0, lows[f"b{i}"] or 0.0
        below = low - max(1.0, high - low)
        values.append(f"coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {below!r}D) AS __f{i}")
    prepare = [
        SQLTransformer(statement=f"SELECT *, {', '.join(values)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="features"),
    ]
    indexer = StringIndexer(inputCol="__target", outputCol="__label", stringOrderType="alphabetAsc").fit(split)
    ready = PipelineModel([*prepare, indexer]).transform(split)
    train = ready.where("not __valid").select("features", F.col("__label").alias("label"))
    model = fit_classifier(train, settings)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    whole = PipelineModel([*prepare, model, names])
    right = (F.col("__target") == F.col("predicted")).cast("double")
    accuracy = whole.transform(split).agg(
        F.lit(target).alias("target"),
        F.count_if(~F.col("__valid")).alias("n_train"),
        F.count_if(F.col("__valid")).alias("n_valid"),
        F.avg(F.when(~F.col("__valid"), right)).alias("train_accuracy"),
        F.avg(F.when(F.col("__valid"), right)).alias("valid_accuracy"),
    )
    return whole, accuracy


def fit_balanced_logistic(data: DataFrame, weight: str = "weight") -> Model:
    """L2-regularised with unit strength on the sum of losses, as ``C = 1``."""
    total = data.agg(F.sum(weight)).first()[0]
    return LogisticRegression(
        weightCol=weight, maxIter=2000, regParam=1.0 / total, elasticNetParam=0.0, standardization=False, tol=1e-8
    ).fit(data)


def balanced_forest_of(s: Settings, classes: int) -> Forest:
    """Classes weigh the same in each tree's own sample, and a split tries the square root of the number of features."""
    return Forest(s.forest_trees, max_depth=s.forest_depth, tries="sqrt", classes=classes, balanced=True, seed=s.seed)


def fit_balanced_forest(data: DataFrame, settings: Settings = Settings()) -> ForestModel:
    classes = int(data.agg(F.max("label")).first()[0]) + 1
    return fit_forest_model(data, balanced_forest_of(settings, classes))
