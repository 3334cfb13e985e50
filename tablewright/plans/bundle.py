"""Saved models: the fitted pipeline and one row about how it was made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.reports import write_report

ABOUT = (
    "target string, model string, features array<string>, feature_types array<string>, dropped array<string>, "
    "seed int, iteration int"
)


def save_bundle(
    model: PipelineModel,
    path: str,
    table: DataFrame,
    target: str,
    name: str,
    features: Sequence[str],
    dropped: Sequence[str] = (),
    seed: int = 42,
    iteration: int = 1,
) -> None:
    model.write().overwrite().save(f"{path}/model")
    types = dict(table.dtypes)
    about = [(target, name, list(features), [types[c] for c in features], list(dropped), seed, iteration)]
    write_report(table.sparkSession.createDataFrame(about, ABOUT), f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, dict[str, str], dict]:
    """The model, its features with their types in training order, and the rest of the row."""
    about = spark.read.schema(ABOUT).json(f"{path}/about").first().asDict()
    return PipelineModel.load(f"{path}/model"), dict(zip(about["features"], about["feature_types"])), about
