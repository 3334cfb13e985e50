"""Scored output: predictions, alignment to a sample file, format check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.sources.csvfiles import write_csv


def with_features(df: DataFrame, features: dict[str, str]) -> DataFrame:
    """Add features (``{name: type}``) the table lacks as nulls."""
    absent = {c: F.lit(None).cast(t) for c, t in features.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def score_batch(model: Transformer, df: DataFrame, features: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for a table that may lack features; ``keep`` columns ride along."""
    scored = model.transform(with_features(df, features))
    return scored.select(*[col(c) for c in keep], "prediction")


def write_predictions(scored: DataFrame, path: str) -> None:
    write_csv(scored, path, mode="overwrite")


def _sample_columns(sample: DataFrame, key: str, sample_key: str | None, sample_target: str | None) -> tuple[str, str]:
    """Key and target column of a sample table; what is not named must be the only choice."""
    sample_key = sample_key or key
    if sample_key not in sample.columns:
        raise ValueError(f"the sample has no column {sample_key}; name its key")
    others = [c for c in sample.columns if c != sample_key]
    if sample_target is None and len(others) != 1:
        raise ValueError(f"the sample has {len(others)} columns besides {sample_key}; name its target")
    return sample_key, sample_target or others[0]


def align_submission(
    predictions: DataFrame,
    key: str,
    prediction: str = "prediction",
    sample: DataFrame | None = None,
    sample_key: str | None = None,
    sample_target: str | None = None,
) -> DataFrame:
    """Predictions in the shape of a sample table: its rows by key, its columns, its target replaced.

    Without a sample the key and the prediction are kept. Rows of the sample without a prediction get null.
    """
    if sample is None:
        return predictions.select(col(key), col(prediction).alias("prediction"))
    sample_key, sample_target = _sample_columns(sample, key, sample_key, sample_target)
    scored = predictions.select(col(key).alias("__k"), col(prediction).alias("__p"))
    filled = sample.join(scored, col(sample_key) == F.col("__k"), "left").withColumn(sample_target, F.col("__p"))
    return filled.select(*[col(c) for c in sample.columns])


def check_submission(submission: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows ``(check, passed, detail)``: same columns in the same order, same number of rows."""
    same = submission.columns == sample.columns
    counts = (
        submission.select(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
        .unionAll(sample.select(F.lit(0).cast("bigint"), F.lit(1).cast("bigint")))
        .agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    )
    return counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("columns").alias("check"),
                    F.lit(same).alias("passed"),
                    F.lit(",".join(submission.columns)).alias("detail"),
                ),
                F.struct(
                    F.lit("rows").alias("check"),
                    (F.col("a") == F.col("b")).alias("passed"),
                    F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail"),
                ),
            )
        )
    )
