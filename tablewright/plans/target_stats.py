"""Boosted trees on categories: ordered target statistics and symmetric trees.

A category becomes the mean label of its rows. For a training row only rows before it in a hashed permutation count, so its own label never tells on it;
a category's window is cut into ranges of the hash, and totals of earlier ranges are added, so a category with a third of all rows is no hot group. Other rows take the mean over all
training rows. Both are smoothed towards the overall mean; unknown categories get it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import categorical_columns, col, is_missing, key_hash, number, numeric_columns
from tablewright.operators.groups import small_side
from tablewright.operators.ordering import ROWS_PER_BUCKET, bucket_count
from tablewright.operators.split import holdout_split
from tablewright.plans.binning import with_row_id
from tablewright.plans.boosting import Boosting, fit_boosted
from tablewright.runtime import scratch_table

PRIOR_WEIGHT = 1.0
#: The usual sizes of boosted symmetric trees.
SYMMETRIC = Boosting(rounds=1000, depth=6, rate=0.03, penalty=3.0, loss="logistic", symmetric=True)


def ordered_target_statistics(
    df: DataFrame, key: str, column: str, label: str, out: str, weight: float = PRIOR_WEIGHT, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add ``out``: the smoothed mean label of the rows of the same category that come before by the hash of ``key`` (unique). Null is a category."""
    mean, rows = df.agg(F.avg(label), F.count("*")).first()
    buckets = bucket_count(rows, rows_per_bucket)
    hashed = df.withColumn("__h", F.coalesce(key_hash(col(key)), F.lit(0))).withColumn("__g", col(column))
    placed = hashed.withColumn("__b", F.floor(F.col("__h") * buckets / F.lit(2**32)).cast("int"))
    inside = Window.partitionBy("__g", "__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    before = placed.withColumn("__s", F.coalesce(F.sum(label).over(inside), F.lit(0.0))).withColumn("__n", F.count("*").over(inside))
    if buckets > 1:
        earlier = Window.partitionBy("__og").orderBy("__ob").rowsBetween(Window.unboundedPreceding, -1)
        totals = placed.groupBy(F.col("__g").alias("__og"), F.col("__b").alias("__ob")).agg(F.sum(label).alias("s"), F.count("*").alias("n"))
        offsets = totals.select("__og", "__ob", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}0") for c in ("s", "n")])
        same = F.col("__g").eqNullSafe(F.col("__og")) & (F.col("__b") == F.col("__ob"))
        before = before.join(small_side(offsets), same).withColumns({"__s": F.col("__s") + F.col("__s0"), "__n": F.col("__n") + F.col("__n0")})
    return before.withColumn(out, (F.col("__s") + F.lit(weight * mean)) / (F.col("__n") + F.lit(weight))).select(*df.columns, out)


def target_statistics(df: DataFrame, column: str, label: str, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """``(category, value)`` over all rows, for rows that are not trained on."""
    mean = df.agg(F.avg(label)).first()[0]
    sums = df.groupBy(col(column).alias("category")).agg(F.sum(label).alias("s"), F.count("*").alias("n"))
    return sums.select("category", ((F.col("s") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))).alias("value"))


def with_target_statistics(df: DataFrame, stats: DataFrame, column: str, out: str, default: float) -> DataFrame:
    side = small_side(stats).select(F.col("category").alias("__c"), F.col("value").alias(out))
    joined = df.join(side, col(column).eqNullSafe(F.col("__c")), "left").drop("__c")
    return joined.withColumn(out, F.coalesce(out, F.lit(default)))


def fit_on_categories(
    df: DataFrame, key: str, target: str, features: Sequence[str], boosting: Boosting = SYMMETRIC, share: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Train on four fifths, a 0/1 target; returns ``(key, label, valid, odds, predicted)`` of all rows and one row of accuracies.

    Numbers miss nothing: a missing one is below all others. Every other column is a category.
    """
    view = df.select(*[col(c) for c in features])
    numbers, texts = numeric_columns(view), categorical_columns(view)
    known = df.where(~is_missing(df, target)).select(col(key).alias("__key"), col(target).cast("double").alias("label"), *[col(c) for c in features])
    rows = scratch_table(holdout_split(known, "__key", 0.2, "valid"), "categories")
    train, mean = rows.where("not valid"), rows.where("not valid").agg(F.avg("label")).first()[0]
    fitted, scored = train, rows
    for i, c in enumerate(texts):
        stats = scratch_table(target_statistics(train, c, "label"), "target_statistics")
        fitted = ordered_target_statistics(fitted, "__key", c, "label", f"__t{i}")
        scored = with_target_statistics(scored, stats, c, f"__t{i}", mean)
    names = [*(f"__x{i}" for i in range(len(numbers))), *(f"__t{i}" for i in range(len(texts)))]

    def vectors(part: DataFrame) -> DataFrame:
        filled = part.withColumns({f"__x{i}": F.coalesce(number(part, c), F.lit(-1.7e308)) for i, c in enumerate(numbers)})
        return VectorAssembler(inputCols=names, outputCol="features").transform(filled)

    ready = with_row_id(fitted.select("__key")).join(vectors(fitted), "__key").select("features", "label", "__row")
    model = fit_boosted(ready, boosting)
    odds = model.transform(vectors(scored)).select(F.col("__key").alias(key), "label", "valid", F.col("prediction").alias("odds"))
    odds = odds.withColumn("predicted", (F.col("odds") > 0).cast("double"))
    right = (F.col("label") == F.col("predicted")).cast("double")
    sides = {"train": ~F.col("valid"), "valid": F.col("valid")}
    accuracy = odds.agg(
        *[F.count_if(w).alias(f"n_{n}") for n, w in sides.items()], *[F.avg(F.when(w, right)).alias(f"{n}_accuracy") for n, w in sides.items()]
    )
    return odds, accuracy
