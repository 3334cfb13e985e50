"""One-hot columns of any number of categories: a dictionary table instead of a list on the driver.

A category's place is its rank in value order, from ranges of values whose sizes are added up, so no task sorts them all. Rows find their places by a join
on the value; the few values that hold many rows each go to all tasks, so a frequent value is no hot key. A row becomes a sparse vector as plain
arrays of indices and values, whose length does not grow with the number of categories.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import categorical_columns, col, number, numeric_columns
from tablewright.operators.groups import small_side
from tablewright.operators.ordering import ROWS_PER_BUCKET, with_row_index
from tablewright.operators.prep import fit_medians, fit_modes, fit_scale, impute
from tablewright.runtime import scratch_table

#: A value with at least one row in so many is sent to all tasks: there are at most as many such values.
FREQUENT = 1_000


@dataclass
class Dictionary:
    """``(value, place, frequent)`` of all values of a column but null, and how many there are."""

    values: DataFrame
    size: int


def fit_dictionary(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> Dictionary:
    """Places in value order, counted from 0."""
    values = df.select(col(column).cast("string").alias("value")).where("value is not null")
    counted = scratch_table(values.groupBy("value").agg(F.count("*").alias("n")), "values")
    size, rows = counted.agg(F.count("*"), F.sum("n")).first()
    frequent = F.col("n") * F.lit(FREQUENT) >= F.lit(rows or 0)
    placed = with_row_index(counted, "value", "place", rows_per_bucket).select("value", "place", frequent.alias("frequent"))
    return Dictionary(scratch_table(placed, "dictionary"), size)


def with_place(df: DataFrame, dictionary: Dictionary, column: str, out: str) -> DataFrame:
    """Add the place of each row's value; null for null and unknown values."""
    rows = df.withColumn("__v", col(column).cast("string"))
    often = dictionary.values.where("frequent").select(F.col("value").alias("__v"), F.col("place").alias("__often"))
    rare = dictionary.values.where("not frequent").select(F.col("value").alias("__r"), F.col("place").alias("__rare"))
    first = rows.join(F.broadcast(often), "__v", "left")  # at most FREQUENT rows
    # Rows that need no partner are spread over the join by a hash.
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(4096)).cast("string"))
    first = first.withColumn("__k", F.when(F.col("__often").isNull() & F.col("__v").isNotNull(), F.col("__v")).otherwise(spread))
    found = first.join(small_side(rare), F.col("__k") == F.col("__r"), "left")
    place = F.when(F.col("__v").isNotNull(), F.coalesce("__often", "__rare"))
    return found.withColumn(out, place).drop("__v", "__often", "__rare", "__r", "__k")


@dataclass
class SparsePreprocessor:
    """Numbers: median, then scale. Categories: most frequent value, then one-hot over dictionaries, unknown values all zero."""

    medians: Mapping[str, float]
    scale: Mapping[str, tuple[float, float]]
    modes: Mapping[str, str]
    dictionaries: Mapping[str, Dictionary]

    @property
    def width(self) -> int:
        return len(self.medians) + sum(d.size for d in self.dictionaries.values())

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``indices`` and ``values`` of each row's sparse vector, of ``width`` in all."""
        indices, values, at, out = [], [], 0, df
        for c, median in self.medians.items():
            mean, width = self.scale.get(c, (0.0, 1.0))
            indices.append(F.lit(at))
            values.append((F.coalesce(number(df, c), F.lit(median)) - F.lit(mean)) / F.lit(width))
            at += 1
        places = []
        for i, (c, dictionary) in enumerate(self.dictionaries.items()):
            out = out.withColumn(f"__f{i}", F.coalesce(col(c).cast("string"), F.lit(self.modes[c])))
            out = with_place(out, dictionary, f"__f{i}", f"__p{i}").drop(f"__f{i}")
            places.append((F.col(f"__p{i}") + F.lit(at)).cast("int"))
            at += dictionary.size
        known = F.filter(F.array(*places), lambda p: p.isNotNull()) if places else F.array().cast("array<int>")
        ones = F.transform(known, lambda p: F.lit(1.0))
        out = out.withColumn("indices", F.concat(F.array(*indices).cast("array<int>"), known))
        out = out.withColumn("values", F.concat(F.array(*values).cast("array<double>"), ones))
        return out.drop(*[f"__p{i}" for i in range(len(self.dictionaries))])


def fit_sparse_preprocessor(df: DataFrame, features: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> SparsePreprocessor:
    view = df.select(*[col(c) for c in features])
    numeric, texts = numeric_columns(view), categorical_columns(view)
    medians = {c: v or 0.0 for c, v in fit_medians(view, numeric).items()}
    scale = fit_scale(impute(view, medians), numeric) if numeric else {}
    modes = {c: v or "" for c, v in fit_modes(view, texts).items()}
    filled = view.fillna({c: modes[c] for c in texts}) if texts else view
    return SparsePreprocessor(medians, scale, modes, {c: fit_dictionary(filled, c, rows_per_bucket) for c in texts})


def as_vector(width: int):
    """The arrays as a vector of Spark's model library, for fits that want one."""
    return F.udf(lambda indices, values: SparseVector(width, indices, values), VectorUDT())
