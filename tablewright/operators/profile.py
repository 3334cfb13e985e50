"""Dataset profile: columns, missing values, leakage, correlation, distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    categorical_columns,
    col,
    is_missing,
    number,
    numeric_columns,
    per_column,
)
from tablewright.functions.stats import t_p_value
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.validate import distinct_values, duplicate_rows

# Name parts that mark a column as a likely copy of the target.
LEAK_TOKENS = ("target", "label", "price", "score", "y", "saleprice", "loss")


def profile_dataset(df: DataFrame, target: str) -> DataFrame:
    """One row: shape, column classes, duplicates, constant columns and target summary."""
    constants = constant_columns(df, target).agg(F.array_sort(F.collect_list("column_name")).alias("c"))
    return target_summary(df, target).select(
        F.col("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(",".join(numeric_columns(df))).alias("numeric_columns"),
        F.lit(",".join(categorical_columns(df))).alias("categorical_columns"),
        duplicate_rows(df).scalar().alias("duplicate_rows"),
        F.array_join(constants.scalar(), ",").alias("constant_columns"),
        F.lit(df.schema[target].dataType.simpleString()).alias("target_dtype"),
        *[F.col(c) for c in ("mean", "std", "min", "max", "n_unique")],
    )


def constant_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """Columns with at most one distinct value, null counting as a value.

    Lowest and highest value decide it, so no distinct count (and no shuffle of the values) is needed.
    """
    names = [c for c in df.columns if c != target]

    def stats(c: str):
        missing = is_missing(df, c)
        present = F.when(~missing, col(c))
        some, none = F.count(present), F.count_if(missing)
        return {"constant": (some == 0) | ((none == 0) & F.min(present).eqNullSafe(F.max(present)))}

    return per_column(df, names, stats).where("constant").select("column_name")


def target_summary(df: DataFrame, target: str) -> DataFrame:
    value = number(df, target)
    return df.agg(
        F.count("*").alias("rows"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).withColumn("n_unique", distinct_values(df, target).scalar())


def name_flags(columns: Sequence[str], tokens: Sequence[str] = LEAK_TOKENS, whole_word: bool = False) -> list[str]:
    """Columns whose name holds one of the tokens (or, with ``whole_word``, is made of one between separators)."""
    if whole_word:
        return [c for c in columns if set(re.split(r"[^a-z0-9]+", c.lower())) & set(tokens)]
    return [c for c in columns if any(t in c.lower() for t in tokens)]


def leakage_report(
    df: DataFrame,
    target: str,
    tokens: Sequence[str] = LEAK_TOKENS,
    whole_word: bool = False,
    same_type: bool = False,
) -> DataFrame:
    """Rows ``(column_name, name_flag, equals_target)``.

    ``same_type`` also asks for the same numeric class (whole or fractional) before calling a column a copy.
    """
    names = [c for c in df.columns if c != target]
    flagged = set(name_flags(names, tokens, whole_word))
    goal = number(df, target)

    def whole(c: str) -> bool:
        return df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")

    def stats(c: str):
        equal = F.coalesce(F.bool_and(number(df, c).eqNullSafe(goal)), F.lit(False))
        if same_type:
            equal = equal & F.lit(whole(c) == whole(target))
        return {"name_flag": F.lit(c in flagged), "equals_target": equal}

    return per_column(df, names, stats)


def missing_by_column(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    return per_column(
        df, df.columns, lambda c: {"dtype": F.lit(types[c]), "n_missing": F.count_if(is_missing(df, c))}
    )


def missing_top(df: DataFrame, limit: int = 15) -> DataFrame:
    """Columns with most missing values first; names break ties."""
    counts = missing_by_column(df).select("column_name", "n_missing").where("n_missing > 0")
    return counts.orderBy(F.desc("n_missing"), "column_name").limit(limit)


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """Share of each non-null target value."""
    known = df.where(~is_missing(df, target))
    total = known.agg(F.count("*")).scalar()
    return (
        known.groupBy(col(target).alias("value"))
        .agg(F.count("*").alias("n"))
        .withColumn("share", F.col("n") / total)
        .orderBy(F.desc("n"), "value")
    )


def target_correlation(df: DataFrame, target: str, names: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of each numeric column with the target, strongest first."""
    names = [c for c in (names or numeric_columns(df)) if c != target]
    goal = number(df, target)
    found = per_column(df, names, lambda c: {"r": _corr(number(df, c), goal)})
    return found.orderBy(F.desc_nulls_last(F.abs("r")), "column_name")


def _corr(x, y):
    """Correlation; NULL where one side does not vary (``corr`` itself would fail the query there)."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x))) * F.sqrt(F.var_pop(F.when(both, y)))
    return F.try_divide(F.covar_pop(x, y), spread)


def univariate_regression(df: DataFrame, column: str, names: Sequence[str] | None = None) -> DataFrame:
    """Least-squares line of each column on ``column``: slope, intercept, r, standard error and rows used."""
    names = list(names or numeric_columns(df))
    x = number(df, column)

    def stats(c: str):
        y = number(df, c)
        return {
            "n": F.regr_count(y, x),
            "slope": F.regr_slope(y, x),
            "intercept": F.regr_intercept(y, x),
            "rvalue": _corr(x, y),
            "sxx": F.regr_sxx(y, x),
            "syy": F.regr_syy(y, x),
        }

    fitted = per_column(df, names, stats)
    unexplained = F.greatest(F.lit(0.0), 1 - F.col("rvalue") * F.col("rvalue"))
    error = F.sqrt(unexplained * F.try_divide("syy", "sxx") / F.when(F.col("n") > 2, F.col("n") - 2))
    return fitted.withColumn("stderr", error).drop("sxx", "syy")


def with_p_value(lines: DataFrame) -> DataFrame:
    """Add the two-sided p-value of a zero slope to the result of :func:`univariate_regression`."""
    t = F.coalesce(F.try_divide("slope", "stderr"), F.lit(float("inf")))
    return lines.withColumn("pvalue", t_p_value(t, (F.col("n") - 2).cast("double")))


def describe_numeric(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    names = list(names or numeric_columns(df))
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])

    def stats(c: str):
        v = number(df, c)
        return {
            "count": F.count(v),
            "mean": F.avg(v),
            "std": F.stddev_samp(v),
            "min": F.min(v),
            **{q: F.lit(x).cast("double") for q, x in zip(("q25", "q50", "q75"), quartiles[c])},
            "max": F.max(v),
        }

    return per_column(df, names, stats)


def boxplot_stats(df: DataFrame, names: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, fences at ``whisker`` inter-quartile ranges and the number of values outside them."""
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])

    def stats(c: str):
        q1, median, q3 = (F.lit(x).cast("double") for x in quartiles[c])
        low, high = q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)
        v = number(df, c)
        return {
            "q1": q1,
            "median": median,
            "q3": q3,
            "lower_fence": low,
            "upper_fence": high,
            "outliers": F.count_if((v < low) | (v > high)),
        }

    return per_column(df, names, stats)


def kde_grid(df: DataFrame, name: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density of a column at evenly spaced points.

    The grid spans the data and half its range on both sides; the bandwidth is ``n^(-1/5)`` sample deviations.
    Equal values count once. Each task adds its own kernels up per grid point, so the shuffle carries one partial grid per task; a
    grid point farther than nine bandwidths, where the kernel is lost in a double, is left out.
    """
    data = df.select(number(df, name).alias("x")).where("x is not null")
    s = data.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"))
    s = s.first()
    if s["n"] < 2 or not s["sd"]:
        raise ValueError(f"{name} needs at least two different values for a density")
    n, width, reach = s["n"], s["sd"] * s["n"] ** -0.2, (s["hi"] - s["lo"]) * 0.5
    start, step = s["lo"] - reach, (s["hi"] - s["lo"] + 2 * reach) / (points - 1)
    at = start + step * np.arange(points)

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            ordered = batch.sort_values("x")
            values, often = ordered["x"].to_numpy(), ordered["often"].to_numpy()
            for low in range(0, len(values), 1024):
                near, weight = values[low : low + 1024], often[low : low + 1024]
                first, last = np.searchsorted(at, (near[0] - 9 * width, near[-1] + 9 * width))
                z = (at[first:last, None] - near[None, :]) / width
                total[first:last] += np.exp(-0.5 * z * z) @ weight
        yield pd.DataFrame({"point": np.arange(points), "total": total})

    scale = 1.0 / (n * width * float(np.sqrt(2 * np.pi)))
    return (
        data.groupBy("x").agg(F.count("*").cast("double").alias("often")).mapInPandas(kernels, "point int, total double")
        .groupBy("point")
        .agg((F.sum("total") * scale).alias("density"))
        .select("point", (F.lit(start) + F.col("point") * F.lit(step)).alias("x"), "density")
    )


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first."""
    known = df.where(~is_missing(df, name))
    return known.groupBy(col(name).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
