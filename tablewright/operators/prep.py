"""Imputation, scaling, encoding and the fitted preprocessor."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
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
from tablewright.operators.quantiles import exact_quantiles

MAX_CATEGORIES = 100_000


def feature_subset(df: DataFrame, target: str, drop: Sequence[str] = (), threshold: float = 0.98) -> DataFrame:
    """Rows ``(column_name, missing_share, kept)`` over the candidate features."""
    names = [c for c in df.columns if c != target and c not in set(drop)]
    shares = per_column(df, names, lambda c: {"missing_share": F.avg(is_missing(df, c).cast("double"))})
    return shares.withColumn("kept", F.coalesce(F.col("missing_share") < threshold, F.lit(False)))


def kept_features(df: DataFrame, target: str, drop: Sequence[str] = (), threshold: float = 0.98) -> list[str]:
    kept = {r["column_name"] for r in feature_subset(df, target, drop, threshold).where("kept").collect()}
    return [c for c in df.columns if c in kept]


def fit_medians(df: DataFrame, names: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, names, [0.5]).items()}


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill missing values of each column with its fitted value."""
    filled = {}
    for c, v in values.items():
        if v is not None:
            present = number(df, c) if isinstance(v, float) else col(c)
            filled[c] = F.coalesce(present, F.lit(v))
    return df.withColumns(filled) if filled else df


def fit_modes(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest on ties.

    Values are counted per column with map-side partials; no task holds all values of a column.
    """
    if not names:
        return {}
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("c"), col(n).cast("string").alias("v")) for i, n in enumerate(names)]))
    ).where("v is not null")
    counted = pairs.groupBy("c", "v").agg(F.count("*").alias("n"))
    best = counted.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    found = {r["c"]: r["v"] for r in best.collect()}
    return {n: found.get(i) for i, n in enumerate(names)}


def fit_scale(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a column that does not vary is divided by 1."""
    if not names:
        return {}
    stats = [f(number(df, c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*stats).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(names)}


def standard_scale(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (number(df, c) - F.lit(m)) / F.lit(s) for c, (m, s) in scale.items()})


def fit_categories(df: DataFrame, name: str, limit: int = 5000) -> list[str]:
    """Sorted distinct values, refused when one column per value would not be a usable table."""
    found = df.select(col(name).cast("string").alias("v")).where("v is not null").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{name} has more than {limit} values; use the sparse preprocessor")
    return sorted(r["v"] for r in found)


def one_hot(df: DataFrame, name: str, categories: Sequence[str], remove: bool = True) -> DataFrame:
    """One 0/1 column ``<name>_<value>`` per fitted value; other values give all zeros."""
    held = col(name).cast("string")
    flags = {f"{name}_{v}": F.coalesce(held == v, F.lit(False)).cast("int") for v in categories}
    out = df.withColumns(flags) if flags else df
    return out.drop(name) if remove else out


@dataclass
class Preprocessor:
    """Fitted constants and encoders; ``stages`` turn a table into a ``features`` vector."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    stages: list[Transformer] = field(default_factory=list)

    def model(self) -> PipelineModel:
        return PipelineModel(self.stages)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model().transform(df)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def check_categories(df: DataFrame, names: Sequence[str], limit: int = MAX_CATEGORIES) -> None:
    """Refuse columns whose values would not fit an encoder on the driver."""
    if names:
        found = df.agg(*[F.approx_count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
        for i, c in enumerate(names):
            if found[f"c{i}"] > limit:
                raise ValueError(f"{c} has about {found[f'c{i}']} values; drop it or group its values before training")


def complete_columns(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Columns without a missing value, in one pass."""
    row = df.agg(*[F.coalesce(F.bool_or(is_missing(df, c)), F.lit(False)).alias(f"m{i}") for i, c in enumerate(names)])
    found = row.first()
    return {c for i, c in enumerate(names) if not found[f"m{i}"]}


def fit_preprocessor(
    df: DataFrame, features: Sequence[str], standardize: bool = True, complete: Collection[str] = (), checked: bool = False
) -> Preprocessor:
    """Numeric: median, then scale. Categorical: most frequent value, then one-hot with unknown values all zero.

    All steps are stock pipeline stages with the fitted constants written in, so the result can be saved.
    Columns listed in ``complete`` miss no value in any table the result will see; they need no fill value, which
    saves their medians and modes. ``checked`` says that :func:`check_categories` has passed already.
    """
    view = df.select(*[col(c) for c in features])
    prep = Preprocessor(numeric_columns(view), categorical_columns(view))
    if not checked:
        check_categories(view, prep.categorical)
    medians = fit_medians(view, [c for c in prep.numeric if c not in complete])
    modes = fit_modes(view, [c for c in prep.categorical if c not in complete])
    prep.medians = {c: medians.get(c) or 0.0 for c in prep.numeric}
    prep.modes = {c: modes.get(c) or "" for c in prep.categorical}
    if standardize:
        prep.scale = fit_scale(impute(view, prep.medians), prep.numeric)
    exprs, scaled, texts = [], [], []
    for i, c in enumerate(prep.numeric):
        value = f"coalesce(nanvl(cast({_quoted(c)} as double), cast(null as double)), {prep.medians[c]!r}D)"
        mean, width = prep.scale.get(c, (0.0, 1.0))
        exprs.append(f"({value} - ({mean!r}D)) / {width!r}D AS __n{i}")
        scaled.append(f"__n{i}")
    for i, c in enumerate(prep.categorical):
        exprs.append(f"coalesce(cast({_quoted(c)} as string), {_text(prep.modes[c])}) AS __t{i}")
        texts.append(f"__t{i}")
    prep.stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    if texts:
        filled = prep.stages[0].transform(df)
        indexer = StringIndexer(
            inputCols=texts,
            outputCols=[f"{t}i" for t in texts],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        )
        indexed = indexer.fit(filled)
        encoder = OneHotEncoder(
            inputCols=[f"{t}i" for t in texts],
            outputCols=[f"{t}v" for t in texts],
            dropLast=True,
            handleInvalid="error",
        ).fit(indexed.transform(filled))
        prep.stages += [indexed, encoder]
    prep.stages.append(
        VectorAssembler(inputCols=scaled + [f"{t}v" for t in texts], outputCol="features", handleInvalid="error")
    )
    return prep
