"""CSV in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import col


def _cp1252_pairs() -> tuple[str, str]:
    """The characters of bytes 0x80-0x9f in Latin-1 and, in the same order, in Windows-1252."""
    latin, windows = "", ""
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", errors="ignore")
        if char:
            latin, windows = latin + chr(code), windows + char
    return latin, windows


def _is_cp1252(encoding: str) -> bool:
    return encoding.lower().replace("-", "").replace("_", "") in ("cp1252", "windows1252")


def _translate_texts(df: DataFrame, old: str, new: str) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.translate(col(c), old, new) for c in texts}) if texts else df


# The words that stand for a missing value in a CSV field, as the usual data frame library reads them.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]
_GUESSES = ("int", "bigint", "double", "boolean", "date", "timestamp")


def _guessed_types(texts: DataFrame) -> dict[str, str]:
    """For each text column the first type that takes all its values, in one aggregate; a column without any stays text."""

    def fits(c: str, t: str) -> Column:
        value = F.btrim(col(c))
        return F.lower(value).isin("true", "false") if t == "boolean" else value.try_cast(t).isNotNull()

    checks = [
        F.count_if(col(c).isNotNull() & ~fits(c, t)).alias(f"{i}_{t}")
        for i, c in enumerate(texts.columns)
        for t in _GUESSES
    ]
    known = [F.count(col(c)).alias(f"{i}_n") for i, c in enumerate(texts.columns)]
    row = texts.agg(*checks, *known).first()
    return {
        c: next((t for t in _GUESSES if row[f"{i}_n"] and not row[f"{i}_{t}"]), "string") for i, c in enumerate(texts.columns)
    }


def has_quoted_breaks(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether a line holds an odd number of quotes, as it does where a quoted field goes on in the next line.

    One pass over the lines, split like any text. Encodings of more than one byte for a quote cannot be looked at so and count as true.
    """
    if encoding.lower().replace("-", "").replace("_", "").startswith(("utf16", "utf32")):
        return True
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    columns: Sequence[str] | None = None,
    multiline: bool | None = None,
    missing: Sequence[str] = MISSING_WORDS,
) -> DataFrame:
    """CSV with a header row. Give ``schema`` for large files: guessing types reads the whole input once more.

    Quoted fields may hold line breaks. A file that has some is one task; the others are split. Unless ``multiline`` says which it is, the lines are
    looked through for quotes that stay open. The ``missing`` words become null. Fields that do not fit their type become null.

    Spark reads no Windows-1252 by itself; it is read as Latin-1, and the bytes that differ are mapped in place.
    """
    windows = _is_cp1252(encoding)
    multiline = has_quoted_breaks(spark, path, encoding) if multiline is None else multiline
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multiline)
    reader = reader.option("encoding", "ISO-8859-1" if windows else encoding)
    if schema is None:
        texts = reader.csv(path)
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        texts = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])).csv(path)
    if columns is not None:
        texts = texts.select(*[col(c) for c in columns])
    if windows:
        texts = _translate_texts(texts, *_cp1252_pairs())
    texts = texts.select(*[F.when(~col(c).isin(*missing), col(c)).alias(c) for c in texts.columns])
    types = _guessed_types(texts) if schema is None else {f.name: f.dataType for f in wanted.fields}
    return texts.select(
        *[
            (col(c) if types[c] in ("string", T.StringType()) else F.btrim(col(c)).try_cast(types[c])).alias(c)
            for c in texts.columns
        ]
    )


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", mode: str = "errorifexists") -> None:
    windows = _is_cp1252(encoding)
    if windows:
        latin, own = _cp1252_pairs()
        df = _translate_texts(df, own, latin)
    writer = df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"')
    writer.option("encoding", "ISO-8859-1" if windows else encoding).csv(path)
