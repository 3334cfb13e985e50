"""Chunk table: text cells of notebooks and other files, one row per cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.groups import present_in
from tablewright.operators.ordering import fill_forward
from tablewright.runtime import spread

_CELL_ARRAYS = "cells array<struct<cell_type:string,source:array<string>>>"
_CELL_TEXTS = "cells array<struct<cell_type:string,source:string>>"
_EDGE_BLANKS = r"(?U)^\s+|\s+$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(path, content)``, one per text file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_BLANKS, "")


def own_heading(code: Column) -> Column:
    """Last first- or second-level heading line of a text, or null."""
    found = F.try_element_at(F.regexp_extract_all(code, F.lit(r"(?md)^##? (.*)$"), F.lit(1)), F.lit(-1))
    return stripped(found)


def number_cells(cells: DataFrame) -> DataFrame:
    """Chunk rows from ``(path, cell_index, cell_type, code)``: blank cells go, headings carry forward."""
    file_name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")
    rows = cells.where(stripped(F.col("code")) != "").withColumn(
        "__own", F.when(F.col("cell_type") == "markdown", own_heading(F.col("code")))
    )
    filled = fill_forward(rows, "path", "cell_index", "__own", "heading")
    return filled.select(
        F.concat_ws("_", stem, F.col("cell_index").cast("string")).alias("chunk_id"),
        "code",
        file_name.alias("source"),
        F.col("cell_index").cast("int").alias("cell_index"),
        "cell_type",
        "heading",
    )


def notebook_chunks(files: DataFrame) -> DataFrame:
    """Chunks of notebook JSON files given as ``(path, content)``; a cell's source may be a list or one string.

    A file that is no JSON object with a list of cells fails the job.
    """
    cells = F.from_json("content", _CELL_TEXTS)["cells"]
    broken = F.raise_error(F.concat(F.lit("no notebook: "), F.col("path")))
    parsed = spread(files).select(
        "path",
        F.from_json("content", _CELL_ARRAYS)["cells"].alias("lists"),
        F.when(cells.isNull(), broken.cast(_CELL_TEXTS.split(" ", 1)[1])).otherwise(cells).alias("texts"),
    )
    cells = parsed.select("path", F.posexplode(F.arrays_zip("lists", "texts")).alias("cell_index", "c"))
    code = F.coalesce(F.array_join("c.lists.source", ""), F.col("c.texts.source"), F.lit(""))
    kind = F.coalesce(F.col("c.texts.cell_type"), F.lit("code"))
    return number_cells(cells.select("path", "cell_index", kind.alias("cell_type"), code.alias("code")))


def percent_chunks(files: DataFrame) -> DataFrame:
    """Chunks of scripts whose cells start with ``# %%`` lines, which may name ``[markdown]`` or ``[code]``.

    A cell without a kind is code, and so is text before the first marker, or a whole file without markers.
    """
    head = r"# %%(?![^\s])"
    marker = r"(?d)\A" + head + r"[ \t]*(?:\[(markdown|code)\])?[^\n]*(?:\n|\z)"
    parts = F.filter(F.split("content", r"(?md)^(?=" + head + ")"), lambda p: p != "")
    cells = spread(files).select("path", F.posexplode(parts).alias("cell_index", "part"))
    body = F.regexp_replace(F.regexp_replace("part", marker, ""), r"\n+\z", "")
    kind = F.when(F.regexp_extract("part", marker, 1) == "markdown", "markdown").otherwise("code")
    return number_cells(cells.select("path", "cell_index", kind.alias("cell_type"), body.alias("code")))


def upsert(rows: DataFrame, key: str, sequence: str, within: Sequence[str] = ()) -> DataFrame:
    """Last written row per key. A maximum per key, so a key written very often costs no sort. Columns ``within`` follow from the key; rows dealt out by them stay.

    A null sequence counts as earliest; of rows with equal sequences the largest in the order of the other columns stays.
    """
    others = [c for c in rows.columns if c not in (key, sequence, *within)]
    last = rows.groupBy(*within, key).agg(F.max(F.struct(sequence, *others)).alias("__last"))
    return last.select(*within, key, "__last.*").select(*rows.columns)


def fetch_chunks(chunks: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks whose id is asked for."""
    return present_in(chunks, ids, key, key)
