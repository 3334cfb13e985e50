import json
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablewright.operators.textlog import error_counts, excerpt, extract_code, with_error
from tablewright.runtime import shared_dir
from tablewright.sources.chunks import notebook_chunks, percent_chunks, read_files, upsert
from tablewright.sources.csvfiles import read_csv, write_csv
from tablewright.sources.reports import append_events, read_events, run_rollup, write_report


def test_csv_in_windows_1252(spark, tmp_path):
    text = "id;name;price\n1;Café – “quoted” €5;3.5\n2;\"a \"\"b\"\";c\";\n"
    (tmp_path / "in.csv").write_bytes(text.encode("cp1252"))
    got = read_csv(spark, str(tmp_path / "in.csv"), "id int, name string, price double", ";", "cp1252", ["name", "price"])
    assert [tuple(r) for r in got.collect()] == [("Café – “quoted” €5", 3.5), ('a "b";c', None)]
    write_csv(got, str(tmp_path / "out"), ";", "windows-1252")
    again = read_csv(spark, str(tmp_path / "out"), "name string, price double", ";", "windows-1252")
    assert sorted(again.collect()) == sorted(got.collect())
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    assert "€".encode("cp1252") in raw


def test_csv_types_are_inferred_without_a_schema(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,x\n2,\n")
    got = read_csv(spark, str(tmp_path / "in.csv"))
    assert got.dtypes == [("a", "int"), ("b", "string")]


def test_csv_keeps_line_breaks_and_reads_missing_words(spark, tmp_path):
    rows = [(1, "a\nb"), (2, 'say "x";\r\ny'), (3, "plain")]
    write_csv(spark.createDataFrame(rows, "i int, t string"), str(tmp_path / "out"))
    got = read_csv(spark, str(tmp_path / "out"), "i int, t string")
    assert sorted(map(tuple, got.collect())) == [(1, "a\nb"), (2, 'say "x";\r\ny'), (3, "plain")]
    (tmp_path / "in.csv").write_text("a,b,c,d\n1,NA,2020-01-02,yes\nnull,2.5,n/a,NaN\n3, 4 ,2021-01-01,no\n")
    got = read_csv(spark, str(tmp_path / "in.csv"))
    assert dict(got.dtypes) == {"a": "int", "b": "double", "c": "date", "d": "string"}
    assert [r["b"] for r in got.orderBy("a").collect()] == [2.5, None, 4.0]
    assert read_csv(spark, str(tmp_path / "in.csv"), "a int, b double, c date, d string").where("b is null or d is null").count() == 2


def test_broken_notebook_fails(spark):
    files = spark.createDataFrame([("x.ipynb", "{broken"), ("y.ipynb", '{"cells": []}')], "path string, content string")
    assert notebook_chunks(files.where("path = 'y.ipynb'")).count() == 0
    with pytest.raises(Exception, match="no notebook"):
        notebook_chunks(files).collect()


def test_percent_cells_without_markers(spark):
    files = spark.createDataFrame(
        [("a.py", "import x\n# %%\nbare = 1\n# %% [markdown]\n# Head\n# %%not a marker\n"), ("b.py", "whole = 2\n")], "path string, content string"
    )
    got = [tuple(r) for r in percent_chunks(files).select("source", "cell_type", "code").orderBy("source", "cell_index").collect()]
    assert got == [
        ("a.py", "code", "import x"),
        ("a.py", "code", "bare = 1"),
        ("a.py", "markdown", "# Head\n# %%not a marker"),
        ("b.py", "code", "whole = 2"),
    ]


def test_upsert_with_null_and_equal_sequence(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "p", None), ("b", "q", 1), ("c", "m", 2), ("c", "n", 2)], "id string, v string, seq int")
    assert {r["id"]: r["v"] for r in upsert(rows, "id", "seq").collect()} == {"a": "x", "b": "q", "c": "n"}


def test_notebook_cells(spark, tmp_path):
    cells = [
        {"cell_type": "code", "source": ["a = 1\n", "b"]},
        {"cell_type": "markdown", "source": "# One \ntext\n## Two"},
        {"source": ["# no heading"]},
        {"cell_type": "code", "source": ["  \n"]},
        {"cell_type": "markdown", "source": ["### deeper"]},
        {"cell_type": "code"},
        {"cell_type": "raw", "source": ["x"]},
    ]
    (tmp_path / "my.book.ipynb").write_text(json.dumps({"cells": cells, "metadata": {}}, indent=1))
    got = notebook_chunks(read_files(spark, str(tmp_path / "*.ipynb"))).orderBy("cell_index").collect()
    assert [(r["chunk_id"], r["cell_type"], r["heading"]) for r in got] == [
        ("my.book_0", "code", None),
        ("my.book_1", "markdown", "Two"),
        ("my.book_2", "code", "Two"),
        ("my.book_4", "markdown", "Two"),
        ("my.book_6", "raw", "Two"),
    ]
    assert got[0]["code"] == "a = 1\nb" and got[0]["source"] == "my.book.ipynb"


def test_percent_cells(spark, tmp_path):
    text = "intro\n# %% [markdown]\n# Title\nbody\n\n# %% [code]\nx = 1\n# %% other\n\n# %% [code]\n\n"
    (tmp_path / "s.py").write_text(text)
    got = percent_chunks(read_files(spark, str(tmp_path / "s.py"))).orderBy("cell_index").collect()
    assert [(r["chunk_id"], r["cell_type"], r["code"], r["heading"]) for r in got] == [
        ("s_0", "code", "intro", None),
        ("s_1", "markdown", "# Title\nbody", "Title"),
        ("s_2", "code", "x = 1", "Title"),
    ]


def test_upsert_keeps_the_last_write(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 3, "new"), ("a", 2, "old"), ("b", 1, "x")], "id string, seq int, v string")
    assert {r["id"]: r["v"] for r in upsert(rows, "id", "seq").collect()} == {"a": "new", "b": "x"}


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.sql(
        "select timestamp'2024-01-01 00:00:00.123456' as timestamp, 'one' as agent, 'start' as event_type, 'p' as payload"
    )
    append_events(events, path)
    append_events(events.withColumn("timestamp", F.expr("timestamp + interval 90 seconds")), path)
    got = run_rollup(read_events(spark, path), "event_type", "agent", "timestamp").first()
    assert got["n_events"] == 2 and got["seconds"] == 90.0


def test_report_is_one_file(spark, tmp_path):
    write_report(spark.range(5).repartition(3), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.json"))) == 1


def test_text_helpers(spark):
    texts = [
        "a\n```python\nx = 1\n```\nb\n```\ny\n```",
        "  plain ",
        "Traceback\nValueError: bad thing \nmore",
        "z" * 600,
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    code = [r["code"] for r in extract_code(df, "t").orderBy("id").collect()]
    assert code[:2] == ["x = 1\n\ny", "plain"]
    got = [(r["error_type"], r["error_message"]) for r in with_error(df, "t").orderBy("id").collect()]
    assert got[2] == ("ValueError", "bad thing") and got[3] == (None, "z" * 500)
    assert got[4] == (None, None) and got[5] == (None, None)
    assert {r["error_type"]: r["n"] for r in error_counts(df, "t").collect()} == {"ValueError": 1, None: 5}
    cut = excerpt(df.where("id = 3"), "t", 10, 20).first()
    assert len(cut["head"]) == 10 and len(cut["tail"]) == 20


def test_scratch_is_cleared(spark):
    from tablewright.runtime import clear_scratch, scratch_table

    kept = scratch_table(spark.range(3), "tidy")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 3 and Path(folder).exists()
    assert clear_scratch(spark) >= 1 and not Path(folder).exists()


def test_shared_folder():
    def session(master, folder):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(master=master, applicationId="shared-folder-test"),
        )

    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(session("yarn", None))
    assert shared_dir(session("local[2]", None)) == shared_dir(session("local[2]", None))


def test_csv_is_split_unless_a_quoted_field_goes_on(spark, tmp_path):
    from tablewright.sources.csvfiles import has_quoted_breaks, read_csv

    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    lines = "".join(f'{i},"a ""quoted"", text {i}"\n' for i in range(2000))
    plain.write_text("id,note\n" + lines)
    broken.write_text("id,note\n" + lines + '9999,"two\nlines"\n')
    assert not has_quoted_breaks(spark, str(plain), "UTF-8") and has_quoted_breaks(spark, str(broken), "UTF-8")
    assert has_quoted_breaks(spark, str(plain), "UTF-16")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        whole, parts = (read_csv(spark, str(p), "id bigint, note string") for p in (broken, plain))
        assert parts.rdd.getNumPartitions() > 3
        assert parts.count() == 2000 and whole.count() == 2001
        assert whole.where("id = 9999").first()["note"] == "two\nlines"
        assert parts.where("id = 7").first()["note"] == 'a "quoted", text 7'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
