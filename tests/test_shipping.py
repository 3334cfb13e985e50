"""Executors need not have the package."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tablewright.functions.geo import ellipsoid_km
from tablewright.operators.bm25 import Bm25Index, bm25_search
from tablewright.operators.lexical import lexical_search
from tablewright.plans.models import Settings, fit_boosting, fit_extra
from pyspark.ml.feature import VectorAssembler
rows = spark.createDataFrame(
    [(1, "alpha beta", "s", 0, "code", None), *[(i, "beta", "s", i, "code", None) for i in range(2, 6)]],
    "chunk_id int, code string, source string, cell_index int, cell_type string, heading string",
)
asked = spark.createDataFrame([(1, "alpha")], "query_id int, q string")
assert bm25_search(Bm25Index.build(rows), asked, 1).count() == 1
assert lexical_search(rows, asked).count() == 1
assert spark.range(2).select(ellipsoid_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("k")).where("k > 110").count() == 2
data = spark.range(20).selectExpr("cast(id as double) a", "cast(id as double) label")
data = VectorAssembler(inputCols=["a"], outputCol="features").transform(data)
small = Settings(extra_trees=2, boost_rounds=2)
for fit in (fit_extra, fit_boosting):
    assert fit(data, small).transform(data).where("prediction is not null").count() == 20
print("all shipped")
"""


def test_functions_reach_workers_that_lack_the_package(tmp_path):
    script = tmp_path / "script.py"
    script.write_text(SCRIPT)
    done = subprocess.run(
        [sys.executable, str(script), str(Path(__file__).resolve().parents[1])],
        cwd=tmp_path, capture_output=True, text=True, timeout=300,
    )
    assert "all shipped" in done.stdout, done.stderr[-3000:]
