"""The inner loops of regression trees on the JVM: ``Trees.java``, compiled by the compiler that Spark has for its own generated code.

The driver compiles the file once for an application and adds the classes to it, so executors need neither this package nor a compiler. Where that does not work
the numpy forms do the same work.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from importlib.resources import files

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOADERS: dict[str, object] = {}


def loader(spark: SparkSession):
    """The class loader with the compiled classes; None if they cannot be had."""
    app = spark.sparkContext.applicationId
    if app not in _LOADERS:
        try:
            compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
            compiler.cook(files("tablewright.plans").joinpath("Trees.java").read_text())
            made = compiler.getBytecodes()
            folder = tempfile.mkdtemp(prefix="tablewright-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            with zipfile.ZipFile(f"{folder}/trees-{app}.jar", "w") as jar:
                for name in made:
                    jar.writestr(f"{name.replace('.', '/')}.class", bytes(made[name]))
            spark.sparkContext._jsc.addJar(f"{folder}/trees-{app}.jar")
            _LOADERS[app] = compiler.getClassLoader()
        except (Py4JError, TypeError, OSError):
            _LOADERS[app] = None
    return _LOADERS[app]


def mapped(df: DataFrame, name: str, schema: str, *arguments) -> DataFrame:
    """The partitions of ``df`` as a class of ``Trees`` turns them into rows of ``schema``."""
    context = df.sparkSession.sparkContext
    jvm, found = context._jvm, loader(df.sparkSession)
    given = context._gateway.new_array(jvm.java.lang.Object, len(arguments))
    for i, a in enumerate(arguments):
        given[i] = a
    function = found.loadClass(f"tablewright.Trees${name}").getConstructors()[0].newInstance(given)
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(StructType.fromDDL(schema).json())
    return DataFrame(df._jdf.mapPartitions(function, jvm.org.apache.spark.sql.Encoders.row(kind)), df.sparkSession)


def words(*values) -> bytes:
    """Whole numbers, fractions and arrays of both as words of eight bytes."""
    arrays = [np.asarray(v) for v in values]
    return b"".join(a.astype({"f": "<f8", "u": "<u8"}.get(a.dtype.kind, "<i8")).tobytes() for a in arrays)


def group_words(binned, groups: list[int]) -> bytes:
    """What is known of the groups before their rows are read."""
    out = [words(len(groups))]
    for g in groups:
        out.append(words(g, binned.rows[g], float(binned.mean[g]), float(binned.scale[g])))
        out += [words(len(v), v.astype(float)) for v in binned.values[g]]
    return b"".join(out)


def rows_fit(binned) -> bool:
    """Whether the bins of every group fit an array of the JVM."""
    return binned.features > 0 and all(n * binned.features < 2**31 - 64 for n in binned.rows.values())


def executor_cores(spark: SparkSession) -> int:
    """Cores of the executor that a lone task runs in."""
    context = spark.sparkContext
    named = context.getConf().get("spark.executor.cores", None)
    inside = re.fullmatch(r"local-cluster\[\d+, *(\d+), *\d+\]", context.master)
    if context.master.startswith("local["):
        return context.defaultParallelism
    return int(inside[1]) if inside else int(named or 1)
