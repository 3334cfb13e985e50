"""Connected components of links that may be many more than one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import forget, written


def smallest_reachable(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has a link: the smallest node it can reach, itself included.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones, are linked to the
    smallest node of the neighbourhood. Each round is written, the number of rounds grows with the logarithm of the longest
    path, and a node with many links is pre-aggregated like any other minimum. Null ends and links of a node to itself are
    left out.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
        "edges",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # Larger neighbours go to the smallest of the neighbourhood.
        large = written(both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct(), "edges")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        # Smaller neighbours and the node itself go to the smallest.
        small = large.join(least, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).where("v <> u")
        small = written(small.distinct(), "edges")
        before = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        after = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        forget(edges, large)
        edges = small
        if before == after:
            break
    # Every node now has one link, to the smallest.
    roots = edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
