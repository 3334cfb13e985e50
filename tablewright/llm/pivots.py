"""Exact top-k search by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the distances of a pivot are cut into annuli, and an annulus is
stored in blocks of bounded size. For a query at distance d from a pivot, the triangle inequality gives how near a vector of an
annulus can be, and with the largest norm of the annulus how high its inner product can be: ``(|q|^2 + n^2 - gap^2) / 2``.
Queries travel in groups of neighbours to the annuli, best bound first, in rounds; after each round only annuli go on whose bound
reaches the k-th score found so far. Pivots come from a bounded sample; every vector is indexed and the result is exact.

Components are whole numbers, ``floor(scale * x)``, so scores are exact in 64 bits.

Defined results: vectors that are null, empty, or hold null or non-finite components, vectors of another length than the most
frequent one (of equally frequent ones the longest), and rows with a null id take no part; of rows with the same id the one with the smallest vector counts.
A query gets as many rows as there are other vectors, if these are fewer than k. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import forget, map_batches, written

PIVOTS = 32
RINGS = 16
BLOCK_ROWS = 1024
#: Neighbouring queries that travel together.
GROUP_ROWS = 64
#: Annuli, in the order of their bounds, after which the k-th score is looked at again.
ROUNDS = (4, 16, 64)
SCALE = 1024


def whole_vectors(vectors: DataFrame, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """``(vec_id, vec)`` of the vectors that take part, one row for each id."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    rows = good.select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("vec"))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (usual["n"] if usual else 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; floating point is exact while no sum can reach 2^53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0.0))


class PivotIndex:
    """``blocks``: ``(ring, ids, vecs)``; for each ring its pivot, distances and largest norm."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, block_rows: int = BLOCK_ROWS):
        """``vectors`` is as ``whole_vectors`` makes it."""
        raw = map_batches(
            vectors,
            lambda b: pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array([np.array(v, np.int64).tobytes() for v in b.column("vec").to_pylist()], pa.binary())], ["vec_id", "vec"]
            ),
            "vec_id long, vec binary",
        )
        raw = written(raw, "vectors")
        chosen = raw.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("vec").collect()
        self.pivots = np.array([np.frombuffer(bytes(r["vec"]), np.int64) for r in chosen])
        self.blocks = None
        if not len(chosen):
            return
        spark = raw.sparkSession
        shared = spark.sparkContext.broadcast(self.pivots)

        def nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = _matrix(batch.column("vec"))
            d = _distances(v, shared.value)
            at = d.argmin(axis=1)
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            columns = [pa.array(at, pa.int32()), pa.array(d[np.arange(len(v)), at]), pa.array(norm)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], ["vec_id", "vec", "pivot", "dist", "norm"])

        self.vectors = written(map_batches(raw, nearest, "vec_id long, vec binary, pivot int, dist double, norm double"), "keyed")
        cuts = self.vectors.groupBy("pivot").agg(F.percentile_approx("dist", [(i + 1) / rings for i in range(rings - 1)], 1000).alias("cuts"))
        cuts = {r["pivot"]: sorted(set(r["cuts"])) for r in cuts.collect()}  # one row for each pivot
        edges = spark.createDataFrame([(p, float(c)) for p, cs in cuts.items() for c in cs], "pivot int, cut double")
        edges = edges.groupBy("pivot").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
        place = F.size(F.filter("cuts", lambda c: c < F.col("dist")))
        ringed = self.vectors.join(F.broadcast(edges), "pivot").withColumn("ring", (F.col("pivot") * rings + place).cast("int"))
        stats = ringed.groupBy("ring").agg(
            F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("n"), F.first("pivot").alias("pivot")
        ).orderBy("ring").collect()  # at most pivots * rings rows
        self.ring = np.array([r["ring"] for r in stats])
        self.of = np.array([r["pivot"] for r in stats])
        self.low, self.high, self.norm = (np.array([r[k] for r in stats]) for k in ("low", "high", "norm"))
        parts = F.create_map(*[F.lit(x) for r in stats for x in (r["ring"], -(-r["n"] // block_rows))])
        block = F.pmod(F.xxhash64("vec_id"), parts[F.col("ring")])
        self.blocks = written(_packed(ringed.withColumn("block", block), ["ring", "block"], ["vec_id", "vec"]), "blocks")

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and ring, a number that no inner product exceeds."""
        d = _distances(queries, self.pivots)[:, self.of]
        gap = np.maximum(np.maximum(self.low - d, d - self.high) - 1e-6 * (d + 1), 0.0)
        norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))[:, None]
        bound = np.minimum((norm**2 + self.norm**2 - gap**2) / 2, norm * self.norm)
        return bound + 1e-6 * np.abs(bound) + 1.0


def _packed(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each key with the ids and vectors of its rows, end to end."""
    lists = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("rows"))

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("rows").to_pylist()
        ids = [np.array([r["vec_id"] for r in one], np.int64).tobytes() for one in rows]
        vecs = [b"".join(r["vec"] for r in one) for one in rows]
        kept = [batch.column(k) for k in keys]
        return pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary()), pa.array(vecs, pa.binary())], [*keys, "ids", "vecs"])

    types = dict(df.dtypes)
    return map_batches(lists, join, ", ".join(f"{k} {types[k]}" for k in keys) + ", ids binary, vecs binary")


def top_products(index: PivotIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the indexed vectors in ``queries`` (their ``vec_id``): all other vectors compete."""
    spark = queries.sparkSession
    kind = "query_id long, vec_id long, score long"
    if index.blocks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = index.vectors.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "vec", "pivot")
    count = own.count()
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // (PIVOTS * GROUP_ROWS)))))
    groups = written(_packed(own.withColumn("salt", salt), ["pivot", "salt"], ["vec_id", "vec"]), "queries")
    groups = groups.withColumn("group", F.struct("pivot", "salt")).select("group", "ids", "vecs")
    shared = spark.sparkContext.broadcast(
        {"pivots": index.pivots, "of": index.of, "low": index.low, "high": index.high, "norm": index.norm, "ring": index.ring}
    )

    def bounded() -> PivotIndex:
        plain = PivotIndex.__new__(PivotIndex)
        plain.__dict__.update(shared.value)
        return plain

    def expand(low: int, high: int):
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rings, out = bounded(), []
            for ids, vecs, least in zip(batch.column("ids").to_pylist(), batch.column("vecs").to_pylist(), batch.column("least").to_pylist(), strict=True):
                names = np.frombuffer(ids, np.int64)
                reached = {r["query_id"]: r["kth"] for r in least or []}
                kth = np.array([reached.get(i, -np.inf) for i in names.tolist()], np.float64)
                bound = rings.bounds(np.frombuffer(vecs, np.int64).reshape(len(names), -1))
                order = np.argsort(-bound.max(axis=0), kind="stable")[low:high]
                floor = np.where(np.isfinite(kth), kth, float(-(1 << 62))).astype(np.int64).tobytes()
                out.extend((int(rings.ring[r]), ids, vecs, floor) for r in order if (bound[:, r] >= kth).any())
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["ring", "qids", "qvecs", "floor"])

        return step

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [[], [], []]
        rows = zip(*(batch.column(c).to_pylist() for c in ("qids", "qvecs", "floor", "ids", "vecs")), strict=True)
        for qids, qvecs, floor, ids, vecs in rows:
            q, v = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
            products = _products(np.frombuffer(qvecs, np.int64).reshape(len(q), -1), np.frombuffer(vecs, np.int64).reshape(len(v), -1))
            floors = np.frombuffer(floor, np.int64)
            for i, one in enumerate(q):
                able = np.flatnonzero((products[i] >= floors[i]) & (v != one))
                best = able[np.lexsort((v[able], -products[i][able]))[:k]]
                got[0].extend([int(one)] * len(best))
                got[1].extend(v[best].tolist())
                got[2].extend(products[i][best].tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["query_id", "vec_id", "score"])

    best = None
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    edges = [0, *ROUNDS, len(index.ring)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if low >= len(index.ring):
            break
        if best is None:
            ready = groups.withColumn("least", F.array().cast("array<struct<query_id:bigint,kth:bigint>>"))
        else:
            kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            member = own.select(F.struct("pivot", salt.alias("salt")).alias("group"), F.col("vec_id").alias("query_id"))
            least = member.join(kth, "query_id").groupBy("group").agg(F.collect_list(F.struct("query_id", "kth")).alias("least"))
            ready = groups.join(least, "group", "left")
        pairs = map_batches(ready.select("ids", "vecs", "least"), expand(low, high), "ring int, qids binary, qvecs binary, floor binary")
        found = map_batches(pairs.join(index.blocks, "ring"), score, kind)
        if best is not None:
            found = found.unionByName(best.select("query_id", "vec_id", "score"))
        before, best = best, written(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "best")
        if before is not None:
            forget(before)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
