"""Feature vectors as bins of one byte, in blocks of rows: what all tree models are grown from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.growth import BINS
from tablewright.runtime import scratch_table

#: Ranks of the edges are off by at most one row in so many.
_ACCURACY = 50 * BINS
_FEATURES_A_PASS = 64
ROW_ID = "__row"
BLOCK = "grp int, n int, valid boolean, codes binary, target binary, ids binary"


@dataclass
class Binned:
    """Blocks of rows; for each group of rows (say, a fold) its bin edges and the grid its targets are rounded to."""

    blocks: DataFrame
    features: int
    groups: list[int]
    values: dict[int, list[np.ndarray]]
    rows: dict[int, int]
    mean: dict[int, float]
    scale: dict[int, float]
    size: int

    def cuts(self, group: int) -> list[np.ndarray]:
        return edges(self.values[group])

    def training_bytes(self, group: int) -> int:
        """Bins, target and id of the rows that trees of a group see."""
        return self.rows[group] * (self.features + 16)


def edges(values: list[np.ndarray]) -> list[np.ndarray]:
    """Between neighbouring values lies an edge; a value at the edge goes left."""
    return [(v[:-1] + v[1:]) / 2 for v in values]


def codes_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix, features by rows; a feature that the matrix lacks is in its first bin."""
    out = np.zeros((len(cuts), len(x)), np.uint8)
    for f in range(min(len(cuts), x.shape[1])):
        out[f] = np.searchsorted(cuts[f], x[:, f], side="left")
    return out


def with_row_id(df: DataFrame) -> DataFrame:
    """A hash of the whole row, to draw samples by that do not depend on the partitions."""
    return df.withColumn(ROW_ID, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def _values(rows: DataFrame, p: int) -> dict[int, list[np.ndarray]]:
    """At most ``BINS`` different values of each feature and group, spread evenly over its rows."""
    shares = [k / (BINS - 1) for k in range(BINS)]
    out: dict[int, list[np.ndarray]] = {}
    for at in range(0, p, _FEATURES_A_PASS):
        wanted = [F.percentile_approx(F.col("x")[f], shares, _ACCURACY).alias(f"v{f}") for f in range(at, min(p, at + _FEATURES_A_PASS))]
        for row in rows.where("not valid").groupBy("grp").agg(*wanted).collect():
            out.setdefault(row["grp"], []).extend(np.unique(np.array(v, float)) for v in row[1:])
    return out


def bin_table(data: DataFrame, features: str = "features", label: str = "label", classes: bool = False, zero_one: bool = False) -> Binned:
    """Bin a table with a vector and a label; ``grp`` (default 0) names the group of a row and ``valid`` the rows that edges and trees must not see.

    Targets of a regression are centred and rounded to a grid so fine that their sum stays a whole number below 2**52. Class numbers
    (``classes``, or ``zero_one`` with their mean) are left as they are.
    """
    classes = classes or zero_one
    ids = F.col(ROW_ID) if ROW_ID in data.columns else F.xxhash64(F.col(features), F.col(label))
    columns = [
        (F.col("grp") if "grp" in data.columns else F.lit(0)).cast("int").alias("grp"),
        (F.col("valid") if "valid" in data.columns else F.lit(False)).alias("valid"),
        vector_to_array(features).alias("x"),
        F.col(label).cast("double").alias("y"),
        ids.alias("id"),
    ]
    rows = scratch_table(data.select(*columns), "rows")
    p = rows.agg(F.max(F.size("x"))).first()[0] or 0
    # Groups may differ in width, say by their one-hot columns.
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), p - F.size("x"))))
    values = _values(rows, p)
    train = rows.where("not valid")
    facts = {r["grp"]: r for r in train.groupBy("grp").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high")).collect()}
    mean = {g: 0.0 if classes and not zero_one else r["mean"] for g, r in facts.items()}
    scale = {}
    for g, r in facts.items():
        reach = max(r["high"] - mean[g], mean[g] - r["low"], 1e-300) * r["n"]
        scale[g] = 1.0 if classes else 2.0 ** min(1000, np.floor(np.log2(2.0**51 / reach)))
    cuts = {g: edges(v) for g, v in values.items()}

    def pack(batches):
        for batch in batches:
            grp, valid = batch.column("grp").to_numpy(), batch.column("valid").to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
            y, row = batch.column("y").to_numpy(), batch.column("id").to_numpy()
            out = [[] for _ in range(6)]
            for g, v in {*zip(grp.tolist(), valid.tolist(), strict=True)}:
                at = np.flatnonzero((grp == g) & (valid == v))
                target = y[at] if v or classes else np.round((y[at] - mean[g]) * scale[g])
                own = (g, len(at), v, codes_of(x[at], cuts[g]).tobytes(), target.tobytes(), row[at].tobytes())
                for column, value in zip(out, own, strict=True):
                    column.append(value)
            types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["grp", "n", "valid", "codes", "target", "ids"])

    blocks = scratch_table(rows.mapInArrow(pack, BLOCK), "blocks")
    size = blocks.agg(F.sum(F.octet_length("codes") + F.octet_length("target") + F.octet_length("ids"))).first()[0] or 0
    return Binned(blocks, p, sorted(facts), values, {g: r["n"] for g, r in facts.items()}, mean, scale, size)


def opened(codes: bytes, target: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of a block: features by rows, targets, row ids."""
    ids = np.frombuffer(ids, np.uint64)
    return np.frombuffer(codes, np.uint8).reshape(-1, len(ids)), np.frombuffer(target, np.float64), ids


def joined(blocks: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [opened(*b) for b in blocks]
    return tuple(np.concatenate([p[k] for p in parts], axis=-1) for k in range(3))
