"""Random forests and extremely randomised trees without a depth limit, by leaf budget if wanted.

Features are binned once (see ``binning``). A regression whose groups of rows have up to ``TASK_BYTES`` each is grown on the JVM (see ``jvm``): every task is sent all rows of
a group once, whatever the number of its trees. Else a group of up to ``LOCAL_BYTES`` goes to all tasks, which grow whole trees. A larger one is grown from
histograms: for each level of the large nodes, tasks add up statistics by node, feature and bin, the sums are shuffled by node, and
one row for each node, its best cut, comes back. Once the rows of a node fit the bound they are shipped to one task, which finishes the subtree
there. All sums are whole numbers, so both ways grow the same trees, on any partitioning.

A leaf budget grows best-first: the open leaf with the highest gain is split next. A tree of a smaller budget is a prefix of that of a larger one, so one run gives trees
of all sizes (``budget_errors``). On large tables, nodes that the budget cannot reach are left out of the levels and of the trees below large nodes.

Several groups of rows, such as the training sides of all folds, are grown in the same jobs. The trees are a table in the shared folder; the driver
holds the splits of large nodes only. To predict, trees of up to ``MODEL_BYTES`` travel to the rows; of larger forests the trees stay where they are, and bins
of the rows travel to them in portions of that size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.plans import jvm
from tablewright.plans.binning import Binned, bin_table, codes_of, joined, opened
from tablewright.plans.growth import (
    _POISSON,
    BINS,
    LEAF,
    Rules,
    Tree,
    best_splits,
    bootstrap_counts,
    children,
    grow,
    histogram,
    leaves,
    pop_order,
    tree_id,
)
from tablewright.runtime import scratch_path, scratch_table

#: Bytes of binned rows that one task grows trees from.
LOCAL_BYTES = 48_000_000
#: The same on the JVM, which holds them once and grows one tree at a time from a copy.
TASK_BYTES = 256_000_000
#: Bytes of trees that pass the driver at a time, on their way to the tasks.
MODEL_BYTES = 16_000_000
#: Bytes of trees of a regression from which on the JVM scores the rows.
SCORED_BYTES = 1_000_000
#: Bytes of histograms that a task holds at a time.
HISTOGRAM_BYTES = 128_000_000
PARTS = "grp int, t int, leaf int, blob binary"
#: Trees are large values: files are cut by their bytes, not by hundreds of rows.
LARGE_VALUES = {"parquet.block.size": 32_000_000, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "compression": "zstd"}


@dataclass(frozen=True)
class Forest:
    """What is grown. ``classes`` is the number of classes, 0 for a regression; ``balanced`` weighs classes by each tree's own sample."""

    trees: int
    min_leaf: int = 1
    max_depth: int | None = None
    tries: str = "all"
    bootstrap: bool = True
    random_cuts: bool = False
    classes: int = 0
    balanced: bool = False
    max_leaves: int | None = None
    seed: int = 42

    def rules(self, p: int, counts: np.ndarray | None = None) -> Rules:
        """``counts`` are the tree's rows by class."""
        tries = max(1, int(np.sqrt(p))) if self.tries == "sqrt" else None
        weights = None
        if self.classes:
            weights = (1.0,) * self.classes
            if self.balanced:
                weights = tuple(float(w) for w in np.where(counts > 0, counts.sum() / (self.classes * np.maximum(counts, 1)), 0.0))
        return Rules(self.min_leaf, self.max_depth, tries, self.random_cuts, weights)

    def sample(self, t: int, target: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows a tree sees, and their statistics."""
        rows, weight = self.drawn(t, ids)
        return rows, self.statistics(weight, target[rows])

    def drawn(self, t: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows a tree sees, and how often (fewer than 20 times)."""
        weight = bootstrap_counts(ids, tree_id(self.seed, t)) if self.bootstrap else np.ones(len(ids), np.int64)
        rows = np.flatnonzero(weight)
        return rows, weight[rows].astype(np.uint8)

    def statistics(self, weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        weight = weight.astype(float)
        if not self.classes:
            return np.stack([np.ones(len(weight)), weight, weight * target])
        stats = np.zeros((1 + self.classes, len(weight)))
        stats[0] = 1
        stats[1 + target.astype(np.int64), np.arange(len(weight))] = weight
        return stats


def packed(feature: np.ndarray, cut: np.ndarray, values: np.ndarray) -> bytes:
    """A tree in level order: its splits, and the values of its leaves."""
    at = feature == LEAF
    head = np.array([len(feature), values.shape[1]], np.int32)
    return head.tobytes() + feature.astype(np.uint16).tobytes() + cut.astype(np.uint8).tobytes() + values[at].astype(np.float32).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut, left child, and values by node."""
    m, k = np.frombuffer(blob, np.int32, 2).tolist()
    feature = np.frombuffer(blob, np.uint16, m, 8)
    cut = np.frombuffer(blob, np.uint8, m, 8 + 2 * m)
    inner = feature != LEAF
    values = np.zeros((m, k))
    values[~inner] = np.frombuffer(blob, np.float32, offset=8 + 3 * m).reshape(-1, k)
    return feature, cut, np.where(inner, 2 * np.cumsum(inner) - 1, 0), values


@dataclass
class Top:
    """The splits of a tree's large nodes."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    ids: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=lambda: [0.0])
    above: list[float] = field(default_factory=lambda: [np.inf])
    stats: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.uint16), np.array(self.cut, np.uint8), np.array(self.left, np.int64)

    def split(self, node: int, feature: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray) -> list[int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, at, gain
        for side, own in zip(children(np.array([self.ids[node]], np.uint64)).tolist(), (left, right), strict=True):
            self.feature.append(LEAF)
            self.cut.append(0)
            self.left.append(0)
            self.depth.append(self.depth[node] + 1)
            self.ids.append(side)
            self.gain.append(0.0)
            self.above.append(min(self.above[node], gain))
            self.stats.append(own)
        return [at, at + 1]


def _local_blocks(binned: Binned, groups: list[int], spark: SparkSession):
    """Training blocks by group, for all tasks; the caller has checked their size."""
    held: dict[int, list] = {}
    for r in binned.blocks.where(~F.col("valid") & F.col("grp").isin(groups)).select("grp", "codes", "target", "ids").collect():
        held.setdefault(r["grp"], []).append((bytes(r["codes"]), bytes(r["target"]), bytes(r["ids"])))
    return spark.sparkContext.broadcast(held)


def fits_locally(binned: Binned, local_bytes: int) -> bool:
    """Whether the rows of every single group fit the bound."""
    return all(binned.training_bytes(g) <= local_bytes for g in binned.groups)


def _grow_here(binned: Binned, forest: Forest, make, schema: str, path: str, local_bytes: int) -> None:
    """Whole trees in tasks that hold all rows of some groups, which fit the bound together; ``make`` turns (group, tree number, tree) into rows."""
    parts, size = [[]], 0
    for g in binned.groups:
        if parts[-1] and size + binned.training_bytes(g) > local_bytes:
            parts.append([])
            size = 0
        parts[-1].append(g)
        size += binned.training_bytes(g)
    for groups in parts:
        _grow_groups(binned, groups, forest, make, schema).write.mode("append").parquet(path)


def _grow_groups(binned: Binned, groups: list[int], forest: Forest, make, schema: str) -> DataFrame:
    spark = binned.blocks.sparkSession
    held, values, p = _local_blocks(binned, groups, spark), binned.values, binned.features
    jobs = [(g, t) for g in groups for t in range(forest.trees)]

    def run(batches):
        opened_group = None
        for batch in batches:
            for job in batch.column("id").to_pylist():
                g, t = jobs[job]
                if opened_group is None or opened_group[0] != g:
                    opened_group = g, joined(held.value[g])
                codes, target, ids = opened_group[1]
                rows, stats = forest.sample(t, target, ids)
                rules = forest.rules(p, stats[1:].sum(axis=1))
                yield make(g, t, grow(np.ascontiguousarray(codes[:, rows]), stats, tree_id(forest.seed, t), rules, values[g]), rules)

    cores = spark.sparkContext.defaultParallelism
    numbers = spark.range(0, len(jobs), 1, min(len(jobs), 4 * cores))
    return numbers.mapInArrow(run, schema)


def _whole_on_jvm(binned: Binned, forest: Forest, local_bytes: int | None) -> bool:
    """Whether tasks of the JVM can grow whole trees of all groups."""
    rules = forest.rules(binned.features) if not forest.classes else None
    plain = rules is not None and rules.tries is None and forest.max_leaves is None and forest.min_leaf >= 1
    known = not forest.random_cuts or all(np.isfinite(v).all() for own in binned.values.values() for v in own)
    fits = jvm.rows_fit(binned) and fits_locally(binned, TASK_BYTES if local_bytes is None else local_bytes)
    return plain and known and fits and jvm.loader(binned.blocks.sparkSession) is not None


def _grow_on_jvm(binned: Binned, forest: Forest) -> DataFrame:
    """Every group goes to some tasks, each of which grows every so many-th of its trees."""
    spark, groups = binned.blocks.sparkSession, binned.groups
    cores = spark.sparkContext.defaultParallelism
    slots = min(forest.trees, cores // math.gcd(cores, len(groups)))
    place = (F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("grp")).cast("int") - 1) * slots
    rows = binned.blocks.where(~F.col("valid") & F.col("grp").isin(groups))
    ids = F.col("ids") if forest.bootstrap else F.lit(None).cast("binary").alias("ids")
    copies = rows.select(F.explode(F.sequence(place, place + slots - 1)).alias("place"), "codes", "target", ids)
    trees = np.concatenate([tree_id(forest.seed, t) for t in range(forest.trees)])
    depth = -1 if forest.max_depth is None else forest.max_depth
    steps = _POISSON if forest.bootstrap else np.zeros(0)
    head = jvm.words(binned.features, forest.min_leaf, depth, slots, int(forest.random_cuts), len(steps), steps, len(trees), trees)
    dealt = copies.repartitionById(len(groups) * slots, "place")
    return jvm.mapped(dealt, "Grow", PARTS, head + jvm.group_words(binned, groups))


def _part_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["grp", "t", "leaf", "blob"])


def _tree_counts(binned: Binned, forest: Forest) -> dict[tuple[int, int], np.ndarray]:
    """Statistics of all rows of each tree."""
    k = 1 + (forest.classes or 2)

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, *block in zip(*(batch.column(c).to_pylist() for c in ("grp", "codes", "target", "ids")), strict=True):
                _, target, ids = opened(*block)
                for t in range(forest.trees):
                    total = forest.sample(t, target, ids)[1].sum(axis=1)
                    sums[g, t] = sums.get((g, t), 0) + total
        rows = [(g, t, i, float(x)) for (g, t), total in sums.items() for i, x in enumerate(total)]
        yield pa.RecordBatch.from_pylist([dict(zip(("grp", "t", "k", "s"), r, strict=True)) for r in rows], pa.schema([("grp", pa.int32()), ("t", pa.int32()), ("k", pa.int32()), ("s", pa.float64())]))

    out: dict[tuple[int, int], np.ndarray] = {}
    summed = binned.blocks.where("not valid").mapInArrow(run, "grp int, t int, k int, s double").groupBy("grp", "t", "k").agg(F.sum("s").alias("s"))
    for r in summed.collect():
        out.setdefault((r["grp"], r["t"]), np.zeros(k))[r["k"]] = r["s"]
    return out


def _level(binned: Binned, forest: Forest, tops: dict, opened_nodes: dict, rules: dict) -> list:
    """Best cuts of open nodes: ``(group, tree, node, feature, cut, gain, left, total)``."""
    p, k = binned.features, 1 + (forest.classes or 2)
    values = binned.values
    arrays = {key: tops[key].arrays() for key in opened_nodes}
    ids = {key: np.array([tops[key].ids[n] for n in nodes], np.uint64) for key, nodes in opened_nodes.items()}

    def scan(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, *block in zip(*(batch.column(c).to_pylist() for c in ("grp", "codes", "target", "ids")), strict=True):
                codes, target, row_ids = opened(*block)
                for (og, t), nodes in opened_nodes.items():
                    if og != g:
                        continue
                    rows, stats = forest.sample(t, target, row_ids)
                    own = codes[:, rows]
                    place = np.full(len(arrays[g, t][0]), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[leaves(*arrays[g, t], own)]
                    keep = at >= 0
                    found = histogram(own[:, keep], at[keep], len(nodes), stats[:, keep])
                    sums[g, t] = sums[g, t] + found if (g, t) in sums else found
        for (g, t), hist in sums.items():
            for i, node in enumerate(opened_nodes[g, t]):
                yield _hist_rows(g, t, node, hist[i])

    def decide(batches):
        """All sums of a node lie in one partition, next to each other."""
        held, key = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "t", "node", "hist")]
            for g, t, node, blob in zip(*columns, strict=True):
                if (g, t, node) != key:
                    if key is not None:
                        yield _decided(key, held)
                    held, key = np.zeros((p, k, BINS)), (g, t, node)
                held += np.frombuffer(blob, np.float64).reshape(p, k, BINS)
        if key is not None:
            yield _decided(key, held)

    def _decided(key, hist):
        g, t, node = key
        mine = ids[g, t][opened_nodes[g, t].index(node)]
        f, c, gain, left, total = best_splits(rules[g, t], np.array([mine], np.uint64), hist[None], values[g])
        row = [g, t, node, int(f[0]), int(c[0]), float(gain[0]), left[:, 0].tobytes(), total[:, 0].tobytes()]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
        names = ["grp", "t", "node", "f", "c", "gain", "lefts", "totals"]
        return pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(row, types, strict=True)], names)

    sums = binned.blocks.where("not valid").mapInArrow(scan, "grp int, t int, node int, hist binary")
    dealt = sums.repartition("grp", "t", "node").sortWithinPartitions("grp", "t", "node")
    schema = "grp int, t int, node int, f int, c int, gain double, lefts binary, totals binary"
    return dealt.mapInArrow(decide, schema).collect()


def _hist_rows(g: int, t: int, node: int, hist: np.ndarray) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip((g, t, node, hist.tobytes()), types, strict=True)], ["grp", "t", "node", "hist"])


def _portions(opened_nodes: dict, p: int, k: int) -> list[dict]:
    """Open nodes in portions whose histograms a task can hold."""
    bound = max(1, HISTOGRAM_BYTES // (p * k * BINS * 8))
    out, room = [{}], bound
    for key, nodes in opened_nodes.items():
        for at in range(0, len(nodes), bound):
            part = nodes[at : at + bound]
            if len(part) > room:
                out.append({})
                room = bound
            out[-1].setdefault(key, []).extend(part)
            room -= len(part)
    return out


def _large_nodes(binned: Binned, forest: Forest, local_rows: int) -> tuple[dict[tuple[int, int], Top], dict[tuple[int, int], Rules]]:
    """Split all nodes of more than ``local_rows`` rows, level by level."""
    p, k = binned.features, 1 + (forest.classes or 2)
    counts = _tree_counts(binned, forest)
    tops, rules, opened_nodes = {}, {}, {}
    for (g, t), total in counts.items():
        tops[g, t] = Top(ids=tree_id(forest.seed, t).tolist(), stats=[total])
        rules[g, t] = forest.rules(p, total[1:])
        opened_nodes[g, t] = [0]

    def large(top: Top, node: int) -> bool:
        deep = forest.max_depth is not None and top.depth[node] >= forest.max_depth
        return top.stats[node][0] > max(local_rows, 2 * forest.min_leaf - 1) and not deep

    opened_nodes = {key: nodes for key, nodes in opened_nodes.items() if large(tops[key], 0)}
    while opened_nodes:
        found = [row for part in _portions(opened_nodes, p, k) for row in _level(binned, forest, tops, part, rules)]
        opened_nodes = {}
        if forest.max_leaves is not None:
            found = _within_budget(found, tops, forest.max_leaves)
        for r in sorted(found, key=lambda r: (r["grp"], r["t"], r["node"])):
            if r["f"] == LEAF:
                continue
            key = r["grp"], r["t"]
            left, total = np.frombuffer(r["lefts"]), np.frombuffer(r["totals"])
            sides = tops[key].split(r["node"], r["f"], r["c"], r["gain"], left, total - left)
            more = [n for n in sides if large(tops[key], n)]
            if more:
                opened_nodes.setdefault(key, []).extend(more)
    return tops, rules


def _within_budget(found: list, tops: dict, budget: int) -> list:
    """Without the nodes that a tree of ``budget`` leaves cannot reach.

    Best-first growth makes a split after all splits whose lowest gain on the way from the root is above its own, so
    a node with ``budget - 1`` such splits among those known so far is never split.
    """
    by_tree: dict[tuple[int, int], list] = {}
    for r in found:
        if r["f"] != LEAF:
            by_tree.setdefault((r["grp"], r["t"]), []).append(r)
    kept = []
    for key, rows in by_tree.items():
        top = tops[key]
        own = np.array([min(top.above[r["node"]], r["gain"]) for r in rows])
        done = [min(a, g) for f, a, g in zip(top.feature, top.above, top.gain, strict=True) if f != LEAF]
        known = np.sort(np.concatenate([done, own]))
        before = len(known) - np.searchsorted(known, own, side="right")
        kept += [r for r, n in zip(rows, before.tolist(), strict=True) if n < budget - 1]
    return kept


def grow_forest(binned: Binned, forest: Forest, local_bytes: int | None = None) -> str:
    """Path of a table ``(grp, t, leaf, blob)`` of trees; those grown in pieces have their large nodes' splits in a row with leaf -1."""
    spark = binned.blocks.sparkSession
    path = scratch_path(spark, "trees")
    if _whole_on_jvm(binned, forest, local_bytes):
        _grow_on_jvm(binned, forest).write.options(**LARGE_VALUES).parquet(path)
        return path
    local_bytes = LOCAL_BYTES if local_bytes is None else local_bytes
    if fits_locally(binned, local_bytes):

        def whole(g: int, t: int, tree: Tree, rules: Rules) -> pa.RecordBatch:
            return _part_rows([(g, t, 0, packed(tree.feature, tree.cut, rules.values(tree.stats)))])

        _grow_here(binned, forest, whole, PARTS, path, local_bytes)
        return path
    tops, rules = _large_nodes(binned, forest, local_bytes // _row_bytes(binned, forest))

    def part(g: int, t: int, leaf: int, tree: Tree, rules: Rules) -> pa.RecordBatch:
        return _part_rows([(g, t, leaf, packed(tree.feature, tree.cut, rules.values(tree.stats)))])

    parts = _finished(binned, forest, tops, rules, part)
    heads = [(g, t, -1, _packed_top(top)) for (g, t), top in tops.items() if len(top.feature) > 1]
    parts.unionByName(spark.createDataFrame(heads, PARTS)).write.parquet(path)
    return path


def _row_bytes(binned: Binned, forest: Forest) -> int:
    """Bytes of a row in the task that finishes its node: bins and statistics."""
    return binned.features + 8 * (2 + (forest.classes or 2))


def _finished(binned: Binned, forest: Forest, tops: dict, rules: dict, make) -> DataFrame:
    """Trees below the large nodes, each grown by the task its rows are shipped to; ``make`` turns (group, tree number, node, tree) into rows of ``PARTS``."""
    p, values = binned.features, binned.values
    arrays = {key: top.arrays() for key, top in tops.items()}
    ids, depths = {key: top.ids for key, top in tops.items()}, {key: top.depth for key, top in tops.items()}

    def ship(batches):
        for batch in batches:
            for g, *block in zip(*(batch.column(c).to_pylist() for c in ("grp", "codes", "target", "ids")), strict=True):
                codes, target, row_ids = opened(*block)
                for t in range(forest.trees):
                    rows, weight = forest.drawn(t, row_ids)
                    leaf = leaves(*arrays[g, t], codes[:, rows])
                    order = np.argsort(leaf, kind="stable")
                    nodes, starts = np.unique(leaf[order], return_index=True)
                    stops = [*starts[1:].tolist(), len(order)]
                    mine = [order[at:stop] for at, stop in zip(starts.tolist(), stops, strict=True)]
                    yield _shipped(g, t, nodes.tolist(), [(codes[:, rows[m]], weight[m], target[rows[m]]) for m in mine])

    def finish(batches):
        for batch in batches:
            for g, t, leaf, rows in zip(*(batch.column(c) for c in ("grp", "t", "leaf", "rows")), strict=True):
                g, t, leaf = g.as_py(), t.as_py(), leaf.as_py()
                pieces = rows.as_py()
                codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(p, -1) for r in pieces], axis=1)
                weight = np.concatenate([np.frombuffer(r["weight"], np.uint8) for r in pieces])
                stats = forest.statistics(weight, np.concatenate([np.frombuffer(r["target"]) for r in pieces]))
                tree = grow(codes, stats, np.array([ids[g, t][leaf]], np.uint64), rules[g, t], values[g], depths[g, t][leaf])
                yield make(g, t, leaf, tree, rules[g, t])

    moved = binned.blocks.where("not valid").mapInArrow(ship, "grp int, t int, leaf int, codes binary, weight binary, target binary")
    nodes = moved.groupBy("grp", "t", "leaf").agg(F.collect_list(F.struct("codes", "weight", "target")).alias("rows"))
    return nodes.mapInArrow(finish, PARTS)


def _shipped(g: int, t: int, nodes: list[int], rows: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = [[g] * len(nodes), [t] * len(nodes), nodes, *([r[i].tobytes() for r in rows] for i in range(3))]
    names = ["grp", "t", "leaf", "codes", "weight", "target"]
    return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names)


def _packed_top(top: Top) -> bytes:
    feature, cut, left = top.arrays()
    return np.int64(len(feature)).tobytes() + feature.tobytes() + cut.tobytes() + left.tobytes()


def _unpacked_top(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.uint16, m, 8), np.frombuffer(blob, np.uint8, m, 8 + 2 * m), np.frombuffer(blob[8 + 3 * m :], np.int64, m)


def added_up(parts: list[tuple[int, int, bytes]], codes: np.ndarray, k: int) -> np.ndarray:
    """Sums of the leaf values of some parts of trees, rows by values."""
    out = np.zeros((codes.shape[1], k))
    tops = {t: _unpacked_top(blob) for t, leaf, blob in parts if leaf < 0}
    places = {t: leaves(*top, codes) for t, top in tops.items()}
    for t, leaf, blob in parts:
        if leaf < 0:
            continue
        feature, cut, left, values = unpacked(blob)
        if t in places:
            mine = np.flatnonzero(places[t] == leaf)
            if len(mine):
                out[mine] += values[leaves(feature, cut, left, codes[:, mine])]
        else:
            out += values[leaves(feature, cut, left, codes)]
    return out


SUMS = "grp int, block long, sums binary"


def block_sums(parts: DataFrame, blocks: DataFrame, k: int, p: int = 0, few: bool = False) -> DataFrame:
    """``(grp, block, sums)``: leaf values of all trees of its group, added up for the rows of each block ``(grp, block, codes)``.

    Trees stay where they are (``few`` small ones are dealt out first); bins of the rows, ``p`` a row, go to them in portions. Splits of large nodes are on the driver as they
    were when grown.
    """
    spark = parts.sparkSession
    tops = spark.sparkContext.broadcast({(r["grp"], r["t"]): bytes(r["blob"]) for r in parts.where("leaf < 0").collect()})
    portions, size = [[]], 0
    for r in blocks.select("grp", "block", F.octet_length("codes").alias("size")).orderBy("grp", "block").collect():
        if portions[-1] and size + r["size"] > MODEL_BYTES:
            portions.append([])
            size = 0
        portions[-1].append((r["grp"], r["block"]))
        size += r["size"]
    path = scratch_path(spark, "block_sums")
    for keys in portions:
        _portion_sums(parts, blocks, keys, tops, k, p, few).write.mode("append").parquet(path)
    return spark.read.schema(SUMS).parquet(path)


def _portion_sums(parts: DataFrame, blocks: DataFrame, keys: list[tuple[int, int]], tops, k: int, p: int, few: bool) -> DataFrame:
    groups = sorted({g for g, _ in keys})
    held: dict[int, list] = {}
    if keys:
        (g0, b0), (g1, b1) = keys[0], keys[-1]
        grp, block = F.col("grp"), F.col("block")
        inside = ((grp > g0) | (block >= b0)) & ((grp < g1) | (block <= b1)) & grp.between(g0, g1)
        for r in blocks.where(inside).select("grp", "block", "n", "codes").collect():
            held.setdefault(r["grp"], []).append((r["block"], r["n"], bytes(r["codes"])))
    trees = parts.where("leaf >= 0").where(F.col("grp").isin(groups))
    spark = blocks.sparkSession
    on_jvm = k == 1 and not tops.value and p > 0 and jvm.loader(spark) is not None
    sent = None if on_jvm else spark.sparkContext.broadcast(held)

    def rows(found: dict) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.binary()]
        columns = [[g for g, _ in found], [b for _, b in found], [s.tobytes() for s in found.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["grp", "block", "sums"])

    def score(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        places, at = {}, None
        for batch in batches:
            for g, t, leaf, blob in zip(*(batch.column(c) for c in ("grp", "t", "leaf", "blob")), strict=True):
                g, t, leaf = g.as_py(), t.as_py(), leaf.as_py()
                feature, cut, left, values = unpacked(blob.as_py())
                if (g, t) != at:
                    places, at = {}, (g, t)
                for b, n, raw in sent.value.get(g, []):
                    codes = np.frombuffer(raw, np.uint8).reshape(-1, n)
                    if (g, b) not in sums:
                        sums[g, b] = np.zeros((n, k))
                    if (g, t) not in tops.value:
                        sums[g, b] += values[leaves(feature, cut, left, codes)]
                        continue
                    if b not in places:
                        places[b] = leaves(*_unpacked_top(tops.value[g, t]), codes)
                    mine = np.flatnonzero(places[b] == leaf)
                    if len(mine):
                        sums[g, b][mine] += values[leaves(feature, cut, left, codes[:, mine])]
        if sums:
            yield rows(sums)

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, b, blob in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "sums")), strict=True):
                own = np.frombuffer(blob).reshape(-1, k)
                sums[g, b] = sums[g, b] + own if (g, b) in sums else own
        if sums:
            yield rows(sums)

    if on_jvm:
        flat = [(g, b, n, codes) for g in sorted(held) for b, n, codes in held[g]]
        raw = jvm.words(len(flat), *[np.array(x[:3], np.int64) for x in flat]) + b"".join(x[3] for x in flat)
        tasks = 2 * spark.sparkContext.defaultParallelism
        spread = trees.repartition(tasks) if few else trees.coalesce(tasks)
        scored = jvm.mapped(spread, "Score", SUMS, spark.sparkContext._jsc.broadcast(raw), p)
    else:
        scored = trees.mapInArrow(score, SUMS)
    return scored.repartition("grp", "block").mapInArrow(add, SUMS)


class _Writer(DefaultParamsWriter):
    """The trees lie beside the parameters."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.parts().write.parquet(f"{path}/trees")


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        return model._set(path=f"{path}/trees", group=-1)


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, MLReadable, MLWritable):
    """Mean of the trees' leaf values; with classes also ``probability``, and the likeliest class as prediction."""

    path = Param(Params._dummy(), "path", "table of the trees", typeConverter=TypeConverters.toString)
    group = Param(Params._dummy(), "group", "group of the trees in the table, -1 for all", typeConverter=TypeConverters.toInt)
    edges = Param(Params._dummy(), "edges", "bin edges of the features as JSON", typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "number of trees", typeConverter=TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a regression", typeConverter=TypeConverters.toInt)
    mean = Param(Params._dummy(), "mean", "mean target", typeConverter=TypeConverters.toFloat)
    scale = Param(Params._dummy(), "scale", "grid steps per unit of the target", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, path="", group=-1, edges="[]", trees=1, classes=0, mean=0.0, scale=1.0, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items()})
        self._setDefault(path="", group=-1, edges="[]", trees=1, classes=0, mean=0.0, scale=1.0, featuresCol="features", predictionCol="prediction")

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)

    @property
    def getNumTrees(self) -> int:
        return self.parts().select("t").distinct().count()

    def parts(self) -> DataFrame:
        found = SparkSession.active().read.schema(PARTS).parquet(self.getOrDefault("path"))
        group = self.getOrDefault("group")
        return found if group < 0 else found.where(F.col("grp") == group)

    def forest(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Feature, cut, left child and leaf values of each tree that was grown in one piece; for small models."""
        return [unpacked(bytes(r["blob"])) for r in self.parts().where("leaf >= 0").orderBy("t", "leaf").collect()]

    def size(self) -> int:
        """Bytes of the trees."""
        return self.parts().agg(F.sum(F.octet_length("blob"))).first()[0] or 0

    def _portions(self) -> list[list[tuple[int, int]]]:
        """Parts of trees in portions of ``MODEL_BYTES``; a tree's top goes with each of its parts."""
        out, size = [[]], 0
        for r in self.parts().where("leaf >= 0").select("t", "leaf", F.octet_length("blob").alias("size")).orderBy("t", "leaf").collect():
            if size and size + r["size"] > MODEL_BYTES:
                out.append([])
                size = 0
            out[-1].append((r["t"], r["leaf"]))
            size += r["size"]
        return out

    def _sent(self) -> list:
        """The portions as broadcasts, made once for a model; a small model is one."""
        if not hasattr(self, "_broadcasts"):
            context, self._broadcasts = SparkSession.active().sparkContext, []
            for keys in self._portions():
                (t0, leaf0), (t1, leaf1) = keys[0], keys[-1]
                t, leaf = F.col("t"), F.col("leaf")
                inside = ((t > t0) | (leaf >= leaf0)) & ((t < t1) | (leaf <= leaf1))
                rows = self.parts().where(t.between(t0, t1) & ((leaf < 0) | inside)).select("t", "leaf", "blob").collect()
                self._broadcasts.append(context.broadcast([(r["t"], r["leaf"], bytes(r["blob"])) for r in rows]))
        return self._broadcasts

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Forests larger than ``MODEL_BYTES``, or ``SCORED_BYTES`` on the JVM, score the rows now, and write them once; smaller ones when the rows are read."""
        cuts = [np.array(c) for c in json.loads(self.getOrDefault("edges"))]
        k = self.getOrDefault("classes") or 1
        if not hasattr(self, "_bytes"):
            self._bytes = self.size()
        on_jvm = k == 1 and not self.getOrDefault("classes") and jvm.loader(dataset.sparkSession) is not None
        if self._bytes > (min(SCORED_BYTES, MODEL_BYTES) if on_jvm else MODEL_BYTES):
            return self.finished(self._scored_by_blocks(dataset, cuts, k)).drop("__sums")
        sent = self._sent()

        def score(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            codes = codes_of(np.stack(rows.to_numpy()), cuts)
            return pd.Series(list(sum(added_up(s.value, codes, k) for s in sent)))

        scored = F.pandas_udf(score, "array<double>")(vector_to_array(self.getFeaturesCol()))
        return self.finished(dataset.withColumn("__sums", scored)).drop("__sums")

    def _scored_by_blocks(self, dataset: DataFrame, cuts: list[np.ndarray], k: int) -> DataFrame:
        """The rows with ``__sums``, by way of blocks of their bins."""
        rows = scratch_table(dataset.withColumn("__place", F.monotonically_increasing_id()), "to_score")
        vectors = rows.select("__place", vector_to_array(self.getFeaturesCol()).alias("x"))

        def pack(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                places = batch.column("__place").to_numpy()
                row = [0, int(places[0]), len(places), codes_of(x, cuts).tobytes(), places.tobytes()]
                types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["grp", "block", "n", "codes", "places"])

        def spread_out(batches):
            for batch in batches:
                for places, sums in zip(*(batch.column(c).to_pylist() for c in ("places", "sums")), strict=True):
                    own = np.frombuffer(sums)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) + 1, k), pa.int32()), pa.array(own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(places, np.int64)), lists], ["__place", "__sums"])

        blocks = scratch_table(vectors.mapInArrow(pack, "grp int, block long, n int, codes binary, places binary"), "row_blocks")
        sums = block_sums(self.parts().withColumn("grp", F.lit(0)), blocks, k, len(cuts), self._bytes <= MODEL_BYTES)
        found = sums.join(blocks.select("grp", "block", "places"), ["grp", "block"]).select("places", "sums")
        return rows.join(found.mapInArrow(spread_out, "__place long, __sums array<double>"), "__place").drop("__place")

    def finished(self, scored: DataFrame) -> DataFrame:
        """Predictions from the sums of the leaf values in ``__sums``."""
        classes, trees = self.getOrDefault("classes"), self.getOrDefault("trees")
        total = [F.col("__sums")[i] / F.lit(float(trees)) for i in range(classes or 1)]
        if not classes:
            value = total[0] / F.lit(self.getOrDefault("scale")) + F.lit(self.getOrDefault("mean"))
            return scored.withColumn(self.getPredictionCol(), value)
        scored = scored.withColumn("__shares", F.array(*total))
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        scored = scored.withColumn("probability", array_to_vector("__shares")).withColumn(self.getPredictionCol(), best.cast("double"))
        return scored.drop("__shares")


def forest_models(binned: Binned, forest: Forest, local_bytes: int | None = None, features: str = "features") -> dict[int, ForestModel]:
    """A model for each group."""
    path = grow_forest(binned, forest, local_bytes)
    return {
        g: ForestModel(
            path=path,
            group=g,
            edges=json.dumps([c.tolist() for c in binned.cuts(g)]),
            trees=forest.trees,
            classes=forest.classes,
            mean=float(binned.mean[g]),
            scale=float(binned.scale[g]),
            featuresCol=features,
        )
        for g in binned.groups
    }


def fit_forest_model(data: DataFrame, forest: Forest, local_bytes: int | None = None) -> ForestModel:
    return forest_models(bin_table(data, classes=forest.classes > 0), forest, local_bytes)[0]


def _reached(tree: Tree, kept: np.ndarray) -> np.ndarray:
    """The nodes of a tree in which only some splits, with all above them, are kept."""
    reached = np.zeros(len(kept), bool)
    reached[0] = True
    left = tree.left
    reached[left[kept]] = reached[left[kept] + 1] = True
    return reached


def _merged(head, pieces: list[tuple[int, bytes]]) -> tuple[Tree, np.ndarray]:
    """One tree in level order, and the values of its nodes, from the splits of large nodes and the trees below them."""
    columns = [[c] for c in head]  # feature, cut, left, gain, value
    at, roots = len(head[0]), []
    for leaf, blob in pieces:
        m = int(np.frombuffer(blob, np.int64, 1)[0])
        value, gain = np.frombuffer(blob, np.float64, m, 8), np.frombuffer(blob, np.float64, m, 8 + 8 * m)
        feature, cut = np.frombuffer(blob, np.uint16, m, 8 + 16 * m), np.frombuffer(blob, np.uint8, m, 8 + 18 * m)
        inner = feature != LEAF
        left = np.where(inner, 2 * np.cumsum(inner) - 1 + at, 0)
        for column, c in zip(columns, (feature, cut, left, gain, value), strict=True):
            column.append(c)
        roots.append((leaf, at))
        at += m
    feature, cut, left, gain, value = (np.concatenate(c) for c in columns)
    for leaf, root in roots:  # the root of a piece is a node of the head
        for column in (feature, cut, left, gain, value):
            column[leaf] = column[root]
    order, level = [], np.zeros(1, np.int64)
    while len(level):
        order.append(level)
        inner = level[feature[level] != LEAF]
        level = np.stack([left[inner], left[inner] + 1], axis=1).ravel()
    pick = np.concatenate(order)
    return Tree(feature[pick], cut[pick], np.zeros((0, len(pick))), gain[pick]), value[pick]


def budget_trees(binned: Binned, forest: Forest, local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """``(t, blob)``: trees of up to ``max_leaves`` leaves with the value of every node and its place in best-first order."""
    spark = binned.blocks.sparkSession
    path = scratch_path(spark, "budget_trees")
    budget = forest.max_leaves

    def prefix(tree: Tree, values: np.ndarray) -> bytes:
        order = pop_order(tree, budget - 1)
        kept = order < budget - 1
        reached = _reached(tree, kept)
        feature = np.where(kept, tree.feature, LEAF)[reached].astype(np.uint16)
        place = np.where(kept, order, budget)[reached].astype(np.int32)
        return np.int64(len(feature)).tobytes() + values[reached].tobytes() + place.tobytes() + feature.tobytes() + tree.cut[reached].tobytes()

    def rows(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], ["t", "blob"])

    if fits_locally(binned, local_bytes):
        _grow_here(binned, forest, lambda g, t, tree, rules: rows([(t, prefix(tree, rules.values(tree.stats)[:, 0]))]), "t int, blob binary", path, local_bytes)
        return spark.read.schema("t int, blob binary").parquet(path)
    tops, rules = _large_nodes(binned, forest, local_bytes // _row_bytes(binned, forest))

    def part(g: int, t: int, leaf: int, tree: Tree, rules: Rules) -> pa.RecordBatch:
        """What a budget can reach of the tree below a node."""
        kept = pop_order(tree, budget - 1) < budget - 1
        reached = _reached(tree, kept)
        feature = np.where(kept, tree.feature, LEAF)[reached].astype(np.uint16)
        value, gain = rules.values(tree.stats)[reached, 0], np.where(kept, tree.gain, 0.0)[reached]
        blob = np.int64(len(feature)).tobytes() + value.tobytes() + gain.tobytes() + feature.tobytes() + tree.cut[reached].tobytes()
        return _part_rows([(g, t, leaf, blob)])

    heads = {t: (*top.arrays(), np.array(top.gain), rules[g, t].values(np.stack(top.stats, axis=1))[:, 0]) for (g, t), top in tops.items()}

    def whole(batches):
        for batch in batches:
            for t, pieces in zip(batch.column("t").to_pylist(), batch.column("parts"), strict=True):
                yield rows([(t, prefix(*_merged(heads[t], [(r["leaf"], r["blob"]) for r in pieces.as_py()])))])

    parts = _finished(binned, forest, tops, rules, part)
    trees = parts.groupBy("t").agg(F.collect_list(F.struct("leaf", "blob")).alias("parts"))
    trees.mapInArrow(whole, "t int, blob binary").write.parquet(path)
    return spark.read.schema("t int, blob binary").parquet(path)


def _budget_tree(blob: bytes):
    m = int(np.frombuffer(blob, np.int64, 1)[0])
    value = np.frombuffer(blob, np.float64, m, 8)
    place = np.frombuffer(blob, np.int32, m, 8 + 8 * m)
    feature = np.frombuffer(blob, np.uint16, m, 8 + 12 * m)
    cut = np.frombuffer(blob, np.uint8, m, 8 + 14 * m)
    inner = feature != LEAF
    return value, place, feature, cut, np.where(inner, 2 * np.cumsum(inner) - 1, 0)


def by_budget(blob: bytes, codes: np.ndarray, budgets: Sequence[int]) -> np.ndarray:
    """Prediction of a tree for each budget (rows) and row (columns), in one walk: a budget ends where the path meets a split made too late."""
    value, place, feature, cut, left = _budget_tree(blob)
    limits = np.array(budgets) - 1
    out = np.empty((len(limits), codes.shape[1]))
    at = np.zeros(codes.shape[1], np.int64)
    done = np.zeros(codes.shape[1], np.int64)  # budgets, from the smallest, that have ended
    going = np.arange(codes.shape[1])
    while len(going):
        node = at[going]
        ended = np.where(feature[node] == LEAF, len(limits), np.searchsorted(limits, place[node], side="right"))
        for k in range(int(done[going].min()), int(ended.max())):
            hit = (done[going] <= k) & (k < ended)
            out[k, going[hit]] = value[node[hit]]
        done[going] = np.maximum(done[going], ended)
        going = going[done[going] < len(limits)]
        node = at[going]
        at[going] = left[node] + (codes[feature[node], going] > cut[node])
    return out


def budget_errors(data: DataFrame, valid: str, budgets: Sequence[int], forest: Forest, local_bytes: int = LOCAL_BYTES) -> list[tuple[int, float]]:
    """Mean absolute error on the flagged rows for each leaf budget, from one forest grown for the largest."""
    budgets = sorted(budgets)
    binned = bin_table(data.withColumn("valid", F.col(valid)))
    table = budget_trees(binned, replace(forest, max_leaves=budgets[-1]), local_bytes)
    mean, scale, trees = binned.mean[0], binned.scale[0], forest.trees
    # Bounded by trees and budget, and sent in portions.
    sizes = table.select("t", F.octet_length("blob").alias("size")).orderBy("t").collect()
    portions, size = [[]], 0
    for r in sizes:
        if size and size + r["size"] > MODEL_BYTES:
            portions.append([])
            size = 0
        portions[-1].append(r["t"])
        size += r["size"]
    context = binned.blocks.sparkSession.sparkContext
    sent = [context.broadcast([bytes(r["blob"]) for r in table.where(F.col("t").isin(p)).select("blob").collect()]) for p in portions]

    def errors(batches):
        total, n = np.zeros(len(budgets)), 0
        for batch in batches:
            for block in zip(*(batch.column(c).to_pylist() for c in ("codes", "target", "ids")), strict=True):
                codes, y, _ = opened(*block)
                got = sum(by_budget(blob, codes, budgets) for part in sent for blob in part.value) / trees / scale + mean
                total += np.abs(got - y).sum(axis=1)
                n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(budgets)), pa.int32()), pa.array(total), pa.array([n] * len(budgets), pa.int64())], ["b", "e", "n"])

    # Validation blocks are few and long walks take time: a block for each task.
    blocks = binned.blocks.where("valid").repartition(max(1, context.defaultParallelism))
    found = blocks.mapInArrow(errors, "b int, e double, n long").groupBy("b").agg((F.sum("e") / F.sum("n")).alias("mae")).collect()
    return [(budgets[r["b"]], r["mae"]) for r in sorted(found, key=lambda r: r["b"])]
