"""Gradient boosting over binned features, with the stop inside the loop.

Each round grows one tree on the gradients of the loss: histograms of the gradients by node, feature and bin, the best cut of each node, a level at a time. The error on the
validation rows is known after each round, and the run ends once ``patience`` rounds have not lowered it; no later round is
fitted. The model keeps the rounds up to the lowest error.

A group of rows of up to ``LOCAL_BYTES`` is boosted by one task; with the squared loss by one of the JVM (see ``jvm``), of up to ``TASK_BYTES``. A larger one stays in its blocks: for each level tasks add up histograms, which
the driver adds up if they are small; else they are shuffled by node, and one row for each node comes back; the scores of the rows are written anew every ``ROUNDS_A_WRITE`` rounds (more often for deep trees), in
place of the older ones, and tasks add the trees since then. Gradients are rounded to a grid on which sums are whole numbers, so both ways grow the same trees.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans import jvm
from tablewright.plans.binning import Binned, bin_table, joined
from tablewright.plans.forest import HISTOGRAM_BYTES, LOCAL_BYTES, PARTS, TASK_BYTES, ForestModel, _hist_rows, _part_rows, packed
from tablewright.plans.growth import BINS, LEAF, Rules, best_splits, bundle_sums, bundled, histogram, places, sampled, tree_id, unbundled
from tablewright.runtime import drop_scratch, scratch_path

ROUNDS_A_WRITE = 8
#: Rows that are scored and added up at a time, so that their columns stay in the processor's cache.
ROWS_A_STEP = 1 << 16
#: Bytes of blocks that one task scans.
STATE_BYTES = 128_000_000
#: Histograms of all tasks of up to so many bytes in a level are added up by the driver, larger ones are shuffled.
SMALL_SUMS = 4_000_000
#: Grid steps of a weight of one under the logistic loss.
_WEIGHT_STEPS = 2.0**20


@dataclass(frozen=True)
class Boosting:
    """Sizes and rates. ``loss`` is "squared" or "logistic" (labels 0 and 1); without ``patience`` all rounds are fitted."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    share: float = 1.0
    min_leaf: int = 1
    penalty: float = 0.0
    patience: int | None = None
    loss: str = "squared"
    symmetric: bool = False
    seed: int = 42

    def rules(self, rows: int) -> Rules:
        return Rules(min_leaf=self.min_leaf, penalty=self.penalty, unit=self.steps(rows)[0], symmetric=self.symmetric)

    def steps(self, rows: int) -> tuple[float, float]:
        """Grid steps of a weight and of a gradient of one; sums over all rows stay below 2**52."""
        if self.loss == "squared":
            return 1.0, 1.0
        return min(_WEIGHT_STEPS, 2.0 ** np.floor(np.log2(2.0**51 / max(rows, 1)))), 2.0 ** np.floor(np.log2(2.0**51 / max(rows, 1)))

    def statistics(self, target: np.ndarray, score: np.ndarray, rows: int) -> np.ndarray:
        """Rows, weights and gradients on the grid."""
        ones = np.ones(len(target))
        return np.stack([*[ones] * (2 if self.loss == "squared" else 1), *self.gradients(target, score, rows)])

    def gradients(self, target: np.ndarray, score: np.ndarray, rows: int) -> list[np.ndarray]:
        """Weights and gradients on the grid; without the weights if each is one."""
        if self.loss == "squared":
            return [np.round(target - score)]
        weight_steps, steps = self.steps(rows)
        p = 1.0 / (1.0 + np.exp(-np.clip(score, -35, 35)))
        return [np.maximum(np.round(p * (1 - p) * weight_steps), 1.0), np.round((target - p) * steps)]

    def leaf_values(self, rules: Rules, stats: np.ndarray, rows: int) -> np.ndarray:
        return self.rate * rules.values(stats)[:, 0] / self.steps(rows)[1]

    def error(self, target: np.ndarray, score: np.ndarray) -> float:
        """Sum of losses; for the squared loss in squared grid steps."""
        if self.loss == "squared":
            return float(((target - score) ** 2).sum())
        return float(np.logaddexp(0.0, np.where(target > 0.5, -score, score)).sum())


class Rounds:
    """Errors so far, and whether to go on."""

    def __init__(self, patience: int | None):
        self.patience, self.errors, self.best = patience, [], 0

    def add(self, error: float) -> bool:
        """True if the search ends: the error has not fallen for ``patience`` rounds."""
        self.errors.append(error)
        if error < self.errors[self.best]:
            self.best = len(self.errors) - 1
        return self.patience is not None and len(self.errors) - 1 - self.best >= self.patience

    @property
    def kept(self) -> int:
        return self.best + 1 if self.patience is not None else len(self.errors)


class Growing:
    """A tree of one round while it grows, level by level; open nodes are the last level's."""

    def __init__(self, root: np.ndarray):
        self.feature, self.cut = [LEAF], [0]
        self.stats: list[np.ndarray | None] = [None]
        self.open, self.root = [0], root

    def step(self, found) -> None:
        """Split the open nodes by ``(features, cuts, gains, lefts, totals)``."""
        features, cuts, _, lefts, totals = found
        opened_nodes = []
        for i, node in enumerate(self.open):
            self.stats[node] = totals[:, i]
            if features[i] == LEAF:
                continue
            self.feature[node], self.cut[node] = int(features[i]), int(cuts[i])
            opened_nodes += [len(self.feature), len(self.feature) + 1]
            self.feature += [LEAF, LEAF]
            self.cut += [0, 0]
            self.stats += [lefts[:, i], totals[:, i] - lefts[:, i]]
        self.open = opened_nodes

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature = np.array(self.feature, np.uint16)
        inner = feature != LEAF
        return feature, np.array(self.cut, np.uint8), np.where(inner, 2 * np.cumsum(inner) - 1, 0)


def down(at: np.ndarray, tree: Growing, codes: np.ndarray) -> np.ndarray:
    """Rows one level further down."""
    feature, cut, left = tree.arrays()
    f = feature[at]
    inner = f != LEAF
    rows = np.flatnonzero(inner)
    at = at.copy()
    node = at[rows]
    at[rows] = left[node] + (codes[f[rows], rows] > cut[node])
    return at


def _boost_here(codes, target, ids, valid_codes, valid_target, start, b: Boosting, values) -> tuple[list[tuple], Rounds]:
    """All rounds over rows that lie in memory: ``(feature, cut, leaf values by node)`` of each tree."""
    n = len(target)
    rules, search, trees = b.rules(n), Rounds(b.patience), []
    score, valid_score = np.full(n, start), np.full(len(valid_target), start)
    for r in range(b.rounds):
        root = tree_id(b.seed, r)
        stats = b.statistics(target, score, n)
        rows = np.flatnonzero(sampled(ids, root, b.share)) if b.share < 1 else None
        own_codes, own_stats = (codes, stats) if rows is None else (codes[:, rows], stats[:, rows])
        tree, at, whole = Growing(root), np.zeros(own_codes.shape[1], np.int64), np.zeros(n, np.int64)
        valid_at = np.zeros(len(valid_target), np.int64)
        for _ in range(b.depth):
            place = np.full(len(tree.feature), -1)
            place[tree.open] = np.arange(len(tree.open))
            node = place[at]
            keep = slice(None) if (node >= 0).all() else np.flatnonzero(node >= 0)
            hist = histogram(own_codes[:, keep], node[keep], len(tree.open), own_stats[:, keep])
            tree.step(best_splits(rules, _ids(tree), hist, values))
            if not tree.open:
                break
            at = down(at, tree, own_codes)
            whole = at if rows is None else down(whole, tree, codes)
            valid_at = down(valid_at, tree, valid_codes)
        gained = b.leaf_values(rules, np.stack(tree.stats, axis=1), n)
        score += gained[whole]
        valid_score += gained[valid_at]
        feature, cut, _ = tree.arrays()
        trees.append((feature, cut, gained))
        if search.add(b.error(valid_target, valid_score)):
            break
    return trees[: search.kept], search


def _ids(tree: Growing) -> np.ndarray:
    return np.repeat(tree.root, len(tree.open))


def _start(b: Boosting, binned: Binned, group: int) -> float:
    """The score of all rows before the first round: the mean, or its log-odds."""
    if b.loss == "squared":
        return 0.0
    share = min(max(binned.mean[group], 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def _boosted_groups(binned: Binned, b: Boosting, groups: list[int]) -> DataFrame:
    """``(grp, t, leaf, blob)`` of some groups, one task for each; their blocks are shuffled to it."""
    values, p = binned.values, binned.features
    mean, scale, starts = binned.mean, binned.scale, {g: _start(b, binned, g) for g in groups}
    squared = b.loss == "squared"

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for g, valid, *block in zip(*(batch.column(c).to_pylist() for c in ("grp", "valid", "codes", "target", "ids")), strict=True):
                held.setdefault(g, ([], []))[int(valid)].append(tuple(block))
        for g in sorted(held):
            train, valid = (sorted(side, key=lambda block: block[2]) for side in held.pop(g))
            codes, target, ids = joined(train)
            empty = (np.zeros((p, 0), np.uint8), np.zeros(0), np.zeros(0, np.uint64))
            valid_codes, y, _ = joined(valid) if valid else empty
            if squared:
                y = (y - mean[g]) * scale[g]
            trees, _ = _boost_here(codes, target, ids, valid_codes, y, starts[g], b, values[g])
            yield _part_rows([(g, t, 0, packed(f, c, v[:, None])) for t, (f, c, v) in enumerate(trees)])

    return _dealt_groups(binned, groups).mapInArrow(run, PARTS)


def _dealt_groups(binned: Binned, groups: list[int]) -> DataFrame:
    """The blocks of each group in a partition of its own."""
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("grp")).cast("int") - 1
    return binned.blocks.where(F.col("grp").isin(groups)).repartitionById(len(groups), place)


def _level_bytes(binned: Binned, b: Boosting) -> int:
    """Histograms of the deepest level of a tree."""
    return 2 ** max(0, b.depth - 1) * binned.features * BINS * 12


def _rounds_on_jvm(binned: Binned, b: Boosting) -> bool:
    plain = b.loss == "squared" and not b.symmetric and b.min_leaf >= 1 and 0 < b.depth <= 14
    return plain and jvm.rows_fit(binned) and _level_bytes(binned, b) <= HISTOGRAM_BYTES and jvm.loader(binned.blocks.sparkSession) is not None


def _boosted_on_jvm(binned: Binned, b: Boosting, groups: list[int]) -> DataFrame:
    """As ``_boosted_groups``. Cores of an executor that would stand idle beside a task add up its rows with it."""
    threads = max(1, min(jvm.executor_cores(binned.blocks.sparkSession) // len(groups), HISTOGRAM_BYTES // _level_bytes(binned, b)))
    trees = np.concatenate([tree_id(b.seed, r) for r in range(b.rounds)])
    sizes = jvm.words(binned.features, b.depth, b.min_leaf, threads, -1 if b.patience is None else b.patience, float(b.rate), float(b.share), float(b.penalty))
    blocks = _dealt_groups(binned, groups).select("grp", "valid", "codes", "target", "ids")
    return jvm.mapped(blocks, "Boost", PARTS, sizes + jvm.words(len(trees), trees) + jvm.group_words(binned, groups))


def _boosted_blocks(binned: Binned, b: Boosting, group: int) -> list[tuple]:
    """The rounds of one group over blocks that stay where they are."""
    n, values, p = binned.rows[group], binned.values[group], binned.features
    mean, scale, start = binned.mean[group], binned.scale[group], _start(b, binned, group)
    squared, rules, bundles = b.loss == "squared", b.rules(n), bundled(values)
    drawn = b.share < 1  # ids are for the draw alone
    spark = binned.blocks.sparkSession
    names = ["valid", "codes", "target", *["ids"] * drawn, "score"]
    search, trees, fresh = Rounds(b.patience), [], []
    tasks = max(spark.sparkContext.defaultParallelism, binned.size // STATE_BYTES)
    node_bytes = (16 if squared else 24) * sum(int(np.prod([max(1, len(values[f])) for f in x])) for x in bundles)
    rounds_a_write = max(1, ROUNDS_A_WRITE >> max(0, b.depth - 3))  # trees of twice the leaves take about twice as long to score

    def scored(codes, score, made):
        total = np.full(codes.shape[1], start) if score is None else score.copy()
        for arrays, gained in made:
            total += gained.take(places(*arrays, codes))
        return total

    def opened_steps(batches, made):
        """Blocks of one side joined up to steps of so many rows, with their scores."""
        held = {side: [] for side in (False, True)}

        def step(side):
            parts = held[side]
            held[side] = []
            codes, target, ids, score = (None if parts[0][k] is None else np.concatenate([x[k] for x in parts], axis=-1) for k in range(4))
            return side, codes, target, ids, scored(codes, score, made)

        for batch in batches:
            columns = [batch.column(c) for c in ("codes", "target", *["ids"] * drawn, "score")]
            for i, side in enumerate(batch.column("valid").to_pylist()):
                codes, target, *ids, score = (c[i].as_buffer() for c in columns)
                target = np.frombuffer(target, np.float64)
                ids = np.frombuffer(ids[0], np.uint64) if drawn else None
                held[side].append((np.frombuffer(codes, np.uint8).reshape(p, -1), target, ids, None if score is None else np.frombuffer(score, np.float64)))
                if sum(len(x[1]) for x in held[side]) >= ROWS_A_STEP:
                    yield step(side)
        for side, parts in held.items():
            if parts:
                yield step(side)

    def level(tree: Growing, made: list, errors: bool):
        """Best cuts of the open nodes and, with ``errors``, the loss of the validation rows under the trees made so far."""
        root, arrays, m = tree.root, tree.arrays(), len(tree.open)
        place = np.full(len(tree.feature), -1, np.int16 if m < 2**15 else np.int32)
        place[tree.open] = np.arange(m)

        def scan(batches):
            total, loss = None, 0.0
            for valid, codes, target, ids, score in opened_steps(batches, made):
                if valid:
                    loss += b.error((target - mean) * scale if squared else target, score) if errors else 0.0
                    continue
                weights = b.gradients(target, score, n)
                keep = sampled(ids, root, b.share) if drawn else None
                node = place.take(places(*arrays, codes)) if len(tree.feature) > 1 else None
                if node is not None and (node < 0).any():
                    keep = node >= 0 if keep is None else keep & (node >= 0)
                if keep is not None:
                    rows = np.flatnonzero(keep)
                    codes, weights, node = codes.take(rows, axis=1), [w.take(rows) for w in weights], None if node is None else node.take(rows)
                found = bundle_sums(bundles, values, codes, node, m, weights)
                total = found if total is None else total + found
            if total is not None:
                for i in range(1 if b.symmetric else m):
                    yield _hist_rows(0, 0, i, total if b.symmetric else total[i])
            if errors:
                yield _hist_rows(0, 0, -1, np.array([loss]))

        def decide(batches):
            return decided(x for batch in batches for x in zip(batch.column("node").to_pylist(), batch.column("hist").to_pylist(), strict=True))

        def decided(parts):
            held: dict[int, np.ndarray] = {}
            for node, blob in parts:
                hist = np.frombuffer(blob, np.float64)
                held[node] = held[node] + hist if node in held else hist
            for node, hist in held.items():
                if node < 0:
                    yield _decision(node, [0], [0], [hist[0]], np.zeros((3, 1)), np.zeros((3, 1)))
                else:
                    cube = unbundled(bundles, values, hist.reshape(m if b.symmetric else 1, 2 if squared else 3, -1))
                    if squared:
                        cube = cube[:, :, [0, 0, 1]]  # a row weighs one
                    found = best_splits(rules, np.repeat(root, len(cube)), cube, values)
                    yield _decision(node, *found)

        partial = state.mapInArrow(scan, "grp int, t int, node int, hist binary")
        if m * node_bytes * tasks <= SMALL_SUMS:
            rows = [r for batch in decided((r["node"], r["hist"]) for r in partial.select("node", "hist").collect()) for r in batch.to_pylist()]
        else:
            dealt = partial.repartition(max(1, min(m, spark.sparkContext.defaultParallelism)), "node")
            rows = dealt.mapInArrow(decide, "node int, f array<int>, c array<int>, gain array<double>, lefts binary, totals binary").collect()
        loss = next((r["gain"][0] for r in rows if r["node"] < 0), None)
        rows = sorted((r for r in rows if r["node"] >= 0), key=lambda r: r["node"])
        joined_up = [np.concatenate([r[c] for r in rows]) for c in ("f", "c", "gain")]
        sides = [np.concatenate([np.frombuffer(r[c]).reshape(3, -1) for r in rows], axis=1) for c in ("lefts", "totals")]
        return (*joined_up, *sides), loss

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "scores")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def rewritten():
        made = list(fresh)

        def run(batches):
            for valid, codes, target, ids, score in opened_steps(batches, made):
                blocks = [x.tobytes() for x in (codes, target, ids, score) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array([valid]), *(pa.array([x], pa.binary()) for x in blocks)], names)

        return written(state.mapInArrow(run, state.schema))

    own = binned.blocks.where(F.col("grp") == group).withColumn("score", F.lit(None).cast("binary")).select(*names)
    state, path = written(own.repartition(tasks))
    stops = b.patience is not None
    for r in range(b.rounds + stops):  # the error of a round comes with the first level of the next one
        tree = Growing(tree_id(b.seed, r))
        for d in range(b.depth):
            judged = stops and d == 0 and r > 0
            found, loss = level(tree, fresh, errors=judged)
            if judged and (search.add(loss) or r == b.rounds):
                return trees[: search.kept]
            tree.step(found)
            if not tree.open:
                break
        gained = b.leaf_values(rules, np.stack(tree.stats, axis=1), n)
        arrays = tree.arrays()
        fresh.append((arrays, gained))
        trees.append((*arrays[:2], gained))
        if len(fresh) == rounds_a_write and r + 1 < b.rounds + stops:
            older = path
            state, path = rewritten()
            fresh = []
            drop_scratch(spark, older)
    return trees


def _decision(node, f, c, gain, lefts, totals) -> pa.RecordBatch:
    row = [node, [int(x) for x in f], [int(x) for x in c], [float(x) for x in gain], np.ascontiguousarray(lefts).tobytes(), np.ascontiguousarray(totals).tobytes()]
    types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["node", "f", "c", "gain", "lefts", "totals"])


def boosted_models(binned: Binned, b: Boosting, local_bytes: int | None = None, features: str = "features") -> dict[int, ForestModel]:
    """A model for each group; with the logistic loss the prediction is the log-odds of class 1."""
    spark = binned.blocks.sparkSession
    if b.patience is not None and binned.blocks.where("valid").isEmpty():
        raise ValueError("a stop needs validation rows")
    path = scratch_path(spark, "boosted")
    on_jvm = b.rounds > 0 and _rounds_on_jvm(binned, b)
    local_bytes = local_bytes if local_bytes is not None else TASK_BYTES if on_jvm else LOCAL_BYTES
    sizes = binned.blocks.groupBy("grp").agg(F.sum(F.octet_length("codes") + F.octet_length("target") + F.octet_length("ids")).alias("size"))
    large = {r["grp"] for r in sizes.where(F.col("size") > local_bytes).collect()}
    small = [g for g in binned.groups if g not in large]
    if small:
        (_boosted_on_jvm if on_jvm else _boosted_groups)(binned, b, small).write.parquet(path)
    for g in sorted(large & {*binned.groups}):
        rows = [(g, t, 0, packed(f, c, v[:, None])) for t, (f, c, v) in enumerate(_boosted_blocks(binned, b, g))]
        spark.createDataFrame(rows, PARTS).write.mode("append").parquet(path)
    squared = b.loss == "squared"
    return {
        g: ForestModel(
            path=path,
            group=g,
            edges=json.dumps([c.tolist() for c in binned.cuts(g)]),
            mean=float(binned.mean[g]) if squared else _start(b, binned, g),
            scale=float(binned.scale[g]) if squared else 1.0,
            featuresCol=features,
        )
        for g in binned.groups
    }


def fit_boosted(data: DataFrame, b: Boosting, local_bytes: int | None = None) -> ForestModel:
    """Rows flagged by a column ``valid`` are for the stop alone."""
    return boosted_models(bin_table(data, zero_one=b.loss == "logistic"), b, local_bytes)[0]
