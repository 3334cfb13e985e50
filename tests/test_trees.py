"""Trees against a plain recursive version, and the ways to grow them against each other."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.plans import boosting as B
from tablewright.plans import crossval as C
from tablewright.plans import models as M
from tablewright.plans.binning import bin_table, codes_of, edges, with_row_id
from tablewright.plans.boosting import Boosting, boosted_models, fit_boosted
from tablewright.plans.forest import Forest, budget_errors, fit_forest_model, forest_models, unpacked
from tablewright.plans.growth import LEAF, Rules, Tree, best_splits, grow, histogram, leaves, pop_order, tree_id


def table(n=600, seed=5, classes=0):
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(size=n), r.integers(0, 6, n), r.uniform(0, 1, n), np.ones(n)], axis=1)
    y = 3 * x[:, 0] ** 2 + x[:, 1] + r.normal(size=n) * 0.2
    if classes:
        y = np.digitize(y, np.quantile(y, np.linspace(0, 1, classes + 1)[1:-1] ** 0.5))
    return x, y.astype(float)


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark, *table())


def frame(spark, x, y):
    rows = [(i, *map(float, row), float(v), i % 5 == 0) for i, (row, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, v boolean")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(with_row_id(df)).select("id", "features", "label", "v", "__row")


def plain_leaves(x, y, rows, min_leaf, depth=None):
    """Sets of rows in the leaves of a tree with the lowest squared error at each split."""
    best = None
    if depth != 0:
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = [i for i in rows if x[i, f] <= cut]
                right = [i for i in rows if x[i, f] > cut]
                if min(len(left), len(right)) >= min_leaf:
                    gain = np.sum(y[left]) ** 2 / len(left) + np.sum(y[right]) ** 2 / len(right) - np.sum(y[rows]) ** 2 / len(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left, right
    if best is None:
        return [tuple(rows)]
    return [part for side in best[1:] for part in plain_leaves(x, y, side, min_leaf, depth and depth - 1)]


@pytest.mark.parametrize("min_leaf, depth", [(1, None), (2, None), (5, 3)])
def test_like_a_plain_tree(min_leaf, depth):
    r = np.random.default_rng(3)
    x, y = r.integers(0, 9, (70, 3)), r.integers(-50, 50, 70).astype(float)
    stats = np.stack([np.ones(70), np.ones(70), y])
    tree = grow(x.T.astype(np.uint8), stats, tree_id(1, 1), Rules(min_leaf, depth), [np.arange(9.0)] * 3)
    at = leaves(tree.feature, tree.cut, tree.left, x.T.astype(np.uint8))
    got = sorted(tuple(np.flatnonzero(at == node)) for node in np.unique(at))
    assert got == sorted(plain_leaves(x, y, list(range(70)), min_leaf, depth))


@pytest.mark.parametrize("rules", [Rules(2), Rules(3, random_cuts=True), Rules(1, tries=1), Rules(1, class_weights=(1.0, 2.0, 0.5))])
def test_histograms_choose_the_same_cut(rules):
    r = np.random.default_rng(4)
    codes, k = r.integers(0, 40, (4, 300)).astype(np.uint8), 4 if rules.class_weights else 3
    stats = np.ones((k, 300))
    if k == 3:
        stats[1], stats[2] = r.integers(1, 4, 300), r.integers(-1000, 1000, 300)
    else:
        stats[1:] = np.eye(3)[r.integers(0, 3, 300)].T
    values = [np.sort(r.normal(size=40)) for _ in range(4)]
    tree = grow(codes, stats, tree_id(9, 2), replace(rules, max_depth=1), values)
    f, c, gain, left, total = best_splits(rules, tree_id(9, 2), histogram(codes, np.zeros(300, int), 1, stats), values)
    assert (f[0], c[0], gain[0]) == (tree.feature[0], tree.cut[0], tree.gain[0])
    assert (left[:, 0] == tree.stats[:, 1]).all() and (total[:, 0] == tree.stats[:, 0]).all()


def values_of(model, data):
    return [r["prediction"] for r in model.transform(data).orderBy("id").select("prediction").collect()]


KINDS = [
    Forest(4, 2),
    Forest(4, 2, random_cuts=True, bootstrap=False),
    Forest(3, 1, max_depth=3),
    Forest(4, 1, tries="sqrt", classes=3),
    Forest(4, 1, tries="sqrt", classes=3, balanced=True),
]


@pytest.mark.parametrize("forest", KINDS)
def test_pieces_and_partitions_change_nothing(spark, data, forest):
    rows = frame(spark, *table(classes=forest.classes)) if forest.classes else data
    whole = fit_forest_model(rows, forest)
    want = values_of(whole, rows)
    for bound in (4_000, 700):
        pieces = fit_forest_model(rows.repartition(7), forest, local_bytes=bound)
        assert pieces.parts().where("leaf < 0").count() == forest.trees
        assert values_of(pieces, rows) == pytest.approx(want, abs=1e-12)
    error = np.mean(np.abs(np.array(want) - [r["label"] for r in rows.orderBy("id").collect()]))
    assert error < (0.4 if not forest.classes else 0.35) or forest.max_depth


def test_leaves_have_enough_rows_and_no_depth_limit(data):
    binned = bin_table(data)
    model = forest_models(binned, Forest(2, 2, bootstrap=False, random_cuts=True))[0]
    for feature, cut, left, _ in model.forest():
        at = leaves(feature, cut, left, codes_of(np.stack([r["features"].toArray() for r in data.collect()]), binned.cuts(0)))
        assert np.unique(at, return_counts=True)[1].min() >= 2
    deep = data.sparkSession.createDataFrame([(i, float(i), (-1.5) ** i) for i in range(40)], "id long, a double, label double")
    deep = VectorAssembler(inputCols=["a"], outputCol="features").transform(deep)
    (feature, cut, left, _), = fit_forest_model(deep, Forest(1, bootstrap=False)).forest()
    depth, at = 0, [0]
    while at := [c for n in at if feature[n] != LEAF for c in (left[n], left[n] + 1)]:
        depth += 1
    assert depth > 32


def test_constant_target_and_one_row(spark):
    for n in (1, 20):
        df = spark.createDataFrame([(i, float(i), 4.0) for i in range(n)], "id long, a double, label double")
        rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
        for model in (fit_forest_model(rows, Forest(3, 1)), fit_boosted(rows, Boosting(3))):
            assert set(values_of(model, rows)) == {4.0}


def test_balanced_by_each_trees_own_sample():
    forest = Forest(20, classes=2, balanced=True)
    target, ids = (np.arange(400) % 10 == 0).astype(float), np.arange(400).astype(np.uint64) * np.uint64(7919)
    weights = set()
    for t in range(20):
        _, stats = forest.sample(t, target, ids)
        rules = forest.rules(4, stats[1:].sum(axis=1))
        weights.add(rules.class_weights)
        weighed = stats[1:].sum(axis=1) * np.array(rules.class_weights)
        assert weighed[0] == pytest.approx(weighed[1]) and weighed.sum() == pytest.approx(stats[1:].sum())
    assert len(weights) == 20


def test_best_first_order_is_a_priority_queue():
    r = np.random.default_rng(8)
    codes, y = r.integers(0, 50, (3, 400)).astype(np.uint8), r.integers(-99, 99, 400).astype(float)
    tree = grow(codes, np.stack([np.ones(400), np.ones(400), y]), tree_id(0, 0), Rules(), [np.arange(50.0)] * 3)
    order, left, open_nodes = pop_order(tree), tree.left, [0]
    for k in range(int((tree.feature != LEAF).sum())):
        inner = [n for n in open_nodes if tree.feature[n] != LEAF]
        node = max(inner, key=lambda n: (tree.gain[n], -n))
        assert order[node] == k
        open_nodes = [n for n in open_nodes if n != node] + [left[node], left[node] + 1]
    assert (order[tree.feature == LEAF] > 10**9).all()


def test_budgets_are_prefixes(data):
    """Errors of all sizes from one forest, in memory and level by level, against each tree cut by hand."""
    forest, budgets = Forest(3, seed=23), [1, 2, 5, 17, 60, 10_000]
    got = budget_errors(data, "v", budgets, forest)
    levels = budget_errors(data.repartition(5), "v", budgets, forest, local_bytes=100)
    assert [b for b, _ in got] == [b for b, _ in levels] == budgets
    assert [e for _, e in got] == pytest.approx([e for _, e in levels])
    binned = bin_table(data.withColumn("valid", F.col("v")))
    train, valid = data.where("not v").collect(), data.where("v").collect()
    held = {int(r["__row"]): r for r in train}
    x = np.stack([r["features"].toArray() for r in train])
    ids = np.array([r["__row"] for r in train], np.int64).view(np.uint64)
    y = np.round((np.array([r["label"] for r in train]) - binned.mean[0]) * binned.scale[0])
    codes, tested = (codes_of(np.stack([r["features"].toArray() for r in side]), binned.cuts(0)) for side in (train, valid))
    sums = np.zeros((len(budgets), len(valid)))
    for t in range(3):
        rows, stats = forest.sample(t, y, ids)
        tree = grow(codes[:, rows], stats, tree_id(23, t), Rules(), binned.values[0])
        for k, budget in enumerate(budgets):
            cut = Tree(np.where(pop_order(tree) < budget - 1, tree.feature, LEAF), tree.cut, tree.stats, tree.gain)
            sums[k] += (tree.stats[2] / tree.stats[1])[leaves(cut.feature, tree.cut, tree.left, tested)]
    want = np.abs(sums / 3 / binned.scale[0] + binned.mean[0] - np.array([r["label"] for r in valid])).mean(axis=1)
    assert [e for _, e in got] == pytest.approx(want.tolist()) and len(held) == len(train)
    assert got[0][1] > got[2][1] > got[4][1]


@pytest.mark.parametrize("b", [
    Boosting(6, 3, 0.3),
    Boosting(5, 2, 0.5, share=0.7, penalty=1.0),
    Boosting(5, 3, 0.3, symmetric=True),
    Boosting(5, 2, 0.3, loss="logistic"),
    Boosting(30, 3, 0.9, patience=3),
])
def test_boosting_in_memory_and_in_blocks(spark, data, monkeypatch, b):
    monkeypatch.setattr(B, "ROUNDS_A_WRITE", 2)
    rows = data if b.loss == "squared" else frame(spark, *table(classes=2))
    rows = rows.withColumn("valid", F.col("v") & F.lit(b.patience is not None))
    here = fit_boosted(rows, b)
    there = fit_boosted(rows.repartition(3), b, local_bytes=10)
    assert values_of(there, rows) == pytest.approx(values_of(here, rows), rel=1e-6, abs=1e-9)
    assert here.getNumTrees == there.getNumTrees
    if b.patience is None:
        assert here.getNumTrees == b.rounds


def test_boosting_like_a_plain_version(spark):
    """Stumps and small trees on the residuals, leaf means times the rate."""
    x, y = table(80)
    x = np.round(x, 2)
    rows, b = frame(spark, x, y), Boosting(4, 2, 0.4)
    score = np.full(80, y.mean())
    for _ in range(4):
        step = np.zeros(80)
        for part in plain_leaves(x, y - score, list(range(80)), 1, 2):
            step[list(part)] = (y - score)[list(part)].mean()
        score += 0.4 * step
    assert values_of(fit_boosted(rows, b), rows) == pytest.approx(score.tolist(), abs=1e-5)


def test_the_stop_saves_rounds(data, monkeypatch):
    rows, fitted = data.withColumn("valid", F.col("v")), []
    monkeypatch.setattr(B.Rounds, "add", lambda self, e, add=B.Rounds.add: (fitted.append(e), add(self, e))[1])
    binned = bin_table(rows)
    values, p = binned.values[0], binned.features
    train, valid = ([(bytes(r["codes"]), bytes(r["target"]), bytes(r["ids"])) for r in binned.blocks.where(w).collect()] for w in ("not valid", "valid"))
    codes, target, ids = B.joined(train)
    tested, y, _ = B.joined(valid)
    b = Boosting(500, 4, 0.7, patience=5)
    trees, search = B._boost_here(codes, target, ids, tested, (y - binned.mean[0]) * binned.scale[0], 0.0, b, values)
    assert len(fitted) < 100 and p == 4
    assert len(trees) == search.best + 1 == len(fitted) - 5
    assert min(fitted) == fitted[search.best]


def test_a_stop_needs_validation_rows(data):
    with pytest.raises(ValueError, match="validation"):
        fit_boosted(data, Boosting(3, patience=2))


def test_rounds():
    search = B.Rounds(2)
    assert [search.add(e) for e in (5.0, 4.0, 4.0, 4.5)] == [False, False, False, True]
    assert search.kept == 2


SMALL = M.Settings(forest_trees=4, boost_rounds=6, extra_trees=3)


@pytest.mark.parametrize("name", ["rf", "extratrees", "gb"])
def test_all_folds_in_one_growth_equal_explicit_refits(spark, name):
    x, y = table(240)
    rows = [(i, float(a), None if i % 9 == 0 else float(b), "uvw"[int(10 * c) % 3] if i % 60 else f"rare{i}", float(v)) for i, ((a, b, c, _), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, kind string, goal double")
    got = C.run_regression_cv(df, "id", "goal", ["a", "b", "kind"], name, SMALL, 3)
    placed = C.kfold_assign(df.select("id", "goal", "a", "b", "kind"), "id", 3, "__fold")
    found = []
    for f in range(3):
        model = M.fit_pipeline(placed.where(F.col("__fold") != f), "goal", ["a", "b", "kind"], name, SMALL)
        found.append(C.regression_metrics(model.transform(placed.where(F.col("__fold") == f)), "goal", "prediction").first())
    for m in ("rmse", "mae", "r2"):
        assert got[m] == pytest.approx(sum(r[m] for r in found) / 3)


def test_saved_models_score_alike(spark, data, tmp_path):
    for k, model in enumerate((fit_forest_model(data, Forest(3, 2), 700), fit_boosted(data, Boosting(3)))):
        model.write().overwrite().save(f"{tmp_path}/{k}")
        assert values_of(type(model).load(f"{tmp_path}/{k}"), data) == values_of(model, data)


def test_models_in_portions(data, monkeypatch):
    from tablewright.plans import forest

    model = fit_forest_model(data, Forest(4, 2), 700)
    want = values_of(model, data)
    monkeypatch.setattr(forest, "MODEL_BYTES", 3_000)
    again = fit_forest_model(data, Forest(4, 2), 700)
    assert len(again._sent()) > 1 and values_of(again, data) == pytest.approx(want)


def test_codes():
    cuts = edges([np.array([1.0, 2.0, 4.0]), np.array([7.0])])
    got = codes_of(np.array([[0.0, 9.0], [1.5, 9.0], [1.6, 9.0], [3.0, 0.0], [9.0, 9.0]]), cuts)
    assert got.tolist() == [[0, 0, 1, 1, 2], [0] * 5]
    assert unpacked  # shown above through the model


def test_nodes_split_by_histograms_and_by_order_give_the_same_tree(monkeypatch):
    from tablewright.plans import growth

    r = np.random.default_rng(3)
    codes = np.stack([r.integers(0, 200, 3000), r.integers(0, 30, 3000), r.integers(0, 4, 3000)]).astype(np.uint8)
    values = [np.arange(200.0), np.arange(30.0), np.arange(4.0)]
    weight = r.integers(1, 4, 3000).astype(float)
    stats = np.stack([np.ones(3000), weight, weight * np.round(codes[0] * 3.0 + r.normal(size=3000) * 40)])
    for rules in (Rules(2), Rules(1, random_cuts=True), Rules(1, tries=1), Rules(5, 4)):
        trees = []
        for bound in (2, 64, 10**6):
            monkeypatch.setattr(growth, "_DENSE", bound)
            trees.append(grow(codes, stats, tree_id(4, 1), rules, values))
        for t in trees[1:]:
            assert t.feature.tolist() == trees[0].feature.tolist() and t.cut.tolist() == trees[0].cut.tolist()
            assert (t.stats == trees[0].stats).all() and (t.gain == trees[0].gain).all()
        assert len(trees[0].feature) > 20


def test_folds_that_fit_one_by_one_are_not_grown_in_pieces(spark, data, monkeypatch):
    """The bound on what a task holds is one of a group, not of all groups together."""
    from tablewright.plans import forest

    rows = data.withColumn("grp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumn("valid", F.col("id") % 3 == F.col("grp"))
    binned = bin_table(rows)
    bound = max(binned.training_bytes(g) for g in binned.groups) * 3 // 2
    assert bound < binned.size
    want = {g: values_of(m, data) for g, m in forest_models(binned, Forest(3, 2)).items()}
    monkeypatch.setattr(forest, "_large_nodes", None)
    assert {g: values_of(m, data) for g, m in forest_models(binned, Forest(3, 2), bound).items()} == want
    boosted = {g: values_of(m, data) for g, m in boosted_models(binned, Boosting(4)).items()}
    monkeypatch.setattr(B, "_boosted_blocks", None)
    assert {g: values_of(m, data) for g, m in boosted_models(binned, Boosting(4), bound * 2).items()} == boosted


@pytest.mark.parametrize("classes", [0, 2])
def test_trees_of_a_large_forest_stay_where_they_are(spark, monkeypatch, classes):
    from tablewright.plans import forest

    rows = frame(spark, *table(classes=classes))
    model = fit_forest_model(rows, Forest(6, 2, classes=classes), 700)
    want = values_of(model, rows)
    monkeypatch.setattr(forest, "MODEL_BYTES", 1_000)
    monkeypatch.setattr(forest.ForestModel, "_sent", None)
    again = fit_forest_model(rows, Forest(6, 2, classes=classes), 700)
    assert values_of(again, rows.repartition(5)) == pytest.approx(want)


def test_budgets_on_large_tables_finish_nodes_in_tasks(spark, data, monkeypatch):
    """Only nodes that do not fit a task are split level by level, as few jobs, whatever the budget."""
    from tablewright.plans import forest

    wanted, budgets, levels = Forest(3, seed=23), [2, 9, 40, 10_000], []
    monkeypatch.setattr(forest, "_level", lambda *args, level=forest._level: (levels.append(1), level(*args))[1])
    here = budget_errors(data, "v", budgets, wanted)
    assert not levels
    there = budget_errors(data.repartition(4), "v", budgets, wanted, local_bytes=28 * 120)
    assert 0 < len(levels) < 10
    assert [e for _, e in there] == pytest.approx([e for _, e in here])


def test_bundles_and_whole_columns_give_the_same_sums_and_places(monkeypatch):
    from tablewright.plans import growth

    r = np.random.default_rng(6)
    widths = (200, 7, 2, 1, 2, 256, 16, 16)
    values = [np.arange(float(w)) for w in widths]
    codes = np.stack([r.integers(0, w, 3000) for w in widths]).astype(np.uint8)
    weight, g = r.integers(1, 4, 3000).astype(float), r.integers(-1000, 1000, 3000).astype(float)
    bundles = growth.bundled(values)
    assert sorted(f for b in bundles for f in b) == list(range(len(widths))) and len(bundles) == 4
    node = r.integers(0, 5, 3000)
    want = histogram(codes, node, 5, np.stack([np.ones(3000), weight, g]))
    assert (growth.unbundled(bundles, values, growth.bundle_sums(bundles, values, codes, node, 5, [weight, g])) == want).all()
    for depth in (1, 3, 9):
        tree = grow(codes, np.stack([np.ones(3000), weight, weight * np.round(g + 9 * codes[0])]), tree_id(4, 1), Rules(2, depth), values)
        at = leaves(tree.feature, tree.cut, tree.left, codes)
        for few in (16, 2, 1):
            monkeypatch.setattr(growth, "_FEW_NODES", few)
            assert (growth.places(tree.feature, tree.cut, tree.left, codes) == at).all()


def test_scores_written_anew_replace_the_older_ones(data, monkeypatch):
    made, dropped = [], []
    monkeypatch.setattr(B, "ROUNDS_A_WRITE", 2)
    monkeypatch.setattr(B, "scratch_path", lambda spark, name, make=B.scratch_path: (made.append(make(spark, name)), made[-1])[1])
    monkeypatch.setattr(B, "drop_scratch", lambda spark, path, drop=B.drop_scratch: (dropped.append(path), drop(spark, path))[1])
    binned = bin_table(data)
    trees = B._boosted_blocks(binned, Boosting(5, 2, 0.3), 0)
    assert len(trees) == 5 and len(made) == 3 and dropped == made[:2]


@pytest.mark.parametrize("b", [Boosting(2, 3, 0.3), Boosting(2, 2, 0.3, symmetric=True), Boosting(3, 2, 0.5, share=0.7, patience=3)])
def test_sums_on_the_driver_and_shuffled_give_the_same_trees(data, monkeypatch, b):
    binned, found = bin_table(data.withColumn("valid", F.col("v") & F.lit(b.patience is not None))), []
    for bound in (B.SMALL_SUMS, 0):
        monkeypatch.setattr(B, "SMALL_SUMS", bound)
        found.append([[x.tolist() for x in tree] for tree in B._boosted_blocks(binned, b, 0)])
    assert found[0] == found[1]


def blobs(model):
    return {(r["grp"], r["t"], r["leaf"]): bytes(r["blob"]) for r in model.parts().collect()}


def off_the_jvm(monkeypatch):
    from tablewright.plans import jvm

    monkeypatch.setattr(jvm, "loader", lambda spark: None)


@pytest.mark.parametrize("forest", [Forest(5, 2), Forest(3, 1, max_depth=3), Forest(9, 2, random_cuts=True, bootstrap=False), Forest(2, 5, random_cuts=True)])
def test_forests_of_the_jvm_are_the_same(spark, monkeypatch, forest):
    """Bit by bit, with large and small nodes, and folds of which each has bins of its own."""
    rows = frame(spark, *table(1500)).withColumn("grp", F.explode(F.array(F.lit(0), F.lit(3)))).withColumn("valid", F.col("id") % 4 == F.col("grp"))
    binned, found = bin_table(rows), []
    for _ in range(2):
        models = forest_models(binned, forest)
        found.append([blobs(m) for m in models.values()])
        assert all(len(b) == forest.trees for b in found[-1])
        off_the_jvm(monkeypatch)
    assert found[0] == found[1]


@pytest.mark.parametrize("b", [Boosting(6, 3, 0.3), Boosting(5, 8, 0.5, share=0.7, penalty=1.0), Boosting(40, 3, 0.9, patience=3), Boosting(3, 2, 0.3, min_leaf=40)])
def test_rounds_of_the_jvm_are_the_same(spark, monkeypatch, b):
    rows = frame(spark, *table(1500)).withColumn("grp", F.explode(F.array(F.lit(0), F.lit(3)))).withColumn("valid", F.col("id") % 4 == F.col("grp"))
    binned, found = bin_table(rows), []
    for _ in range(2):
        found.append([blobs(m) for m in boosted_models(binned, b).values()])
        off_the_jvm(monkeypatch)
    assert found[0] == found[1] and all(len(x) <= b.rounds for x in found[0])


def test_the_threads_of_a_lone_task_change_nothing(spark, monkeypatch):
    from tablewright.plans import jvm

    r = np.random.default_rng(2)
    x = np.stack([r.normal(size=120_000), r.integers(0, 6, 120_000)], axis=1)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": x[:, 0] * x[:, 1] + r.normal(size=120_000)}))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    b, binned, found = Boosting(3, 5, 0.3, share=0.8), bin_table(rows), []
    for cores in (8, 1):
        monkeypatch.setattr(jvm, "executor_cores", lambda spark, cores=cores: cores)
        found.append(blobs(boosted_models(binned, b)[0]))
    assert found[0] == found[1]


@pytest.mark.parametrize("few", [True, False])
def test_scores_of_the_jvm_are_the_same(spark, data, monkeypatch, few):
    from tablewright.plans import forest

    model = fit_forest_model(data, Forest(7, 2))
    want = values_of(model, data)
    monkeypatch.setattr(forest, "SCORED_BYTES", 10)
    monkeypatch.setattr(forest, "MODEL_BYTES", 10**6 if few else 1_000)
    monkeypatch.setattr(forest.ForestModel, "_sent", None)
    assert values_of(model, data.repartition(5)) == pytest.approx(want, rel=1e-12)


def test_a_large_group_is_not_grown_in_pieces(data, monkeypatch):
    """Beyond what passes the driver, the rows of a group go to the tasks by a shuffle."""
    from tablewright.plans import forest

    binned = bin_table(data.withColumn("valid", F.col("v")))
    monkeypatch.setattr(forest, "LOCAL_BYTES", 100)
    monkeypatch.setattr(B, "LOCAL_BYTES", 100)
    for name in ("_large_nodes", "_local_blocks"):
        monkeypatch.setattr(forest, name, None)
    monkeypatch.setattr(B, "_boosted_blocks", None)
    assert len(blobs(forest_models(binned, Forest(3, 2))[0])) == 3
    assert len(blobs(boosted_models(binned, Boosting(3, patience=2))[0])) <= 3
