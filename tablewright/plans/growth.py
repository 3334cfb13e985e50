"""Growing one tree from binned features with numpy.

All sums are whole numbers below 2**53 kept in doubles: targets are rounded to a grid and weights are counts. So sums do not depend on the order
of the rows, and a node is split alike wherever, and in however many pieces, its rows are added up.

Statistics of a node are the number of its rows and then, for a regression, their weight and weighted target; for classes, the weight of each class.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

LEAF = 0xFFFF
BINS = 256
#: Features of up to so many bins are added up by bin instead of being kept in order.
_FEW = 8
#: Nodes of at least so many rows are split from histograms, of which so many are looked at in one step.
_DENSE = 256
_NODES_A_STEP = 1024
#: Levels of up to so many inner nodes are passed by comparing whole columns.
_FEW_NODES = 16
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(20)])
_NEVER = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(ids: np.ndarray, salt: int) -> np.ndarray:
    return mixed(np.asarray(ids, np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each id."""
    return (salted(ids, salt) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def tree_id(seed: int, tree: int) -> np.ndarray:
    return salted(salted(np.array([seed % (1 << 63)], np.uint64), 1), tree)


def bootstrap_counts(rows: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson with mean 1, from the hash of row and tree."""
    return np.searchsorted(_POISSON, uniform(rows ^ tree[0], 3), side="right")


def sampled(rows: np.ndarray, tree: np.ndarray, share: float) -> np.ndarray:
    return uniform(rows ^ tree[0], 4) < share


@dataclass(frozen=True)
class Rules:
    """How nodes are split. ``class_weights`` switches from variance to Gini impurity of weighted classes.

    A weight of one counts as ``unit`` grid steps, and ``penalty`` is added to the weight of every node. ``symmetric`` trees have one split for all nodes of a level.
    """

    min_leaf: int = 1
    max_depth: int | None = None
    tries: int | None = None
    random_cuts: bool = False
    class_weights: tuple[float, ...] | None = None
    penalty: float = 0.0
    unit: float = 1.0
    symmetric: bool = False

    def score(self, sums: np.ndarray) -> np.ndarray:
        """What a split maximises, added over its sides; ``sums`` without the number of rows."""
        if self.class_weights is None:
            weight = sums[0] / self.unit + self.penalty
            return np.divide(sums[1] ** 2, weight, out=np.zeros(weight.shape), where=weight > 0)
        classes = sums * np.array(self.class_weights).reshape(-1, *[1] * (sums.ndim - 1))
        weight = classes.sum(axis=0)
        return np.divide((classes**2).sum(axis=0), weight, out=np.zeros(weight.shape), where=weight > 0)

    def values(self, stats: np.ndarray) -> np.ndarray:
        """For a regression the mean target, for classes their shares; one row for each node."""
        if self.class_weights is None:
            weight = stats[1] / self.unit + self.penalty
            return np.divide(stats[2], weight, out=np.zeros(weight.shape), where=weight > 0)[:, None]
        classes = stats[1:] * np.array(self.class_weights)[:, None]
        return (classes / np.maximum(classes.sum(axis=0), 1e-300)).T


def gain_floor(parent: np.ndarray) -> np.ndarray:
    """Gains up to this are rounding."""
    return 1e-12 * np.maximum(1.0, np.abs(parent))


def drawn_cuts(rules: Rules, ids: np.ndarray, low: np.ndarray, high: np.ndarray, feature: int, values: np.ndarray) -> np.ndarray:
    """The last bin left of a random threshold between the lowest and the highest bin of each node."""
    bottom, top = values[low], values[high]
    threshold = bottom + uniform(ids, 100 + feature) * (top - bottom)
    return np.clip(np.searchsorted(values, threshold, side="right") - 1, low, np.maximum(high - 1, low))


def choose(rules: Rules, ids: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The feature with the highest gain (rows: features; -inf: no split); of ``tries`` features drawn for the node among those that can split it."""
    if rules.tries is not None and rules.tries < len(gains):
        order = np.stack([salted(ids, 10_000 + f) for f in range(len(gains))])
        order = np.where(np.isfinite(gains), order >> np.uint64(1), np.uint64(_NEVER))
        rank = order.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable")
        gains = np.where(rank < rules.tries, gains, -np.inf)
    return gains.argmax(axis=0)


def children(ids: np.ndarray) -> np.ndarray:
    """Ids of the left and right child of each node, in turn."""
    return np.stack([salted(ids, 20), salted(ids, 21)], axis=1).ravel()


@dataclass
class Tree:
    """Nodes in level order; the children of the r-th inner node are the nodes 2r+1 and 2r+2."""

    feature: np.ndarray
    cut: np.ndarray
    stats: np.ndarray
    gain: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @property
    def left(self) -> np.ndarray:
        inner = self.feature != LEAF
        return np.where(inner, 2 * np.cumsum(inner) - 1, 0)


def leaves(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Leaf of each row; ``codes`` has a row for each feature."""
    at = np.zeros(codes.shape[1], np.int64)
    going = np.arange(codes.shape[1]) if len(feature) and feature[0] != LEAF else np.zeros(0, np.int64)
    while len(going):
        node = at[going]
        node = left[node] + (codes[feature[node], going] > cut[node])
        at[going] = node
        going = going[feature[node] != LEAF]
    return at


def grow(codes: np.ndarray, stats: np.ndarray, root: np.ndarray, rules: Rules, values: list[np.ndarray], depth: int = 0) -> Tree:
    """A tree from all rows: ``codes`` features by rows, ``stats`` statistics by rows with the number of rows (1 each) first.

    Nodes of ``_DENSE`` rows and more are split from histograms. The rows of a smaller one are sorted once by every feature of more than a few bins, and its
    splits part each order in place. A level is a few passes over the rows that can still be split, whatever its number of nodes.
    """
    p, n = codes.shape
    bins = [max(len(values[f]), int(codes[f].max(initial=0)) + 1) for f in range(p)]
    many = [f for f in range(p) if bins[f] > _FEW]
    few = [f for f in range(p) if bins[f] <= _FEW]
    totals, ids = stats.sum(axis=1)[:, None], root
    dense = _Dense(np.zeros(1, np.int64), np.arange(n), np.zeros(n, np.int64))
    sparse = _Sparse(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((max(1, len(many)), 0), np.int64))
    levels = []
    while totals.shape[1]:
        m = totals.shape[1]
        parent = rules.score(totals[1:])
        gains, cuts = np.full((p, m), -np.inf), np.zeros((p, m), np.int64)
        lefts = np.zeros((p, len(totals), m))
        if rules.max_depth is None or depth < rules.max_depth:
            _split_dense(dense, codes, stats, totals, parent, ids, rules, values, bins, (gains, cuts, lefts))
            _split_sparse(sparse, codes, stats, totals, parent, ids, rules, values, bins, many, few, (gains, cuts, lefts))
            gains[:, totals[0] < 2 * rules.min_leaf] = -np.inf
        best = choose(rules, ids, gains)
        nodes = np.arange(m)
        gain = gains[best, nodes]
        split = gain > gain_floor(parent)
        feature = np.where(split, best, LEAF).astype(np.uint16)
        cut = np.where(split, cuts[best, nodes], 0).astype(np.uint8)
        levels.append((feature, cut, totals, np.where(split, gain, 0.0), ids))
        if not split.any():
            break
        left = lefts[best[split], :, nodes[split]].T
        totals = np.stack([left, totals[:, split] - left], axis=2).reshape(len(stats), -1)
        ids = children(ids[split])
        # Rows of children too small to be split again are left out.
        sizes = totals[0].astype(np.int64)
        going = sizes >= 2 * rules.min_leaf
        rank = 2 * (np.cumsum(split) - 1)
        older = _parted(sparse, codes, split, rank, best, cut, sizes, going)
        dense, rows, at = _dealt(dense, codes, split, rank, best, cut, sizes, going)
        sparse = _joined(older, _sorted(rows, at, codes, many, sizes))
        depth += 1
    return Tree(*(np.concatenate(parts, axis=-1) for parts in zip(*levels, strict=True)))


@dataclass(frozen=True)
class _Dense:
    """Large open nodes: their numbers in the level, their rows, and the place of each row's node in ``nodes``."""

    nodes: np.ndarray
    rows: np.ndarray
    at: np.ndarray


@dataclass(frozen=True)
class _Sparse:
    """Small open nodes: their numbers in the level, their sizes, and for each feature their rows by node and bin."""

    nodes: np.ndarray
    sizes: np.ndarray
    order: np.ndarray


def _split_dense(dense, codes, stats, totals, parent, ids, rules, values, bins, out) -> None:
    gains, cuts, lefts = out
    m, nodes = len(dense.nodes), dense.nodes
    if not m:
        return
    everything = len(dense.rows) == codes.shape[1]
    weights = stats[1:] if everything else stats[1:, dense.rows]
    for f, width in enumerate(bins):
        cell = dense.at * width
        cell += codes[f] if everything else codes[f][dense.rows]
        hist = np.empty((m, len(stats), width))
        hist[:, 0] = np.bincount(cell, minlength=m * width).reshape(m, width)
        for k, w in enumerate(weights):
            hist[:, k + 1] = np.bincount(cell, weights=w, minlength=m * width).reshape(m, width)
        for low in range(0, m, _NODES_A_STEP):
            some, own = nodes[low : low + _NODES_A_STEP], hist[low : low + _NODES_A_STEP]
            gains[f, some], cuts[f, some], found = cut_gains(rules, ids[some], own, totals[:, some], parent[some], f, values[f])
            lefts[f][:, some] = found


def _split_sparse(sparse, codes, stats, totals, parent, ids, rules, values, bins, many, few, out) -> None:
    gains, cuts, lefts = out
    m, nodes, sizes = len(sparse.nodes), sparse.nodes, sparse.sizes
    if not m:
        return
    n = sparse.order.shape[1]
    starts = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(m), sizes)
    own_totals, own_parent, own_ids = totals[:, nodes], parent[nodes], ids[nodes]
    left_n = np.arange(1, n + 1) - starts[seg]
    inside = ((left_n >= rules.min_leaf) & (sizes[seg] - left_n >= max(1, rules.min_leaf)))[:-1]
    for k, f in enumerate(many):
        o = sparse.order[k]
        c = codes[f].take(o)
        at = np.flatnonzero(inside & (c[1:] != c[:-1]))
        if rules.random_cuts and len(at):
            drawn = drawn_cuts(rules, own_ids, c[starts], c[starts + sizes - 1], f, values[f]).take(seg.take(at))
            at = at[(c.take(at) <= drawn) & (c.take(at + 1) > drawn)]
        if not len(at):
            continue
        s = seg.take(at)
        left, right = np.empty((len(stats) - 1, len(at))), np.empty((len(stats) - 1, len(at)))
        for j, w in enumerate(stats[1:]):
            run = np.cumsum(w.take(o))
            before = np.where(starts > 0, run.take(starts - 1), 0.0)
            np.subtract(run.take(at), before.take(s), out=left[j])
            np.subtract(own_totals[j + 1].take(s), left[j], out=right[j])
        gain = rules.score(left)
        gain += rules.score(right)
        gain -= own_parent.take(s)
        first = np.flatnonzero(np.diff(s, prepend=-1))
        top = np.maximum.reduceat(gain, first)
        hits = np.flatnonzero(gain == np.repeat(top, np.diff(first, append=len(s))))
        place = hits[np.flatnonzero(np.diff(s.take(hits), prepend=-1))]  # the first of equal gains
        found = s[first]
        node = nodes[found]
        gains[f, node], cuts[f, node] = top, c[at[place]]
        lefts[f, 0, node], lefts[f][1:, node] = at[place] + 1 - starts[found], left[:, place]
    if few:
        rows = sparse.order[0]
        weights = [w.take(rows) for w in stats[1:]]
        for f in few:
            width = bins[f]
            cell = seg * width
            cell += codes[f].take(rows)
            hist = np.empty((m, len(stats), width))
            hist[:, 0] = np.bincount(cell, minlength=m * width).reshape(m, width)
            for k, w in enumerate(weights):
                hist[:, k + 1] = np.bincount(cell, weights=w, minlength=m * width).reshape(m, width)
            gains[f, nodes], cuts[f, nodes], found = cut_gains(rules, own_ids, hist, own_totals, own_parent, f, values[f])
            lefts[f][:, nodes] = found


def _dealt(dense, codes, split, rank, best, cut, sizes, going) -> tuple[_Dense, np.ndarray, np.ndarray]:
    """Large nodes of the next level; rows, with the numbers of their nodes, of those that are small from now on."""
    node = dense.nodes[dense.at]
    kept = np.flatnonzero(split[node])
    rows, node = dense.rows[kept], node[kept]
    child = rank[node] + (codes[best[node], rows] > cut[node])
    large = going & (sizes >= _DENSE)
    mine = large[child]
    nodes = np.unique(child[mine])
    place = np.zeros(len(sizes), np.int64)
    place[nodes] = np.arange(len(nodes))
    small = (going & ~large)[child]
    return _Dense(nodes, rows[mine], place[child[mine]]), rows[small], child[small]


def _sorted(rows, at, codes, many, sizes) -> _Sparse:
    nodes = np.unique(at)
    place = np.zeros(len(sizes), np.int64)
    place[nodes] = np.arange(len(nodes))
    at = place[at].astype(np.uint16 if len(nodes) < 65_536 else np.uint32)
    out = np.empty((max(1, len(many)), len(rows)), np.int64)
    for k in range(len(out)):
        by_bin = np.argsort(codes[many[k]][rows], kind="stable") if many else np.arange(len(rows))
        out[k] = rows[by_bin[np.argsort(at[by_bin], kind="stable")]]
    return _Sparse(nodes, sizes[nodes], out)


def _joined(a: _Sparse, b: _Sparse) -> _Sparse:
    return _Sparse(np.concatenate([a.nodes, b.nodes]), np.concatenate([a.sizes, b.sizes]), np.concatenate([a.order, b.order], axis=1))


def _parted(sparse, codes, split, rank, best, cut, sizes, going) -> _Sparse:
    """Small nodes of the next level, their rows in the same order inside each."""
    node = sparse.nodes
    children_of = np.stack([rank[node], rank[node] + 1], axis=1)[split[node]].ravel()
    wanted = going[children_of]
    nodes = children_of[wanted]
    out_sizes = sizes[nodes]
    start = np.zeros(len(sizes), np.int64)
    start[nodes] = np.cumsum(out_sizes) - out_sizes
    seg = np.repeat(node, sparse.sizes)
    rows = sparse.order[0]
    goes = np.zeros(codes.shape[1], np.int8)  # 0: out, 1: left, 2: right
    side = np.where(codes[best[seg], rows] <= cut[seg], 1, 2).astype(np.int8)
    child = rank[seg] + (side - 1)
    stays = split[seg]
    stays[stays] = going[child[stays]]
    goes[rows] = np.where(stays, side, 0)
    out = np.empty((len(sparse.order), int(out_sizes.sum())), np.int64)
    # In every order a node's rows are next to each other, so the rows that go left, and those that go right, are already in place one after the other.
    left_nodes, right_nodes = rank[node][split[node]], rank[node][split[node]] + 1
    sides = [(1, left_nodes[going[left_nodes]]), (2, right_nodes[going[right_nodes]])]
    places = []
    for mark, own in sides:
        count = sizes[own]
        first = np.cumsum(count) - count
        places.append((mark, np.arange(int(count.sum())) + np.repeat(start[own] - first, count)))
    for k, o in enumerate(sparse.order):
        g = goes.take(o)
        for mark, place in places:
            out[k][place] = o[g == mark]
    return _Sparse(nodes, out_sizes, out)


def cut_gains(rules: Rules, ids: np.ndarray, hist: np.ndarray, totals: np.ndarray, parent: np.ndarray, feature: int, values: np.ndarray):
    """Gain, cut and statistics left of the cut for the best cut of one feature in each node; ``hist`` has nodes, statistics and bins."""
    m, bins = len(hist), np.arange(hist.shape[2])
    run = np.cumsum(hist, axis=2).transpose(1, 0, 2)  # statistics, nodes, bins
    rest = totals[:, :, None] - run
    held = hist[:, 0] > 0
    # Of cuts that part alike, the one at the last bin on the left.
    fits = held & (run[0] >= rules.min_leaf) & (rest[0] >= rules.min_leaf) & (run[0] > 0) & (rest[0] > 0)
    if rules.random_cuts:
        low, high = held.argmax(axis=1), len(bins) - 1 - held[:, ::-1].argmax(axis=1)
        drawn = drawn_cuts(rules, ids, low, high, feature, values)
        last = np.where(held & (bins <= drawn[:, None]), bins, -1).max(axis=1)
        fits &= bins == last[:, None]
    gain = rules.score(run[1:]) + rules.score(rest[1:]) - parent[:, None]
    if rules.symmetric:
        gain = np.broadcast_to(np.where(fits.any(axis=0), gain.sum(axis=0), -np.inf), fits.shape)
    else:
        gain = np.where(fits, gain, -np.inf)
    cut = gain.argmax(axis=1)
    nodes = np.arange(m)
    return gain[nodes, cut], cut, run[:, nodes, cut]


def best_splits(rules: Rules, ids: np.ndarray, hist: np.ndarray, values: list[np.ndarray]):
    """The same choice from histograms of shape (nodes, features, statistics, bins): feature, cut, gain and statistics left of the cut."""
    m, p, k, _ = hist.shape
    totals = hist[:, 0].sum(axis=2).T
    parent = rules.score(totals[1:])
    gains, cuts, lefts = np.full((p, m), -np.inf), np.zeros((p, m), np.int64), np.zeros((p, k, m))
    nodes = np.arange(m)
    for f in range(p):
        gains[f], cuts[f], lefts[f] = cut_gains(rules, ids, hist[:, f], totals, parent, f, values[f])
    best = choose(rules, ids, gains)
    gain = gains[best, nodes]
    split = (gain > gain_floor(parent)) & ((totals[0] >= 2 * rules.min_leaf) | rules.symmetric)
    return np.where(split, best, LEAF), cuts[best, nodes], np.where(split, gain, 0.0), lefts[best, :, nodes].T, totals


def histogram(codes: np.ndarray, node: np.ndarray, m: int, stats: np.ndarray) -> np.ndarray:
    """Statistics by node, feature and bin of rows with the given node numbers."""
    out = np.empty((m, len(codes), len(stats), BINS))
    base = node.astype(np.int64) * BINS
    for f, c in enumerate(codes):
        at = base + c
        for k, s in enumerate(stats):
            out[:, f, k] = np.bincount(at, weights=s, minlength=m * BINS).reshape(m, BINS)
    return out


def bundled(values: list[np.ndarray]) -> list[list[int]]:
    """Features in bundles that are added up by one number: those of few bins together, as long as their combinations are at most ``BINS``."""
    out: list[list[int]] = []
    size = BINS + 1
    for f in sorted(range(len(values)), key=lambda f: len(values[f])):
        width = max(1, len(values[f]))
        if size * width > BINS:
            out.append([])
            size = 1
        out[-1].append(f)
        size *= width
    return out


def bundle_sums(bundles: list[list[int]], values: list[np.ndarray], codes: np.ndarray, node: np.ndarray | None, m: int, weights: list[np.ndarray]) -> np.ndarray:
    """Number of rows and sums of weights by node (None: one for all rows), statistic, and bin of each bundle in turn."""
    out = []
    base = None if node is None else node.astype(np.int64)
    for bundle in bundles:
        width = int(np.prod([max(1, len(values[f])) for f in bundle]))
        at = codes[bundle[0]]
        for f in bundle[1:]:
            at = at * np.uint8(len(values[f])) + codes[f]  # below BINS
        at = at.astype(np.int64) if base is None else base * width + at
        sums = [np.bincount(at, minlength=m * width), *(np.bincount(at, weights=w, minlength=m * width) for w in weights)]
        out.append(np.stack([x.reshape(m, width) for x in sums], axis=1, dtype=np.float64, casting="unsafe"))
    return np.concatenate(out, axis=2)


def unbundled(bundles: list[list[int]], values: list[np.ndarray], sums: np.ndarray) -> np.ndarray:
    """The same sums as ``histogram`` has them: by node, feature, statistic and bin."""
    m, k, _ = sums.shape
    out = np.zeros((m, len(values), k, BINS))
    low = 0
    for bundle in bundles:
        shape = [max(1, len(values[f])) for f in bundle]
        width = int(np.prod(shape))
        cube = sums[:, :, low : low + width].reshape(m, k, *shape)
        low += width
        for i, f in enumerate(bundle):
            out[:, f, :, : shape[i]] = cube.sum(axis=tuple(2 + j for j in range(len(shape)) if j != i))
    return out


def places(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Node of each row after all splits, as ``leaves``. Levels of few nodes compare whole columns, deeper ones look up the node of each row."""
    n = codes.shape[1]
    kind = np.uint8 if len(feature) <= BINS else np.uint16 if len(feature) <= LEAF else np.int64
    at = np.zeros(n, kind)
    here: list[tuple[int, np.ndarray | None]] = [(0, None)] if feature[0] != LEAF else []
    while here and len(here) <= _FEW_NODES:
        below = []
        for node, rows in here:
            right = codes[feature[node]] > cut[node]
            if rows is not None:
                right &= rows
            others = ~right if rows is None else rows ^ right
            for child, own in ((int(left[node]), others), (int(left[node]) + 1, right)):
                if feature[child] == LEAF:
                    at |= np.multiply(own, kind(child), dtype=kind)
                else:
                    below.append((child, own))
        here = below
    if here:
        for node, rows in here:
            at |= np.multiply(rows, kind(node), dtype=kind)
        inner = feature != LEAF
        first = np.where(inner, feature, 0).astype(np.int64) * n
        last, after = np.where(inner, cut, BINS - 1).astype(np.uint8), np.where(inner, left, np.arange(len(feature))).astype(kind)
        flat, row = np.ascontiguousarray(codes).reshape(-1), np.arange(n)
        open_nodes = {node for node, _ in here}
        while open_nodes:
            at = after.take(at) + (flat.take(first.take(at) + row) > last.take(at)).astype(kind)
            open_nodes = {c for node in open_nodes for c in (int(left[node]), int(left[node]) + 1) if feature[c] != LEAF}
    return at


def pop_order(tree: Tree, limit: int | None = None) -> np.ndarray:
    """When best-first growth splits each node: always the open leaf with the highest gain, the lower node on ties. Never: a very large number.

    A tree of at most L leaves consists of the first L - 1 splits, so trees of all sizes are prefixes of this order.
    """
    order, left, done = np.full(len(tree.feature), _NEVER), tree.left, 0
    heap = [(-tree.gain[0], 0)] if tree.feature[0] != LEAF else []
    while heap and (limit is None or done < limit):
        _, node = heapq.heappop(heap)
        order[node] = done
        done += 1
        for child in (int(left[node]), int(left[node]) + 1):
            if tree.feature[child] != LEAF:
                heapq.heappush(heap, (-tree.gain[child], child))
    return order
