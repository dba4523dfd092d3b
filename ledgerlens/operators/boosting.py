"""Gradient-boosted trees from distributed gradient histograms.

Features are cut into at most 256 bins at quantiles of the training rows. A
tree grows from sums of the gradients and row counts by (node, feature, bin),
which every task adds up for its rows; at most ``open nodes x features x 256``
sums leave a task whatever the data. All nodes that may still be split are
asked for together, about once a level of the tree.

The rows are held as one block of arrays per partition in a cached RDD, so a
level is a small job without a query plan, file or shuffle. Every round a new
RDD takes the tree's values into the margins, and every ``REWRITE`` rounds it is
written to the checkpoint folder, which bounds what a lost executor repeats.

* ``loss="squared"``: second-order boosting. A split gains
  GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2), a leaf is
  -G / (H + l2); columns are drawn once a tree, rows by a hash of the customer
  and the round.
* ``loss="absolute"``: the gradient is the sign of the residual; a leaf is the
  median of its rows' residuals.
* ``max_leaves``: best-first growth, the leaf of largest gain first, to any
  depth. ``max_depth`` alone is growth by levels.
* Early stopping: margins are kept with the rows, so a round's training and
  validation error come with the first histogram of the next round; the fit
  ends after ``patience`` rounds without a smaller validation error and keeps
  the trees of the best one.
"""

from __future__ import annotations

import dataclasses
import heapq
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy, not this package

BINS = 256
REWRITE = 20  # trees after which the rows with their margins are written
ROWS_PER_PART = 250_000
FEW_PARTS = 24  # partitions whose sums the driver adds up itself; those of more are combined in steps
MEDIAN_RANKS = 1_000_000  # accuracy of the median of all targets, the start of the absolute loss
SAMPLES = 256  # values of a leaf that a partition sends in a step of the search for its median
ALIKE = 1e-9  # relative difference of two gains below which the first feature and bin is taken


@dataclasses.dataclass(frozen=True)
class Boosting:
    """Parameters of a fit."""
    loss: str = "squared"
    rounds: int = 100
    rate: float = 0.1
    max_depth: int | None = 5
    max_leaves: int | None = None
    l2: float = 1.0
    min_rows: int = 1
    min_gain: float = 0.0
    row_share: float = 0.8
    column_share: float = 0.8
    patience: int | None = 10
    seed: int = 42

    def __post_init__(self):
        if self.loss not in ("squared", "absolute"):
            raise ValueError(f"unsupported loss {self.loss!r}")
        if self.max_depth is None and self.max_leaves is None:
            raise ValueError("a tree needs a largest depth or number of leaves")


SECOND_ORDER = Boosting()
LEAF_WISE = Boosting(loss="absolute", max_depth=None, max_leaves=31, l2=0.0, min_rows=20, row_share=1.0, column_share=1.0)


@dataclasses.dataclass
class Node:
    gradient: float
    rows: int
    depth: int
    path: int  # 1 for the root, then 2 p and 2 p + 1; settles equal gains
    known: bool = False  # its histogram has been asked for
    gain: float = 0.0
    feature: int = -1  # of its split; -1 if it has none
    bin: int = -1  # bins up to it go left
    left: int = -1
    right: int = -1
    value: float = 0.0


@dataclasses.dataclass
class Tree:
    """Nodes by number; ``split`` are the inner nodes that are in use."""
    nodes: list[Node]
    split: set[int]

    def arrays(self) -> tuple[np.ndarray, ...]:
        inner = [i in self.split for i in range(len(self.nodes))]
        cols = zip(*((n.feature if s else -1, n.bin, n.left, n.right, n.value) for n, s in zip(self.nodes, inner)))
        return tuple(np.array(c) for c in cols)

    def leaves(self) -> list[int]:
        out, todo = [], [0]
        while todo:
            i = todo.pop()
            if i in self.split:
                todo += [self.nodes[i].right, self.nodes[i].left]
            else:
                out.append(i)
        return out


def places(bins: np.ndarray, arrays: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf of each row."""
    feature, cut, left, right, _ = arrays
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(live):
        node = at[live]
        at[live] = np.where(bins[live, feature[node]] <= cut[node], left[node], right[node])
        live = live[feature[at[live]] >= 0]
    return at


def drawn(hashes: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Whether a row takes part in a round: a hash of its customer, the seed
    and the round, so that it does not depend on where the row lies."""
    if share >= 1:
        return np.ones(len(hashes), bool)
    x = hashes.view(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2 ** 64), 2 ** 64 - 1))


def columns_of(turn: int, n: int, cfg: Boosting) -> np.ndarray:
    """The features of a round's tree."""
    keep = max(1, round(cfg.column_share * n))
    return np.sort(np.random.default_rng([cfg.seed, turn]).permutation(n)[:keep])


def best_split(gradients: np.ndarray, rows: np.ndarray, columns: np.ndarray, cfg: Boosting) -> tuple[float, int, int, float, int]:
    """(gain, feature, bin, left gradient, left rows) of the best cut of a node's
    histograms (features x bins); of gains alike the first feature and bin."""
    left_g, left_n = np.cumsum(gradients, axis=1)[columns], np.cumsum(rows, axis=1)[columns]
    g, n = left_g[:, -1:], left_n[:, -1:]
    right_g, right_n = g - left_g, n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g ** 2 / (left_n + cfg.l2) + right_g ** 2 / (right_n + cfg.l2) - g ** 2 / (n + cfg.l2)
    gain[(left_n < max(cfg.min_rows, 1)) | (right_n < max(cfg.min_rows, 1))] = -np.inf
    top = gain.max()
    if not top > cfg.min_gain + ALIKE * abs(g[0, 0]):
        return 0.0, -1, -1, 0.0, 0
    f, b = np.unravel_index(int(np.flatnonzero(gain.ravel() >= top - ALIKE * max(1.0, abs(top)))[0]), gain.shape)
    return float(gain[f, b]), int(columns[f]), int(b), float(left_g[f, b]), int(left_n[f, b])


def most_gain(node: Node, cfg: Boosting) -> float:
    """A bound of the gain of a node that has not been looked at: signs add to
    one a row at most; other gradients have no such bound."""
    if node.path > 1 and node.rows < 2 * max(cfg.min_rows, 1):
        return 0.0
    return float(node.rows) if cfg.loss == "absolute" and node.path > 1 else float("inf")


def grow(histograms, columns: np.ndarray, cfg: Boosting) -> Tree:
    """Grow a tree. ``histograms(tree, nodes)`` gives (gradients, rows) of each
    node. The order of splits is followed as far as gains are known, taking
    unknown nodes for leaves; those that might still come into it are asked
    for together, until there are none."""
    tree = Tree([Node(0.0, 0, 0, 1)], set())
    while True:
        tree.split, queue, unknown, least = set(), [], [], 0.0
        todo, leaves = [0], 1
        while True:
            for i in todo:
                node = tree.nodes[i]
                if cfg.max_depth is None or node.depth < cfg.max_depth:
                    if not node.known:
                        unknown.append(i)
                    elif node.feature >= 0:
                        heapq.heappush(queue, (-node.gain, node.path, i))
            if not queue:
                break
            if cfg.max_leaves is not None and leaves >= cfg.max_leaves:
                least = min(tree.nodes[i].gain for i in tree.split)
                break
            i = heapq.heappop(queue)[2]
            tree.split.add(i)
            leaves += 1
            todo = [tree.nodes[i].left, tree.nodes[i].right]
        unknown = [i for i in unknown if most_gain(tree.nodes[i], cfg) > least]
        if not unknown:
            return tree
        for i, (gradients, rows) in zip(unknown, histograms(tree, unknown)):
            node = tree.nodes[i]
            node.known = True
            if i == 0:
                node.gradient, node.rows = float(gradients[0].sum()), int(rows[0].sum())
            node.gain, node.feature, node.bin, left_g, left_n = best_split(gradients, rows, columns, cfg)
            if node.feature >= 0:
                node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
                tree.nodes += [Node(left_g, left_n, node.depth + 1, 2 * node.path),
                               Node(node.gradient - left_g, node.rows - left_n, node.depth + 1, 2 * node.path + 1)]


@dataclasses.dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    history: list[tuple[int, float, float | None]]  # round, training error, validation error
    loss: str

    def importances(self) -> list[float]:
        """Share of each feature in the gains of all splits."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for i in t.split:
                total[t.nodes[i].feature] += t.nodes[i].gain
        return (total / total.sum() if total.sum() > 0 else total).tolist()

    def predict(self) -> Column:
        edges, base, trees = self.edges, self.base, [t.arrays() for t in self.trees]

        @F.arrow_udf("double")
        def predicted(*cols: pa.Array) -> pa.Array:
            bins = binned([c.to_numpy(zero_copy_only=False) for c in cols], edges)
            return pa.array(margins(bins, np.full(len(bins), base), trees))

        return predicted(*[F.col(c).cast("double") for c in self.features])

    def to_json(self) -> str:
        kept = [{"nodes": [dataclasses.astuple(n) for n in t.nodes], "split": sorted(t.split)} for t in self.trees]
        return json.dumps({"features": self.features, "edges": [e.tolist() for e in self.edges], "base": self.base,
                           "trees": kept, "history": self.history, "loss": self.loss})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        trees = [Tree([Node(*n) for n in t["nodes"]], set(t["split"])) for t in d["trees"]]
        return Model(d["features"], [np.array(e) for e in d["edges"]], d["base"], trees, [tuple(h) for h in d["history"]], d["loss"])


def binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Rows x features: how many edges lie below the value."""
    return np.column_stack([np.searchsorted(e, c, side="left") for c, e in zip(columns, edges)]).astype(np.uint8)


def margins(bins: np.ndarray, start: np.ndarray, trees: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    out = np.array(start, np.float64)
    for t in trees:
        out += t[4][places(bins, t)]
    return out


def bin_edges(data: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins`` - 1 cuts of each feature at its quantiles, in one
    aggregate."""
    shares = [i / bins for i in range(1, bins)]
    found = data.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 20 * bins).alias(f"q{i}")
                       for i, c in enumerate(features)]).first()
    return [np.unique(np.array(found[f"q{i}"] or [], np.float64)) for i in range(len(features))]


Block = tuple[np.ndarray, ...]  # hash, valid, target, margin, and bins with a row per feature


def _gradient(margin: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    return margin - y if loss == "squared" else np.sign(margin - y)


LOSSES = {"squared": lambda e: e * e, "absolute": np.abs}
TRAIN_LOSS, TRAIN_ROWS, VALID_LOSS, VALID_ROWS = range(4)


def held(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch, with the features as bins, as bytes."""
    for b in batches:
        h, valid, y, *xs = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        parts = h, valid, y, np.ascontiguousarray(binned(xs, edges).T)
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["h", "valid", "y", "bins"])


def block(rows, n: int, base: float) -> Iterator[Block]:
    """One block from the batches of a partition."""
    kept = [(np.frombuffer(r.h, np.int64), np.frombuffer(r.valid, bool), np.frombuffer(r.y),
             np.frombuffer(r.bins, np.uint8).reshape(n, -1)) for r in rows]
    empty = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0), np.empty((n, 0), np.uint8))
    h, valid, y, bins = (np.concatenate(c, axis=-1) for c in zip(empty, *kept))
    yield h, valid, y, np.full(len(y), base), bins


def bracket(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rank: int) -> tuple[float, float]:
    """Bounds of the value of a rank (from 1) from what partitions sent: some
    of their values in order, how many rows lie below each and up to each, and
    how many before the first that was not looked at (all, at the end)."""
    values = np.unique(np.concatenate([f[0] for f in found]))
    below, upto = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for v, less, most, before_end in found:
        below += np.append(less, before_end[1])[np.searchsorted(v, values, side="left")]  # at most so many are smaller
        upto += np.append(before_end[0], most)[np.searchsorted(v, values, side="right")]  # at least so many are not larger
    return values[np.flatnonzero(below < rank)[-1]], values[np.flatnonzero(upto >= rank)[0]]


class Rows:
    """The blocks of a fit."""

    def __init__(self, blocks: RDD, n: int, cfg: Boosting):
        self.blocks, self.n, self.cfg, self.trees, self.before = blocks, n, cfg, 0, []
        self.blocks.persist(StorageLevel.MEMORY_AND_DISK).checkpoint()

    def add(self, tree: Tree) -> None:
        arrays = tree.arrays()

        def moved(blocks: Iterator[Block]) -> Iterator[Block]:
            for h, valid, y, margin, bins in blocks:
                yield h, valid, y, margins(bins.T, margin, [arrays]), bins

        self.before.append(self.blocks)
        self.blocks, self.trees = self.blocks.mapPartitions(moved, True), self.trees + 1
        self.blocks.persist(StorageLevel.MEMORY_AND_DISK)
        if self.trees % REWRITE == 0:
            self.blocks.checkpoint()

    def free(self) -> None:
        """Give up the blocks that those of today were made from."""
        while self.before:
            self.before.pop().unpersist()

    def close(self) -> None:
        self.free()
        self.blocks.unpersist()

    def histograms(self, turn: int, tree: Tree, nodes: list[int], errors: bool) -> tuple[list, dict]:
        """Gradients and rows of each node by (feature, bin); with ``errors``
        also the losses of the margins as they are."""
        n, cfg, arrays, size = self.n, self.cfg, tree.arrays(), len(nodes) * BINS

        def summed(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
            slot = np.full(len(arrays[0]), -1)
            slot[nodes] = np.arange(len(nodes))
            for h, valid, y, margin, bins in blocks:
                losses, sums = np.zeros(4), np.zeros((2, n, size))
                if errors:
                    e = LOSSES[cfg.loss](margin - y)
                    losses[:] = e[~valid].sum(), (~valid).sum(), e[valid].sum(), valid.sum()
                if nodes:
                    at = slot[places(bins.T, arrays)]
                    own = np.flatnonzero((at >= 0) & ~valid & drawn(h, cfg.seed, turn, cfg.row_share))
                    first, gradient = at[own] * BINS, _gradient(margin[own], y[own], cfg.loss)
                    for f in range(n):
                        cell = first + bins[f, own]
                        sums[0, f], sums[1, f] = np.bincount(cell, gradient, size), np.bincount(cell, minlength=size)
                yield np.concatenate([losses, sums.ravel()])

        sums = self.blocks.mapPartitions(summed)
        few = self.blocks.getNumPartitions() <= FEW_PARTS
        total = sum(sums.collect()) if few else sums.treeReduce(lambda a, b: a + b)
        self.free()
        g, rows = total[4:].reshape(2, n, len(nodes), BINS).swapaxes(1, 2)
        return list(zip(g, rows.astype(np.int64))), dict(enumerate(total[:4].tolist())) if errors else {}

    def medians(self, turn: int, tree: Tree) -> dict[int, float]:
        """The median residual of each leaf (the lower of two), exact: each
        partition sends values spread over the distinct ones within the bounds
        known so far, until the bounds of all leaves meet."""
        cfg, arrays = self.cfg, tree.arrays()
        bounds = {i: (-np.inf, np.inf) for i in tree.leaves() if tree.nodes[i].rows}
        done: dict[int, float] = {}
        while bounds:
            asked = dict(bounds)

            def sent(blocks: Iterator[Block]) -> Iterator[dict]:
                for h, valid, y, margin, bins in blocks:
                    own = np.flatnonzero(~valid & drawn(h, cfg.seed, turn, cfg.row_share))
                    at, left, out = places(bins.T[own], arrays), y[own] - margin[own], {}
                    order = np.argsort(at, kind="stable")
                    ends = np.searchsorted(at[order], np.arange(len(arrays[0]) + 1))
                    for i, (low, high) in asked.items():
                        r = np.sort(left[order[ends[i]:ends[i + 1]]])
                        below, end = np.searchsorted(r, low, side="left"), np.searchsorted(r, high, side="right")
                        values, first, counts = np.unique(r[below:end], return_index=True, return_counts=True)
                        kept = np.unique(np.linspace(0, len(values) - 1, min(SAMPLES, len(values))).astype(np.int64))
                        less = below + first[kept]
                        out[i] = values[kept], less, less + counts[kept], (int(below), int(end))
                    yield out

            got = self.blocks.mapPartitions(sent).collect()
            for i in asked:
                low, high = bracket([g[i] for g in got], (tree.nodes[i].rows + 1) // 2)
                bounds[i] = (low, high)
                if low == high:
                    done[i] = float(low)
                    del bounds[i]
        return done


def boost(rows, n: int, cfg: Boosting) -> tuple[list[Tree], list[tuple[int, float, float | None]]]:
    """The trees and errors by round of a fit on ``rows`` with ``n`` features."""
    trees: list[Tree] = []
    history: list[tuple[int, float, float | None]] = []
    best = (float("inf"), 0)
    root = lambda x: x ** 0.5 if cfg.loss == "squared" else x

    def judged(losses: dict) -> bool:
        """Note the error of the trees so far; whether to go on."""
        nonlocal best
        seen = losses[VALID_ROWS] > 0
        valid = root(losses[VALID_LOSS] / losses[VALID_ROWS]) if seen else None
        history.append((len(trees), root(losses[TRAIN_LOSS] / losses[TRAIN_ROWS]), valid))
        if seen and valid < best[0]:
            best = (valid, len(trees))
        return not (seen and cfg.patience and len(trees) - best[1] >= cfg.patience)

    for turn in range(cfg.rounds):
        columns, errors = columns_of(turn, n, cfg), {}

        def asked(tree, nodes):
            got, losses = rows.histograms(turn, tree, nodes, errors=not errors)
            errors.update(losses)
            return got

        tree = grow(asked, columns, cfg)
        if not judged(errors):
            break
        middle = rows.medians(turn, tree) if cfg.loss == "absolute" else {}
        for i in tree.leaves():
            node = tree.nodes[i]
            node.value = cfg.rate * (middle.get(i, 0.0) if cfg.loss == "absolute" else -node.gradient / (node.rows + cfg.l2))
        trees.append(tree)
        rows.add(tree)
    else:
        judged(rows.histograms(cfg.rounds, Tree([Node(0.0, 0, 0, 1)], set()), [], errors=True)[1])
    if cfg.patience and any(h[2] is not None for h in history):
        trees = trees[:best[1]]
    return trees, history


def fit(train: DataFrame, features: list[str], target: str, cfg: Boosting = SECOND_ORDER, key: str = "CustomerID",
        validation: Column | None = None, parts: int | None = None) -> Model:
    """Fit on the rows of ``train`` that ``validation`` does not mark; with
    marked rows and ``cfg.patience``, stop early and keep the best round.
    ``parts``: partitions of the rows, by their number if not given.
    Rows without a target are left out; a null feature lies above all cuts."""
    marked = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
    data = train.select(F.xxhash64(key).alias("h"), marked.alias("valid"), F.col(target).cast("double").alias("y"),
                        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).where("y is not null")
    edges = bin_edges(data.where("not valid"), [f"x{i}" for i in range(len(features))])
    fits = ~F.col("valid")
    n_rows, mean, median, n_valid = data.agg(
        F.count_if(fits), F.avg(F.when(fits, F.col("y"))), F.percentile_approx(F.when(fits, F.col("y")), 0.5, MEDIAN_RANKS),
        F.count_if("valid")).first()
    if not n_rows:
        raise ValueError("no rows to fit on")
    base = float(mean if cfg.loss == "squared" else median)
    n = len(features)

    parts = parts or -(-(n_rows + n_valid) // ROWS_PER_PART)
    ensure_checkpoint_dir(train.sparkSession)
    batches = data.repartition(parts).mapInArrow(lambda b: held(b, edges), "h binary, valid binary, y binary, bins binary")
    rows = Rows(batches.rdd.mapPartitions(lambda r: block(r, n, base)), n, cfg)
    try:
        return Model(list(features), edges, base, *boost(rows, n, cfg), cfg.loss)
    finally:
        rows.close()


def rounds_table(spark: SparkSession, model: Model) -> DataFrame:
    """(round, train_error, validation_error, is_best) of a fit; round 0 is the
    constant start, the errors are RMSE or MAE by the loss."""
    return spark.createDataFrame([(r, t, v, r == len(model.trees)) for r, t, v in model.history],
                                 "round int, train_error double, validation_error double, is_best boolean")


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """The model as one JSON text."""
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path, wholetext=True).first()[0])
