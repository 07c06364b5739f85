"""Trees grown level by level from distributed histograms: a classification tree and second-order boosting.

Features are cut into at most ``max_bins`` bins once: all distinct values where there are few, quantiles
where there are many. The training rows become blocks of bin numbers, one byte or two per cell, cached by
Spark. A level of a tree is one job: every task routes its rows through the tree so far and adds up, per
node, feature and bin, the class counts (classification) or gradient and Hessian (boosting); the sums of all
tasks are merged by a tree reduction, and only they reach the driver, which picks one split per node. A
level whose histograms would be large is done in groups of nodes, so the driver's memory is bounded
whatever the depth. The blocks keep the margins of boosting from round to round, and are written to the
checkpoint folder every few rounds, so a lost executor costs these rounds at most.

Blocks that fill one partition only, as small tables do, have no sums to merge between tasks; there the same
growth runs inside the one task instead of hundreds of jobs of a few milliseconds' work each.

RDDs are used because the rows of a block are worked on as arrays that stay cached between many jobs; each
of them would otherwise be planned and compiled anew.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import ensure_checkpoint_dir

# workers get the functions of this module with each job, so they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells (rows x features) of a table that grows inside one task, or of each task where there are many; cells of
#: each of a few tasks; histogram numbers of a job.
TASK_CELLS, JOB_CELLS, MOST_NUMBERS = 2_000_000, 250_000, 1 << 23
#: Boosting grows inside one task up to so many times TASK_CELLS (cells x outputs): a level of them takes less than a job.
LONE_TIMES = 3
#: Tasks whose sums go to the driver directly; more are merged on executors first.
DIRECT_TASKS = 16
#: Rounds between two checkpoints of the blocks.
CHECKPOINT_ROUNDS = 20
#: A split must gain more than this (the least gain of the boosting loss; rounding for Gini).
LEAST_LOSS_GAIN, ROUNDING = 1e-6, 1e-12
#: Leaves of a tree that bits of one number stand for.
MASK_LEAVES, ALL_LEAVES = 64, np.uint64(2**64 - 1)


@dataclass
class Tree:
    """Nodes in the order they were made; node 0 is the root, a feature below 0 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)  # the right child follows the left one
    value: list = field(default_factory=list)  # a leaf's weight, or class counts
    gain: list[float] = field(default_factory=list)
    level: list[int] = field(default_factory=list)

    def add(self, value, level: int) -> int:
        for own, new in zip((self.feature, self.bin, self.threshold, self.left, self.value, self.gain, self.level), (-1, 0, 0.0, -1, value, 0.0, level)):
            own.append(new)
        return len(self.feature) - 1

    @property
    def depth(self) -> int:
        return max(self.level)

    @property
    def n_leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def route(self, columns: np.ndarray, cuts: list) -> np.ndarray:
        """The leaf of every row; ``columns`` is features x rows, a row goes left up to the cut of its node."""
        feature, left, cut = np.array(self.feature), np.array(self.left), np.array(cuts)
        node = np.zeros(columns.shape[1], np.int64)
        rows = np.arange(columns.shape[1])
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = left[at] + (columns[feature[at], rows] > cut[at])
        return node

    def place(self, bins: np.ndarray, cuts: list[int], n_bins: int) -> np.ndarray:
        """``route`` over bin numbers below ``n_bins``: each feature's bin leaves some of the leaves open, together one."""
        return self.placing(cuts, n_bins)(bins)

    def placing(self, cuts: list[int], n_bins: int) -> Callable[[np.ndarray], np.ndarray]:
        """``place`` as a function of the bins, for many blocks."""
        leaves = [v for v, f in enumerate(self.feature) if f < 0]
        if len(leaves) > MASK_LEAVES:
            return lambda bins: self.route(bins, cuts)
        under = [0] * len(self.feature)
        for i, v in enumerate(leaves):
            under[v] = 1 << i
        open_: dict[int, np.ndarray] = {}
        for v in reversed(range(len(self.feature))):  # children come after their parent
            f = self.feature[v]
            if f >= 0:
                left, right = under[self.left[v]], under[self.left[v] + 1]
                under[v] = left | right
                if f not in open_:
                    open_[f] = np.full(n_bins, ALL_LEAVES)
                mask = open_[f]
                mask[: cuts[v] + 1] &= ALL_LEAVES ^ np.uint64(right)
                mask[cuts[v] + 1 :] &= ALL_LEAVES ^ np.uint64(left)
        nodes, root = np.array(leaves), np.uint64(under[0])

        def of(bins: np.ndarray) -> np.ndarray:
            found = np.full(bins.shape[1], root, np.uint64)
            for f, mask in open_.items():
                found &= mask.take(bins[f])
            return nodes.take(np.bitwise_count(found - np.uint64(1)))

        return of


@dataclass
class Forest:
    """A trained model: rounds of one tree per output."""

    trees: list[list[Tree]]
    n_features: int
    n_classes: int
    boosted: bool
    start: float = 0.0

    @property
    def depth(self) -> int:
        return max(t.depth for round_ in self.trees for t in round_)

    @property
    def n_leaves(self) -> int:
        return sum(t.n_leaves for round_ in self.trees for t in round_)

    def margins(self, values: np.ndarray) -> np.ndarray:
        """rows x outputs: sums of leaf weights, or class shares of the leaf."""
        columns = np.ascontiguousarray(values.T)
        if not self.boosted:
            tree = self.trees[0][0]
            counts = np.array(tree.value, float)[tree.route(columns, tree.threshold)]
            return counts / counts.sum(axis=1, keepdims=True)
        cuts, n_bins = self._cuts()
        bins = np.zeros(columns.shape, np.int64)
        for f, own in enumerate(cuts):  # a value that is no number goes left everywhere
            bins[f] = np.where(np.isnan(columns[f]), 0, np.searchsorted(own, columns[f], side="left"))
        out = np.full((1 if self.n_classes == 2 else self.n_classes, len(values)), self.start)
        for round_ in self.trees:
            for k, tree in enumerate(round_):
                at = [int(np.searchsorted(cuts[f], t)) if f >= 0 else 0 for f, t in zip(tree.feature, tree.threshold)]
                out[k] += np.array(tree.value, float)[tree.place(bins, at, n_bins)]
        return np.ascontiguousarray(out.T)

    def _cuts(self) -> tuple[list[np.ndarray], int]:
        """The thresholds of each feature over all trees, ascending, and the most bins they make."""
        found: list[set[float]] = [set() for _ in range(self.n_features)]
        for tree in (t for round_ in self.trees for t in round_):
            for f, t in zip(tree.feature, tree.threshold):
                if f >= 0:
                    found[f].add(t)
        return [np.array(sorted(own), float) for own in found], max(map(len, found), default=0) + 1

    def scores(self, values: np.ndarray) -> np.ndarray:
        """rows x classes, adding up to 1."""
        margins = self.margins(values)
        return probabilities(margins, self.n_classes) if self.boosted else margins

    def importance(self) -> list[float]:
        """Share of each feature: all Gini decrease of a tree, mean gain of a split in boosting."""
        total, splits = np.zeros(self.n_features), np.zeros(self.n_features)
        for tree in (t for round_ in self.trees for t in round_):
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += g
                    splits[f] += 1
        own = total / np.maximum(splits, 1) if self.boosted else total
        return (own / own.sum()).tolist() if own.sum() > 0 else own.tolist()

    def score_column(self, features: str) -> Column:
        """Class scores of a vector column."""
        forest = self

        @F.arrow_udf("array<double>")
        def of(vectors: pa.Array) -> pa.Array:
            scores = forest.scores(vectors.flatten().to_numpy().reshape(len(vectors), forest.n_features))
            ends = np.arange(len(vectors) + 1, dtype=np.int32) * scores.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(scores.ravel()))

        return of(vector_to_array(features))


def probabilities(margins: np.ndarray, n_classes: int) -> np.ndarray:
    if n_classes == 2:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.column_stack([1 - p, p])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# --- bins and blocks ------------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, n_features: int, max_bins: int) -> list[np.ndarray]:
    """Cuts of each feature: midpoints between its distinct values, or between quantiles where these are too many."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * n_features
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(-1, n_features)
            for f in range(n_features):
                if len(seen[f]) <= max_bins:  # one value too many says enough
                    seen[f] = np.union1d(seen[f], values[:, f])[: max_bins + 1]
        columns = [pa.array(np.repeat(np.arange(n_features), [len(s) for s in seen]), pa.int32()), pa.array(np.concatenate(seen))]
        yield pa.RecordBatch.from_arrays(columns, names=["f", "v"])

    arrays = rows.select(vector_to_array("features").alias("x"))
    found: list[list[float]] = [[] for _ in range(n_features)]
    for r in arrays.mapInArrow(distinct, "f int, v double").distinct().collect():
        found[r.f].append(r.v)
    wide = [f for f in range(n_features) if len(found[f]) > max_bins]
    if wide:
        shares = F.array(*[F.lit(i / max_bins) for i in range(max_bins + 1)])
        row = arrays.agg(*[F.percentile_approx(F.col("x")[f], shares, F.lit(40 * max_bins)).alias(f"q{f}") for f in wide]).first()
        for f in wide:
            found[f] = row[f"q{f}"]
    points = [np.unique(np.array(v, float)) for v in found]
    return [(p[:-1] + p[1:]) / 2 if f not in wide else p[:-1] for f, p in enumerate(points)]


#: (number, bins: features x rows, label), and in boosting the margin: rows x outputs, an output after the other.
Block = tuple


def blocks_of(rows: DataFrame, edges: list[np.ndarray], outputs: int | None = None) -> RDD:
    """The rows (features vector, label) as cached blocks of bin numbers, written once to the checkpoint folder.

    With the ``outputs`` of boosting, which takes hundreds of levels, tables of up to LONE_TIMES x TASK_CELLS go to one task.
    """
    kind = np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().reshape(len(batch), -1)
            bins = np.array([np.searchsorted(e, values[:, f], side="left") for f, e in enumerate(edges)], kind).reshape(len(edges), len(batch))
            label = batch.column(1).to_numpy().astype(np.int32)
            columns = [pa.array([len(batch)], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "bins", "label"])

    ensure_checkpoint_dir(rows.sparkSession)
    count = rows.count()
    packed = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double")).mapInArrow(pack, "n int, bins binary, label binary")
    cells = count * max(1, len(edges))
    tasks = -(-cells // TASK_CELLS)
    if outputs is not None and cells * outputs <= LONE_TIMES * TASK_CELLS:
        tasks = 1
    if tasks > 1:  # their sums still go to the driver directly
        tasks = max(tasks, min(DIRECT_TASKS, -(-cells // JOB_CELLS)))
    tasks = max(1, min(packed.rdd.getNumPartitions(), tasks))
    blocks = packed.where("n > 0").rdd.coalesce(tasks)

    def unpack(part: int, own: Iterator) -> Iterator[Block]:
        for i, r in enumerate(own):
            bins = np.frombuffer(bytes(r.bins), kind).reshape(len(edges), r.n)
            yield (part << 24) + i, bins, np.frombuffer(bytes(r.label), np.int32)

    made = blocks.mapPartitionsWithIndex(unpack)
    made.persist(StorageLevel.MEMORY_AND_DISK)
    made.checkpoint()
    return made


def added(blocks: Iterable[Block], histogram, length: int) -> np.ndarray:
    """Sum of ``histogram(block)`` over blocks that are seen one at a time."""
    total = np.zeros(length)
    for block in blocks:
        total += histogram(block)
    return total


class InTask:
    """Sums over the blocks of the only partition, inside its task."""

    def __init__(self, blocks: Iterator[Block]):
        self.blocks = list(blocks)

    def sum(self, histogram, length: int) -> np.ndarray:
        return added(self.blocks, histogram, length)

    def map(self, change) -> None:
        self.blocks = [change(b) for b in self.blocks]

    def keeps(self, numbers: int) -> bool:
        """Whether there is room for so many numbers a row between two sums."""
        return numbers * sum(len(b[2]) for b in self.blocks) <= TASK_CELLS

    def close(self) -> None:
        self.blocks = []


class InJobs:
    """Sums over the blocks of all tasks: one job each. Changed blocks are cached, and checkpointed now and then."""

    def __init__(self, blocks: RDD):
        self.blocks, self.before, self.changes = blocks, None, 0

    def sum(self, histogram, length: int) -> np.ndarray:
        """Sum of ``histogram(block)``, a flat array of ``length`` numbers; cells of nothing aren't sent."""

        def of_task(own: Iterator[Block]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            total = added(own, histogram, length)  # the blocks of a task grow with the table, so they aren't gathered
            at = np.flatnonzero(total)
            yield at.astype(np.int32 if length < 1 << 31 else np.int64), total[at]

        def both(a: tuple, b: tuple) -> tuple:
            at, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
            return at, np.bincount(place, weights=np.concatenate([a[1], b[1]]), minlength=len(at))

        sums = self.blocks.mapPartitions(of_task)
        parts = sums.collect() if sums.getNumPartitions() <= DIRECT_TASKS else [sums.treeReduce(both)]
        out = np.zeros(length)
        for at, values in parts:
            out[at] += values
        return out

    def map(self, change) -> None:
        """The blocks after ``change``, made by the next sum; those before the last change are let go."""
        if self.before is not None:
            self.before.unpersist()
        self.before, self.blocks = self.blocks, self.blocks.map(change)
        self.blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.changes += 1
        if self.changes % CHECKPOINT_ROUNDS == 0:
            self.blocks.checkpoint()

    def keeps(self, numbers: int) -> bool:
        return False  # each sum is a job of its own

    def close(self) -> None:
        for blocks in (self.before, self.blocks):
            if blocks is not None:
                blocks.unpersist()


def grown(blocks: RDD, grow):
    """``grow(sums)`` where the blocks are: by jobs over all partitions, or in the task of the only one."""
    if blocks.getNumPartitions() == 1:
        found = blocks.mapPartitions(lambda own: [grow(InTask(own))]).collect()[0]
        blocks.unpersist()
        return found
    sums = InJobs(blocks)
    found = grow(sums)
    sums.close()
    blocks.unpersist()
    return found


# --- one level ------------------------------------------------------------------------------------------------


def _cells(bins: np.ndarray, slot: np.ndarray, slots: int, n_bins: int, channels: list[np.ndarray]) -> np.ndarray:
    """(slots, features, bins, channels) sums of the rows whose slot is below ``slots``; ``channels`` has a weight per row each."""
    out = np.empty((slots, len(bins), n_bins, len(channels)))
    first = slot * n_bins
    for f, own in enumerate(bins):
        key = first + own
        for c, weight in enumerate(channels):
            out[:, f, :, c] = np.bincount(key, weights=weight, minlength=slots * n_bins)[: slots * n_bins].reshape(slots, n_bins)
    return out


def _groups(nodes: list, numbers: int) -> list[list]:
    """Nodes in groups whose histograms have a bounded size."""
    size = max(1, MOST_NUMBERS // max(1, numbers))
    return [nodes[i : i + size] for i in range(0, len(nodes), size)]


def _slots(tree: Tree, nodes: list[int], bins: np.ndarray, n_bins: int) -> np.ndarray:
    """Place in ``nodes`` of each row's node, below 0 for rows elsewhere."""
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))
    return place[tree.place(bins, tree.bin, n_bins)]


# --- classification tree --------------------------------------------------------------------------------------


def gini_splits(cells: np.ndarray, min_split: int, min_leaf: int) -> list[tuple | None]:
    """Per node: (decrease of rows x Gini, feature, bin, left counts, right counts), or None where no split is legal."""
    below = cells.cumsum(axis=2)
    total = below[:, :1, -1:, :]
    above = total - below
    left, right = below.sum(axis=3), above.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (below * below).sum(axis=3) / left + (above * above).sum(axis=3) / right
    legal = (left >= max(1, min_leaf)) & (right >= max(1, min_leaf))
    found: list[tuple | None] = []
    for node in range(len(cells)):
        counts = total[node, 0, 0]
        rows = counts.sum()
        if rows < min_split or (counts > 0).sum() < 2 or not legal[node].any():
            found.append(None)
            continue
        decrease = np.where(legal[node], purity[node] - (counts * counts).sum() / rows, -np.inf)
        f, b = np.unravel_index(np.argmax(np.round(decrease, 9)), decrease.shape)
        # like other growers of such trees, a split that gains nothing by itself is taken too
        found.append((max(decrease[f, b], 0.0), int(f), int(b), below[node, f, b], above[node, f, b]) if decrease[f, b] > -ROUNDING * rows else None)
    return found


def fit_tree(rows: DataFrame, n_features: int, n_classes: int, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1, max_bins: int = 256) -> Forest:
    """Gini tree of ``rows`` (features, label). A node with fewer rows than ``min_samples_split`` stays a leaf."""
    edges = bin_edges(rows, n_features, max_bins)
    blocks = blocks_of(rows, edges)
    n_bins = max(map(len, edges), default=0) + 1

    def grow(sums) -> Tree:
        tree = Tree()
        root = sums.sum(lambda b: np.bincount(b[2], minlength=n_classes).astype(float), n_classes)
        frontier = [tree.add(root.tolist(), 0)]
        while frontier and (max_depth is None or tree.level[frontier[0]] < max_depth):
            able = [v for v in frontier if sum(tree.value[v]) >= max(2, min_samples_split) and sum(c > 0 for c in tree.value[v]) > 1]
            found: list[tuple | None] = []
            for nodes in _groups(able, n_features * n_bins * n_classes):

                def counts(block: Block, nodes=nodes) -> np.ndarray:
                    slot = _slots(tree, nodes, block[1], n_bins)
                    own = slot >= 0
                    key, bins, label = slot[own] * n_bins, block[1][:, own], block[2][own]
                    out = np.empty((len(nodes), n_features, n_bins, n_classes))
                    for f in range(n_features):
                        out[:, f] = np.bincount((key + bins[f]) * n_classes + label, minlength=len(nodes) * n_bins * n_classes).reshape(len(nodes), n_bins, n_classes)
                    return out.ravel()

                shape = (len(nodes), n_features, n_bins, n_classes)
                found += gini_splits(sums.sum(counts, int(np.prod(shape))).reshape(shape), min_samples_split, min_samples_leaf)
            frontier = []
            for v, split in zip(able, found):
                if split is not None:
                    decrease, f, b, left, right = split
                    tree.feature[v], tree.bin[v], tree.threshold[v], tree.gain[v] = f, b, float(edges[f][b]), float(decrease)
                    tree.left[v] = tree.add(left.tolist(), tree.level[v] + 1)
                    tree.add(right.tolist(), tree.level[v] + 1)
                    frontier += [tree.left[v], tree.left[v] + 1]
        return tree

    return Forest([[grown(blocks, grow)]], n_features, n_classes, boosted=False)


# --- second-order boosting ------------------------------------------------------------------------------------


def gradients(label: np.ndarray, margin: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log loss: rows x outputs."""
    if n_classes == 2:
        p = 1 / (1 + np.exp(-margin))
        return p - (label == 1)[:, None], np.maximum(p * (1 - p), 1e-16)
    p = probabilities(margin, n_classes)
    hit = np.zeros_like(p)
    hit[np.arange(len(hit)), label] = 1
    return p - hit, np.maximum(2 * p * (1 - p), 1e-16)


def loss_splits(cells: np.ndarray, l2: float, min_child_weight: float, features: np.ndarray) -> list[tuple | None]:
    """Per node: (gain, feature, bin, left (G, H), right (G, H)) by the second-order loss, or None."""
    below = cells.cumsum(axis=2)
    total = below[:, :1, -1:, :]
    above = total - below
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    gain = score(below) + score(above) - score(total)
    legal = (below[..., 1] >= min_child_weight) & (above[..., 1] >= min_child_weight) & (below[..., 1] > 0) & (above[..., 1] > 1e-12)
    legal &= features[None, :, None]
    gain = np.where(legal, gain, -np.inf)
    found: list[tuple | None] = []
    for node in range(len(cells)):
        f, b = np.unravel_index(np.argmax(gain[node]), gain[node].shape)
        found.append((gain[node, f, b], int(f), int(b), below[node, f, b], above[node, f, b]) if gain[node, f, b] > LEAST_LOSS_GAIN else None)
    return found


def fit_boosting(
    rows: DataFrame, n_features: int, n_classes: int, n_estimators: int = 100, max_depth: int = 6, learning_rate: float = 0.3, subsample: float = 1.0,
    colsample_bytree: float = 1.0, max_bins: int = 256, l2: float = 1.0, min_child_weight: float = 1.0, seed: int = 42,
) -> Forest:
    """Boosted trees on ``rows`` (features, label): logistic loss for two classes, softmax with one tree per class for more.

    Two classes start at the margin of one Newton step from zero, more at zero. A leaf weighs
    -G / (H + l2) times the learning rate. Rows of ``subsample`` are drawn anew each round by block
    and place, features of ``colsample_bytree`` for each tree.
    """
    edges = bin_edges(rows, n_features, max_bins)
    n_bins = max(map(len, edges), default=0) + 1
    outputs = 1 if n_classes == 2 else n_classes
    blocks = blocks_of(rows, edges, outputs)

    def grow(sums) -> tuple[float, list[list[Tree]]]:
        start = 0.0
        if n_classes == 2:
            ones, count = sums.sum(lambda b: np.array([b[2].sum(), len(b[2])], float), 2)
            start = float(4 * (ones / count - 0.5))
        sums.map(lambda b: (*b[:3], np.full((len(b[2]), outputs), start, order="F")))
        draw = np.random.default_rng(seed)
        rounds: list[list[Tree]] = []
        for number in range(n_estimators):
            trees = [Tree() for _ in range(outputs)]
            picked = np.zeros((outputs, n_features), bool)
            for k in range(outputs):
                picked[k, draw.permutation(n_features)[: max(1, int(np.ceil(colsample_bytree * n_features)))]] = True
            frontier = [(k, tree.add(0.0, 0)) for k, tree in enumerate(trees)]
            known: dict | None = {} if sums.keeps(outputs) else None
            for level in range(max_depth):
                found: list[tuple | None] = []
                totals: list[np.ndarray] = []
                for nodes in _groups(frontier, n_features * n_bins * 2):
                    shape = (len(nodes), n_features, n_bins, 2)
                    loss = _loss_histogram(nodes, shape, trees, number, n_classes, subsample, seed, known)
                    cells = sums.sum(loss, int(np.prod(shape))).reshape(shape)
                    done = 0
                    for k, same in groupby(nodes, lambda node: node[0]):
                        own = len(list(same))
                        found += loss_splits(cells[done : done + own], l2, min_child_weight, picked[k])
                        done += own
                    totals += list(cells[:, 0].sum(axis=1))
                after = []
                for (k, v), split, (g, h) in zip(frontier, found, totals):
                    tree = trees[k]
                    if level == 0:
                        tree.value[v] = float(-g / (h + l2) * learning_rate)
                    if split is None:
                        continue
                    gain, f, b, left, right = split
                    tree.feature[v], tree.bin[v], tree.threshold[v], tree.gain[v] = f, b, float(edges[f][b]), float(gain)
                    tree.left[v] = tree.add(float(-left[0] / (left[1] + l2) * learning_rate), level + 1)
                    tree.add(float(-right[0] / (right[1] + l2) * learning_rate), level + 1)
                    after += [(k, tree.left[v]), (k, tree.left[v] + 1)]
                frontier = after
                if not frontier:
                    break
            rounds.append(trees)
            sums.map(_moved(trees, n_bins))
        return start, rounds

    start, rounds = grown(blocks, grow)
    return Forest(rounds, n_features, n_classes, boosted=True, start=start)


def _loss_histogram(
    nodes: list[tuple[int, int]], shape: tuple, trees: list[Tree], number: int, n_classes: int, subsample: float, seed: int, known: dict | None
):
    """Gradients and Hessians per (tree, node), feature and bin of a block.

    ``known`` has those of the rows of each block, once found in this round; without it they are found anew.
    """
    groups = {k: [i for i, (other, _) in enumerate(nodes) if other == k] for k in sorted({k for k, _ in nodes})}
    placing: dict[int, tuple[Callable, np.ndarray]] = {}

    def slots(k: int, bins: np.ndarray) -> np.ndarray:
        """Place of each row's node among those of tree ``k``, or their number."""
        if k not in placing:  # made by the task, for all its blocks
            own = np.full(len(trees[k].feature), len(groups[k]))
            own[[nodes[i][1] for i in groups[k]]] = np.arange(len(groups[k]))
            placing[k] = trees[k].placing(trees[k].bin, shape[2]), own
        node, own = placing[k]
        return own.take(node(bins))

    def loss(block: Block) -> np.ndarray:
        part, bins, label, margin = block
        gradient, hessian = known[part] if known and part in known else gradients(label, margin, n_classes)
        if known is not None:
            known[part] = gradient, hessian
        drawn = np.random.default_rng((seed, number, part)).random(len(label)) < subsample if subsample < 1 else None
        out = np.zeros(shape) if len(groups) > 1 else None
        for k, at in groups.items():
            slot = slots(k, bins)
            if drawn is not None:
                slot = np.where(drawn, slot, len(at))
            own = slot < len(at)
            if 2 * np.count_nonzero(own) > len(own):  # the others are counted beside
                cells = _cells(bins, slot, len(at), shape[2], [gradient[:, k], hessian[:, k]])
            else:
                cells = _cells(bins[:, own], slot[own], len(at), shape[2], [gradient[own, k], hessian[own, k]])
            if out is None:
                return cells.ravel()
            out[at] = cells
        return out.ravel()

    return loss


def _moved(trees: list[Tree], n_bins: int):
    """Adds the leaf weights of a round to the margins of a block."""

    def move(block: Block) -> Block:
        part, bins, label, margin = block
        return part, bins, label, margin + np.stack([np.array(t.value, float)[t.place(bins, t.bin, n_bins)] for t in trees]).T

    return move
