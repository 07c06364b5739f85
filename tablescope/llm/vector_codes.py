"""Product codes of vectors: a codebook per part position, fitted by dual-tree Lloyd rounds over all rows.

A vector of integers is cut into equal consecutive parts. Each task takes its rows in blocks and lays two
trees for every part position: one over the block's parts (halved at the median of their widest dimension,
with box, sums and counts of every node), one over the entries of the codebook. Both trees are walked level
by level, all pairs of a level at once: a pair goes if the least distance between its boxes is above the
greatest distance to some other entry node, and single entries also go if another is nearer at every corner
of the box; a node of parts that is left with a single entry is assigned whole, by its cached sums and
counts; the parts of leaves that keep several entries compare their integer distances. Every quantity is a
64-bit integer, so results are exact and don't depend on blocks.

A round returns sums and counts per part position and entry, added up by Spark; only codebooks, positions x
entries x width numbers, pass through the driver. Rows are never grouped by key; sums of labels are
pre-aggregated, and a label with most rows is joined by broadcast, or salted where labels are many.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped;
where lengths differ, or are no multiple of the number of parts, the missing components are 0. Components
beyond 2 ** 26 in size after scaling count as that size. Keys may be null (last in order) or repeated (in
order of their vectors); with fewer rows than entries there are fewer entries. Sums beyond 64 bits are
null. An empty table gives no rows. More columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import map_arrow, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Size at which scaled components stop; distances and their sums over a block stay below 2 ** 63.
MOST_COMPONENT = 1 << 26
#: Vectors of a block, components of a block (the lower bound counts), and parts of a leaf.
BLOCK, BLOCK_COMPONENTS, LEAF = 65_536, 1 << 22, 8
#: Labels whose sums are broadcast, and copies of each beyond.
MOST_LABELS, LABEL_COPIES = 100_000, 32


# --- the two trees of a block ---------------------------------------------------------------------------------


class Tree:
    """Points of several positions (positions, points, width) in the order of a balanced tree, level by level.

    All positions have the same shape: a node of level l is ``(position, index)`` numbered position * 2**l +
    index, its children on the next level are 2 * node and 2 * node + 1. Padding points repeat a real one
    and weigh nothing.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        positions, count, width = points.shape
        self.levels = max(0, int(np.ceil(np.log2(max(1, -(-count // leaf))))))
        size = -(-count // (1 << self.levels))
        padded = np.minimum(np.arange(size << self.levels), count - 1)
        order = np.broadcast_to(padded, (positions, len(padded)))
        # the real occurrence of the last point is the first one
        number = np.broadcast_to(np.arange(len(padded)), order.shape)
        for level in range(self.levels):
            nodes = positions << level
            own = order.reshape(nodes, -1)
            cell = np.take_along_axis(points, order[:, :, None], axis=1).reshape(nodes, own.shape[1], width)
            widest = (cell.max(axis=1) - cell.min(axis=1)).argmax(axis=1)
            values = np.take_along_axis(cell, widest[:, None, None], axis=2)[:, :, 0]
            sort = values.argsort(axis=1, kind="stable")
            order = np.take_along_axis(own, sort, axis=1).reshape(positions, -1)
            number = np.take_along_axis(number.reshape(own.shape), sort, axis=1).reshape(positions, -1)
        self.order = order  # (positions, padded points): place in ``points``
        self.real = number < count
        self.points = np.take_along_axis(points, order[:, :, None], axis=1)
        self.size = self.points.shape[1] >> self.levels
        shape = (positions << self.levels, self.size, width)
        cells, real = self.points.reshape(shape), self.real.reshape(shape[:2])
        low, high = cells.min(axis=1), cells.max(axis=1)
        total, number = (cells * real[:, :, None]).sum(axis=1), real.sum(axis=1)
        self.low, self.high, self.sums, self.counts = [low], [high], [total], [number]
        for _ in range(self.levels):
            pair = lambda a: a.reshape(-1, 2, *a.shape[1:])
            low, high, total, number = pair(low).min(axis=1), pair(high).max(axis=1), pair(total).sum(axis=1), pair(number).sum(axis=1)
            self.low.insert(0, low), self.high.insert(0, high), self.sums.insert(0, total), self.counts.insert(0, number)


def bounds(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of two boxes, pair by pair."""
    gap = np.maximum(np.maximum(other_low - high, low - other_high), 0)
    reach = np.maximum(other_high - low, high - other_low)
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


class Assignment:
    """Nearest entry of every part of a block, ties to the lower index; whole nodes where one entry is left."""

    def __init__(self, parts: np.ndarray, codebooks: np.ndarray):
        """``parts``: (rows, positions, width); ``codebooks``: (positions, entries, width)."""
        self.tree = tree = Tree(np.ascontiguousarray(parts.transpose(1, 0, 2)), LEAF)
        entries = Tree(codebooks, 1)
        self.positions, self.entries = codebooks.shape[:2]
        # pairs of one level of both trees; where one tree ends before the other it stays at its last level
        node, entry = np.arange(self.positions), np.arange(self.positions)
        self.whole: list[tuple[int, np.ndarray, np.ndarray]] = []  # level, nodes, entry index
        level = depth = 0
        while True:
            least, most = bounds(tree.low[level][node], tree.high[level][node], entries.low[depth][entry], entries.high[depth][entry])
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            runs = np.diff(np.r_[starts, len(node)])
            limit = np.repeat(np.minimum.reduceat(most, starts), runs)
            kept = least <= limit
            node, entry = node[kept], entry[kept]
            if depth == entries.levels:
                kept = self._undominated(entries, level, node, entry)
                node, entry = node[kept], entry[kept]
                first = np.r_[True, node[1:] != node[:-1]]
                single = first & np.r_[first[1:], True]
                self.whole.append((level, node[single], self._index(entries, entry[single])))
                node, entry = node[~single], entry[~single]
            if not len(node) or (level == tree.levels and depth == entries.levels):
                break
            if depth < entries.levels:
                depth += 1
                node, entry = np.repeat(node, 2), np.repeat(entry * 2, 2) + np.tile([0, 1], len(entry))
            if level < tree.levels:
                level += 1
                # both children of a node with all its entries; pairs stay sorted by node
                order = np.argsort(np.r_[node * 2, node * 2 + 1], kind="stable")
                node, entry = np.r_[node * 2, node * 2 + 1][order], np.r_[entry, entry][order]
        self._leaves(entries, node, entry)

    def _undominated(self, entries: Tree, level: int, node: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Pairs whose entry may be nearest somewhere in the node's box, seen from the entry nearest to its centre.

        The difference of two entries' distances is linear in the point, so its greatest value over the box
        is taken corner by corner, dimension by dimension.
        """
        low, high = self.tree.low[level][node], self.tree.high[level][node]
        own, index = entries.low[-1][entry], self._index(entries, entry)
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        runs = np.diff(np.r_[starts, len(node)])
        gap = 2 * own - low - high
        near = (gap * gap).sum(axis=1)
        order = np.lexsort((index, near, node))
        best = np.repeat(order[starts], runs)  # the first of each node in this order
        chosen = own[best]
        # |x - chosen|^2 - |x - own|^2 = 2 x (own - chosen) + |chosen|^2 - |own|^2
        slope = 2 * (own - chosen)
        most = np.maximum(slope * low, slope * high).sum(axis=1) + (chosen * chosen - own * own).sum(axis=1)
        return ~((most < 0) | ((most == 0) & (index[best] < index)))

    def _index(self, entries: Tree, nodes: np.ndarray) -> np.ndarray:
        """Index of the entry that a last-level node of the entry tree holds."""
        return entries.order.reshape(-1)[nodes]

    def _leaves(self, entries: Tree, node: np.ndarray, entry: np.ndarray) -> None:
        self.leaves = np.unique(node)
        size, width = self.tree.size, self.tree.points.shape[2]
        if not len(node):
            self.nearest = np.empty((0, size), np.int64)
            return
        # by leaf, then by index: the first of equal distances is the lowest index
        index = self._index(entries, entry)
        order = np.lexsort((index, node))
        node, index = node[order], index[order]
        points = self.tree.points.reshape(-1, size, width)
        own = entries.points.reshape(self.positions, -1, width)
        place = np.empty_like(entries.order)
        np.put_along_axis(place, entries.order, np.broadcast_to(np.arange(entries.order.shape[1]), place.shape), axis=1)
        position = node >> self.tree.levels
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        best = np.empty((len(starts), size), np.int64)
        # a few leaves at a time, so that memory stays bounded
        step = max(1, (1 << 18) // size)
        ends = np.r_[starts[1:], len(node)]
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, side="right")))
            low, high = starts[at], ends[to - 1]
            gap = points[node[low:high]] - own[position[low:high], place[position[low:high], index[low:high]]][:, None, :]
            distance = (gap * gap).sum(axis=2)
            runs = starts[at:to] - low
            least = np.minimum.reduceat(distance, runs, axis=0)
            hit = distance == np.repeat(least, np.diff(np.r_[runs, high - low]), axis=0)
            candidate = np.where(hit, index[low:high, None], self.entries)
            best[at:to] = np.minimum.reduceat(candidate, runs, axis=0)
            at = to
        self.nearest = best

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums (positions, entries, width) and counts (positions, entries) of the assigned parts."""
        tree, width = self.tree, self.tree.points.shape[2]
        total, number = np.zeros((self.positions * self.entries, width), np.int64), np.zeros(self.positions * self.entries, np.int64)
        for level, nodes, index in self.whole:
            target = (nodes >> level) * self.entries + index
            np.add.at(total, target, tree.sums[level][nodes])
            np.add.at(number, target, tree.counts[level][nodes])
        if len(self.leaves):
            real = tree.real.reshape(-1, tree.size)[self.leaves]
            target = ((self.leaves >> tree.levels) * self.entries)[:, None] + self.nearest
            np.add.at(total, target[real], tree.points.reshape(-1, tree.size, width)[self.leaves][real])
            np.add.at(number, target[real], 1)
        return total.reshape(self.positions, self.entries, width), number.reshape(self.positions, self.entries)

    def codes(self, rows: int) -> np.ndarray:
        """(rows, positions): the entry of every part."""
        tree = self.tree
        flat = np.empty((self.positions << tree.levels, tree.size), np.int64)
        for level, nodes, index in self.whole:
            flat.reshape(self.positions << level, -1)[nodes] = index[:, None]
        flat[self.leaves] = self.nearest
        out = np.empty((self.positions, rows), np.int64)
        np.put_along_axis(out, tree.order, flat.reshape(self.positions, -1), axis=1)
        return out.T


# --- passes over all rows -------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def integer_rows(vectors: DataFrame, key: str, vector: str, label: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(key, label, x) of every usable row, and the number of entries of each x, a multiple of ``parts``."""
    own = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    limit = float(MOST_COMPONENT)
    integer = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(limit)), F.lit(-limit))).cast("long")
    own = own.where(usable(F.col("vector"))).select("key", "label", F.transform("vector", integer).alias("x"))
    longest = own.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // parts) * parts
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    return own.select("key", "label", F.when(F.size("x") < width, F.concat("x", missing)).otherwise(F.col("x")).alias("x")), width


def blocks_of(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in blocks and their parts (rows, positions, width); larger blocks have smaller boxes."""

    def block(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        flat = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return rows, flat.reshape(len(rows), parts, -1)

    held, count = [], 0
    for batch in batches:
        low = 0
        while low < len(batch):
            most = max(1, min(BLOCK, BLOCK_COMPONENTS // max(1, len(batch.column("x")[low]))))
            if count >= most:
                yield block(pa.Table.from_batches(held))
                held, count = [], 0
            held.append(batch.slice(low, most - count))
            low, count = low + len(held[-1]), count + len(held[-1])
    if held:
        yield block(pa.Table.from_batches(held))


def summed(codebooks: np.ndarray):
    """Sums and counts of a task: one row per position and entry that has parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for _, parts in blocks_of(batches, len(codebooks)):
            for p in range(len(codebooks)):
                sums, counts = Assignment(parts[:, p : p + 1], codebooks[p : p + 1]).sums()
                total[p] += sums[0]
                number[p] += counts[0]
        position, entry = np.nonzero(number)
        columns = [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(number[position, entry]), pa.array(list(total[position, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "count", "sums"])

    return run


def lloyd_round(own: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of means, unused entries as they were."""
    width = codebooks.shape[2]
    found = map_arrow(own.select("x"), summed(codebooks), "position int, entry int, count bigint, sums array<bigint>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    after = codebooks.copy()
    for r in found.groupBy("position", "entry").agg(F.sum("count").alias("count"), *sums).collect():
        after[r.position, r.entry] = [int(r[f"s{i}"]) // r["count"] for i in range(width)]
    return after


def first_codebooks(own: DataFrame, entries: int, parts: int) -> np.ndarray:
    """(positions, entries, width): the parts of the rows of smallest keys."""
    rows = own.orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return np.ascontiguousarray(np.array([r.x for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2))


def coded(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(len(codebooks))[None, :]
        for rows, parts in blocks_of(batches, len(codebooks)):
            codes = np.hstack([Assignment(parts[:, p : p + 1], codebooks[p : p + 1]).codes(len(rows)) for p in range(len(codebooks))])
            gap = parts - codebooks[place, codes]
            error = (gap * gap).sum(axis=(1, 2))
            digits = codes.astype(np.uint8).tobytes().hex()
            text = [digits[i : i + 2 * len(codebooks)] for i in range(0, len(digits), 2 * len(codebooks))]
            out = pa.Table.from_arrays([rows.column("key"), rows.column("label"), pa.array(text), pa.array(error)], names=["key", "label", "code", "error"])
            yield from out.combine_chunks().to_batches()

    return run


def fit_codebooks(own: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    codebooks = first_codebooks(own, entries, parts)
    for _ in range(rounds):
        codebooks = lloyd_round(own, codebooks)
    return codebooks


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with the error summed over equal labels, nulls together."""
    sums = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of_label"), "label_error")
    if sums.count() <= MOST_LABELS:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
    # each label's sum in some copies, so that the rows of a common label are dealt to as many tasks
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_COPIES - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(LABEL_COPIES)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))).drop("of_label", "salt", "of_salt")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error, label_error) of every usable row, and the codebooks (positions, entries, width)."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    own, width = integer_rows(vectors, key, vector, label, parts, scale)
    own = materialize(own, "vector-parts")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = f"key {kinds['key']}, label {kinds['label']}, code string, error bigint"
    if width == 0:
        return with_label_error(own.sparkSession.createDataFrame([], schema)), np.zeros((parts, 0, 0), np.int64)
    codebooks = fit_codebooks(own, parts, entries, rounds)
    return with_label_error(materialize(map_arrow(own, coded(codebooks), schema), "vector-codes")), codebooks


def decode(codes: DataFrame, codebooks: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector that each code stands for, scaled back: column ``decoded``."""
    width = codebooks.shape[2]
    entry = lambda p: F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in codebooks[p] / scale])
    at = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.concat(*[entry(p)[at(p)] for p in range(len(codebooks))]) if width else F.lit(None).cast("array<double>"))


def codebooks_text(codebooks: np.ndarray) -> str:
    """All integers by part, entry, and position within the part, joined by commas."""
    return ",".join(map(str, codebooks.reshape(-1).tolist()))
