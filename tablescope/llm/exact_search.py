"""Exact top-k search by inner product with multi-resolution segment statistics.

Components are turned into integers. Vectors are turned onto the principal axes of all rows (their second
moments are one distributed sum), which keeps every inner product and brings what vectors share to the
front. A turned vector is cut into 1, 2, 4, ... segments of about equal moments, down to single components,
and of each segment the mean and the deviation are kept. For two vectors with means m, m' and deviations s, s' over a segment
of length L the inner product over it is at most L * (m * m' + s * s') (Cauchy-Schwarz on the centred
parts); on distances this is the familiar lower bound L * ((m - m')^2 + (s - s')^2).

A first pass scores every query against one block of vectors; its k-th best score there can only be below
the true one, and goes to all blocks as the query's threshold. In each block a query's candidates go
through the levels from coarse to fine: those whose bound is below the threshold are dropped, the next
level looks at the survivors only, and the survivors of the last level are scored exactly in integers.
Bounds are widened by the rounding of doubles and bounds equal to the threshold survive, so ties are
settled exactly, by the smaller key.

Vectors and queries are packed into blocks; every query block meets every vector block, one pair at a
time. Both are tables that the tasks of a product of partitions read, so no pair is shuffled, nothing goes
through the driver, and a task holds a few blocks. Each pair returns the queries' k best of the block; a
task raises a query's threshold to the k-th best score it has seen. The k best of all are the answer.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows with a null key; components beyond 2 ** 26 in size after scaling count as that size, so that no
score leaves 64 bits; of rows that repeat a key the smallest vector counts; where lengths differ the
missing components are 0; fewer than k candidates give fewer rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.shared import map_arrow, materialize
from tablescope.llm.whitening import products_of

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Vectors of a block.
BLOCK = 4096
#: Queries that go through the levels together.
QUERY_STEP = 256
#: Most files of a table of blocks; each holds a block, or a few.
MOST_FILES = 10_000
#: Size at which scaled components stop.
MOST_COMPONENT = 1 << 26
#: Above this share of survivors a level is one matrix product for all queries; below, it is taken for the survivors alone.
DENSE = 0.25


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, values): one row per key, components floor(scale * x) as long."""
    own = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    own = own.where(F.col("key").isNotNull() & usable(F.col("vector")))
    limit = F.lit(float(MOST_COMPONENT))
    values = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * scale, limit), -limit)).cast("long"))
    return own.select("key", values.alias("values")).groupBy("key").agg(F.min("values").alias("values"))


def statistics(matrix: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means * sqrt(length) and deviations * sqrt(length) of each row's segments, which begin at ``cuts``."""
    lengths = np.diff([*cuts, matrix.shape[1]])
    sums = np.add.reduceat(matrix, cuts, axis=1)
    squares = np.add.reduceat(matrix * matrix, cuts, axis=1)
    spread = np.sqrt(np.maximum(squares - sums * sums / lengths, 0))
    return sums / np.sqrt(lengths), spread


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def levels_of(moments: np.ndarray) -> list[np.ndarray]:
    """Beginnings of the segments from coarse to fine; ``moments`` of the axes are falling.

    The 1, 2, 4, ... segments of a level hold about equal shares of the moments, so the first axes soon stand
    alone and the weak ones stay together. At the last level every component is a segment.
    """
    width = len(moments)
    shares = np.cumsum(np.maximum(moments, 0) + 1e-12 * max(float(np.max(moments)), 1e-300))
    shares = shares / shares[-1]
    levels = []
    for i in range(width.bit_length() - 1):
        ends = np.searchsorted(shares, np.arange(1, 1 << i) / (1 << i)) + 1
        levels.append(np.unique([0, *ends[ends < width]]))
    return [*levels, np.arange(width)]


def principal_axes(own: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The second moments of all rows along their axes, largest first, and the axes as orthonormal rows."""
    filled = F.when(F.size("values") < width, F.concat("values", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("values")))).otherwise(F.col("values"))
    rows = map_arrow(own.select(filled.alias("x")), products_of(np.zeros(width, np.int64)), "i int, values array<double>")
    moments = np.zeros((width, width))
    for r in rows.select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r.i, r.i + r.j] = moments[r.i + r.j, r.i] = r.v
    values, axes = np.linalg.eigh(moments)
    return values[::-1], axes.T[::-1]


def survivors(
    queries: np.ndarray, vectors: np.ndarray, levels: list[np.ndarray], floors: np.ndarray, alive: np.ndarray, shares: list[float] | None = None
) -> np.ndarray:
    """Pairs of turned queries and vectors that no level drops; ``alive`` are those to begin with."""
    reach = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
    slack = floors[:, None] - 1e-9 * (reach + 1)
    for cuts in levels:
        own = [np.hstack(statistics(part, cuts)) for part in (queries, vectors)]
        if alive.mean() > DENSE:
            alive &= own[0] @ own[1].T >= slack
        else:
            for i in range(len(queries)):
                left = np.flatnonzero(alive[i])
                alive[i, left] = own[1][left] @ own[0][i] >= slack[i, left]
        if shares is not None:
            shares.append(float(alive.mean()))
        if not alive.any():
            break
    return alive


def best_of_block(
    query_keys: np.ndarray, queries: np.ndarray, floors: np.ndarray, keys: np.ndarray, vectors: np.ndarray, axes: np.ndarray,
    levels: list[np.ndarray], k: int, shares: list[float] | None = None,
) -> tuple[np.ndarray, ...]:
    """(query key, key, score) of each query's k best vectors of the block that reach its floor; the query itself is left out."""
    found: list[tuple[np.ndarray, ...]] = []
    turned = vectors @ axes.T
    for low in range(0, len(queries), QUERY_STEP):
        part, own = queries[low : low + QUERY_STEP], query_keys[low : low + QUERY_STEP]
        alive = survivors(part @ axes.T, turned, levels, floors[low : low + QUERY_STEP], own[:, None] != keys[None, :], shares)
        for i in range(len(part)):
            left = np.flatnonzero(alive[i])
            exact = vectors[left] @ part[i]
            order = np.lexsort((keys[left], -exact))[:k]
            found.append((np.full(len(order), own[i]), keys[left][order], exact[order]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def best_scores(best: np.ndarray, query: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """``best``, rising scores by query, with more scores of rising query numbers, at most as many for each."""
    new = np.full(best.shape, -np.inf)
    new[query, np.arange(len(query)) - np.searchsorted(query, query)] = scores
    return np.sort(np.hstack([best, new]), axis=1)[:, -best.shape[1] :]


def search_blocks(axes: np.ndarray, levels: list[np.ndarray], k: int):
    def rows_of(batch: pa.RecordBatch, keys: str, values: str, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = batch.column(values)[i].values
        cuts, flat = np.asarray(own.offsets), own.values.to_numpy(zero_copy_only=False)
        return batch.column(keys)[i].values.to_numpy(zero_copy_only=False), padded([flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])], len(axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}  # the k best scores so far of the queries of a block, by its first query
        for batch in batches:
            for i in range(len(batch)):
                query_keys, queries = rows_of(batch, "query_keys", "queries", i)
                keys, vectors = rows_of(batch, "keys", "vectors", i)
                floors = batch.column("floors")[i].values.to_numpy(zero_copy_only=False)
                best = seen.get(query_keys[0], np.full((len(query_keys), k), -np.inf))
                out = best_of_block(query_keys, queries, np.maximum(floors, best[:, 0]), keys, vectors, axes, levels, k)
                seen[query_keys[0]] = best_scores(best, np.searchsorted(query_keys, out[0]), out[2])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "key", "score"])

    return run


def packed(df: DataFrame, blocks: int, number: str) -> DataFrame:
    """Rows (key, values, floor) in blocks of near BLOCK rows; a hash decides the block. Dealt so that few share a file."""
    df = df.withColumn(number, F.pmod(F.xxhash64("key"), F.lit(blocks))).repartition(min(blocks, MOST_FILES), number)
    return df.groupBy(number).agg(F.sort_array(F.collect_list(F.struct("key", "values", "floor"))).alias("rows"))


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """Every query's k best: query_id, rank (from 1), key, score. Queries: keys divisible by ``query_every``."""
    own = materialize(integers(vectors, key, vector, scale), "vectors")
    count, width = own.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("values")), F.lit(1))).first()
    moments, axes = principal_axes(own, width)
    levels = levels_of(moments)
    blocks = max(1, -(-count // BLOCK))
    query_blocks = max(1, -(-count // (BLOCK * query_every)))
    nothing = F.lit(float("-inf"))
    data = packed(own.withColumn("floor", nothing), blocks, "block").select("block", F.col("rows.key").alias("keys"), F.col("rows.values").alias("vectors"))
    data = materialize(data, "vector-blocks")

    def meet(queries: DataFrame, last: int) -> DataFrame:
        """The query set, in blocks, against the vector blocks 0 to ``last``: one row per pair, met where both are read."""
        rows = packed(queries, query_blocks, "query_block").select(F.col("rows.key").alias("query_keys"), F.col("rows.values").alias("queries"), F.col("rows.floor").alias("floors"))
        # not broadcast, however small the compressed files are: blocks come many times larger out of them
        rows = materialize(rows, "query-blocks").hint("shuffle_replicate_nl")
        met = data.where(F.col("block") <= last).drop("block").crossJoin(rows).select("query_keys", "queries", "floors", "keys", "vectors")
        found = map_arrow(met, search_blocks(axes, levels, k), "query_id bigint, key bigint, score bigint")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = own.where(F.col("key") % query_every == 0).withColumn("floor", nothing)
    if blocks > 1:
        first = meet(queries, 0).where(F.col("rank") == k).select(F.col("query_id").alias("key"), F.col("score").cast("double").alias("own_floor"))
        queries = queries.join(first, "key", "left").withColumn("floor", F.coalesce("own_floor", "floor")).drop("own_floor")
        queries = materialize(queries, "query-floors")
    ranked = meet(queries, blocks - 1)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
