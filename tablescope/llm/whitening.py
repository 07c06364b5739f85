"""Whitening of embeddings by spectral divide and conquer on polar decompositions.

1. Entries become integers; counts and sums of every dimension are exact. A second pass centres each vector
   by the rounded mean and adds up the products of its entries as one matrix per batch of rows, each summed
   again by Spark entry by entry; the rest of the mean, below one half, is taken off the small matrix.
2. The covariance V is d x d and is split on the driver. For a shift s the polar factor of V - s I is its
   matrix sign U, found by dynamically weighted Halley steps with QR factorisations (QDWH); (U + I) / 2 is
   the projector on the eigenvectors above s. An orthonormal basis of its range and of the complement gives
   two smaller matrices, and each is split again until it is one component, or a multiple of the identity.
   Halves that hold none of the wanted components are left alone.
3. The whitening matrix, components x dimensions, goes to every task and is applied to each centred vector.
   Spark checks the result: the covariance of the whitened columns against the identity.

Only matrices of the dimension reach the driver, whatever the number of rows. Rows are never grouped, so
repeated rows, keys and null keys each keep their own row.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped; where
lengths differ the missing entries are 0. Entries beyond 2 ** 40 in size after scaling count as that size.
Components whose eigenvalue is at most 1e-12 of the trace can't be scaled to unit variance and are left
out, so one row, equal rows and an empty table return none. A deviation beyond 64 bits is null. Of equal
eigenvalues any basis may come, the same for all rows. More columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import map_arrow, materialize

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Size at which scaled entries stop.
MOST_ENTRY = 1 << 40
#: Widest vectors: the covariance of this many dimensions (two matrices of 128 MB) fits a driver.
MOST_DIMENSIONS = 4096
#: Rows of a block of products: with entries below 2 ** 20 each product sum stays exact in doubles.
BLOCK = 4096
NO_VARIANCE = 1e-12


# --- the small matrix: polar factor, projector, recursion -------------------------------------------------


def polar_sign(matrix: np.ndarray, most_steps: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, which is its matrix sign, by QDWH."""
    size = len(matrix)
    x = matrix / max(np.linalg.norm(matrix), np.finfo(float).tiny)
    # a lower bound of the smallest singular value; a bound that is too low only costs steps
    try:
        low = 1 / (np.sqrt(size) * np.abs(np.linalg.inv(x)).sum(axis=0).max())
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, np.finfo(float).eps), 1.0)
    for _ in range(most_steps):
        square = low * low
        root = (4 * (1 - square) / (square * square)) ** (1 / 3) if square < 1 else 0.0
        a = np.sqrt(1 + root) + 0.5 * np.sqrt(max(8 - 4 * root + 8 * (2 - square) / (square * np.sqrt(1 + root)), 0))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(size)]))
        after = (b / c) * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        after = (after + after.T) / 2
        change = np.linalg.norm(after - x)
        x, low = after, min(low * (a + b * square) / (1 + c * square), 1.0)
        if change <= 1e-15 * size or (1 - low < 1e-14 and change <= 1e-10):
            break
    return x


def split_space(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below a shift; both hold at least one vector."""
    size = len(matrix)
    diagonal = np.sort(np.diag(matrix))
    centre = np.trace(matrix) / size
    spread = max(np.linalg.norm(matrix - centre * np.eye(size)), np.finfo(float).tiny)
    # the median of the diagonal halves the matrix; the centre always lies strictly between the ends
    for shift in (np.median(diagonal), centre, centre + 1e-3 * spread, centre - 1e-3 * spread):
        projector = (polar_sign(matrix - shift * np.eye(size)) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size or np.linalg.norm(projector @ projector - projector) > 1e-8:
            continue
        # range of the projector: orthonormalised images of its largest columns, twice for full precision
        basis = np.linalg.qr(projector @ _range_start(projector, rank), mode="complete")[0]
        images = np.hstack([projector @ basis[:, :rank], basis[:, rank:] - projector @ basis[:, rank:]])
        basis = np.linalg.qr(images)[0]
        return basis[:, :rank], basis[:, rank:]
    raise ArithmeticError("no shift splits the matrix")


def _range_start(projector: np.ndarray, rank: int) -> np.ndarray:
    """Unit vectors whose images span the range, picked by a pivoted Gram-Schmidt on the columns."""
    rest, picked = projector.copy(), []
    for _ in range(rank):
        best = int(np.argmax((rest * rest).sum(axis=0)))
        picked.append(best)
        direction = rest[:, best] / np.linalg.norm(rest[:, best])
        rest -= np.outer(direction, direction @ rest)
    return np.eye(len(projector))[:, picked]


def components_of(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as rows."""
    size = len(covariance)
    scale = max(float(np.abs(covariance).max(initial=0.0)), np.finfo(float).tiny)
    found: list[tuple[float, np.ndarray]] = []
    spaces = [np.eye(size)]  # from the highest eigenvalues to the lowest
    while spaces and len(found) < wanted:
        basis = spaces.pop(0)
        inside = basis.T @ covariance @ basis
        inside = (inside + inside.T) / 2
        width = len(inside)
        if width == 1 or np.linalg.norm(inside - np.trace(inside) / width * np.eye(width)) <= 8 * width * np.finfo(float).eps * scale:
            order = np.argsort(-np.diag(inside), kind="stable")
            found += [(inside[i, i], basis[:, i]) for i in order]
            continue
        above, below = split_space(inside)
        spaces[:0] = [basis @ above, basis @ below]
    found = sorted(found, key=lambda f: -f[0])[:wanted]
    return np.array([f[0] for f in found]), np.array([f[1] for f in found]).reshape(len(found), size)


# --- passes over all rows -----------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def scaled(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): floor(SCALE * c) + OFFSET of every usable row, ``d`` entries each."""
    own = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    limit = float(MOST_ENTRY)
    integer = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(limit)), F.lit(-limit))).cast("long") + OFFSET
    own = own.select("key", F.transform("vector", integer).alias("x"))
    width = own.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"{width} dimensions are more than the {MOST_DIMENSIONS} whose covariance a driver holds")
    filled = F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x"))
    return own.select("key", filled.alias("x"))


def matrix_of(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix of 64-bit integers."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def products_of(centre: np.ndarray):
    """Sums of products of centred entries over a task: one row per row of the matrix, right of the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                part = (matrix_of(batch.slice(low, BLOCK)) - centre).astype(float)
                total += part.T @ part
        rows = [total[i, i:] for i in range(len(centre))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "values"])

    return run


def sums_of(own: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of every dimension."""
    count = own.count()
    by_place = own.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("s"))
    return count, [int(r.s) for r in by_place.orderBy("i").collect()]


def covariance_of(own: DataFrame, count: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``count``, centred before multiplying."""
    centre = np.array([(2 * s + count) // (2 * count) for s in sums], np.int64)
    rows = map_arrow(own.select("x"), products_of(centre), "i int, values array<double>")
    summed = rows.select("i", F.posexplode("values").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((len(sums), len(sums)))
    for r in summed.collect():
        out[r.i, r.i + r.j] = out[r.i + r.j, r.i] = r.v
    rest = np.array([(s - count * int(c)) / count for s, c in zip(sums, centre)])
    return out / count - np.outer(rest, rest)


def projections(count: int, sums: list[int], whitener: np.ndarray):
    """key, deviation and whitened values of every row; ``whitener`` is components x dimensions."""
    totals = np.array(sums, object)
    centre = np.array([s // count for s in sums], np.int64)
    part = np.array([s % count / count for s in sums])
    fits = max((abs(s) for s in sums), default=0) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                rows = batch.slice(low, BLOCK)
                x = matrix_of(rows)
                most = int(np.abs(x).max()) + 1
                reach = int(np.abs(x - centre).max()) + 1
                if fits and most * count < 1 << 62 and (reach * count) ** 2 * len(sums) < 1 << 63:
                    gap = x * count - np.array(sums, np.int64)
                    deviation = (gap * gap).sum(axis=1).tolist()
                else:
                    gap = x.astype(object) * count - totals
                    deviation = [v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)]
                white = ((x - centre) - part) @ whitener.T
                values = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), len(whitener)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(deviation, pa.int64()), values], names=["key", "deviation", "white"])

    return run


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the whitened columns' covariance minus the identity."""
    pairs = list(combinations_with_replacement(range(components), 2))
    row = white.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    own = materialize(scaled(vectors, key, vector), "whitening")
    count, sums = sums_of(own)
    type_of_key = own.schema["key"].dataType.simpleString()
    names = f"`{key}` {type_of_key}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    none = vectors.sparkSession.createDataFrame([], names)
    if not count:
        return none
    covariance = covariance_of(own, count, sums)
    trace = float(np.trace(covariance))
    values, directions = components_of(covariance, min(components, len(sums)))
    keep = values > NO_VARIANCE * trace
    values, directions = values[keep], directions[keep]
    if not len(values):
        return none
    whitener = directions / np.sqrt(values)[:, None]
    schema = f"key {type_of_key}, deviation bigint, white array<double>"
    white = materialize(map_arrow(own, projections(count, sums, whitener), schema), "whitened")
    error = identity_error(white, len(values))
    explained = F.array(*[F.lit(float(v) / trace) for v in values])
    rows = white.select("key", "deviation", F.posexplode("white").alias("i", "whitened"))
    return rows.select(
        F.col("key").alias(key), (F.col("i") + 1).alias("component"), F.lit(count).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"),
    )
