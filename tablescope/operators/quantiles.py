"""Exact order statistics by narrowing brackets.

Spark's exact ``percentile`` keeps a value -> count map of the whole column in one buffer, so
its memory grows with the data.  Here ``percentile_approx`` (a bounded sketch) brackets each
wanted rank, and one grouped count keeps single values only inside the brackets, about 4/10,000
of the rows per rank; rows between brackets collapse to one counter per gap before the shuffle.
A bracket with too many distinct values for one task is narrowed by another sketch.  The driver
sees a few numbers per bracket.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.session import checkpointed

# workers get the functions of this module with each job, so they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ACCURACY = 10_000
VALUES_PER_TASK = 1_000_000
FEWEST_VALUES = 16


@dataclass
class Bracket:
    """Rank ``rank`` (0-based) of column ``name`` should lie in [low, high]."""

    name: str
    rank: int
    low: float
    high: float


def probe_points(probs: list[float]) -> list[float]:
    """Sketch positions just below and above each wanted probability, plus both ends."""
    margin = 2 / ACCURACY
    points = {0.0, 1.0}
    for p in probs:
        points.update((max(0.0, p - margin), min(1.0, p + margin)))
    return sorted(points)


def sketch(value: Column, points: list[float]) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(p) for p in points]), F.lit(ACCURACY))


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    ranks: dict[str, list[int]],
    counts: dict[str, int],
    sketches: dict[str, tuple[list[float], list[float]]] | None = None,
    values_per_task: int = VALUES_PER_TASK,
) -> dict[tuple[str, int], float]:
    """Values at the 0-based ``ranks`` of each column (nulls ignored, ``counts`` non-nulls).

    ``columns`` are double expressions; ``sketches`` passes (points, values) pairs that an
    earlier job already computed.
    """
    wanted = [(n, k) for n, ks in ranks.items() for k in sorted(set(ks)) if counts.get(n, 0) > 0]
    if not wanted:
        return {}
    missing = [n for n in dict.fromkeys(n for n, _ in wanted) if n not in (sketches or {})]
    known = dict(sketches or {})
    if missing:
        points = {n: probe_points([k / counts[n] for k in ranks[n]]) for n in missing}
        row = df.agg(*[sketch(columns[n], points[n]).alias(f"s{i}") for i, n in enumerate(missing)]).first()
        known.update({n: (points[n], row[f"s{i}"]) for i, n in enumerate(missing)})

    brackets = []
    for name, rank in wanted:
        points, values = known[name]
        position, margin = rank / counts[name], 1.5 / ACCURACY
        low = max((v for p, v in zip(points, values) if p <= max(0.0, position - margin)), default=values[0])
        high = min((v for p, v in zip(points, values) if p >= min(1.0, position + margin)), default=values[-1])
        brackets.append(Bracket(name, rank, low, high))

    found: dict[tuple[str, int], float] = {}
    # below this a narrowed bracket could stay as it is: a sketch never separates neighbours
    values_per_task = max(values_per_task, FEWEST_VALUES)
    while brackets:
        ranges = _disjoint_ranges(brackets)
        grouped = _grouped(df, columns, ranges)
        grouped = checkpointed(grouped)
        stats = _slot_stats(grouped)
        found.update(_pick_checked(grouped, ranges, brackets, stats, values_per_task))
        brackets = [b for b in brackets if (b.name, b.rank) not in found]
        if brackets:
            _narrow(df, columns, ranges, brackets, stats)
    return found


def _disjoint_ranges(brackets: list[Bracket]) -> dict[str, list[tuple[float, float]]]:
    """Brackets per column, overlapping ones merged, in ascending order."""
    result: dict[str, list[tuple[float, float]]] = {}
    for b in sorted(brackets, key=lambda b: (b.low, b.high)):
        own = result.setdefault(b.name, [])
        if own and b.low <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], b.high))
        else:
            own.append((b.low, b.high))
    return result


def _slot(value: Column, ranges: list[tuple[float, float]], first: int = 0) -> Column:
    """Slot of a value by halving: for range j, 4j is the gap before it, 4j+1 its low end,
    4j+2 its interior and 4j+3 its high end.

    The ends are slots of their own, so a hot value at an end never keeps a range large.
    """
    if not ranges:
        return F.lit(4 * first)
    middle = len(ranges) // 2
    low, high = ranges[middle]
    here = 4 * (first + middle)
    return (
        F.when(value < F.lit(low), _slot(value, ranges[:middle], first))
        .when(value == F.lit(low), F.lit(here + 1))
        .when(value < F.lit(high), F.lit(here + 2))
        .when(value == F.lit(high), F.lit(here + 3))
        .otherwise(_slot(value, ranges[middle + 1 :], first + middle + 1))
    )


def _places(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``_slot`` of many values; as in Spark, NaN equals itself and is above all numbers."""
    j = np.searchsorted(high, values, side="left")
    inside = j < len(high)
    at = np.minimum(j, len(high) - 1)
    is_nan = np.isnan(values)
    below = (values < low[at]) | (np.isnan(low[at]) & ~is_nan)
    at_low = (values == low[at]) | (np.isnan(low[at]) & is_nan)
    at_high = (values == high[at]) | (np.isnan(high[at]) & is_nan)
    return 4 * j + np.where(~inside | below, 0, np.where(at_low, 1, np.where(at_high, 3, 2)))


def _grouped(df: DataFrame, columns: dict[str, Column], ranges: dict[str, list]) -> DataFrame:
    """(c, slot, v, n): counts per gap (v null) and per value inside the ranges."""
    ends = [np.array(r, float).T for r in ranges.values()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, (low, high) in enumerate(ends):
                values = batch.column(c).drop_null().to_numpy()
                slot = _places(values, low, high)
                gaps = np.bincount(slot[slot % 4 == 0], minlength=4 * len(low) + 1)
                gap = np.flatnonzero(gaps)
                kept, n = np.unique(values[slot % 4 > 0], return_counts=True)
                found = [
                    pa.array(np.full(len(gap) + len(kept), c, np.int32)),
                    pa.array(np.concatenate([gap, _places(kept, low, high)]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(gap)), kept]), mask=np.arange(len(gap) + len(kept)) < len(gap)),
                    pa.array(np.concatenate([gaps[gap], n])),
                ]
                yield pa.RecordBatch.from_arrays(found, names=["c", "slot", "v", "n"])

    values = df.select(*[columns[n].cast("double").alias(f"x{i}") for i, n in enumerate(ranges)])
    counted = values.mapInArrow(count, "c int, slot int, v double, n bigint")
    return counted.groupBy("c", "slot", "v").agg(F.sum("n").alias("n"))


def _slot_stats(grouped: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Rows and distinct values per (column, slot)."""
    rows = grouped.groupBy("c", "slot").agg(F.sum("n").alias("rows"), F.count("v").alias("values")).collect()
    return {(r["c"], r["slot"]): (r["rows"], r["values"]) for r in rows}


def _pick(
    grouped: DataFrame,
    partition: list[str],
    need: dict[tuple, list[int]],
    names: list[str],
    below: dict | None = None,
) -> dict:
    """Values at the needed ranks of each partition, counted from its first row."""
    upto = F.sum("n").over(W.partitionBy(*partition).orderBy("slot", "v").rowsBetween(W.unboundedPreceding, 0))
    # one text key per (column) or (column, slot): the map is as long as the list of brackets
    entries = [
        x
        for key, ks in need.items()
        for x in (F.lit("/".join(map(str, key))), F.array(*[F.lit(k).cast("bigint") for k in ks]))
    ]
    wanted = F.element_at(F.create_map(*entries), F.concat_ws("/", *partition))
    steps = grouped.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("n"))
    hit = F.filter(wanted, lambda k: (k >= F.col("start")) & (k < F.col("upto")))
    rows = (
        steps.where(F.col("v").isNotNull())
        .select(*partition, "v", F.explode(hit).alias("k"))
        .collect()  # one row per wanted rank
    )
    return {
        (names[r["c"]], r["k"] + (below or {}).get(tuple(r[p] for p in partition), 0)): r["v"] for r in rows
    }


def _pick_checked(grouped: DataFrame, ranges: dict, brackets: list[Bracket], stats: dict, values_per_task: int) -> dict:
    """Pick from the ranges whose number of distinct values fits one task."""
    names = list(ranges)
    need: dict[tuple, list[int]] = {}
    below: dict[tuple, int] = {}
    for b in brackets:
        c = names.index(b.name)
        start = 0
        for slot in range(4 * len(ranges[b.name]) + 1):
            rows, values = stats.get((c, slot), (0, 0))
            if start <= b.rank < start + rows and slot % 4 > 0 and values <= values_per_task:
                need.setdefault((c, slot), []).append(b.rank - start)
                below[c, slot] = start
            start += rows
    if not need:
        return {}
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("slot")) for c, s in need])
    fitting = grouped.where(F.array_contains(keys, F.struct("c", "slot")))
    return _pick(fitting, ["c", "slot"], need, names, below)


def _narrow(df: DataFrame, columns: dict[str, Column], ranges: dict, brackets: list[Bracket], stats: dict) -> None:
    """Give each open rank a new bracket: a sketch of the slot that was found to hold it."""
    names = list(ranges)
    exprs = []
    for i, b in enumerate(brackets):
        c, own = names.index(b.name), ranges[b.name]
        slot, start = 0, 0
        while start + stats.get((c, slot), (0, 0))[0] <= b.rank:
            start += stats.get((c, slot), (0, 0))[0]
            slot += 1
        position = (b.rank - start) / stats[c, slot][0]
        points = [max(0.0, position - 2 / ACCURACY), min(1.0, position + 2 / ACCURACY)]
        value = columns[b.name]
        held = _slot(value, own) == slot
        exprs.append(sketch(F.when(held, value), points).alias(f"s{i}"))
    row = df.agg(*exprs).first()
    for i, b in enumerate(brackets):
        b.low, b.high = row[f"s{i}"]


def quantile_ranks(count: int, probs: list[float]) -> list[int]:
    """Ranks needed to interpolate each probability linearly between its neighbours."""
    ranks = set()
    for p in probs:
        position = p * (count - 1)
        ranks.update((math.floor(position), math.ceil(position)))
    return sorted(ranks)


def interpolate(values: dict[int, float], count: int, p: float) -> float:
    position = p * (count - 1)
    low, high = math.floor(position), math.ceil(position)
    return values[low] + (values[high] - values[low]) * (position - low)


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    counts: dict[str, int] | None = None,
    sketches: dict[str, tuple[list[float], list[float]]] | None = None,
    values_per_task: int = VALUES_PER_TASK,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles of each column; None for a column without values."""
    if not columns:
        return {}
    if counts is None or sketches is None:
        points = probe_points(probs)
        exprs = []
        for i, value in enumerate(columns.values()):
            exprs += [F.count(value).alias(f"n{i}"), sketch(value, points).alias(f"s{i}")]
        row = df.agg(*exprs).first()
        counts = {n: row[f"n{i}"] for i, n in enumerate(columns)}
        sketches = {n: (points, row[f"s{i}"]) for i, n in enumerate(columns) if counts[n]}
    ranks = {n: quantile_ranks(counts[n], probs) for n in columns if counts[n]}
    values = order_statistics(df, columns, ranks, counts, sketches, values_per_task)
    result: dict[str, list[float] | None] = {}
    for n in columns:
        if not counts[n]:
            result[n] = None
            continue
        own = {k: values[n, k] for k in ranks[n]}
        result[n] = [interpolate(own, counts[n], p) for p in probs]
    return result
