"""Connected components of an edge table by repeated smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) with a neighbour; the component is its smallest node.

    Alternates two star steps: every node hooks its larger neighbours to its smallest neighbour, then its
    smaller neighbours. A star of any size only ever sends one row per edge, and a hub is met by partial
    aggregation, so it is not gathered. The number of rounds grows with the logarithm of the nodes.
    """
    forward = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialize(forward.distinct(), "edges")
    before, state = None, _state(current)
    while state != before:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above the node move to the smallest
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its neighbours below it move to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(current)
    own = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.unionByName(own.select(F.col("component").alias("node"), "component")).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal states are equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
