"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

EDGES_A_PART = 500_000


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Large-star hangs a node's larger neighbours under the smallest of its neighbourhood,
    small-star does so with the smaller ones; alternating, the graph becomes stars in a
    logarithmic number of rounds. Minima are pre-aggregated before each shuffle, and
    the joins that follow are plain equi-joins which adaptive execution can split, so a hub
    with very many neighbours never lands in one task. The driver sees two numbers a round.
    An empty edge table gives an empty result; self-loops and repeated edges are ignored.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    current = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct()
    current = materialize(current, "edges")
    seen = _digest(current)
    parts = 1 + seen[0] // EDGES_A_PART  # stars have no more edges than the graph they come from
    if not seen[0]:
        return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(low, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(root, "hi")
        small = (
            hung.filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(root.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        last, current = current, materialize(small.coalesce(parts), "stars")
        discard(last)
        now = _digest(current)
        if now == seen:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
