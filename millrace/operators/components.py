"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.skew import join_spread
from millrace.runtime import discard, materialize


#: Edges up to which a round joins plainly: that many narrow rows are light for one task, even if all share a node.
LIGHT = 5_000


def _meet(rows: DataFrame, least: DataFrame, key: str, light: bool) -> DataFrame:
    return rows.join(least.drop("n"), key) if light else join_spread(rows, least, key, "n")


def _larger_star(edges: DataFrame, light: bool = False) -> DataFrame:
    """Every neighbour above a node is hung on the least node of that neighbourhood."""
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("n"))
    hung = _meet(both, least, "node", light).filter(F.col("other") > F.col("node"))
    return hung.select(F.col("other").alias("hi"), F.least("m", "node").alias("lo")).distinct()


def _smaller_star(edges: DataFrame, light: bool = False) -> DataFrame:
    """A node and its lower neighbours are hung on the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    moved = _meet(edges, least, "hi", light).filter(F.col("lo") != F.col("m"))
    return moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node id that links reach from node.

    Edges are two bigint columns; self loops and edges with a null end are ignored, and a node on no edge is absent.
    Each round contracts stars with map-side-combined minima, and the edges of a node with many are dealt over tasks
    before they meet its minimum, so one node may carry a third of all edges. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.filter(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo"))
    signature = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first())
    now = materialize(pairs.distinct(), "edges")
    seen = signature(now)
    for _ in range(max_rounds):
        light = seen[0] <= LIGHT
        after = materialize(_smaller_star(_larger_star(now, light), light), "edges")
        discard(now)
        now = after
        mark = signature(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
