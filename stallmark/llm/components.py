"""Connected components of an edge table, by alternating stars.

Each round points all larger neighbours of a node at its smallest neighbour, then all smaller ones. Rounds follow the
logarithm of the longest chain. Edges stay distributed; a round ends in the shared checkpoint folder, so a lost
executor costs one round at most. The smallest neighbour of a node is combined before the shuffle; the join back
splits hot nodes (both of its sides are plain exchanges, which adaptive execution may split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallmark.operators.durable import settle


def _mark(edges: DataFrame):
    """Equal for equal sets of edges."""
    h = F.xxhash64("a", "b")
    return edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first()


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest neighbour of u, u included, as ``m``."""
    low = settle(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return edges.join(low, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has an edge to another node, and the smallest node reachable from it.

    Loops, repeated edges and edges with a null end add nothing. No edges give no rows.
    """
    edges = settle(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("p"),
                                F.col(b).alias("q")).filter("p <> q").select("a", "b").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = settle(_star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        starred = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        edges = settle(starred.select(F.inline(F.array(
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("v").alias("a"), F.col("m").alias("b"))))).filter("a <> b").distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
