"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join


def _least(edges: DataFrame) -> DataFrame:
    """a, its least neighbour m and the number n of its edges; the aggregate is combined before the shuffle."""
    return cut(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of it) for the nodes of edges (a, b), by alternating large and small stars.

    Each round hangs every node's greater neighbours, then its lesser ones, on its least neighbour, so no neighbourhood is ever
    gathered, and the edges of a node that has many are dealt out over several tasks. Rounds grow with the logarithm of the longest path;
    each is written to the shared folder."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least(both)
        hung = spread_join(both, low.select("a", F.least("m", "a").alias("m")), "a", ["b"], low)
        large = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        kept = low.filter("m < a").select("a", F.col("m").alias("b"))
        e2 = cut(large.unionByName(kept).distinct(), "large")
        low2 = _least(e2)
        small = spread_join(e2, low2.drop("n"), "a", ["b"], low2).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small, "stars")
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == mark:
            break
        mark = now
    # every node now hangs on its component's least one
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
