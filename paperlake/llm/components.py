"""Connected components of an edge table, by alternating star contractions.

Each round hangs the neighbours of a node on the smallest of them (first those above the node, then
those below), after Kiveris and others, "Connected Components in MapReduce and Beyond" (2014). The
number of rounds grows with the logarithm of the number of nodes. A node with very many neighbours
is no large group: minima have partial results before the shuffle, and joins can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Rounds

__all__ = ["connected_components"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b, contracted once."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), F.col("a").alias("_from"))
    if large:
        hung = hung.filter("a > _from").select("a", "b")
    else:
        hung = hung.select("a", "b").union(least.select("a", F.col("m").alias("b")))
    return hung.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is its smallest node.

    Loops, repeated and reversed edges do no harm. Without edges there are no rows.
    """
    rounds = Rounds(edges.sparkSession, "edges")
    now = rounds.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        now = rounds.keep(_star(_star(now, True), False))
        count, low, high = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.sum(F.xxhash64("b", "a") % F.lit(1 << 40))).first()
        if not count or mark == (count, low, high):
            break
        mark = (count, low, high)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
