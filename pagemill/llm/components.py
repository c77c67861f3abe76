"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins over the edges that are left; a round's result is written to the shared folder, so
lineage stays short and a lost executor costs one round at most. Rounds grow with the logarithm of the longest path.

Defined cases: an edge with a null end and an edge from a node to itself link nothing; repeated edges count once; no edges, no rows;
other columns are ignored. No texts are read here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are hung on the node's least neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (a > b here) and its lesser neighbours are hung on the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b; one orderable type) reaches. Nodes without edges are absent."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        # The number of rows and the exclusive-or of two hashes of each identify the set of distinct rows.
        sign = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if sign == mark or not sign[0]:
            break
        mark = sign
        before, now = now, written(_small_star(_large_star(now)), "edges")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
