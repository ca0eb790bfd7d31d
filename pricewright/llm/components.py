"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MOST_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b): the smallest node of each component, for all nodes of edges between two nodes.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones, are linked to its
    smallest neighbour. Rounds grow with the logarithm of the size; neighbours are never listed, only their minimum is
    aggregated and joined back, and the edges of each round are a written table.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
        before = state
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "edges")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = staged(
            large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct(), "edges")
    raise RuntimeError("components did not settle")
