"""Connected components of a graph at rest, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmart.llm.common import at_rest

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """`edges` (u, v) with u > v. Large: a node's larger neighbours, small: its smaller ones, join its smallest."""
    both = edges.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")),
                                         F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
        met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v) but the roots: the smallest node that is reachable.

    Rounds of joins and partial aggregates, each written to shared storage; no node's neighbours are collected. The
    number of rounds grows with the logarithm of the number of nodes. At the end each edge leads to its root.
    """
    edges = at_rest(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        # Done when no node has two smaller neighbours and no root is another's member.
        several = edges.groupBy("u").count().where("count > 1").limit(1)
        inner = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u").distinct(), "u", "left_semi").limit(1)
        if several.isEmpty() and inner.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = at_rest(_star(at_rest(_star(edges, True), "large-star"), False), "small-star")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
