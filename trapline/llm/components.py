"""Connected components as rounds of joins, with a checkpoint after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root


def component_roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has an edge; the root is the smallest node reachable.

    Alternates large-star and small-star steps (each links a node's
    neighbourhood to its smallest member) until all components are stars: every
    node has one edge down, to a node without any. Self-loops and repeated edges
    are dropped; an empty edge table gives no rows. The number of rounds is
    logarithmic in the longest path; edges that are stars already take none.
    """
    checkpoint_root(edges.sparkSession)
    up = F.greatest(a, b)
    edges = edges.where(F.col(a) != F.col(b)).select(up.alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    while not _stars(edges):
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a row an edge, repeats included: they go at the end of the round
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours point to the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v")))
        edges = small.where(F.col("u") != F.col("v")).distinct().checkpoint()
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every upper end of an edge has one edge and is no lower end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
    of_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all"))
    return of_node.agg(F.count_if((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("all") > 1)))).first()[0] == 0
