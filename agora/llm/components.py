"""Connected components of links as joins and sums, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, ws: Workspace) -> DataFrame:
    """``links`` (a, b): one row per node, ``node`` and ``label``, the least node that it is connected with (itself included).

    Large-star and small-star steps in turn until all is stars: each hangs a node's neighbours under the least of
    them, so the number of rounds grows with the logarithm of the number of nodes. A hub's links are never gathered:
    its least neighbour is a partial sum, written first, and the join with it can be split.
    """
    edges = ws.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.keep(large, "large")
        least2 = ws.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.keep(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        ws.drop(edges, least, large, least2)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one other that itself hangs under none: then the edges are the answer."""
    nodes = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return nodes.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()
