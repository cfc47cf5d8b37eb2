"""Connected components by alternating small and large stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import dropped, written


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    A round points each node's neighbours at the smallest of them; rounds grow with the
    logarithm of the longest path. A node with very many links is summed up before the
    shuffle, and its rows are spread by the skew join. Self-links and nulls are ignored.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while True:
        least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
        if least.where("n > 1").isEmpty() and edges.join(least.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            dropped(least)
            break
        small = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "cc-edges")
        dropped(before, least)
        both = edges.select(F.col("v").alias("w"), F.col("u").alias("x")).union(edges.select(F.col("u").alias("w"), F.col("v").alias("x")))
        lowest = written(both.groupBy("w").agg(F.min("x").alias("x")).select(F.col("w").alias("v"), F.least("w", "x").alias("m")), "cc-least")
        before, edges = edges, written(edges.join(lowest, "v").select("u", F.col("m").alias("v")).distinct(), "cc-edges")
        dropped(before, lowest)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
