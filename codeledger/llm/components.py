"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeledger.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b of any ordered type; returns node, root, the root being the smallest node that is reachable.

    Large-star and small-star steps in turn: each hangs a node's neighbours on the smallest of them,
    until each component is one star. The neighbours of a node are never gathered, only their minimum, which is
    taken before the shuffle, too. Each step is written to the shared folder, so nothing is computed
    twice and a lost executor costs one step. Nodes without a link to another are left out.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        # Large star: every larger neighbour of a goes to the smallest around a.
        large = stored(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "cc-large")
        # Small star: a and its smaller neighbours go to the smallest of those.
        smaller = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(smaller, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(smaller.select("a", F.col("low").alias("b")))
        edges = stored(small.distinct(), "cc-links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link down and none of them another one further down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down")).distinct())
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n")).filter("down > 1 OR down = 1 AND n > 1").isEmpty()
