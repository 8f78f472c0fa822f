"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that links reach) for every node of ``links`` (``a``, ``b``).

    Alternating large-star and small-star rounds: every node hands its larger neighbours to its smallest one, then its
    smaller ones, until all nodes point at their component's smallest node. The number of rounds grows with the
    logarithm of the longest path, and stars need none. Each round is a written table.
    """
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct())
    while not is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: the larger neighbours of each node point at the smallest.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours point at the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = settled(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def is_stars(edges: DataFrame) -> bool:
    """Whether every node either points at one other or is pointed at, and none does both."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
            .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    odd = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter(
        "out > 1 or out = 1 and into = 1")
    return odd.isEmpty()
