"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.common import stored


def components(links: DataFrame, name: str) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``links`` (columns a, b).

    Large-star and small-star steps (Kiveris and others, 2014): every node hands the smallest
    node it knows to its larger, then to its smaller neighbours, until nothing changes. The
    number of rows never grows, and the rounds grow with the logarithm of the nodes. Only the
    minimum of a node's neighbours is needed, an aggregate, so a node with many links is not
    gathered anywhere. Each round is stored in the shared folder.
    """
    edges = stored(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).join(
            least.withColumnRenamed("u", "x"), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, name)
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
