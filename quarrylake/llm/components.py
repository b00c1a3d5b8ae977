"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _forest(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child, that is, all trees are stars."""
    children = edges.groupBy(F.col("a").alias("node")).count()
    if children.filter("count > 1").limit(1).count():
        return False
    return edges.select(F.col("b").alias("node")).join(children, "node", "left_semi").limit(1).count() == 0


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component), a row per linked node, the root included.

    component is the smallest node reachable. Large-star and small-star steps alternate until
    every tree is a star; each step is joins of written tables, so a node with very many links
    is split by adaptive execution, and each minimum is aggregated before it is shuffled. Null
    nodes and links of a node to itself are ignored.
    """
    edges = links.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = scratch.keep(edges.distinct(), "edges")
    while not _forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = scratch.keep(least, "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.filter("a <> b").distinct(), "large")
        least = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(
            F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")
        )
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = scratch.keep(small.distinct(), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return scratch.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
