"""Connected components of links between documents or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b: long), the component being its smallest node.

    In each round every node is given to the smallest of its neighbours or itself, chains of these
    are shortened, and the links between the groups are the links of the next round.  Links of a
    node of very many are combined before they are shuffled; nothing is collected but counts.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("component")))
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        parent = materialize(parent)
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("up"))
            parent = parent.join(up, "p", "left").select("a", F.coalesce("up", "p").alias("p"))
        parent = materialize(parent)
        of_a, of_b = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = materialize(edges.join(of_a, "a").join(of_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        step = parent.select(F.col("a").alias("component"), "p")
        mapping = materialize(mapping.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")))
    lowest = mapping.groupBy("component").agg(F.min("node").alias("lowest"))
    return mapping.join(lowest, "component").select("node", F.col("lowest").alias("component"))
