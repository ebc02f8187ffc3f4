"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._scratch import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node of its component.

    Each round points all larger neighbours of a node, and then all smaller ones, at the
    least of them; it ends when every link points at a root. A node with a third of all
    links is no trouble: minima are pre-aggregated and the joins can split its rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = keep(edges, "links")
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = keep(large, "links-large")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = keep(small.unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "links-small")
        roots = edges.select(F.col("lo").alias("hi")).distinct()
        if edges.join(roots, "hi", "left_semi").isEmpty() and edges.groupBy("hi").count().where("count > 1").isEmpty():
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
