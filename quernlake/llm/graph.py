"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_and_reread


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is named by its smallest node.

    Each round takes the smallest label among a node's neighbours, then the label's own label; a round is written to the shared folder, so
    that no lineage grows. Rounds grow with the logarithm of the longest path, about. Labels are one row for each node, and never leave the executors.
    """
    both = links.select("a", "b").where("a <> b")
    both = write_and_reread(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component"))
    labels = write_and_reread(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        lower = write_and_reread(lower, "labels")
        # Pointer jumping: a label is a node too.
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        lower = write_and_reread(lower.join(jump, "component").select("node", "was", F.least("component", "further").alias("component")), "labels")
        if lower.where("component <> was").isEmpty():
            return lower.select("node", "component")
        labels = lower.select("node", "component")
