"""Connected components of an edge table, without moving the graph to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the component's smallest node.

    Each round takes the smallest label that an edge brings, to the node and to the root that
    its label names, and then follows labels one step (pointer jumping), so the rounds
    grow with the logarithm of the longest path. Sums before shuffles keep nodes of many
    edges from gathering them in one task. Labels are cut from their lineage each round. Null
    ends and loops are ignored; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), F.col("component").alias("offer"))
        told = seen.groupBy("node").agg(F.min("offer").alias("offer"))
        # To the root as well: else long paths would take as many rounds as they are long.
        roots = told.join(labels, "node").select(F.col("component").alias("node"), "offer")
        offers = told.unionByName(roots).groupBy("node").agg(F.min("offer").alias("offer"))
        nearer = labels.join(offers, "node").select("node", F.least("component", "offer").alias("component"), F.col("component").alias("was"))
        nearer = checkpointed(nearer)
        of = nearer.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = checkpointed(nearer.join(of, "component").select("node", F.least("component", "next").alias("component"), "was"))
        done = jumped.where("component <> was").isEmpty()
        labels = jumped.select("node", "component")
        if done:
            return labels
