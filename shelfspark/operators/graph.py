"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its smallest node.

    Each round every node takes the smallest label among its own, its neighbours' and those of the nodes
    that these labels name, and the edges are drawn anew between labels. A label that nobody joins has
    a smaller neighbour in the next round, so two rounds halve the labels at least. Minima are combined before the
    shuffle, so a node with very many neighbours is no burden.
    """
    pairs = edges.where(F.col(left) != F.col(right)).select(
        F.col(left).alias("u"), F.col(right).alias("v"))
    now = cut_lineage(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(now.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())
    while not now.isEmpty():
        # the smallest neighbour that is smaller than the node, else the node itself
        least = now.groupBy("u").agg(F.min("v").alias("v")).select(
            F.col("u").alias("node"), F.least("u", "v").alias("to"))
        least = cut_lineage(least)
        while True:  # to the root of each tree of smallest neighbours, two steps at a time
            jump = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
            further = cut_lineage(least.join(jump, "to", "left").select(
                "node", F.coalesce("next", "to").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            least = further.select("node", "to")
            if further.where("moved").isEmpty():
                break
        root = least.select(F.col("node").alias("label"), F.col("to"))
        labels = cut_lineage(labels.join(root, "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")))
        ends = now.join(least.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(
            least.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        now = cut_lineage(ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    return labels.select("node", F.col("label").alias("component"))
