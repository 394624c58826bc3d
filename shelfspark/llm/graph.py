"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stage


def stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and is no ``v``."""
    one, none = F.lit(1), F.lit(0)
    ends = (edges.select(F.col("u").alias("node"), one.alias("up"), none.alias("down"))
            .unionByName(edges.select(F.col("v").alias("node"), none.alias("up"), one.alias("down"))))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter(F.col("up") + F.col("down") * F.least("up", one) > 1).isEmpty()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node with an edge.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the edges are stars. Each
    step is a minimum per node, combined before the shuffle, and a join; each round is written.
    """
    high, low = F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    now = stage(edges.filter(F.col(left) != F.col(right)).select(high, low).distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").filter("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), "m")
                 .unionByName(least).select("u", F.col("m").alias("v")).distinct())
        now = stage(small, "edges")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))
                         .distinct()))
