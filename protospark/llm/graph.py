"""Connected components over links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protospark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links`` (``a``, ``b``, longs): the smallest id that links reach.

    Links that are null or join an id to itself count for nothing. Each round joins the links to their
    nodes' smallest neighbours (aggregated before the shuffle) and is written to the shared folder.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stars = False
    while not stars:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        # done when every node has one link, and to a node that has none itself
        heads = edges.groupBy("u").agg(F.count("*").alias("n"))
        stars = edges.join(heads.select(F.col("u").alias("v"), "n"), "v", "left").agg(F.count("n")).first()[0] == 0 and heads.where("n > 1").limit(1).count() == 0
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cut(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots))
