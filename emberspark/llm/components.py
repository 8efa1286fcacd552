"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberspark.llm.common import cut


def _stamp(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node with an edge.

    ``edges`` has long columns ``a`` and ``b`` without nulls; direction and repeats do not matter.
    In a large-star step every node ties its larger neighbours to the smallest node around it, in a
    small-star step its smaller ones; edges never grow in number and end as stars around the
    components' smallest nodes after a few rounds.  Each round is written to the checkpoint folder.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # every edge now points from a to a smaller b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = cut(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                    .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _stamp(edges)
        if now == before:
            break
        before = now
    centers = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(centers.select("node", F.col("node").alias("component"))))
