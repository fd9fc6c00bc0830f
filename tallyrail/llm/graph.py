"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node it is connected with) of every node of ``edges`` (columns a and b, long).

    Alternating large-star and small-star rounds: each round hangs neighbours under the least one, so the number of
    rounds grows with the logarithm of the longest path. No round gathers the neighbours of a node: the least one
    comes from an aggregation that combines before its shuffle, and is written before it is joined, so that the edges
    of a node with many can be dealt to several tasks. Each round is written to the checkpoint folder.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))  # a node has few least ones here
        hung = large.join(small, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        edges = checkpointed(
            small.select("a", F.col("m").alias("b")).union(hung.filter("x <> y").select(F.greatest("x", "y"), F.least("x", "y"))).distinct()
        )
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return labels.union(edges.select("b", "b").distinct()).groupBy("node").agg(F.min("label").alias("label"))
