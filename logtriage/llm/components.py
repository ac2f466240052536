"""Connected components of large edge lists by repeated star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtriage.llm.common import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node that it is linked to.

    Alternates two steps until nothing changes: every node hands the smallest of itself and its neighbours
    to its larger neighbours, then to its smaller ones. Both keep what is connected, and end in stars around
    the smallest nodes after a number of rounds that grows with the logarithm of the nodes. Neighbour
    minima are aggregates and joins on the node, so a node with very many links is spread by partial
    aggregation and split joins. Each round is written to the shared folder. Nulls and self-links are left out.
    """
    current = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        # large star: every node tells its larger neighbours the smallest node around it
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # rows with v > u hang v below m
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "links")
        # small star: smaller neighbours and the node itself hang below the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        a = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        b = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        current = small
        if a == b:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(current.select("v", "v").distinct())
