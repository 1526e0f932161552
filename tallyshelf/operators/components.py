"""Connected components of links, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.scratch import broadcast_if_small, stage


def connected_components(links: DataFrame, tag: str = "links") -> DataFrame:
    """(node, component) for every node of the undirected ``links`` (a, b), the
    component being its smallest node; nodes are numbers or strings.

    Large-star and small-star steps in turn; each is a minimum per node, which
    combines before the shuffle, and a join.  Every round is written to the
    shared folder.  Ends when a round changes nothing, after about the logarithm
    of the longest chain.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), tag)
    size = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = edges.agg(*size).first()
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = broadcast_if_small(stage(low, f"{tag}-low"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.filter("u <> v"), f"{tag}-large")
        low = broadcast_if_small(stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-low"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = stage(small, tag)
        now = edges.agg(*size).first()
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
