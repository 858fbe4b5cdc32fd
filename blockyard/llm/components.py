"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Each round is two hash aggregations and two joins on node keys, written to the shared folder; edges shrink to
    stars, so rounds grow with the logarithm of the longest path. The smallest neighbours are written before they are
    joined, so Spark can split a join in which one node has most of the edges. Self-loops give a component of their own.
    """
    pairs = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.union(pairs.filter("u = v").select("u", "v")).distinct(), "large")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        pairs = store(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen = now
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
