"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: for each node of an edge the smallest id reachable from it.

    Alternates large-star and small-star steps: each step joins every node to the smallest neighbour, until nothing
    changes. Every round is written down in the shared folder, and so are the smallest neighbours, so that the joins have
    exchanges of their own, in which Spark splits the star of a large component; only a count and a checksum reach the driver.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    now, state = materialize(pairs.where("a <> b").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = materialize(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        state = tuple(found)
