"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum (combined map-side) and an equi join; a vertex with very
many links is a skewed join key, never a collected group.  Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjex.session import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of comparable, non-null ids -> (node, component): the smallest id
    reachable, for every node with a link to another node."""
    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")
    before = state(edges)
    if before[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = written(small.distinct(), "links")
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
