"""Connected components of an edge table, by alternating large-star and small-star steps; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b longs) -> (key, comp): the smallest key that each key can reach; keys that are their component's smallest are left out. A written table, for discard()."""
    e = stash(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "edges")
    while True:
        # done when each key has one edge and no edge's end begins another
        ends = e.select(F.col("v").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("m", F.lit(0), F.lit(1)))
        if ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out = 1 and in = 1").isEmpty():
            out = e.select(F.col("v").alias("key"), F.col("m").alias("comp"))
            out.stashed_at = e.stashed_at
            return out
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).union(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least("u", F.min("w")).alias("x"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("x").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("x"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("x").alias("m")), F.struct(F.col("m").alias("v"), F.col("x").alias("m")))).alias("e"))
        old, e = e, stash(small.select("e.v", "e.m").where("v <> m").distinct(), "edges")
        discard(old)
