"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b); the root is the smallest node that it reaches.

    Large-star and small-star steps alternate: each hangs a node's neighbours below its smallest one.  A
    step is an aggregate and a join on the node, which skew-join handling can split; rounds grow with the
    logarithm of the size.  Each round is stored, so a lost executor costs one round at most.
    """
    def downward(df, a, b):
        return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = store(downward(links, "a", "b"))
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = store(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = store(downward(small.union(least.select("u", "m")), "a", "b"))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
