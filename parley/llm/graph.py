"""Checked broadcasts and connected components, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import persist

#: rows of two numbers that may be sent to every executor: about 32 MB
SMALL = 1_000_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is, for a shuffled join.

    Counts ``df``, so it should be stored.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id that has an edge.

    Alternates large and small stars until no edge changes, which takes a number of
    rounds logarithmic in the longest path. A node with many edges is reduced by its
    minimum first, which combines before the shuffle.
    """
    sign = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
    now = persist(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = now.agg(*sign).collect()
    while before[0][0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        star = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        after = persist(star.where("a <> b").distinct(), "edges")
        # equal counts and sums of hashes: nothing has moved
        known, before = before, after.agg(*sign).collect()
        now = after
        if known == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
