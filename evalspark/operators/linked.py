"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark.session import durable


def linked(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node reachable.

    In a round every node hangs its larger neighbours on the smallest node it
    sees, then itself and its smaller neighbours. Paths halve, so the rounds grow
    with the logarithm of the longest one; each is written, and no neighbourhood
    is gathered.
    """
    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now, seen = durable(edges.filter("a <> b").select(*ordered).distinct()), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum("b").cast("decimal(38,0)"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if not state[0] or state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct())
        seen = state
        both = now.union(now.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = durable(small.union(lowest).filter("a <> b").select(*ordered).distinct())
