"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark.llm.tables import cut


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them.

    With ``both_ways`` a node looks at all neighbours and re-hangs the larger
    ones; without, it looks at the smaller ones only and re-hangs them and
    itself. Neither step makes more edges than it was given.
    """
    looking = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        looking = looking.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = looking.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = looking.join(least, "u")
    if both_ways:
        moved = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Alternates two star contractions until nothing changes. The number of rounds
    grows with the logarithm of the longest path, and every round is written, so
    the plan does not grow. No node's neighbourhood is gathered. Edges with a
    null end and loops are ignored; an empty table gives an empty table.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        now = cut(_star(_star(now, True), False))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
