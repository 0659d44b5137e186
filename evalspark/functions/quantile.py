"""Exact grouped median without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DIGITS = 4096


def unit_median(frame: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median of ``value`` in [0, 1] per key (mean of the middle two).

    Spark's own exact percentile keeps every distinct value of a group in one
    task. Here the value is narrowed digit by digit in base 4096: a histogram of
    the first digit locates the two middle ranks, then one of the second digit,
    and only the values that share both digits are ordered. Equal values collapse
    to a count before the first shuffle.
    """
    first = F.floor(F.col("_v") * DIGITS)
    second = F.floor((F.col("_v") * DIGITS - F.col("_d1")) * DIGITS)
    values = (
        frame.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_d1", first)
        .withColumn("_d2", second)
    )
    level2 = values.groupBy(*keys, "_d1", "_d2").agg(F.sum("_n").alias("_n"))
    level1 = level2.groupBy(*keys, "_d1").agg(F.sum("_n").alias("_n"))

    group = Window.partitionBy(*keys)
    upto = group.orderBy("_d1").rowsBetween(Window.unboundedPreceding, 0)
    ranked = level1.select(
        *keys, "_d1", (F.sum("_n").over(upto) - F.col("_n")).alias("_skip"), "_n",
        F.floor((F.sum("_n").over(group) + 1) / 2).alias("_lo"),
        F.floor((F.sum("_n").over(group) + 2) / 2).alias("_hi"),
    )
    hits1 = _holding_middle(ranked).select(*keys, "_d1", "_skip", "_lo", "_hi")

    inner = [*keys, "_d1"]
    upto2 = Window.partitionBy(*inner).orderBy("_d2").rowsBetween(Window.unboundedPreceding, 0)
    ranked2 = level2.join(hits1, inner).withColumn(
        "_skip", F.col("_skip") + F.sum("_n").over(upto2) - F.col("_n")
    )
    hits2 = _holding_middle(ranked2).select(*inner, "_d2", "_skip", "_lo", "_hi")

    leaf = [*inner, "_d2"]
    upto3 = Window.partitionBy(*leaf).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked3 = values.join(hits2, leaf).withColumn(
        "_skip", F.col("_skip") + F.sum("_n").over(upto3) - F.col("_n")
    )
    holds_lo = (F.col("_skip") < F.col("_lo")) & (F.col("_lo") <= F.col("_skip") + F.col("_n"))
    holds_hi = (F.col("_skip") < F.col("_hi")) & (F.col("_hi") <= F.col("_skip") + F.col("_n"))
    return _holding_middle(ranked3).groupBy(*keys).agg(
        ((F.max(F.when(holds_lo, F.col("_v"))) + F.max(F.when(holds_hi, F.col("_v")))) / 2).alias(name)
    )


def _holding_middle(ranked: DataFrame) -> DataFrame:
    return ranked.filter(
        (F.col("_skip") < F.col("_hi")) & (F.col("_lo") <= F.col("_skip") + F.col("_n"))
    )
