"""Confidence calibration, run-to-run diffs and corpus measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.stats import rate

HIGH_CONFIDENCE = 0.8
BINS = 10


def correct() -> Column:
    return F.col("exec_match").cast("double")


def confidence_matrix(answers: DataFrame, keys: list[str], high: float = HIGH_CONFIDENCE) -> DataFrame:
    """Confidence against correctness; confident and wrong is the cell that hurts."""
    sure = F.when(F.col("confidence") >= high, F.lit("high")).otherwise(F.lit("low"))
    return answers.groupBy(
        *keys, sure.alias("confidence_level"), F.col("exec_match").alias("correct")
    ).agg(F.count(F.lit(1)).alias("cases"))


def brier_ece(answers: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """Brier score and expected calibration error from per-bin sums."""
    bin_of = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    gap = F.col("confidence") - correct()
    per_bin = answers.groupBy(*keys, bin_of.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(gap * gap).alias("_squares"), F.sum(gap).alias("_gap")
    )
    return per_bin.groupBy(*keys).agg(
        F.sum("_n").alias("cases"),
        rate(F.sum("_squares"), F.sum("_n")).alias("brier"),
        rate(F.sum(F.abs("_gap")), F.sum("_n")).alias("ece"),
    )


def selective_accuracy(answers: DataFrame, keys: list[str], high: float = HIGH_CONFIDENCE) -> DataFrame:
    """Accuracy on the answers an agent is sure of, and how many those are."""
    sure = F.col("confidence") >= high
    return answers.groupBy(*keys).agg(
        F.count_if(sure).alias("confident_cases"),
        rate(F.count_if(sure), F.count(F.lit(1))).alias("coverage"),
        rate(F.count_if(sure & F.col("exec_match")), F.count_if(sure)).alias("accuracy"),
    )


def run_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Per case: regression, improvement, unchanged, added or removed."""
    old = before.select(*keys, F.col("exec_match").alias("before_match"))
    new = after.select(*keys, F.col("exec_match").alias("after_match"))
    b, a = F.col("before_match"), F.col("after_match")
    change = (
        F.when(b.isNull(), F.lit("added")).when(a.isNull(), F.lit("removed"))
        .when(b & ~a, F.lit("regression")).when(~b & a, F.lit("improvement")).otherwise(F.lit("unchanged"))
    )
    return old.join(new, keys, "full").withColumn("change", change)


def canonical_share(cases: DataFrame, canonical: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the referenced tables that are canonical ones."""
    listed = canonical.select(F.col("table_name").alias("_t")).distinct().withColumn("_known", F.lit(True))
    used = cases.select(*keys, F.explode("tables").alias("_t"))
    return used.join(listed, "_t", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("references"),
        rate(F.count_if(F.col("_known").isNotNull()), F.count(F.lit(1))).alias("canonical_share"),
    )


def rephrase_consistency(answers: DataFrame, keys: list[str], result_hash: str) -> DataFrame:
    """Whether all phrasings of a question got the same answer.

    Smallest and largest hash agree exactly when there is a single one, so no set
    is built.
    """
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("phrasings"),
        (F.min(result_hash) == F.max(result_hash)).alias("consistent"),
    )
