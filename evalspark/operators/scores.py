"""Scores of single cases: pure projections of the case-run table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.constants import (
    AGENT_LABEL, CALIBRATION_SLUGS, CATEGORIES, DIMENSIONS, EFFICIENCY_BAND, GOLDEN_LABEL, MAX_BYTES_SCANNED,
    TIERS,
)
from evalspark.functions.text import fixed, signed_percent


def fixed_table(spark: SparkSession, rows: tuple, names: tuple[str, ...]) -> DataFrame:
    """A small table of fixed values as a local relation (no job, no Python rows)."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def category_dim(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, CATEGORIES, ("category", "title", "trust_risk", "trust_critical", "calibration"))


def tier_dim(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, TIERS, ("tier", "name", "aggregate", "target_share"))


def with_category(cases: DataFrame) -> DataFrame:
    """Attach title, risk and the aggregate flags of the category (12 fixed rows)."""
    return cases.join(F.broadcast(category_dim(cases.sparkSession)), "category", "left")


def bytes_ratio() -> Column:
    golden, agent = F.col("golden_bytes"), F.col("agent_bytes")
    return F.try_divide((agent - golden).cast("double"), golden.cast("double"))


def optimization_label() -> Column:
    """Agent bytes against golden bytes; only meaningful when the results match."""
    ratio = bytes_ratio()
    return (
        F.when(~F.col("exec_match"), F.lit("n/a"))
        .when(F.col("golden_bytes") == 0, F.lit("comparable"))
        .when(ratio <= -EFFICIENCY_BAND, F.lit("better"))
        .when(ratio >= EFFICIENCY_BAND, F.lit("worse"))
        .otherwise(F.lit("comparable"))
    )


def judge_passed() -> Column:
    """All three dimensions are 1; a case without a verdict has not passed."""
    dims = [F.col(d) == 1 for d in DIMENSIONS]
    return F.coalesce(F.col("judged") & dims[0] & dims[1] & dims[2], F.lit(False))


def efficiency_ratio() -> Column:
    """Golden bytes over agent bytes, capped at 1, for matching cases with both sizes."""
    usable = F.col("exec_match") & (F.col("golden_bytes") > 0) & (F.col("agent_bytes") > 0)
    ratio = F.try_divide(F.col("golden_bytes").cast("double"), F.col("agent_bytes").cast("double"))
    return F.when(usable, F.least(ratio, F.lit(1.0)))


def is_failure() -> Column:
    """No match, unless a calibration case that the judge found sound."""
    excused = F.col("category").isin(*CALIBRATION_SLUGS) & judge_passed()
    return ~F.col("exec_match") & F.col("category").isNotNull() & ~excused


def score_efficiency(cases: DataFrame) -> DataFrame:
    return cases.withColumn("optimization", optimization_label())


def review_candidates(cases: DataFrame) -> DataFrame:
    """Flag goldens an agent beat: same result, sound method, clearly fewer bytes."""
    ratio = bytes_ratio()
    wins = ratio <= -EFFICIENCY_BAND
    reason = (
        F.when(~F.col("exec_match"), F.lit("results differ"))
        .when(~F.col("judged"), F.lit("no verdict"))
        .when(~judge_passed(), F.lit("method not sound"))
        .when(F.col("golden_bytes") == 0, F.lit("golden size unknown"))
        .when(wins, F.concat(F.lit("same result with "), signed_percent(ratio), F.lit(" bytes")))
        .otherwise(F.lit("not clearly cheaper"))
    )
    sound = F.col("exec_match") & judge_passed() & (F.col("golden_bytes") != 0)
    return cases.withColumns({"review": F.coalesce(sound & wins, F.lit(False)), "reason": reason})


def bytes_guard(cases: DataFrame, estimate: str, ceiling: int = MAX_BYTES_SCANNED) -> DataFrame:
    """Queries whose estimate is over the ceiling; no estimate (null or 0) passes."""
    return cases.withColumn(
        "reason",
        F.when(
            F.col(estimate) > ceiling,
            F.concat(
                F.lit("would scan "), fixed(F.col(estimate) / 1e9, 2),
                F.lit(f" GB — exceeds {ceiling / 1e9:.0f} GB ceiling"),
            ),
        ),
    )


def case_status(cases: DataFrame) -> DataFrame:
    """First error wins: golden query, agent query, judge.

    A failed query leaves the case unmatched and unjudged; a failed judge call
    keeps the match.
    """
    golden, agent, judge = F.col("golden_error"), F.col("agent_error"), F.col("judge_error")
    query_failed = golden.isNotNull() | agent.isNotNull()
    return cases.withColumns({
        "error": F.coalesce(
            F.concat(F.lit(f"{GOLDEN_LABEL}_sql: "), golden),
            F.concat(F.lit(f"{AGENT_LABEL}_sql: "), agent),
            F.concat(F.lit("judge: "), judge),
        ),
        "exec_match": F.col("matched") & ~query_failed,
        "judged": ~query_failed & judge.isNull(),
    })


def case_lines(cases: DataFrame) -> DataFrame:
    """One status line per case: id, pass mark, dimensions, efficiency, failure category."""
    dims = [F.col(d).cast("string") for d in DIMENSIONS]
    verdict = F.when(F.col("judged"), F.concat_ws("/", *dims)).otherwise(F.lit("-/-/-"))
    category = F.when(F.col("judged"), F.coalesce("failure_category", F.lit(""))).otherwise(F.lit(""))
    return cases.withColumn(
        "line",
        F.concat(
            F.rpad(F.left("case_id", F.lit(28)), 28, " "), F.lit(" "),
            F.when(F.col("exec_match"), F.lit("✓")).otherwise(F.lit("✗")),
            F.lit("  judge "), verdict, F.lit("   opt "),
            F.rpad(F.coalesce("optimization", F.lit("-")), 11, " "), F.lit(" "), category,
        ),
    )
