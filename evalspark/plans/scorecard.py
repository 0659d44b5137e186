"""Trust-weighted scorecards: every agent and run in one grouped plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.constants import (
    BAR_WIDTH, CALIBRATION_SLUGS, CALIBRATION_THRESHOLD, DIMENSIONS, GOLDEN_LABEL, HEADLINE_THRESHOLD,
    MIN_CASES_PER_AGGREGATE, TOP_FAILURE_CATEGORIES, TRUST_CRITICAL_SLUGS, TRUST_CRITICAL_THRESHOLD,
)
from evalspark.functions.quantile import unit_median
from evalspark.functions.stats import rate, wilson_bounds
from evalspark.functions.text import percent
from evalspark.operators.ordering import null_safe_join
from evalspark.operators.scores import category_dim, efficiency_ratio, is_failure, judge_passed

# aggregate: (name in lists, label in reports, threshold)
AGGREGATES = {
    "headline": ("headline", "Headline correctness (T1)", HEADLINE_THRESHOLD),
    "trust": ("trust-critical", "Trust-critical correctness", TRUST_CRITICAL_THRESHOLD),
    "calibration": ("calibration", "Calibration (uncertainty / refusal)", CALIBRATION_THRESHOLD),
}


def _members() -> dict[str, tuple[Column, Column]]:
    """Aggregate -> (case belongs to it, case passes it). One case may feed several."""
    match = F.col("exec_match")
    return {
        "headline": (F.col("tier") == "T1", match),
        "trust": (F.col("category").isin(*TRUST_CRITICAL_SLUGS), match),
        "calibration": (F.col("category").isin(*CALIBRATION_SLUGS), judge_passed()),
    }


def pass_counts(cases: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """Passed and total of the aggregates. Errored cases stay in every total."""
    members = _members()
    columns = []
    for name in names or list(AGGREGATES):
        belongs, passes = members[name]
        columns += [
            F.count_if(belongs & passes).alias(f"{name}_passed"),
            F.count_if(belongs).alias(f"{name}_total"),
        ]
    return cases.groupBy(*keys).agg(*columns)


def with_rates(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rate and ok / warn / na of every aggregate against its threshold."""
    added = {}
    for name in names or list(AGGREGATES):
        value = rate(F.col(f"{name}_passed"), F.col(f"{name}_total"))
        added[f"{name}_rate"] = value
        added[f"{name}_status"] = (
            F.when(value.isNull(), F.lit("na"))
            .when(value >= AGGREGATES[name][2], F.lit("ok"))
            .otherwise(F.lit("warn"))
        )
    return counts.withColumns(added)


def with_verdict(rated: DataFrame, minimum: int = MIN_CASES_PER_AGGREGATE) -> DataFrame:
    """Thin aggregates as text, and the verdict."""
    thin = F.array_compact(F.array(*[
        F.when(F.col(f"{name}_total") < minimum, F.lit(title)) for name, (title, _, _) in AGGREGATES.items()
    ]))
    below = {name: F.col(f"{name}_status") == "warn" for name in AGGREGATES}
    verdict = (
        F.when(F.col("insufficient") != "", F.lit("incomplete"))
        .when(below["trust"] | below["calibration"], F.lit("do_not_promote"))
        .when(below["headline"], F.lit("investigate"))
        .otherwise(F.lit("promote"))
    )
    return rated.withColumn("insufficient", F.array_join(thin, ", ")).withColumn("verdict", verdict)


def failures_by_category(cases: DataFrame, keys: list[str]) -> DataFrame:
    return (
        cases.filter(is_failure())
        .groupBy(*keys, "category")
        .agg(F.count(F.lit(1)).alias("failures"), F.min("case_pos").alias("first_pos"))
    )


def top_failures(failures: DataFrame, keys: list[str], top: int = TOP_FAILURE_CATEGORIES) -> DataFrame:
    """The largest failure categories per key, ties in order of first appearance."""
    order = Window.partitionBy(*keys).orderBy(F.desc("failures"), "first_pos")
    return failures.withColumn("place", F.row_number().over(order).cast("bigint")).filter(F.col("place") <= top)


def failure_shares(failures: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each top category among the top categories, with a bar."""
    top = top_failures(failures, keys)
    share = rate(F.col("failures"), F.sum("failures").over(Window.partitionBy(*keys)))
    filled = F.bround(share * BAR_WIDTH, 0).cast("int")
    return (
        top.withColumn("share", share)
        .join(F.broadcast(category_dim(failures.sparkSession)).select("category", "title"), "category", "left")
        .select(
            *keys, "place", "category", F.coalesce("title", "category").alias("title"), "failures",
            "share", percent(F.col("share")).alias("share_text"),
            F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(BAR_WIDTH) - filled)).alias("bar"),
        )
    )


def efficiency_median(cases: DataFrame, keys: list[str]) -> DataFrame:
    ratios = cases.withColumn("_ratio", efficiency_ratio())
    return unit_median(ratios, keys, "_ratio", "efficiency_median")


def faithfulness(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Mean number of passed dimensions (0..3) over the judged cases."""
    return cases.groupBy(*keys).agg(faithfulness_column().alias("faithfulness"))


def faithfulness_column() -> Column:
    passed = sum((F.when(F.col(d) != 0, 1).otherwise(0) for d in DIMENSIONS), F.lit(0))
    return rate(F.sum(F.when(F.col("judged"), passed)), F.count_if(F.col("judged")))


def scorecard(
    cases: DataFrame,
    keys: list[str] | None = None,
    minimum: int = MIN_CASES_PER_AGGREGATE,
    exclude_golden_errors: bool = False,
) -> DataFrame:
    """One row per agent: aggregates, efficiency, faithfulness, failures, verdict.

    Cases whose golden query failed count against the agent, as every case does;
    ``exclude_golden_errors`` leaves them out.
    """
    keys = keys or ["agent_name"]
    if exclude_golden_errors:
        cases = cases.filter(~F.coalesce(F.startswith("error", F.lit(f"{GOLDEN_LABEL}_sql:")), F.lit(False)))
    members = _members()
    sums = []
    for name, (belongs, passes) in members.items():
        sums += [F.count_if(belongs & passes).alias(f"{name}_passed"), F.count_if(belongs).alias(f"{name}_total")]
    passed = sum((F.when(F.col(d) != 0, 1).otherwise(0) for d in DIMENSIONS), F.lit(0))
    failed = is_failure()
    # one pass over the cases: everything but the median is a sum over the categories of a key
    per = cases.groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("cases"), *sums, F.sum(F.when(F.col("judged"), passed)).alias("_points"),
        F.count_if("judged").alias("_judged"), F.count_if(failed).alias("failures"), F.min(F.when(failed, F.col("case_pos"))).alias("first_pos"))
    names = ["cases", *[f"{name}_{part}" for name in members for part in ("passed", "total")], "_points", "_judged"]
    ranked = F.struct((-F.col("failures")).alias("order"), "first_pos", "category", "failures")
    base = per.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in names], F.array_sort(F.collect_list(F.when(F.col("failures") > 0, ranked))).alias("_top"))
    shown = F.transform(F.slice("_top", 1, TOP_FAILURE_CATEGORIES), lambda t: F.concat(
        t["category"], F.lit(" ("), t["failures"].cast("string"), F.lit(")")))
    base = base.withColumns({"faithfulness": rate(F.col("_points"), F.col("_judged")), "top_failures": F.array_join(shown, ", ")}).drop(
        "_points", "_judged", "_top")
    joined = null_safe_join(base, efficiency_median(cases, keys), keys, "left")
    return with_verdict(with_rates(joined), minimum)


def verdict_message(minimum: int = MIN_CASES_PER_AGGREGATE) -> Column:
    return (
        F.when(
            F.col("verdict") == "incomplete",
            F.concat(
                F.lit(f"VERDICT: incomplete — aggregate(s) below minimum case count ({minimum}): "),
                F.col("insufficient"), F.lit(". Corpus is too thin to support a ship/no-ship claim."),
            ),
        )
        .when(F.col("verdict") == "promote", F.lit("VERDICT: ok to promote — all aggregates above threshold."))
        .when(
            F.col("verdict") == "do_not_promote",
            F.lit("VERDICT: do not promote — trust-critical or calibration below threshold; "
                  "investigate before re-scoring."),
        )
        .otherwise(F.lit("VERDICT: investigate — headline correctness below threshold but "
                         "trust-critical and calibration look ok."))
    )


def aggregate_line(name: str) -> Column:
    """Label, rate, counts and mark of one aggregate as text."""
    _, label, threshold = AGGREGATES[name]
    value, passed, total = F.col(f"{name}_rate"), F.col(f"{name}_passed"), F.col(f"{name}_total")
    mark = F.when(value >= threshold, F.lit("  ✓")).otherwise(F.lit(f"  ⚠ below {threshold:.0%}"))
    return F.when(total == 0, F.lit(f"{label}: — (no cases)")).otherwise(
        F.concat(
            F.lit(f"{label}: "), percent(value), F.lit(" ("), passed.cast("string"), F.lit("/"),
            total.cast("string"), F.lit(")"), mark,
        )
    )


def scorecard_lines(cards: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The aggregate lines and the verdict of every scorecard, one row per line."""
    keys = keys or ["agent_name"]
    lines = F.array(*[aggregate_line(name) for name in AGGREGATES], verdict_message())
    return cards.select(*keys, F.posexplode(lines).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def wilson_verdict(cards: DataFrame) -> DataFrame:
    """Verdict that admits noise: no hard call while an interval straddles its threshold."""
    added, straddles = {}, F.lit(False)
    for name, (_, _, threshold) in AGGREGATES.items():
        low, high = wilson_bounds(F.col(f"{name}_passed"), F.col(f"{name}_total"))
        added[f"{name}_low"], added[f"{name}_high"] = low, high
        straddles = straddles | F.coalesce((low < threshold) & (high >= threshold), F.lit(True))
    honest = F.when(F.col("verdict") == "incomplete", F.lit("incomplete")).when(
        straddles, F.lit("investigate")
    ).otherwise(F.col("verdict"))
    return cards.withColumns(added).withColumn("honest_verdict", honest)
