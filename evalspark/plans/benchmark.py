"""A benchmark run: pair, execute, compare, judge, score, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.operators import corpus as C, diff
from evalspark.operators.ordering import null_safe_join
from evalspark.operators.scores import case_status, optimization_label
from evalspark.plans.scorecard import scorecard
from evalspark.session import scratch_path
from evalspark.sources.sql_runner import execute_texts

CASE_KEYS = ["agent_name", "case_id"]
SHARED = "_golden"  # stands for the agent where a result belongs to all of them
VERDICT_COLUMNS = ("factual_accuracy", "completeness", "no_hallucination", "failure_category", "reasoning", "judge_error")


def score_cases(pairs: DataFrame, diffs: DataFrame, stats: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The case-run table: every paired case with match, errors, verdict and efficiency.

    ``stats`` has ``golden_bytes``, ``agent_bytes``, ``golden_error``,
    ``agent_error`` per case, ``verdicts`` the judge columns and ``judge_error``.
    """
    rows = pairs
    for part in (diffs.select(*CASE_KEYS, "matched", "summary", "detail"), stats, verdicts):
        rows = null_safe_join(rows, part, CASE_KEYS, "left")
    rows = rows.withColumns({
        "matched": F.coalesce("matched", F.lit(False)),
        "judge_error": F.when(
            F.col("factual_accuracy").isNull(), F.coalesce("judge_error", F.lit("no verdict"))
        ),
    })
    scored = case_status(rows)
    failed_query = F.col("golden_error").isNotNull() | F.col("agent_error").isNotNull()
    return scored.withColumn("optimization", F.when(~failed_query, optimization_label())).drop(
        "matched", "golden_error", "agent_error", "judge_error"
    )


def execute_pairs(
    pairs: DataFrame, row_cap: int | None = None, max_bytes: int | None = None, width: int = 8, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run both SQL texts of every pair; (encoded result rows, statistics).

    A golden text shared by several agents runs once. Agent texts follow where the
    golden query of their case left a result, which its statistics tell.
    """
    path = path or scratch_path(pairs.sparkSession, "results")
    golden = pairs.select(
        F.lit(diff.GOLDEN).alias("side"), F.lit(SHARED).alias("agent_name"), "case_id", F.col("golden_sql").alias("sql")).distinct()
    golden_rows, golden_stats = execute_texts(golden, f"{path}/golden", width, row_cap, max_bytes)
    ran = golden_stats.filter("error IS NULL").select("case_id").distinct()  # a failed golden query ends the case
    agent = pairs.join(ran, "case_id", "left_semi").select(
        F.lit(diff.AGENT).alias("side"), "agent_name", "case_id", F.col("agent_sql").alias("sql"))
    agent_rows, agent_stats = execute_texts(agent, f"{path}/agent", width, row_cap, max_bytes)
    return golden_rows.unionByName(agent_rows), golden_stats.unionByName(agent_stats)


def compare_results(pairs: DataFrame, rows: DataFrame, statistics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(diffs, stats per case) from executed results; goldens are shared by all agents."""
    cases = pairs.select(*CASE_KEYS)

    def spread(frame: DataFrame) -> DataFrame:
        golden = frame.filter(F.col("side") == diff.GOLDEN).drop("agent_name").join(cases, "case_id")
        agent = frame.filter(F.col("side") == diff.AGENT)
        return golden.select(*frame.columns).union(agent)

    wide = spread(statistics)
    ran = wide.filter(F.col("error").isNull())
    both = ran.groupBy(*CASE_KEYS).agg(F.count(F.lit(1)).alias("_sides")).filter(F.col("_sides") == 2).drop("_sides")
    layouts = null_safe_join(ran.select(*CASE_KEYS, "side", "cols"), both, CASE_KEYS, "left_semi")
    diffs = diff.diff_batch(spread(rows), CASE_KEYS, [diff.CELLS], layouts)

    def pick(side: str, column: str) -> F.Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    stats = wide.groupBy(*CASE_KEYS).agg(
        pick(diff.GOLDEN, "bytes").alias("golden_bytes"), pick(diff.AGENT, "bytes").alias("agent_bytes"),
        pick(diff.GOLDEN, "duration_ms").alias("golden_ms"), pick(diff.AGENT, "duration_ms").alias("agent_ms"),
        pick(diff.GOLDEN, "n_rows").alias("golden_rows"), pick(diff.AGENT, "n_rows").alias("agent_rows"),
        pick(diff.GOLDEN, "error").alias("golden_error"), pick(diff.AGENT, "error").alias("agent_error"),
    )
    return diffs, stats


def run_benchmark(
    spark: SparkSession, goldens: DataFrame, inputs: DataFrame, verdicts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(case runs, scorecards) of all submissions in ``inputs``.

    ``verdicts`` are the judge's answers per (agent_name, case_id), for instance
    from ``judge_verdicts`` over collected responses.
    """
    pairs = C.pair_cases(goldens, inputs).withColumnRenamed("id", "case_id")
    rows, statistics = execute_pairs(pairs)
    diffs, stats = compare_results(pairs, rows, statistics)
    cases = score_cases(pairs, diffs, stats, verdicts.select(*CASE_KEYS, *VERDICT_COLUMNS))
    return cases, scorecard(cases)
