"""Scores of single cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.catalog.scorecards import CALIBRATION, SOUND, TITLE, TRUST
from evalspark.operators import scores

RATIO = "(agent_bytes - golden_bytes) * 1.0::DOUBLE / nullif(golden_bytes, 0)"
LABEL = f"""CASE WHEN NOT exec_match THEN 'n/a' WHEN golden_bytes = 0 THEN 'comparable'
  WHEN {RATIO} <= -0.10 THEN 'better' WHEN {RATIO} >= 0.10 THEN 'worse' ELSE 'comparable' END"""


@query("optimization_score", f"""
SELECT agent_name, case_id, golden_bytes, agent_bytes, {LABEL} AS optimization FROM {{case_runs}}""")
def optimization_score(t):
    return scores.score_efficiency(t.case_runs).select(
        "agent_name", "case_id", "golden_bytes", "agent_bytes", "optimization"
    )


@query("optimization_counts", f"""
SELECT {LABEL} AS optimization, count(*) AS cases FROM {{case_runs}} GROUP BY 1""")
def optimization_counts(t):
    return scores.score_efficiency(t.case_runs).groupBy("optimization").agg(F.count(F.lit(1)).alias("cases"))


@query("review_candidates", f"""
SELECT agent_name, case_id,
  coalesce(exec_match AND {SOUND} AND golden_bytes <> 0 AND {RATIO} <= -0.10, false) AS review,
  CASE WHEN NOT exec_match THEN 'results differ' WHEN NOT judged THEN 'no verdict'
    WHEN NOT {SOUND} THEN 'method not sound' WHEN golden_bytes = 0 THEN 'golden size unknown'
    WHEN {RATIO} <= -0.10 THEN concat('same result with -', CAST(round_even(abs({RATIO}) * 100, 0) AS BIGINT), '% bytes')
    ELSE 'not clearly cheaper' END AS reason
FROM {{case_runs}}""")
def review_candidates(t):
    return scores.review_candidates(t.case_runs).select("agent_name", "case_id", "review", "reason")


@query("case_with_category", f"""
SELECT agent_name, case_id, category, {TITLE} AS title, {TRUST} AS trust_critical, {CALIBRATION} AS calibration
FROM {{case_runs}}""")
def case_with_category(t):
    return scores.with_category(t.case_runs).select(
        "agent_name", "case_id", "category", "title", "trust_critical", "calibration"
    )


@query("bytes_guard", """
SELECT agent_name, case_id, agent_bytes * 1000 AS estimated_bytes,
  CASE WHEN agent_bytes * 1000 > 1073741824
    THEN concat('would scan ', format('{:.2f}', agent_bytes * 1000 / 1e9),
                ' GB — exceeds 1 GB ceiling') END AS reason
FROM {case_runs}""")
def bytes_guard(t):
    estimated = t.case_runs.withColumn("estimated_bytes", F.col("agent_bytes") * 1000)
    return scores.bytes_guard(estimated, "estimated_bytes").select(
        "agent_name", "case_id", "estimated_bytes", "reason"
    )


@query("case_status", """
SELECT agent_name, case_id,
  CASE WHEN case_pos % 97 = 0 THEN 'peak_sql: dry-run failed' WHEN case_pos % 89 = 0 THEN 'agent_sql: execution failed'
       WHEN case_pos % 83 = 0 THEN 'judge: bad json' END AS error,
  (case_pos % 7 <> 0 AND case_pos % 97 <> 0 AND case_pos % 89 <> 0) AS exec_match,
  (case_pos % 97 <> 0 AND case_pos % 89 <> 0 AND case_pos % 83 <> 0) AS judged
FROM {case_runs}""")
def case_status(t):
    pos = F.col("case_pos")
    outcomes = t.case_runs.select(
        "agent_name", "case_id",
        F.when(pos % 97 == 0, "dry-run failed").alias("golden_error"),
        F.when(pos % 89 == 0, "execution failed").alias("agent_error"),
        F.when(pos % 83 == 0, "bad json").alias("judge_error"),
        (pos % 7 != 0).alias("matched"),
    )
    return scores.case_status(outcomes).select("agent_name", "case_id", "error", "exec_match", "judged")


@query("case_lines", f"""
SELECT agent_name, case_id, concat(rpad(left(case_id, 28), 28, ' '), ' ',
  CASE WHEN exec_match THEN '✓' ELSE '✗' END, '  judge ',
  CASE WHEN judged THEN concat_ws('/', factual_accuracy, completeness, no_hallucination) ELSE '-/-/-' END,
  '   opt ', rpad({LABEL}, 11, ' '), ' ',
  CASE WHEN judged AND NOT exec_match THEN 'wrong_filter' ELSE '' END) AS line
FROM {{case_runs}}""")
def case_lines(t):
    cases = scores.score_efficiency(t.case_runs).withColumn(
        "failure_category", F.when(~F.col("exec_match"), F.lit("wrong_filter"))
    )
    return scores.case_lines(cases).select("agent_name", "case_id", "line")
