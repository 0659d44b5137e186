"""Aggregates, verdicts and failure breakdowns over the case-run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.plans import scorecard as S

AGENT = ["agent_name"]

# shared pieces of the checks
TRUST = ("category IN ('schema_selection', 'business_logic', 'temporal_logic', 'silent_wrongness', "
         "'hallucination_resistance', 'reasoning_faithfulness')")
CALIBRATION = "category IN ('ambiguity_handling', 'refusal_scope')"
SOUND = "(judged AND factual_accuracy = 1 AND completeness = 1 AND no_hallucination = 1)"
FAILED = f"(NOT exec_match AND NOT ({CALIBRATION} AND {SOUND}))"
RATIO = ("CASE WHEN exec_match AND golden_bytes > 0 AND agent_bytes > 0 "
         "THEN least(golden_bytes * 1.0::DOUBLE / agent_bytes, 1.0) END")
COUNTS = f"""SELECT agent_name, count(*) AS cases,
  count(*) FILTER (WHERE tier = 'T1' AND exec_match) AS headline_passed,
  count(*) FILTER (WHERE tier = 'T1') AS headline_total,
  count(*) FILTER (WHERE {TRUST} AND exec_match) AS trust_passed,
  count(*) FILTER (WHERE {TRUST}) AS trust_total,
  count(*) FILTER (WHERE {CALIBRATION} AND {SOUND}) AS calibration_passed,
  count(*) FILTER (WHERE {CALIBRATION}) AS calibration_total,
  median({RATIO}) AS efficiency_median,
  sum(CASE WHEN judged THEN factual_accuracy + completeness + no_hallucination END) * 1.0::DOUBLE
    / nullif(count(*) FILTER (WHERE judged), 0) AS faithfulness
FROM {{case_runs}} GROUP BY agent_name"""
RATED = f"""SELECT *, headline_passed * 1.0::DOUBLE / nullif(headline_total, 0) AS headline_rate,
  trust_passed * 1.0::DOUBLE / nullif(trust_total, 0) AS trust_rate,
  calibration_passed * 1.0::DOUBLE / nullif(calibration_total, 0) AS calibration_rate
FROM ({COUNTS})"""


def _status(name: str, bar: str) -> str:
    return f"CASE WHEN {name}_rate IS NULL THEN 'na' WHEN {name}_rate >= {bar} THEN 'ok' ELSE 'warn' END"


STATUSED = f"""SELECT *, {_status('headline', '0.90')} AS headline_status,
  {_status('trust', '0.85')} AS trust_status, {_status('calibration', '0.80')} AS calibration_status,
  concat_ws(', ', CASE WHEN headline_total < 5 THEN 'headline' END,
            CASE WHEN trust_total < 5 THEN 'trust-critical' END,
            CASE WHEN calibration_total < 5 THEN 'calibration' END) AS insufficient
FROM ({RATED})"""
JUDGED = f"""SELECT *, CASE WHEN insufficient <> '' THEN 'incomplete'
  WHEN trust_status = 'warn' OR calibration_status = 'warn' THEN 'do_not_promote'
  WHEN headline_status = 'warn' THEN 'investigate' ELSE 'promote' END AS verdict
FROM ({STATUSED})"""
FAILURES = f"""SELECT agent_name, category, count(*) AS failures, min(case_pos) AS first_pos
FROM {{case_runs}} WHERE {FAILED} GROUP BY agent_name, category"""
TOP = f"""SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY failures DESC, first_pos) AS place
FROM ({FAILURES}) QUALIFY place <= 3"""


def aggregate_check(name: str, condition: str, passed: str, bar: str) -> str:
    return f"""SELECT agent_name, {name}_passed, {name}_total, round({name}_rate, 9) AS {name}_rate,
  {_status(name, bar)} AS {name}_status FROM (
  SELECT agent_name, count(*) FILTER (WHERE {condition} AND {passed}) AS {name}_passed,
    count(*) FILTER (WHERE {condition}) AS {name}_total,
    count(*) FILTER (WHERE {condition} AND {passed}) * 1.0::DOUBLE
      / nullif(count(*) FILTER (WHERE {condition}), 0) AS {name}_rate
  FROM {{case_runs}} GROUP BY agent_name)"""


def _one_aggregate(t, name: str):
    rated = S.with_rates(S.pass_counts(t.case_runs, AGENT, [name]), [name])
    return rated.withColumn(f"{name}_rate", F.round(f"{name}_rate", 9))


@query("headline", aggregate_check("headline", "tier = 'T1'", "exec_match", "0.90"))
def headline(t):
    return _one_aggregate(t, "headline")


@query("trust_critical", aggregate_check("trust", TRUST, "exec_match", "0.85"))
def trust_critical(t):
    return _one_aggregate(t, "trust")


@query("calibration", aggregate_check("calibration", CALIBRATION, SOUND, "0.80"))
def calibration(t):
    return _one_aggregate(t, "calibration")


@query("failures_by_category", FAILURES)
def failures_by_category(t):
    return S.failures_by_category(t.case_runs, AGENT)


@query("failures_top3", TOP)
def failures_top3(t):
    return S.top_failures(S.failures_by_category(t.case_runs, AGENT), AGENT)


@query("efficiency_median", f"""
SELECT agent_name, round(median({RATIO}), 9) AS efficiency_median FROM {{case_runs}}
GROUP BY agent_name HAVING count({RATIO}) > 0""")
def efficiency_median(t):
    return S.efficiency_median(t.case_runs, AGENT).withColumn(
        "efficiency_median", F.round("efficiency_median", 9)
    )


@query("faithfulness", f"SELECT agent_name, round(faithfulness, 9) AS faithfulness FROM ({COUNTS})")
def faithfulness(t):
    return S.faithfulness(t.case_runs, AGENT).withColumn("faithfulness", F.round("faithfulness", 9))


@query("scorecard", f"""
SELECT c.agent_name, cases, headline_passed, headline_total, trust_passed, trust_total, calibration_passed,
  calibration_total, round(faithfulness, 9) AS faithfulness, round(efficiency_median, 9) AS efficiency_median,
  coalesce(f.top_failures, '') AS top_failures, round(headline_rate, 9) AS headline_rate, headline_status,
  round(trust_rate, 9) AS trust_rate, trust_status, round(calibration_rate, 9) AS calibration_rate,
  calibration_status, insufficient, verdict
FROM ({JUDGED}) c LEFT JOIN (
  SELECT agent_name, string_agg(concat(category, ' (', failures, ')'), ', ' ORDER BY place) AS top_failures
  FROM ({TOP}) GROUP BY agent_name) f ON c.agent_name = f.agent_name""")
def scorecard(t):
    card = S.scorecard(t.case_runs)
    rounded = ["faithfulness", "efficiency_median", "headline_rate", "trust_rate", "calibration_rate"]
    return card.withColumns({c: F.round(c, 9) for c in rounded})


@query("insufficient", f"""
SELECT agent_name, headline_total, trust_total, calibration_total, insufficient FROM ({STATUSED})""")
def insufficient(t):
    rated = S.with_verdict(S.with_rates(S.pass_counts(t.case_runs, AGENT)))
    return rated.select("agent_name", "headline_total", "trust_total", "calibration_total", "insufficient")


@query("verdict", f"SELECT agent_name, headline_status, trust_status, calibration_status, verdict FROM ({JUDGED})")
def verdict(t):
    rated = S.with_verdict(S.with_rates(S.pass_counts(t.case_runs, AGENT)))
    return rated.select("agent_name", "headline_status", "trust_status", "calibration_status", "verdict")


def _line(name: str, label: str, bar: str, bar_text: str) -> str:
    return f"""CASE WHEN {name}_total = 0 THEN '{label}: — (no cases)' ELSE concat('{label}: ',
      CAST(round_even({name}_rate * 100, 0) AS BIGINT), '% (', {name}_passed, '/', {name}_total, ')',
      CASE WHEN {name}_rate >= {bar} THEN '  ✓' ELSE '  ⚠ below {bar_text}' END) END"""


LINES = f"""SELECT agent_name, CAST(0 AS BIGINT) AS pos,
    {_line('headline', 'Headline correctness (T1)', '0.90', '90%')} AS line FROM ({JUDGED})
  UNION ALL SELECT agent_name, 1, {_line('trust', 'Trust-critical correctness', '0.85', '85%')} FROM ({JUDGED})
  UNION ALL SELECT agent_name, 2,
    {_line('calibration', 'Calibration (uncertainty / refusal)', '0.80', '80%')} FROM ({JUDGED})
  UNION ALL SELECT agent_name, 3, CASE verdict
    WHEN 'incomplete' THEN concat('VERDICT: incomplete — aggregate(s) below minimum case count (5): ', insufficient,
      '. Corpus is too thin to support a ship/no-ship claim.')
    WHEN 'promote' THEN 'VERDICT: ok to promote — all aggregates above threshold.'
    WHEN 'do_not_promote' THEN 'VERDICT: do not promote — trust-critical or calibration below threshold; investigate before re-scoring.'
    ELSE 'VERDICT: investigate — headline correctness below threshold but trust-critical and calibration look ok.' END
  FROM ({JUDGED})"""


@query("scorecard_lines", LINES)
def scorecard_lines(t):
    rated = S.with_verdict(S.with_rates(S.pass_counts(t.case_runs, AGENT)))
    return S.scorecard_lines(rated)


TITLE = """CASE category WHEN 'translation_correctness' THEN 'Translation correctness'
  WHEN 'schema_selection' THEN 'Schema selection' WHEN 'business_logic' THEN 'Business logic & domain knowledge'
  WHEN 'temporal_logic' THEN 'Temporal & calendar logic' WHEN 'silent_wrongness' THEN 'Silent-wrongness traps'
  WHEN 'ambiguity_handling' THEN 'Ambiguity handling' WHEN 'hallucination_resistance' THEN 'Hallucination resistance'
  WHEN 'refusal_scope' THEN 'Refusal & scope awareness' WHEN 'efficiency' THEN 'Efficiency / cost'
  WHEN 'reasoning_faithfulness' THEN 'Reasoning faithfulness'
  WHEN 'consistency_rephrasing' THEN 'Consistency under rephrasing' ELSE 'Adversarial / robustness' END"""


@query("failure_shares", f"""
SELECT agent_name, place, category, {TITLE} AS title, failures, round(share, 9) AS share,
  concat(CAST(round_even(share * 100, 0) AS BIGINT), '%') AS share_text,
  concat(repeat('█', CAST(round_even(share * 20, 0) AS BIGINT)),
         repeat('░', 20 - CAST(round_even(share * 20, 0) AS BIGINT))) AS bar
FROM (SELECT *, failures * 1.0::DOUBLE / sum(failures) OVER (PARTITION BY agent_name) AS share FROM ({TOP}))""")
def failure_shares(t):
    shares = S.failure_shares(S.failures_by_category(t.case_runs, AGENT), AGENT)
    return shares.withColumn("share", F.round("share", 9))
