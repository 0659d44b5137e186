"""Whole runs: scored case tables, reports, guarded SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.catalog.calibration import AGREED, GATES, LABEL as KAPPA_LABEL, LONG, kappa_check
from evalspark.catalog.cases import LABEL
from evalspark.catalog.results import SUMMARY, _diffs
from evalspark.catalog.scorecards import JUDGED, TOP, _line
from evalspark.operators import corpus as C
from evalspark.operators.scores import score_efficiency
from evalspark.plans import benchmark as B, reporting as R, scorecard as S
from evalspark.session import scratch_path
from evalspark.sources.sql_runner import execute_texts

AGENT = ["agent_name"]

SCORED = f"""SELECT 'agent' AS agent_name, s_suppkey AS case_id, s_name AS prompt,
    CASE WHEN s_suppkey % 19 = 0 THEN 'peak_sql: dry-run failed' WHEN s_suppkey % 17 = 0 THEN 'agent_sql: timeout'
      WHEN s_suppkey % 13 = 0 THEN 'judge: bad json' WHEN s_suppkey % 11 = 0 THEN 'judge: no verdict' END AS error,
    d.matched AND s_suppkey % 19 <> 0 AND s_suppkey % 17 <> 0 AS exec_match,
    s_suppkey % 19 <> 0 AND s_suppkey % 17 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 11 <> 0 AS judged,
    CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 11 <> 0 THEN s_nationkey % 2 END AS factual_accuracy,
    d.summary, s_nationkey * 100 AS golden_bytes, s_nationkey * (80 + s_suppkey % 41) AS agent_bytes
  FROM supplier JOIN ({SUMMARY}) d ON d.case_id = s_suppkey"""


@query("score_cases", f"""
SELECT *, CASE WHEN error IS NULL OR error LIKE 'judge%' THEN {LABEL} END AS optimization
FROM ({SCORED})""")
def score_cases(t):
    supplier, key = t.supplier, F.col("s_suppkey")
    tags = [F.lit("agent").alias("agent_name"), key.alias("case_id")]
    pairs = supplier.select(*tags, F.col("s_name").alias("prompt"))
    diffs = _diffs(t).withColumn("agent_name", F.lit("agent"))
    stats = supplier.select(
        *tags, (F.col("s_nationkey") * 100).alias("golden_bytes"),
        (F.col("s_nationkey") * (80 + key % 41)).alias("agent_bytes"),
        F.when(key % 19 == 0, "dry-run failed").alias("golden_error"),
        F.when(key % 17 == 0, "timeout").alias("agent_error"),
    )
    bad = (key % 13 == 0) | (key % 11 == 0)
    score = F.when(~bad, F.col("s_nationkey") % 2)
    verdicts = supplier.select(
        *tags, score.alias("factual_accuracy"), score.alias("completeness"), F.when(~bad, 1).alias("no_hallucination"),
        F.lit(None).cast("string").alias("failure_category"), F.lit("").alias("reasoning"),
        F.when(key % 13 == 0, "bad json").alias("judge_error"),
    )
    return B.score_cases(pairs, diffs, stats, verdicts).select(
        "agent_name", "case_id", "prompt", "error", "exec_match", "judged", "factual_accuracy", "summary",
        "golden_bytes", "agent_bytes", "optimization",
    )


def reported_cases(t):
    pos = F.col("case_pos")
    return score_efficiency(t.case_runs).withColumns({
        "summary": F.when(~F.col("exec_match"), F.concat(F.lit("values differ in "), (pos % 7).cast("string"), F.lit(" rows"))),
        "detail": F.when(pos % 5 == 0, F.lit("first\nsecond")).otherwise(F.lit("")),
        "failure_category": F.when(~F.col("exec_match"), F.lit("wrong_filter")),
        "reasoning": F.concat(F.lit("because of "), "domain"),
        "golden_ms": pos % 900, "agent_ms": pos % 800, "golden_rows": pos % 50, "agent_rows": pos % 40,
    })


MB = "format('{{:.1f}}', {side}_bytes / 1e6)"


def _query_line(side: str, label: str, ms: int, rows: int) -> str:
    return f"""CASE WHEN error IS NULL THEN concat('**{label} query:** ', case_pos % {ms}, ' ms · ', {MB.format(side=side)},
      ' MB scanned · ', case_pos % {rows}, ' rows') END"""


CASE_LINES = f"""[concat('### ', case_id, '  ·  ', tier, '  ·  ', category), '', concat('**Prompt:** ', prompt), '',
  CASE WHEN error IS NOT NULL THEN concat('**❌ Error:** ', error) END, CASE WHEN error IS NOT NULL THEN '' END,
  CASE WHEN error IS NULL THEN concat('**execution_match:** ', CASE WHEN exec_match THEN 'True' ELSE 'False' END) END,
  CASE WHEN error IS NULL AND NOT exec_match THEN '' END,
  CASE WHEN error IS NULL AND NOT exec_match THEN concat('**exec-diff:** values differ in ', case_pos % 7, ' rows') END,
  CASE WHEN error IS NULL AND NOT exec_match AND case_pos % 5 = 0 THEN '' END,
  CASE WHEN error IS NULL AND NOT exec_match AND case_pos % 5 = 0 THEN '```' END,
  CASE WHEN error IS NULL AND NOT exec_match AND case_pos % 5 = 0 THEN concat('first', chr(10), 'second') END,
  CASE WHEN error IS NULL AND NOT exec_match AND case_pos % 5 = 0 THEN '```' END,
  CASE WHEN error IS NULL THEN '' END,
  CASE WHEN error IS NULL AND judged THEN concat('**Judge:** factual=', factual_accuracy, ', complete=', completeness,
    ', no_halluc=', no_hallucination) END,
  CASE WHEN error IS NULL AND judged AND NOT exec_match THEN '**Failure category:** `wrong_filter`' END,
  CASE WHEN error IS NULL AND judged THEN '' END,
  CASE WHEN error IS NULL AND judged THEN concat('**Judge reasoning:** because of ', domain) END,
  CASE WHEN error IS NULL AND judged THEN '' END,
  CASE WHEN error IS NULL THEN concat('**Optimization:** `', {LABEL}, '`') END, CASE WHEN error IS NULL THEN '' END,
  {_query_line('golden', 'peak', 900, 50)}, {_query_line('agent', 'agent', 800, 40)}, CASE WHEN error IS NULL THEN '' END]"""
HEADER_LINES = f"""[concat('# Benchmark run — ', agent_name, ' — 2001-08-01'), '', concat('- **Agent:** `', agent_name, '`'),
  concat('- **Cases scored:** ', cases), '- **Judge model:** judge-one', '- **JUDGE_PROMPT hash:** `0f1e2d3c`',
  CASE WHEN cases % 2 = 0 THEN concat('- **Usage:** ', cases, ' calls') END, '',
  '## Trust-weighted scorecard', '',
  concat('- **', {_line('headline', 'Headline correctness (T1)', '0.90', '90%')}, '**'),
  concat('- **', {_line('trust', 'Trust-critical correctness', '0.85', '85%')}, '**'),
  concat('- **', {_line('calibration', 'Calibration (uncertainty / refusal)', '0.80', '80%')}, '**'),
  '- **Efficiency ratio (median, on correct):** ' || format('{{:.2f}}', efficiency_median),
  '- **Reasoning faithfulness (judge avg):** ' || format('{{:.2f}}', faithfulness) || ' / 3',
  '- **Failures concentrated in:** ' || top_failures, '', concat('> ', CASE verdict
    WHEN 'incomplete' THEN concat('VERDICT: incomplete — aggregate(s) below minimum case count (5): ', insufficient,
      '. Corpus is too thin to support a ship/no-ship claim.')
    WHEN 'promote' THEN 'VERDICT: ok to promote — all aggregates above threshold.'
    WHEN 'do_not_promote' THEN 'VERDICT: do not promote — trust-critical or calibration below threshold; investigate before re-scoring.'
    ELSE 'VERDICT: investigate — headline correctness below threshold but trust-critical and calibration look ok.' END), '']"""
TITLES = """SELECT unnest(['translation_correctness', 'schema_selection', 'business_logic', 'temporal_logic', 'silent_wrongness',
    'ambiguity_handling', 'hallucination_resistance', 'refusal_scope', 'efficiency', 'reasoning_faithfulness',
    'consistency_rephrasing', 'adversarial_robustness']) AS category,
  unnest(['Translation correctness', 'Schema selection', 'Business logic & domain knowledge', 'Temporal & calendar logic',
    'Silent-wrongness traps', 'Ambiguity handling', 'Hallucination resistance', 'Refusal & scope awareness', 'Efficiency / cost',
    'Reasoning faithfulness', 'Consistency under rephrasing', 'Adversarial / robustness']) AS title"""
TOP_TEXT = f"""SELECT agent_name, string_agg(concat(title, ' (', failures, ')'), ', ' ORDER BY place) AS top_failures
  FROM ({TOP}) JOIN ({TITLES}) USING (category) GROUP BY agent_name"""
LOOSE = """SELECT concat('agent_', CAST(doc_id % 5 AS STRING)) AS agent_name, CASE WHEN toxic = 1 THEN 'extra' ELSE 'unanswered' END AS kind,
  concat('doc_', CAST(doc_id AS STRING)) AS id, doc_id AS case_pos FROM {labels} WHERE quality = 0 OR toxic = 1"""


@query("report_lines", f"""
SELECT * FROM (
  SELECT agent_name, CAST(2 AS BIGINT) AS section, case_pos AS pos, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
  FROM (SELECT *, list_filter({CASE_LINES}, lambda x: x IS NOT NULL) AS ls FROM {{case_runs}})
  UNION ALL SELECT agent_name, 0, 0, unnest(range(len(ls))), unnest(ls)
  FROM (SELECT *, {HEADER_LINES} AS ls FROM ({JUDGED}) j LEFT JOIN ({TOP_TEXT}) f USING (agent_name))
  UNION ALL SELECT agent_name, 1, 2, unnest([0, 1]), unnest(['## Per-case detail', '']) FROM (SELECT DISTINCT agent_name FROM {{case_runs}})
  UNION ALL SELECT agent_name, 1, CASE kind WHEN 'extra' THEN 1 ELSE 0 END, unnest([0, 1]), unnest([concat(CASE kind WHEN 'extra'
      THEN '⚠ **Agent inputs without matching golden:** ' ELSE '⚠ **Prompts not answered by agent:** ' END, ids), ''])
  FROM (SELECT agent_name, kind, string_agg(id, ', ' ORDER BY case_pos) AS ids FROM ({LOOSE}) GROUP BY agent_name, kind))
WHERE line IS NOT NULL""")
def report_lines(t):
    cards = S.scorecard(t.case_runs).withColumns({
        "finished_at": F.lit("2001-08-01"), "judge_model": F.lit("judge-one"), "judge_prompt_hash": F.lit("0f1e2d3c"),
        "usage": F.when(F.col("cases") % 2 == 0, F.concat(F.col("cases").cast("string"), F.lit(" calls")))})
    loose = t.spark.sql(LOOSE, labels=t.labels)
    return R.report_lines(reported_cases(t), cards, AGENT, C.id_lists(loose, ["agent_name", "kind"]))


TRIPLE = "concat('(', {s}_factual_accuracy, ',', {s}_completeness, ',', {s}_no_hallucination, ')')"
PLACE = "CASE dim WHEN 'factual_accuracy' THEN 0 WHEN 'completeness' THEN 1 ELSE 2 END"
PREVIEW = "translate(CASE WHEN length(reasoning) > 90 THEN concat(left(reasoning, 90), '...') ELSE reasoning END, chr(10), ' ')"
GATE = f"""SELECT coalesce(string_agg(CASE WHEN low_agreement THEN dim END, ', ' ORDER BY dim), '') AS below_agreement,
  coalesce(string_agg(CASE WHEN low_kappa THEN dim END, ', ' ORDER BY dim), '') AS below_kappa FROM ({GATES})"""
OVERALL = f"SELECT sum({AGREED}) AS agreed, count(*) * 4 AS possible FROM {{calibration_cases}}"


@query("calibration_report_lines", f"""
SELECT CAST(section AS BIGINT) AS section, CAST(pos AS BIGINT) AS pos, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT 0 AS section, 0 AS pos, unnest([0, 1, 2]) AS line_no, unnest(['# Judge calibration run', '', concat('**Overall agreement:** ',
    CAST(round_even(agreed * 100.0::DOUBLE / possible, 0) AS BIGINT), '% (', agreed, '/', possible, ')')]) AS line FROM ({OVERALL})
  UNION ALL SELECT 1, 0, unnest([0, 1, 2, 3]), unnest([
    CASE WHEN below_agreement <> '' THEN concat('**⚠ Below 85% threshold:** ', below_agreement) END,
    CASE WHEN below_agreement = '' AND below_kappa = '' THEN 'Gate: all dimensions clear both bars'
      WHEN below_kappa = '' THEN concat('Gate: ', below_agreement, ' below 85% raw agreement')
      ELSE concat('Gate: ', below_kappa, ' below κ=0.60') END, '', '| dimension | agreed | rate | kappa | label |'])
  FROM ({GATE})
  UNION ALL SELECT 2, {PLACE} + 1, 0, concat('| ', dim, ' | ', agreed, '/', n, ' | ',
    CAST(round_even(agreed * 100.0::DOUBLE / n, 0) AS BIGINT), '% | ', format('{{:.2f}}', kappa), ' | ', {KAPPA_LABEL}, ' |')
  FROM ({kappa_check('dim', f'({LONG})')})
  UNION ALL SELECT 3, case_id, {PLACE}, concat('| ', case_id, ' | ', dim, ' | ', human, ' | ', judge, ' | ', {PREVIEW}, ' |')
  FROM ({LONG}) WHERE human <> judge
  UNION ALL SELECT 4, case_id, 0, concat('| ', case_id, ' | ', {TRIPLE.format(s='human')}, ' | ', {TRIPLE.format(s='judge')}, ' | ',
    {AGREED} - CASE WHEN human_category IS NOT DISTINCT FROM judge_category THEN 1 ELSE 0 END, ' |') FROM {{calibration_cases}}
  UNION ALL SELECT 5, case_id, unnest([0, 1, 2, 3]), unnest([concat('### ', case_id), '', concat('- **Reasoning:** ', reasoning), ''])
  FROM {{calibration_cases}}) WHERE line IS NOT NULL""")
def calibration_report_lines(t):
    return R.calibration_report_lines(t.calibration_cases)


# one SQL text per nation, of five kinds: two that run, a write, a typo, a comment
NATION_SQL = """CASE n_nationkey % 5
  WHEN 0 THEN concat('SELECT c_mktsegment, count(*) AS n FROM {table} WHERE c_nationkey = ', n_nationkey, ' GROUP BY 1;')
  WHEN 1 THEN concat('-- all of them', char(10), 'SELECT * FROM {table} WHERE c_nationkey = ', n_nationkey)
  WHEN 2 THEN 'DROP TABLE {table}' WHEN 3 THEN 'SELECT no_such_column FROM {table}' ELSE '-- nothing to select' END"""


@query("run_query_stats", """
SELECT n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN coalesce(segments, 0) WHEN 1 THEN coalesce(customers, 0) END AS row_count,
  CASE n_nationkey % 5 WHEN 0 THEN true WHEN 1 THEN true END AS scanned,
  CASE n_nationkey % 5 WHEN 0 THEN 2 WHEN 1 THEN (SELECT count(*) FROM (DESCRIBE {customer})) END AS n_cols,
  CASE n_nationkey % 5 WHEN 2 THEN 'only SELECT/WITH' WHEN 3 THEN 'dry-run failed: UNRESOLVED_COLUMN.WITH_SUGGESTION'
    WHEN 4 THEN 'empty SQL' END AS error
FROM {nation} LEFT JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS segments, count(*) AS customers
  FROM {customer} GROUP BY c_nationkey) ON c_nationkey = n_nationkey""")
def run_query_stats(t):
    """Guarded execution of a table of SQL texts over the customers, several side by side."""
    name = f"evalspark_customer_{uuid.uuid4().hex}"
    t.customer.createOrReplaceTempView(name)
    texts = t.nation.select(F.col("n_name").alias("name"), F.expr(NATION_SQL.replace("{table}", name)).alias("sql"))
    stats = execute_texts(texts, scratch_path(t.spark, "texts"))[1]
    t.spark.catalog.dropTempView(name)
    return stats.select(
        "name", F.col("n_rows").alias("row_count"), (F.col("bytes") > 0).alias("scanned"), F.size("cols").cast("bigint").alias("n_cols"),
        F.regexp_extract("error", "^(only SELECT/WITH|[^(]*)", 1).alias("error"))
