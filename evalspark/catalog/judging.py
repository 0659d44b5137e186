"""Judge requests, answers, cost and budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.catalog.results import KEYS, SUMMARY, VALUES, _diffs
from evalspark.operators import judging as J

# shared pieces of the checks
FENCE = "(?s)```(?:json)?\\s*(.*?)\\s*```"
RAW = """CASE wrapping WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```')
  ELSE concat('My verdict: ', body, ' That is all.') END"""


def json_text(raw: str) -> str:
    inner = f"CASE WHEN regexp_matches({raw}, '{FENCE}') THEN regexp_extract({raw}, '{FENCE}', 1) ELSE {raw} END"
    return f"nullif(regexp_extract({inner}, '(?s)\\{{{{.*\\}}}}', 0), '')".replace("{{", "{").replace("}}", "}")


@query("judge_usage", """
SELECT run_id, calls, input_tokens, output_tokens, round(cost, 9) AS cost_usd,
  concat(calls, ' calls, ', format('{:,}', input_tokens), ' in / ', format('{:,}', output_tokens), ' out tokens, ~$',
    format('{:.4f}', cost)) AS usage
FROM (SELECT run_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  (sum(input_tokens) * 3.0::DOUBLE + sum(output_tokens) * 15.0::DOUBLE) / 1000000 AS cost
  FROM {judge_log} GROUP BY run_id)""")
def judge_usage(t):
    return J.judge_usage(t.judge_log, ["run_id"]).withColumn("cost_usd", F.round("cost_usd", 9))


@query("judge_budget", """
SELECT run_id, call_id, row_number() OVER (PARTITION BY run_id ORDER BY called_at, call_id) <= 75 AS allowed
FROM {judge_log}""")
def judge_budget(t):
    return J.judge_budget(t.judge_log, "run_id", ["called_at", "call_id"]).select("run_id", "call_id", "allowed")


@query("extract_json", f"""
SELECT call_id, {json_text('response')} AS json, CAST(json_extract_string({json_text('response')}, '$.k') AS BIGINT) AS k
FROM {{judge_log}}""")
def extract_json(t):
    found = J.extract_json(t.judge_log.select("call_id", "response"), "response", "json").drop("response")
    return found.withColumn("k", F.get_json_object("json", "$.k").cast("bigint"))


@query("judge_verdicts", f"""
WITH parsed AS (SELECT call_id, {json_text('raw')} AS j FROM (SELECT call_id, {RAW} AS raw FROM {{judge_answers}})),
dims AS (SELECT call_id, j, CAST(json_extract_string(j, '$.factual_accuracy') AS INTEGER) AS f,
  CAST(json_extract_string(j, '$.completeness') AS INTEGER) AS c, CAST(json_extract_string(j, '$.no_hallucination') AS INTEGER) AS n
  FROM parsed),
checked AS (SELECT *, CASE WHEN j IS NULL THEN 'no JSON object' WHEN f IS NULL THEN 'missing factual_accuracy'
  WHEN c IS NULL THEN 'missing completeness' WHEN n IS NULL THEN 'missing no_hallucination' END AS error FROM dims)
SELECT call_id, error, CASE WHEN error IS NULL THEN f END AS factual_accuracy, CASE WHEN error IS NULL THEN c END AS completeness,
  CASE WHEN error IS NULL THEN n END AS no_hallucination,
  CASE WHEN error IS NULL AND json_extract_string(j, '$.failure_category') IN ('wrong_join', 'time_window')
    THEN json_extract_string(j, '$.failure_category') END AS failure_category,
  CASE WHEN error IS NULL THEN coalesce(json_extract_string(j, '$.reasoning'), '') END AS reasoning
FROM checked""")
def judge_verdicts(t):
    raw = t.judge_answers.select("call_id", F.expr(RAW).alias("raw"))
    return J.judge_verdicts(raw, "raw").drop("raw")


@query("result_csv_head", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) AS r,
  count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(n) AS n_rows, concat('l_orderkey,l_linenumber,l_quantity,l_returnflag', chr(10),
  string_agg(concat_ws(',', l_orderkey, l_linenumber, l_quantity, l_returnflag), chr(10) ORDER BY r), chr(10),
  CASE WHEN max(n) > 200 THEN concat(chr(10), '[truncated to first 200 of ', max(n), ' rows]', chr(10)) ELSE '' END) AS csv
FROM ranked WHERE r <= 200 GROUP BY l_suppkey""")
def result_csv_head(t):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    return J.result_csv_head(t.lineitem, ["l_suppkey"], columns, columns)


def template_sql(template: str) -> str:
    """The template as a SQL concatenation of its texts and slots."""
    pieces = []
    for text, slot in J.template_parts(template):
        pieces.append("'" + text.replace("'", "''") + "'")
        if slot:
            pieces.append(slot)
    return f"concat({', '.join(pieces)})"


CASE_COLUMNS = {
    "prompt": "concat('What did ', s_name, ' ship?')",
    "golden_sql": "concat('SELECT * FROM results WHERE case_id = ', CAST(s_suppkey AS STRING))",
    "agent_sql": "concat('SELECT * FROM results WHERE case_id = ', CAST(s_suppkey AS STRING), ' ORDER BY 1')",
    "agent_answer": "concat('Selected the results of nation ', CAST(s_nationkey AS STRING))",
}


@query("judge_requests", f"""
SELECT case_id, {template_sql(J.DEFAULT_TEMPLATE)} AS request FROM (
  SELECT s_suppkey AS case_id, {', '.join(f'{sql} AS {name}' for name, sql in CASE_COLUMNS.items())},
    r.csv AS golden_result_csv, CASE WHEN d.detail = '' THEN d.summary ELSE concat(d.summary, chr(10), d.detail) END AS exec_diff
  FROM supplier s
  JOIN (SELECT case_id, concat('l_returnflag,l_linestatus,n,sum_qty', chr(10), string_agg(concat_ws(',', l_returnflag,
      l_linestatus, n, sum_qty), chr(10) ORDER BY l_returnflag, l_linestatus), chr(10)) AS csv
    FROM {{golden_results}} GROUP BY case_id) r ON r.case_id = s.s_suppkey
  JOIN ({SUMMARY}) d ON d.case_id = s.s_suppkey)""")
def judge_requests(t):
    cases = t.supplier.select(
        F.col("s_suppkey").alias("case_id"), *[F.expr(sql).alias(name) for name, sql in CASE_COLUMNS.items()]
    )
    heads = J.result_csv_head(t.golden_results, KEYS, VALUES, VALUES).select("case_id", "csv")
    detail = F.when(F.col("detail") == "", F.col("summary")).otherwise(F.concat_ws("\n", "summary", "detail"))
    diffs = _diffs(t).select("case_id", detail.alias("exec_diff"))
    # a case with an empty golden result is judged on the header alone
    filled = cases.join(heads, "case_id", "left").join(diffs, "case_id", "left").withColumn(
        "golden_result_csv", F.coalesce("csv", F.lit(J.csv_header(VALUES))))
    return J.judge_requests(filled).select("case_id", "request")
