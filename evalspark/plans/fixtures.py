"""Evaluation tables derived from the given star schema.

Each view is one SQL text that Spark and the SQL check run alike. ``{table}``
names an input table, ``{view}`` another view of this module.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

CATEGORY_CASE = """CASE {key} % 12
         WHEN 0 THEN 'translation_correctness' WHEN 1 THEN 'schema_selection' WHEN 2 THEN 'business_logic'
         WHEN 3 THEN 'temporal_logic' WHEN 4 THEN 'silent_wrongness' WHEN 5 THEN 'ambiguity_handling'
         WHEN 6 THEN 'hallucination_resistance' WHEN 7 THEN 'refusal_scope' WHEN 8 THEN 'efficiency'
         WHEN 9 THEN 'reasoning_faithfulness' WHEN 10 THEN 'consistency_rephrasing'
         ELSE 'adversarial_robustness' END"""

VIEWS = {
    # one row per (agent, case)
    "case_runs": f"""
SELECT CASE WHEN o_orderkey < 10 THEN 'agent_tiny'
            ELSE concat('agent_', CAST(o_custkey % 5 AS STRING)) END AS agent_name,
       o_orderkey AS case_pos,
       concat('case_', CAST(o_orderkey AS STRING)) AS case_id,
       CASE WHEN o_orderkey % 20 < 4 THEN 'T1' WHEN o_orderkey % 20 < 17 THEN 'T2' ELSE 'T3' END AS tier,
       {CATEGORY_CASE.format(key="o_custkey")} AS category,
       o_orderpriority AS domain,
       concat('How many orders has customer ', CAST(o_custkey AS STRING), '?') AS prompt,
       CASE WHEN o_orderkey % 97 = 0 THEN 'peak_sql: dry-run failed'
            WHEN o_orderkey % 89 = 0 THEN 'agent_sql: execution failed'
            WHEN o_orderkey % 83 = 0 THEN 'judge: bad json' END AS error,
       (o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0
        AND o_orderkey % (7 + 4 * (o_custkey % 5)) <> 0) AS exec_match,
       (o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AND o_orderkey % 83 <> 0) AS judged,
       CASE WHEN o_orderkey % 29 = 0 THEN 0 ELSE 1 END AS factual_accuracy,
       CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 1 END AS completeness,
       CASE WHEN o_orderkey % 37 = 0 THEN 0 ELSE 1 END AS no_hallucination,
       CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE o_orderkey * 100 END AS golden_bytes,
       o_orderkey * (85 + o_custkey % 41) AS agent_bytes
FROM {{orders}}""",
    # long result rows, one small result per case_id
    "golden_results": """
SELECT l_suppkey AS case_id, l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty
FROM {lineitem} GROUP BY l_suppkey, l_returnflag, l_linestatus""",
    "agent_results": """
SELECT case_id, l_returnflag, l_linestatus, n,
       CASE case_id % 6 WHEN 2 THEN sum_qty * (1 + 1e-7) WHEN 3 THEN sum_qty * 101 / 100 ELSE sum_qty END AS sum_qty
FROM {golden_results} g WHERE NOT (case_id % 6 = 1 AND l_returnflag = 'R')
UNION ALL
SELECT case_id, l_returnflag, l_linestatus, n, sum_qty
FROM {golden_results} h WHERE case_id % 6 = 5 AND l_returnflag = 'A'""",
    "result_columns": """
SELECT DISTINCT l_suppkey AS case_id, 'golden' AS side, 'l_returnflag,l_linestatus,n,sum_qty' AS cols
FROM {lineitem}
UNION ALL
SELECT DISTINCT l_suppkey AS case_id, 'agent' AS side,
       CASE WHEN l_suppkey % 6 = 4 THEN 'l_returnflag,l_linestatus,n,total_qty'
            ELSE 'l_returnflag,l_linestatus,n,sum_qty' END AS cols
FROM {lineitem}""",
    "perturbed_lineitem": """
SELECT l_orderkey, l_linenumber, l_returnflag,
       CASE WHEN l_orderkey % 1000 = 1 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
FROM {lineitem} WHERE l_orderkey % 5000 <> 3""",
    # the same lines with noise below the tolerance in both numbers; one group holds other rows, one more of them
    "noisy_golden": """
SELECT l_returnflag, l_linestatus, l_quantity * (1 + 2e-6 * (l_orderkey % 3 - 1)) AS q,
       l_discount * (1 + 2e-6 * (l_partkey % 3 - 1)) AS d
FROM {lineitem}""",
    "noisy_agent": """
SELECT l_returnflag, l_linestatus, l_quantity * (1 + 2e-6 * (l_suppkey % 3 - 1)) AS q,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_orderkey % 1000 = 7 THEN l_discount + 0.01 ELSE l_discount END
         * (1 + 2e-6 * (l_linenumber % 3 - 1)) AS d
FROM {lineitem}
UNION ALL
SELECT l_returnflag, l_linestatus, l_quantity AS q, l_discount AS d
FROM {lineitem} WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_orderkey % 1000 = 8""",
    # calls to the judge with its raw answers
    "judge_log": """
SELECT user_id AS run_id, event_id AS call_id, ts AS called_at,
       CAST(floor(value * 10) AS BIGINT) AS input_tokens,
       event_id % 512 AS output_tokens,
       CASE event_id % 3 WHEN 0 THEN props
            WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```')
            ELSE concat('Here is my score: ', props, ' done') END AS response
FROM {events}""",
    # answers in the verdict shape, some broken, some with an unknown category
    "judge_answers": """
SELECT event_id AS call_id,
       CASE WHEN event_id % 50 = 0 THEN concat('no verdict for ', event_type)
            WHEN event_id % 41 = 0 THEN concat(chr(123), '"factual_accuracy": 1, "reasoning": "', event_type, '"', chr(125))
            ELSE concat(chr(123), '"factual_accuracy": ', CAST(event_id % 2 AS STRING),
                        ', "completeness": ', CASE WHEN value > 10 THEN '1' ELSE '0' END,
                        ', "no_hallucination": 1, "failure_category": ',
                        CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"wrong_join"'
                             WHEN 2 THEN '"bad_mood"' ELSE '"time_window"' END,
                        CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(', "reasoning": "saw ', event_type, '"') END,
                        chr(125)) END AS body,
       event_id % 3 AS wrapping
FROM {events}""",
    # human against judge, long form
    "calibration_scores": """
SELECT l.doc_id AS case_id, d.lang AS domain, 'factual_accuracy' AS dim, l.quality AS human,
       CASE WHEN l.doc_id % 9 = 0 THEN 1 - l.quality ELSE l.quality END AS judge
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
UNION ALL
SELECT l2.doc_id AS case_id, d2.lang AS domain, 'no_hallucination' AS dim, 1 - l2.toxic AS human,
       CASE WHEN l2.doc_id % 7 = 0 THEN 1 ELSE 1 - l2.toxic END AS judge
FROM {labels} l2 JOIN {documents} d2 ON l2.doc_id = d2.doc_id""",
    # human and judge side by side with categories and reasoning
    "calibration_cases": """
SELECT l.doc_id AS case_id, d.lang AS domain,
       l.quality AS human_factual_accuracy, 1 AS human_completeness, 1 - l.toxic AS human_no_hallucination,
       CASE WHEN l.doc_id % 9 = 0 THEN 1 - l.quality ELSE l.quality END AS judge_factual_accuracy,
       CASE WHEN d.n_chars % 11 = 0 THEN 0 ELSE 1 END AS judge_completeness,
       CASE WHEN l.doc_id % 7 = 0 THEN 1 ELSE 1 - l.toxic END AS judge_no_hallucination,
       CASE l.doc_id % 3 WHEN 0 THEN 'missing_filter' WHEN 1 THEN 'wrong_join' END AS human_category,
       CASE WHEN l.doc_id % 13 = 0 THEN 'other' WHEN l.doc_id % 3 = 0 THEN 'missing_filter'
            WHEN l.doc_id % 3 = 1 THEN 'wrong_join' END AS judge_category,
       d.text AS reasoning
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    # confidence with outcome, per agent
    "agent_confidence": """
SELECT agent_name, case_id, exec_match, CAST((case_pos * 37) % 101 AS DOUBLE) / 100 AS confidence
FROM {case_runs} cr""",
    # many submissions
    "submissions": """
SELECT concat(lang, '_', source) AS submission, doc_id AS case_id,
       concat('SELECT ', CAST(n_chars AS STRING)) AS agent_sql, concat('doc ', lang) AS agent_explanation
FROM {documents}""",
    # raw golden corpus with the dirt a spreadsheet export has
    "corpus_raw": f"""
SELECT CASE WHEN doc_id % 211 = 5 THEN '  ' WHEN doc_id % 100 = 7 THEN concat(' doc_', CAST(doc_id - 1 AS STRING))
            ELSE concat('doc_', CAST(doc_id AS STRING)) END AS id,
       CASE WHEN doc_id % 90 = 4 THEN 'T9' WHEN doc_id % 3 = 0 THEN ' t1' WHEN doc_id % 3 = 1 THEN 'T2 '
            ELSE 'T3' END AS tier,
       CASE WHEN doc_id % 120 = 11 THEN 'unheard_of' ELSE {CATEGORY_CASE.format(key="doc_id")} END AS category,
       lang AS domain, text AS prompt,
       CASE WHEN doc_id % 8 = 6 THEN '-- nothing to select' ELSE concat('SELECT ', CAST(n_chars AS STRING), chr(10), 'FROM "t";') END AS peak_sql,
       CASE WHEN doc_id % 10 = 9 THEN NULL ELSE concat('known since ', source) END AS golden_reasoning,
       concat(source, ', ', lang, ',,') AS tables,
       'count, filter' AS sql_features,
       CASE doc_id % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN ' TRUE ' ELSE CASE WHEN doc_id % 70 = 9 THEN 'maybe' ELSE '0' END END AS ambiguity_flag,
       CASE WHEN doc_id % 2 = 0 THEN 'y' END AS evidence_required,
       CASE doc_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN ' Approved' ELSE 'approved' END AS status,
       doc_id AS case_pos
FROM {{documents}}""",
    # raw submission of one agent
    "submission_raw": """
SELECT CASE WHEN l.doc_id % 50 = 3 THEN concat('stray_', CAST(l.doc_id AS STRING)) ELSE concat(' doc_', CAST(l.doc_id AS STRING)) END AS id,
       CASE WHEN l.doc_id % 60 = 8 THEN '   ' ELSE concat('SELECT ', CAST(l.quality AS STRING), ' ') END AS agent_sql,
       CASE WHEN l.doc_id % 75 = 10 THEN NULL ELSE concat('because of ', CAST(l.toxic AS STRING)) END AS agent_explanation,
       l.doc_id AS case_pos
FROM {labels} l""",
    # raw submissions of several agents, each with some of the answers
    "agent_answers": """
SELECT concat('q', CAST(x.quality AS STRING)) AS agent_name, s.*
FROM {submission_raw} s JOIN {labels} x ON x.doc_id = s.case_pos
UNION ALL
SELECT concat('t', CAST(y.toxic AS STRING)) AS agent_name, r.*
FROM {submission_raw} r JOIN {labels} y ON y.doc_id = r.case_pos""",
    # run history: one row per finished run
    "run_ledger": """
SELECT substr(sha256(concat('run:', CAST(o_custkey % 400 AS STRING), o_orderstatus)), 1, 16) AS fingerprint,
       concat('agent_', CAST(o_custkey % 7 AS STRING)) AS agent_name,
       o_orderkey AS run_id,
       o_orderdate AS finished_at,
       concat('runs/', CAST(o_orderkey AS STRING), '.md') AS report_path,
       concat('submissions/agent_', CAST(o_custkey % 7 AS STRING), '.csv') AS source_csv,
       substr(sha256(concat('a', CAST(o_custkey % 3 AS STRING))), 1, 16) AS agent_hash,
       substr(sha256(concat('c', o_orderstatus)), 1, 16) AS corpus_hash,
       substr(sha256(concat('j', o_orderpriority)), 1, 8) AS judge_prompt_hash
FROM {orders}""",
}
_REFERENCE = re.compile(r"\{([a-z]\w*)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table or a derived view as a DataFrame; ``known`` keeps those built before."""
    known = {} if known is None else known
    if name not in known:
        if name in TABLES:
            known[name] = table(spark, sf_dir, name)
        else:
            text = VIEWS[name]
            inputs = {ref: view(spark, sf_dir, ref, known) for ref in set(_REFERENCE.findall(text))}
            known[name] = spark.sql(_spark_dialect(text), **inputs)
    return known[name]


def with_views(sql: str) -> str:
    """Prefix ``sql`` (which uses ``{view}`` placeholders) with the views it needs."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for ref in _REFERENCE.findall(text):
            if ref in VIEWS and ref not in ordered:
                need(VIEWS[ref])
                ordered.append(ref)

    need(sql)
    plain = lambda text: _REFERENCE.sub(r"\1", text)
    ctes = [f"{name} AS ({plain(VIEWS[name])})" for name in ordered]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _spark_dialect(text: str) -> str:
    """SHA-256 is the one function the two engines name differently."""
    return re.sub(r"sha256\((concat\((?:[^()]|\([^()]*\))*\))\)", r"sha2(\1, 256)", text)
