"""Corpus and submission files: reading, validation, pairing."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evalspark.catalog import query
from evalspark.functions.stats import rate
from evalspark.functions.text import parse_flag, parse_list
from evalspark.operators import corpus as C
from evalspark.operators.scores import category_dim, tier_dim
from evalspark.session import scratch_path
from evalspark.sources import files

# shared pieces of the checks
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def strip(text: str) -> str:
    return rf"regexp_replace(coalesce({text}, ''), '\A{WS}+|{WS}+\z', '', 'g')"


def flag(text: str) -> str:
    word = f"lower({strip(text)})"
    return f"""CASE WHEN {text} IS NULL THEN false WHEN {word} IN ('', 'n', 'no', 'false', '0') THEN false
      WHEN {word} IN ('y', 'yes', 'true', '1') THEN true END"""


def items(text: str) -> str:
    parts = f"list_transform(string_split(coalesce({text}, ''), ','), lambda x: {strip('x')})"
    return f"array_to_string(list_filter({parts}, lambda x: x <> ''), '|')"


APPROVED = f"lower({strip('status')}) = 'approved'"
PRESENT = f"{strip('id')} <> ''"
SLUGS = """('translation_correctness', 'schema_selection', 'business_logic', 'temporal_logic', 'silent_wrongness',
  'ambiguity_handling', 'hallucination_resistance', 'refusal_scope', 'efficiency', 'reasoning_faithfulness',
  'consistency_rephrasing', 'adversarial_robustness')"""
GOLDENS = f"""SELECT {strip('id')} AS id, upper({strip('tier')}) AS tier, {strip('category')} AS category,
    {strip('domain')} AS domain, {strip('prompt')} AS prompt, coalesce(peak_sql, '') AS golden_sql,
    {strip('golden_reasoning')} AS golden_reasoning, {items('tables')} AS tables, {items('sql_features')} AS sql_features,
    {flag('ambiguity_flag')} AS ambiguity_flag, {flag('evidence_required')} AS evidence_required,
    lower({strip('status')}) AS status, case_pos
  FROM {{corpus_raw}} WHERE {PRESENT}"""
INPUTS = f"""SELECT {strip('id')} AS id, {strip('agent_sql')} AS agent_sql,
    {strip('agent_explanation')} AS agent_explanation, case_pos FROM {{submission_raw}} WHERE {PRESENT}"""

AGENT_INPUTS = INPUTS.replace("SELECT", "SELECT agent_name,", 1).replace("{submission_raw}", "{agent_answers}")


def joined(frame):
    return frame.withColumns({c: F.array_join(c, "|") for c in ("tables", "sql_features")})


@query("read_golden", f"SELECT * EXCLUDE (case_pos) FROM ({GOLDENS})")
def read_golden(t):
    """The corpus written as CSV with quotes and line breaks, read back and typed."""
    path = files.write_csv(t.corpus_raw.drop("case_pos").withColumn("note", F.lit("ignored")), scratch_path(t.spark, "corpus"))
    # the order in the files is that of the writer's tasks
    return joined(C.golden_cases(files.read_golden(t.spark, path), include_drafts=True)).drop("case_pos")


@query("read_submissions", """
SELECT submission AS agent_name, CAST(case_id AS STRING) AS id, agent_sql, agent_explanation FROM {submissions}""")
def read_submissions(t):
    """One folder of CSV files per agent, extra columns ignored."""
    rows = t.submissions.select(
        F.col("case_id").cast("string").alias("prompt"), F.col("case_id").cast("string").alias("id"),
        "agent_sql", "agent_explanation", "submission",
    )
    path = files.write_csv(rows, scratch_path(t.spark, "submissions"), ["submission"])
    return C.agent_inputs(files.read_submissions(t.spark, path, "submission"), ["agent_name"]).drop("case_pos")


@query("parse_result_csv", """
SELECT l_suppkey AS case_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus) - 1 AS pos,
  l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 4) AS qty,
  concat(l_returnflag, '"', chr(10), l_linestatus, CASE WHEN l_suppkey % 2 = 0 THEN chr(13) ELSE ', ' END, chr(10)) AS note
FROM {lineitem} GROUP BY l_suppkey, l_returnflag, l_linestatus""")
def parse_result_csv(t):
    """Every small result rendered as inline CSV text, with quotes and line breaks inside fields, and parsed again."""
    line = F.to_csv(F.struct("l_returnflag", "l_linestatus", "n", "sum_qty"))
    even = F.col("case_id") % 2 == 0  # these end their lines with CRLF
    note = F.concat(F.lit('"'), "l_returnflag", F.lit('""\n'), "l_linestatus", F.when(even, "\r").otherwise(", "), F.lit('\n"'))
    texts = t.golden_results.groupBy("case_id").agg(  # one line per flag and status
        F.array_sort(F.collect_list(F.concat_ws(",", line, note))).alias("lines"))
    end = F.when(even, "\r\n").otherwise("\n")
    texts = texts.select("case_id", "lines", end.alias("end"))
    joined = F.aggregate("lines", F.concat(F.lit("flag,status,n,qty,note"), "end"), lambda text, one: F.concat(text, one, F.col("end")))
    return files.parse_result_csv(
        texts.select("case_id", joined.alias("text")), "text", "flag string, status string, n bigint, qty double, note string", ["case_id"])


@query("corpus_violations", f"""
SELECT {strip('id')} AS id, 'tier' AS rule, upper({strip('tier')}) AS value FROM {{corpus_raw}} a
WHERE {PRESENT} AND upper({strip('tier')}) NOT IN ('T1', 'T2', 'T3')
UNION ALL SELECT {strip('id')}, 'category', {strip('category')} FROM {{corpus_raw}} b
WHERE {PRESENT} AND {strip('category')} NOT IN {SLUGS}
UNION ALL SELECT {strip('id')}, 'ambiguity_flag', ambiguity_flag FROM {{corpus_raw}} c
WHERE {PRESENT} AND {APPROVED} AND ({flag('ambiguity_flag')}) IS NULL
UNION ALL SELECT {strip('id')}, 'evidence_required', evidence_required FROM {{corpus_raw}} d
WHERE {PRESENT} AND {APPROVED} AND ({flag('evidence_required')}) IS NULL
UNION ALL SELECT {strip('id')}, 'duplicate_id', CAST(count(*) AS STRING) FROM {{corpus_raw}} e
WHERE {PRESENT} GROUP BY 1 HAVING count(*) > 1""")
def corpus_violations(t):
    return C.golden_violations(t.corpus_raw)


@query("duplicate_ids", "SELECT text AS id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(t):
    return C.duplicate_ids(t.documents.select(F.col("text").alias("id")), ["id"])


@query("submission_violations", f"""
SELECT {strip('id')} AS id, 'agent_sql' AS rule, agent_sql AS value FROM {{submission_raw}} a
WHERE {PRESENT} AND {strip('agent_sql')} = ''
UNION ALL SELECT {strip('id')}, 'agent_explanation', agent_explanation FROM {{submission_raw}} b
WHERE {PRESENT} AND {strip('agent_explanation')} = ''
UNION ALL SELECT {strip('id')}, 'duplicate_id', CAST(count(*) AS STRING) FROM {{submission_raw}} c
WHERE {PRESENT} GROUP BY 1 HAVING count(*) > 1""")
def submission_violations(t):
    return C.submission_violations(t.submission_raw)


FLAG_TEXT = """CASE o_orderkey % 8 WHEN 0 THEN ' Y ' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN 'TRUE'
  WHEN 4 THEN NULL WHEN 5 THEN '0' WHEN 6 THEN o_orderstatus ELSE '1' END"""


@query("parse_flags", f"""
SELECT o_orderkey, raw, {flag('raw')} AS flag FROM (SELECT o_orderkey, {FLAG_TEXT} AS raw FROM orders)""")
def parse_flags(t):
    raw = t.orders.select("o_orderkey", F.expr(FLAG_TEXT).alias("raw"))
    return raw.withColumn("flag", parse_flag(F.col("raw")))


@query("parse_lists", f"""
SELECT p_partkey, {items("concat(p_brand, ', ', p_type, ',,')")} AS items,
  len(list_filter(list_transform(string_split(concat(p_brand, ', ', p_type, ',,'), ','), lambda x: {strip('x')}), lambda x: x <> '')) AS n
FROM part""")
def parse_lists(t):
    parsed = parse_list(F.concat("p_brand", F.lit(", "), "p_type", F.lit(",,")))
    return t.part.select(
        "p_partkey", F.array_join(parsed, "|").alias("items"), F.size(parsed).cast("bigint").alias("n")
    )


@query("approved_cases", f"SELECT * FROM ({GOLDENS}) WHERE status = 'approved'")
def approved_cases(t):
    return joined(C.golden_cases(t.corpus_raw))


@query("submission_template", f"""
SELECT {strip('id')} AS id, {strip('prompt')} AS prompt, '' AS agent_sql, '' AS agent_explanation
FROM {{corpus_raw}} WHERE {strip('status')} = 'approved'""")
def submission_template(t):
    return C.submission_template(t.corpus_raw)


# SQL texts made from the documents: comments, trailing semicolons, writes, scripts.
SQL_TEXT = """replace(CASE doc_id % 11
  WHEN 0 THEN concat('SELECT ', CAST(n_chars AS STRING), ' AS n;')
  WHEN 1 THEN concat('-- ', text)
  WHEN 2 THEN concat('/* ', text, ' */ with t as (select 1) select * from t')
  WHEN 3 THEN concat('DELETE FROM ', source)
  WHEN 4 THEN concat('SELECT 1; DROP TABLE ', source)
  WHEN 5 THEN concat('WITH t AS (SELECT 1) INSERT INTO ', source, ' SELECT * FROM t')
  WHEN 6 THEN concat('SELECT ''-- ', source, ''' AS c', chr(10), 'FROM t ; ')
  WHEN 7 THEN concat('  ', chr(9), 'select', chr(10), CAST(doc_id AS STRING), ';;')
  WHEN 8 THEN ';' WHEN 9 THEN concat('insert into ', lang, ' values (1)')
  ELSE text END, 'ß', 'ss')"""


@query("read_only_lint", rf"""
WITH texts AS (SELECT doc_id, {SQL_TEXT} AS sql_text FROM documents),
bare AS (SELECT *, {strip("regexp_replace(sql_text, '(--[^' || chr(10) || ']*)|((?s:/[*].*?[*]/))', ' ', 'g')")} AS b FROM texts),
body AS (SELECT *, CASE WHEN b LIKE '%;' THEN {strip("left(b, length(b) - 1)")} ELSE b END AS s FROM bare),
parts AS (SELECT *, CASE WHEN strpos(s, ';') > 0 THEN {strip("substr(s, strpos(s, ';') + 1)")} END AS rest,
  upper(regexp_extract(s, '\A[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+')) AS first FROM body),
judged AS (SELECT doc_id, CASE WHEN s = '' THEN 'empty SQL' WHEN rest <> '' THEN 'multi-statement queries not allowed'
  WHEN first NOT IN ('SELECT', 'WITH') THEN concat('only SELECT/WITH queries are allowed; got ''', first, '''')
  WHEN regexp_matches(s, '(?is)\A\s*with\b.*\)\s*insert\b') THEN 'WITH must not lead into a write' END AS reason FROM parts)
SELECT doc_id, reason, reason IS NULL AS allowed FROM judged""")
def read_only_lint(t):
    texts = t.documents.select("doc_id", F.expr(SQL_TEXT).alias("sql_text"))
    return C.read_only_lint(texts, "sql_text").select("doc_id", "reason", "allowed")


@query("pair_cases", f"""
SELECT g.id, g.case_pos, g.category, g.golden_sql, i.agent_sql, i.agent_explanation
FROM ({GOLDENS}) g JOIN ({INPUTS}) i ON g.id = i.id WHERE g.status = 'approved'""")
def pair_cases(t):
    pairs = C.pair_cases(C.golden_cases(t.corpus_raw), C.agent_inputs(t.submission_raw))
    return pairs.select("id", "case_pos", "category", "golden_sql", "agent_sql", "agent_explanation")


@query("unanswered", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unanswered(t):
    goldens = t.documents.select(F.col("doc_id").alias("id"))
    return C.unanswered(goldens, t.labels.select(F.col("doc_id").alias("id")))


@query("unanswered_by_agent", """
SELECT d.doc_id AS id, a.agent_name FROM documents d, (SELECT DISTINCT concat('q', quality) AS agent_name FROM labels
  UNION SELECT DISTINCT concat('t', toxic) FROM labels) a
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id
  AND (concat('q', l.quality) = a.agent_name OR concat('t', l.toxic) = a.agent_name))""")
def unanswered_by_agent(t):
    goldens = t.documents.select(F.col("doc_id").alias("id"))
    answers = t.labels.select(
        F.col("doc_id").alias("id"),
        F.explode(F.array(
            F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string"))
        )).alias("agent_name"),
    )
    return C.unanswered_by_agent(goldens, answers)


@query("extra_inputs", f"""
SELECT i.id, i.agent_sql FROM ({INPUTS}) i WHERE NOT EXISTS (
  SELECT 1 FROM ({GOLDENS}) g WHERE g.id = i.id AND g.status = 'approved')""")
def extra_inputs(t):
    extra = C.extra_inputs(C.golden_cases(t.corpus_raw), C.agent_inputs(t.submission_raw))
    return extra.select("id", "agent_sql")


@query("unmatched_lists", f"""
WITH approved AS (SELECT * FROM ({GOLDENS}) WHERE status = 'approved'), inputs AS ({AGENT_INPUTS}),
loose AS (SELECT a.agent_name, 'unanswered' AS kind, g.id, g.case_pos FROM approved g, (SELECT DISTINCT agent_name FROM inputs) a
    WHERE NOT EXISTS (SELECT 1 FROM inputs i WHERE i.id = g.id AND i.agent_name = a.agent_name)
  UNION ALL SELECT agent_name, 'extra', id, case_pos FROM inputs WHERE id NOT IN (SELECT id FROM approved))
SELECT agent_name, kind, count(*) AS n, string_agg(id, ', ' ORDER BY case_pos, id) AS ids FROM loose GROUP BY 1, 2""")
def unmatched_lists(t):
    return C.unmatched_lists(C.golden_cases(t.corpus_raw), C.agent_inputs(t.agent_answers, ["agent_name"]))


@query("category_dim", """
SELECT category, trust_risk, CASE WHEN tc THEN 'Y' ELSE 'N' END AS trust_critical,
  CASE WHEN cal THEN 'Y' ELSE 'N' END AS calibration, count(agent_name) AS cases
FROM (SELECT unnest(['translation_correctness', 'schema_selection', 'business_logic', 'temporal_logic', 'silent_wrongness',
        'ambiguity_handling', 'hallucination_resistance', 'refusal_scope', 'efficiency', 'reasoning_faithfulness',
        'consistency_rephrasing', 'adversarial_robustness']) AS category,
      unnest(['low', 'high', 'high', 'high', 'high', 'high', 'high', 'medium', 'medium', 'high', 'medium', 'low']) AS trust_risk,
      unnest([false, true, true, true, true, false, true, false, false, true, false, false]) AS tc,
      unnest([false, false, false, false, false, true, false, true, false, false, false, false]) AS cal) c
LEFT JOIN {case_runs} USING (category) GROUP BY ALL""")
def category_tab(t):
    """The category table with the number of cases each category has."""
    counts = t.case_runs.groupBy("category").agg(F.count(F.lit(1)).alias("cases"))
    yes_no = {c: F.when(F.col(c), F.lit("Y")).otherwise(F.lit("N")) for c in ("trust_critical", "calibration")}
    return category_dim(t.spark).withColumns(yes_no).join(counts, "category", "left").select(
        "category", "trust_risk", "trust_critical", "calibration", F.coalesce("cases", F.lit(0)).alias("cases")
    )


@query("tier_dim", """
SELECT tier, target_share::DOUBLE AS target_share, cases, round(cases * 1.0::DOUBLE / sum(cases) OVER (), 9) AS measured_share
FROM (SELECT unnest(['T1', 'T2', 'T3']) AS tier, unnest([0.2, 0.65, 0.15]) AS target_share)
JOIN (SELECT tier, count(*) AS cases FROM {case_runs} GROUP BY tier) USING (tier)""")
def tier_tab(t):
    """The tier table: target share of the corpus against the measured one."""
    counts = t.case_runs.groupBy("tier").agg(F.count(F.lit(1)).alias("cases"))
    everything = F.sum("cases").over(Window.partitionBy(F.lit(1)))  # three rows
    return tier_dim(t.spark).join(counts, "tier").select(
        "tier", "target_share", "cases", F.round(rate(F.col("cases"), everything), 9).alias("measured_share")
    )
