"""Judge calibration against human labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.operators import calibration as C


def kappa_check(keys: str, source: str = "{calibration_scores}") -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}n, agreed, CASE WHEN n = 0 THEN 0.0 WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END
    ELSE (po - pe) / (1 - pe) END::DOUBLE AS kappa
  FROM (SELECT *, p * q + (1 - p) * (1 - q) AS pe FROM (
    SELECT {lead}count(*) AS n, count(*) FILTER (WHERE human = judge) AS agreed,
      count(*) FILTER (WHERE human = judge) * 1.0::DOUBLE / count(*) AS po,
      count(*) FILTER (WHERE human = 1) * 1.0::DOUBLE / count(*) AS p,
      count(*) FILTER (WHERE judge = 1) * 1.0::DOUBLE / count(*) AS q FROM {source} {group}))"""


LABEL = """CASE WHEN kappa < 0.2 THEN 'poor' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate'
  WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost perfect' END"""
AGREED = """(CASE WHEN human_factual_accuracy = judge_factual_accuracy THEN 1 ELSE 0 END
  + CASE WHEN human_completeness = judge_completeness THEN 1 ELSE 0 END
  + CASE WHEN human_no_hallucination = judge_no_hallucination THEN 1 ELSE 0 END
  + CASE WHEN human_category IS NOT DISTINCT FROM judge_category THEN 1 ELSE 0 END)"""
LONG = """SELECT case_id, domain, 'factual_accuracy' AS dim, human_factual_accuracy AS human,
    judge_factual_accuracy AS judge, reasoning FROM {calibration_cases} c1
  UNION ALL SELECT case_id, domain, 'completeness', human_completeness, judge_completeness, reasoning FROM {calibration_cases} c2
  UNION ALL SELECT case_id, domain, 'no_hallucination', human_no_hallucination, judge_no_hallucination, reasoning
  FROM {calibration_cases} c3"""


def rounded(frame, *names):
    return frame.withColumns({n: F.round(n, 9) for n in names})


@query("human_judge_join", """
SELECT case_id, dim, human, judge FROM {calibration_scores}""")
def human_judge_join(t):
    scores = t.calibration_scores
    return C.human_judge_join(scores.select("case_id", "dim", "human"), scores.select("case_id", "dim", "judge"))


@query("dim_agreement", """
SELECT dim, count(*) AS n, count(*) FILTER (WHERE human = judge) AS agreed,
  round(count(*) FILTER (WHERE human = judge) * 1.0::DOUBLE / count(*), 9) AS rate,
  count(*) FILTER (WHERE human = judge) * 1.0 / count(*) < 0.85 AS below_bar
FROM {calibration_scores} GROUP BY dim""")
def dim_agreement(t):
    return rounded(C.dim_agreement(t.calibration_scores, ["dim"]), "rate")


@query("cohens_kappa", f"SELECT dim, n, agreed, round(kappa, 9) AS kappa FROM ({kappa_check('dim')})")
def cohens_kappa(t):
    return rounded(C.cohens_kappa(t.calibration_scores, ["dim"]), "kappa").select("dim", "n", "agreed", "kappa")


@query("kappa_labels", f"SELECT dim, {LABEL} AS label, kappa < 0.6 AS below_bar FROM ({kappa_check('dim', f'({LONG})')})")
def kappa_labels(t):
    scores = C.long_scores(t.calibration_cases, ["case_id"])
    return C.cohens_kappa(scores, ["dim"]).select("dim", "label", "below_bar")


@query("kappa_by_domain", f"""
SELECT dim, domain, n, agreed, round(kappa, 9) AS kappa, {LABEL} AS label, kappa < 0.6 AS below_bar
FROM ({kappa_check('dim, domain')})""")
def kappa_by_domain(t):
    return rounded(C.cohens_kappa(t.calibration_scores, ["dim", "domain"]), "kappa")


@query("category_agreement", """
SELECT count(*) AS n, count(*) FILTER (WHERE human_category IS NOT DISTINCT FROM judge_category) AS agreed,
  round(avg(CASE WHEN human_category IS NOT DISTINCT FROM judge_category THEN 1.0::DOUBLE ELSE 0 END), 9) AS rate
FROM {calibration_cases}""")
def category_agreement(t):
    return rounded(C.category_agreement(t.calibration_cases), "rate")


@query("case_agreement", f"SELECT case_id, {AGREED} AS agreed FROM {{calibration_cases}}")
def case_agreement(t):
    return C.case_agreement(t.calibration_cases).select("case_id", "agreed")


@query("overall_agreement", f"""
SELECT CAST(sum({AGREED}) AS BIGINT) AS agreed, count(*) * 4 AS possible,
  round(sum({AGREED}) * 1.0::DOUBLE / (count(*) * 4), 9) AS rate FROM {{calibration_cases}}""")
def overall_agreement(t):
    return rounded(C.overall_agreement(t.calibration_cases), "rate")


@query("disagreements", f"""
SELECT case_id, dim, human, judge,
  CASE WHEN length(reasoning) > 90 THEN concat(left(reasoning, 90), '...') ELSE reasoning END AS reasoning
FROM ({LONG}) WHERE human <> judge""")
def disagreements(t):
    return C.disagreements(t.calibration_cases)


GATES = f"""SELECT dim, agreed * 1.0 / n < 0.85 AS low_agreement, kappa < 0.6 AS low_kappa
  FROM ({kappa_check('dim', f'({LONG})')})"""


@query("calibration_gate", f"""
SELECT *, CASE WHEN below_agreement = '' AND below_kappa = '' THEN 'all dimensions clear both bars'
  WHEN below_kappa = '' THEN concat(below_agreement, ' below 85% raw agreement')
  ELSE concat(below_kappa, ' below κ=0.60') END AS gate
FROM (SELECT coalesce(string_agg(CASE WHEN low_agreement THEN dim END, ', ' ORDER BY dim), '') AS below_agreement,
  coalesce(string_agg(CASE WHEN low_kappa THEN dim END, ', ' ORDER BY dim), '') AS below_kappa FROM ({GATES}))""")
def calibration_gate(t):
    return C.calibration_gate(C.long_scores(t.calibration_cases, ["case_id"]))


# Report files: every document plays one report of its source. Two thirds carry a
# proper name, half of the bodies state an agreement.
REPORT_FILES = """SELECT source, doc_id, concat('runs/calibration/', CASE WHEN doc_id % 3 = 0 THEN 'notes_' ELSE '' END,
    '20', lpad(CAST(doc_id % 26 AS STRING), 2, '0'), '-0', CAST(1 + doc_id % 9 AS STRING), '-1', CAST(doc_id % 10 AS STRING),
    '_', lpad(CAST(doc_id % 240000 AS STRING), 6, '0'), '_', substr({hash}, 1, 8), '.md') AS path,
  concat(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('- **Overall agreement:** ', CAST(50 + doc_id % 50 AS STRING), '%') ELSE '' END) AS body
  FROM {documents}"""
FILES_CHECK = REPORT_FILES.replace("{hash}", "sha256(concat('p', CAST(doc_id % 2 AS STRING)))")
NAME = "regexp_extract(path, '([^/]*)$', 1)"
LATEST = f"""SELECT source, "timestamp", prompt_hash, agreement_pct, path FROM (
  SELECT source, path, regexp_extract({NAME}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}_\\d{{6}})_([0-9a-f]{{8}})\\.md$', 1) AS "timestamp",
    regexp_extract({NAME}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}_\\d{{6}})_([0-9a-f]{{8}})\\.md$', 2) AS prompt_hash,
    try_cast(nullif(regexp_extract(body, '\\*\\*Overall agreement:\\*\\*\\s*(\\d+)%', 1), '') AS INTEGER) AS agreement_pct
  FROM ({FILES_CHECK}))
  WHERE "timestamp" <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY "timestamp" DESC, path DESC) = 1"""


def report_files(t):
    documents = t.documents
    return t.spark.sql(
        REPORT_FILES.replace("{hash}", "sha2(concat('p', CAST(doc_id % 2 AS STRING)), 256)"), documents=documents
    )


@query("latest_calibration", LATEST)
def latest_calibration(t):
    return C.latest_calibration(report_files(t), ["source"])


@query("calibration_freshness", f"""
SELECT s.source, s.prompt_hash, CASE WHEN l.source IS NULL THEN 'never' WHEN l.prompt_hash = s.prompt_hash THEN 'current'
    ELSE 'stale' END AS state,
  CASE WHEN l.source IS NULL THEN '⚠ Judge not yet calibrated.'
    WHEN l.prompt_hash = s.prompt_hash THEN concat('Judge calibrated: ', split_part("timestamp", '_', 1), ' (',
      coalesce(agreement_pct || '%', '?'), ' agreement, current prompt)')
    ELSE concat('⚠ Judge calibration is stale: last calibrated ', split_part("timestamp", '_', 1), ' against prompt `',
      l.prompt_hash, '` (', coalesce(agreement_pct || '%', '?'), ' agreement); current prompt is `', s.prompt_hash, '`.') END AS status
FROM (SELECT source, substr(sha256(concat('p', CAST(max(n_chars) % 2 AS STRING))), 1, 8) AS prompt_hash
      FROM {{documents}} GROUP BY source UNION ALL SELECT 'unseen', substr(sha256('p0'), 1, 8)) s
LEFT JOIN ({LATEST}) l ON s.source = l.source""")
def calibration_freshness(t):
    current = t.documents.groupBy("source").agg(
        F.left(F.sha2(F.concat(F.lit("p"), (F.max("n_chars") % 2).cast("string")), 256), F.lit(8)).alias("prompt_hash")
    )
    unseen = t.spark.range(1).select(
        F.lit("unseen").alias("source"), F.left(F.sha2(F.lit("p0"), 256), F.lit(8)).alias("prompt_hash")
    )
    latest = C.latest_calibration(report_files(t), ["source"])
    return C.calibration_freshness(current.union(unseen), latest, ["source"])
