"""Confidence, ensembles, intervals, drift, coverage and lint queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.catalog.calibration import kappa_check, rounded
from evalspark.catalog.corpus import GOLDENS
from evalspark.catalog.scorecards import AGENT, JUDGED
from evalspark.operators import calibration as K, corpus as C, measures as P
from evalspark.plans import scorecard as S

JUDGES = ["judge_0", "judge_1", "judge_2"]
# three judges vote on every labelled document
VOTES = """SELECT l.doc_id AS case_id, 'factual_accuracy' AS dim, concat('judge_', CAST(j AS STRING)) AS judge_name,
    CASE WHEN (l.doc_id + j) % (5 + j) = 0 THEN 1 - l.quality ELSE l.quality END AS score
  FROM {labels} l, UNNEST_JUDGES
  UNION ALL SELECT l2.doc_id, 'no_hallucination', concat('judge_', CAST(j AS STRING)),
    CASE WHEN (l2.doc_id + j) % (4 + j) = 0 THEN l2.toxic ELSE 1 - l2.toxic END
  FROM {labels} l2, UNNEST_JUDGES"""
VOTES_CHECK = VOTES.replace("UNNEST_JUDGES", "(SELECT unnest([0, 1, 2]) AS j) js")


def votes(t):
    lateral = VOTES.replace(", UNNEST_JUDGES", " LATERAL VIEW explode(array(0, 1, 2)) js AS j")
    return t.spark.sql(lateral, labels=t.labels)


@query("judge_spread", f"""
SELECT case_id, dim, count(*) AS judges, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS spread,
  max(score) - min(score) AS range FROM ({VOTES_CHECK}) GROUP BY case_id, dim""")
def judge_spread(t):
    return rounded(K.judge_spread(votes(t), ["case_id", "dim"]), "mean", "spread")


PAIRS = f"""SELECT a.dim, a.judge_name AS judge_a, b.judge_name AS judge_b, a.score AS human, b.score AS judge
  FROM ({VOTES_CHECK}) a JOIN ({VOTES_CHECK}) b ON a.case_id = b.case_id AND a.dim = b.dim AND a.judge_name < b.judge_name"""


@query("judge_pair_kappa", f"""
SELECT dim, judge_a, judge_b, n, round(kappa, 9) AS kappa FROM ({kappa_check('dim, judge_a, judge_b', f'({PAIRS})')})""")
def judge_pair_kappa(t):
    return rounded(K.judge_pair_kappa(votes(t), JUDGES), "kappa")


# the labelled documents in order make up calibration runs of 100 cases
RUNS = "SELECT case_id // 100 AS run_no, dim, human, judge FROM {calibration_scores}"


@query("calibration_drift", f"""
SELECT run_no, dim, n, round(kappa, 9) AS kappa,
  round(kappa - lag(kappa) OVER (PARTITION BY dim ORDER BY run_no), 9) AS change
FROM ({kappa_check('run_no, dim', f'({RUNS})')})""")
def calibration_drift(t):
    scores = t.calibration_scores.withColumn("run_no", F.floor(F.col("case_id") / 100))
    history = K.cohens_kappa(scores, ["run_no", "dim"]).select("run_no", "dim", "n", "kappa")
    return rounded(K.calibration_drift(history, ["dim"], "run_no"), "kappa", "change")


# Poisson(1) draws told by the hash of seed, replicate and block
POISSON = "list_count(list_filter([{steps}], lambda s: s <= bits))".format(
    steps=", ".join(str(int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)))) for k in range(10)))
BITS = "CAST(concat('0x', substr(sha256({text}), 1, 8)) AS BIGINT)"
DRAWS = f"""SELECT replicate, block, CAST({POISSON} AS BIGINT) AS times FROM (
    SELECT r.replicate, b.block, {BITS.format(text="concat('7:', r.replicate, ':', b.block)")} AS bits
    FROM (SELECT unnest(range(500)) AS replicate) r, (SELECT unnest(range(128)) AS block) b)"""


@query("kappa_bootstrap", f"""
WITH blocked AS (SELECT dim, human, judge, {BITS.format(text="CAST(case_id AS STRING)")} % 128 AS block FROM {{calibration_scores}}),
draws AS MATERIALIZED ({DRAWS}),
drawn AS (SELECT dim, replicate, sum(times) AS n, sum(CASE WHEN human = judge THEN times ELSE 0 END) AS agreed,
    sum(CASE WHEN human = 1 THEN times ELSE 0 END) AS h, sum(CASE WHEN judge = 1 THEN times ELSE 0 END) AS j
  FROM blocked JOIN draws USING (block) GROUP BY dim, replicate),
rates AS (SELECT dim, n, agreed * 1.0::DOUBLE / n AS po, (h * 1.0::DOUBLE / n) * (j * 1.0::DOUBLE / n)
    + (1 - h * 1.0::DOUBLE / n) * (1 - j * 1.0::DOUBLE / n) AS pe FROM drawn),
kappas AS (SELECT dim, CASE WHEN n = 0 THEN 0.0 WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END
    ELSE (po - pe) / (1 - pe) END::DOUBLE AS k FROM rates),
spread AS (SELECT dim, quantile_cont(k, 0.025) AS low, quantile_cont(k, 0.975) AS high FROM kappas GROUP BY dim)
SELECT dim, round(kappa, 9) AS kappa, round(low, 9) AS low, round(high, 9) AS high, low >= 0.6 OR high < 0.6 AS conclusive
FROM ({kappa_check('dim')}) JOIN spread USING (dim)""")
def kappa_bootstrap(t):
    return rounded(K.kappa_bootstrap(t.calibration_scores, ["dim"]), "kappa", "low", "high")


@query("confidence_matrix", """
SELECT agent_name, CASE WHEN confidence >= 0.8 THEN 'high' ELSE 'low' END AS confidence_level, exec_match AS correct,
  count(*) AS cases FROM {agent_confidence} GROUP BY ALL""")
def confidence_matrix(t):
    return P.confidence_matrix(t.agent_confidence, AGENT)


@query("brier_ece", """
WITH bins AS (SELECT agent_name, least(floor(confidence * 10), 9) AS b, count(*) AS n,
    sum((confidence - exec_match::INT) * (confidence - exec_match::INT)) AS sq, sum(confidence - exec_match::INT) AS gap
  FROM {agent_confidence} GROUP BY 1, 2)
SELECT agent_name, CAST(sum(n) AS BIGINT) AS cases, round(sum(sq) / sum(n), 9) AS brier,
  round(sum(abs(gap)) / sum(n), 9) AS ece FROM bins GROUP BY agent_name""")
def brier_ece(t):
    return rounded(P.brier_ece(t.agent_confidence, AGENT), "brier", "ece")


@query("selective_accuracy", """
SELECT agent_name, count(*) FILTER (WHERE confidence >= 0.8) AS confident_cases,
  round(count(*) FILTER (WHERE confidence >= 0.8) * 1.0::DOUBLE / count(*), 9) AS coverage,
  round(count(*) FILTER (WHERE confidence >= 0.8 AND exec_match) * 1.0::DOUBLE
    / nullif(count(*) FILTER (WHERE confidence >= 0.8), 0), 9) AS accuracy
FROM {agent_confidence} GROUP BY agent_name""")
def selective_accuracy(t):
    return rounded(P.selective_accuracy(t.agent_confidence, AGENT), "coverage", "accuracy")


def _wilson(name: str, sign: str) -> str:
    p, n = f"({name}_passed * 1.0::DOUBLE / {name}_total)", f"{name}_total"
    return f"""CASE WHEN {n} > 0 THEN ({p} + 1.96 * 1.96 / (2 * {n}) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n}
      + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n}) END"""


BARS = {"headline": "0.90", "trust": "0.85", "calibration": "0.80"}
BOUNDS = ", ".join(
    f"{_wilson(n, '-')} AS {n}_low, {_wilson(n, '+')} AS {n}_high" for n in BARS
)
STRADDLES = " OR ".join(
    f"({n}_low IS NULL OR ({n}_low < {bar} AND {n}_high >= {bar}))" for n, bar in BARS.items()
)


@query("wilson_verdict", f"""
SELECT agent_name, {', '.join(f'round({n}_{s}, 9) AS {n}_{s}' for n in BARS for s in ('low', 'high'))}, verdict,
  CASE WHEN verdict = 'incomplete' THEN 'incomplete' WHEN {STRADDLES} THEN 'investigate' ELSE verdict END AS honest_verdict
FROM (SELECT *, {BOUNDS} FROM ({JUDGED}))""")
def wilson_verdict(t):
    cards = S.with_verdict(S.with_rates(S.pass_counts(t.case_runs, AGENT)))
    bounds = [f"{n}_{s}" for n in BARS for s in ("low", "high")]
    return rounded(S.wilson_verdict(cards), *bounds).select("agent_name", *bounds, "verdict", "honest_verdict")


@query("run_diff", """
WITH b AS (SELECT case_id, exec_match FROM {case_runs} WHERE case_pos % 10 <> 3),
a AS (SELECT case_id, CASE WHEN case_pos % 17 = 0 THEN NOT exec_match ELSE exec_match END AS exec_match
  FROM {case_runs} WHERE case_pos % 10 <> 7)
SELECT coalesce(b.case_id, a.case_id) AS case_id, b.exec_match AS before_match, a.exec_match AS after_match,
  CASE WHEN b.case_id IS NULL THEN 'added' WHEN a.case_id IS NULL THEN 'removed'
    WHEN b.exec_match AND NOT a.exec_match THEN 'regression' WHEN NOT b.exec_match AND a.exec_match THEN 'improvement'
    ELSE 'unchanged' END AS change
FROM b FULL JOIN a ON b.case_id = a.case_id""")
def run_diff(t):
    cases, pos = t.case_runs, F.col("case_pos")
    flipped = F.when(pos % 17 == 0, ~F.col("exec_match")).otherwise(F.col("exec_match"))
    return P.run_diff(
        cases.filter(pos % 10 != 3), cases.filter(pos % 10 != 7).withColumn("exec_match", flipped), ["case_id"]
    )


@query("canonical_share", """
WITH used AS (SELECT source AS agent_name, unnest([source, lang, concat(source, '_archive')]) AS t FROM documents)
SELECT agent_name, count(*) AS "references", round(count(c.t) * 1.0::DOUBLE / count(*), 9) AS canonical_share
FROM used LEFT JOIN (SELECT DISTINCT source AS t FROM documents UNION SELECT 'en') c ON used.t = c.t GROUP BY agent_name""")
def canonical_share(t):
    documents = t.documents
    cases = documents.select(
        F.col("source").alias("agent_name"),
        F.array("source", "lang", F.concat("source", F.lit("_archive"))).alias("tables"),
    )
    english = t.spark.range(1).select(F.lit("en").alias("table_name"))
    canonical = documents.select(F.col("source").alias("table_name")).union(english)
    return rounded(P.canonical_share(cases, canonical, AGENT), "canonical_share")


@query("coverage", """
SELECT tier, category, domain, count(*) AS cases FROM {case_runs} GROUP BY CUBE (tier, category, domain)""")
def coverage(t):
    return C.coverage(t.case_runs)


@query("corpus_lint", f"""
WITH goldens AS ({GOLDENS})
SELECT DISTINCT id, 'duplicate_prompt' AS rule, CAST(n AS STRING) AS value FROM (
  SELECT id, lower(regexp_replace(prompt, '[\\t-\\r ]+', ' ', 'g')) AS p FROM goldens) JOIN (
  SELECT lower(regexp_replace(prompt, '[\\t-\\r ]+', ' ', 'g')) AS p, count(DISTINCT id) AS n FROM goldens GROUP BY 1) USING (p) WHERE n > 1
UNION ALL SELECT id, 'missing_reasoning', '' FROM goldens WHERE golden_reasoning = ''""")
def corpus_lint(t):
    return C.corpus_lint(C.golden_cases(t.corpus_raw, include_drafts=True))


@query("rephrase_consistency", """
SELECT lower(source) AS variant_set, lang, count(*) AS phrasings,
  count(DISTINCT CASE WHEN n_chars > 200 THEN 'long' ELSE lang END) = 1 AS consistent
FROM documents GROUP BY 1, 2""")
def rephrase_consistency(t):
    answer = F.sha2(F.when(F.col("n_chars") > 200, F.lit("long")).otherwise(F.col("lang")), 256)
    answers = t.documents.select(F.lower("source").alias("variant_set"), "lang", answer.alias("result_hash"))
    return P.rephrase_consistency(answers, ["variant_set", "lang"], "result_hash")
