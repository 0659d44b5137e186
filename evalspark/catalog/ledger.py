"""Fingerprints and the run ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import query
from evalspark.operators import ledger as L
from evalspark.session import scratch_path
from evalspark.sources.ledger_store import LedgerConflict, append_runs, newest_entries

JUDGE_HASH = "0f1e2d3c"
FIELDS = ["case_id", "agent_sql", "agent_explanation"]

# shared pieces of the checks
def blob_sql(line: str) -> str:
    words = [f"sum(CAST(concat('0x', substr(sha256({line}), {8 * i + 1}, 8)) AS BIGINT))" for i in range(8)]
    return f"concat_ws(':', count(*), {', '.join(words)})"


BLOBS = f"""SELECT submission, count(*) AS n_rows, {blob_sql(
    "concat(CAST(case_id AS STRING), chr(31), agent_sql, chr(31), agent_explanation)")} AS blob
  FROM {{submissions}} GROUP BY submission"""
CORPUS = f"""SELECT {blob_sql("concat(CAST(item_id AS STRING), chr(31), trim(text))")} AS corpus FROM benchmark"""
PRINTS = f"""SELECT submission, substr(sha256(blob), 1, 16) AS agent_hash, substr(sha256(corpus), 1, 16) AS corpus_hash,
    '{JUDGE_HASH}' AS judge_prompt_hash, substr(sha256(concat('agent:', blob, chr(10), 'corpus:', corpus, chr(10),
    'judge:', '{JUDGE_HASH}')), 1, 16) AS fingerprint
  FROM ({BLOBS}), ({CORPUS})"""
# every third submission has run before
PRIOR = f"""SELECT fingerprint, concat('agent_', submission) AS agent_name, concat('runs/', submission, '.md') AS report_path,
    length(submission) AS run_id, TIMESTAMP '2024-01-01' AS finished_at
  FROM ({PRINTS}) WHERE ascii(substr(fingerprint, 1, 1)) % 3 = 0"""


def submission_blobs(t):
    return L.canonical_blob(t.submissions, ["submission"], FIELDS).withColumn("corpus", F.lit("benchmark"))


def fingerprints(t):
    named = t.benchmark.withColumn("corpus", F.lit("benchmark"))
    corpora = L.canonical_blob(named, ["corpus"], ["item_id", "text"])
    return L.fingerprints(submission_blobs(t), corpora, JUDGE_HASH)


def prior_runs(prints):
    return prints.filter(F.ascii(F.substring("fingerprint", 1, 1)) % 3 == 0).select(
        "fingerprint", F.concat(F.lit("agent_"), "submission").alias("agent_name"),
        F.length("submission").cast("bigint").alias("run_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("finished_at"),
        F.concat(F.lit("runs/"), "submission", F.lit(".md")).alias("report_path"),
    )


@query("canonical_blob", BLOBS)
def canonical_blob(t):
    return submission_blobs(t).select("submission", "n_rows", "blob")


@query("run_fingerprint", f"SELECT submission, fingerprint FROM ({PRINTS})")
def run_fingerprint(t):
    return fingerprints(t).select("submission", "fingerprint")


@query("component_hashes", f"SELECT submission, agent_hash, corpus_hash, judge_prompt_hash FROM ({PRINTS})")
def component_hashes(t):
    return fingerprints(t).select("submission", "agent_hash", "corpus_hash", "judge_prompt_hash")


@query("ledger_lookup", f"""
SELECT s.submission, s.fingerprint, p.agent_name AS prior_agent, p.report_path AS prior_report,
  p.report_path IS NOT NULL AS already_run
FROM ({PRINTS}) s LEFT JOIN ({PRIOR}) p ON s.fingerprint = p.fingerprint""")
def ledger_lookup(t):
    prints = fingerprints(t)
    return L.ledger_lookup(prints, prior_runs(prints)).select(
        "submission", "fingerprint", "prior_agent", "prior_report", "already_run"
    )


@query("runs_to_execute", f"""
SELECT submission, fingerprint, submission LIKE 'en%' AS forced FROM ({PRINTS})
WHERE fingerprint NOT IN (SELECT fingerprint FROM ({PRIOR})) OR submission LIKE 'en%'""")
def runs_to_execute(t):
    prints = fingerprints(t)
    wanted = prints.select("submission", "fingerprint", F.startswith("submission", F.lit("en")).alias("forced"))
    return L.runs_to_execute(wanted, prior_runs(prints)).select("submission", "fingerprint", "forced")


@query("ledger_upsert", """
SELECT * FROM {run_ledger} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY finished_at DESC, run_id DESC) = 1""")
def ledger_upsert(t):
    runs = t.run_ledger
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return L.ledger_upsert(runs.filter(F.col("finished_at") < cut), runs.filter(F.col("finished_at") >= cut))


@query("dedup_runs", """
SELECT * FROM {run_ledger} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY finished_at, run_id) = 1""")
def dedup_runs(t):
    return L.first_runs(t.run_ledger)


@query("recent_runs", "SELECT * FROM {run_ledger} ORDER BY finished_at DESC, run_id DESC, fingerprint LIMIT 25")
def recent_runs(t):
    return L.recent_runs(t.run_ledger)


@query("changed_components", """
WITH looked AS (SELECT *, lag(run_id) OVER w AS prev_run_id, lag(agent_hash) OVER w AS pa, lag(corpus_hash) OVER w AS pc,
  lag(judge_prompt_hash) OVER w AS pj FROM {run_ledger} WINDOW w AS (PARTITION BY agent_name ORDER BY finished_at, run_id))
SELECT agent_name, run_id, prev_run_id, CASE WHEN prev_run_id IS NOT NULL THEN concat_ws(',',
  CASE WHEN agent_hash <> pa THEN 'agent_hash' END, CASE WHEN corpus_hash <> pc THEN 'corpus_hash' END,
  CASE WHEN judge_prompt_hash <> pj THEN 'judge_prompt_hash' END) END AS changed FROM looked""")
def changed_components(t):
    return L.changed_components(t.run_ledger)


@query("stored_ledger", """
WITH early AS (SELECT * FROM {run_ledger} WHERE finished_at < TIMESTAMP '1998-01-01'
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY finished_at, run_id) = 1),
later AS (SELECT * FROM {run_ledger} WHERE finished_at >= TIMESTAMP '1998-01-01' AND fingerprint NOT IN (SELECT fingerprint FROM early)
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY finished_at, run_id) = 1),
forced AS (SELECT * FROM {run_ledger} WHERE fingerprint < '8'
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY finished_at DESC, run_id DESC) = 1)
SELECT *, CAST(1 AS BIGINT) AS version FROM early WHERE fingerprint >= '8'
UNION ALL BY NAME SELECT *, 2 AS version FROM later WHERE fingerprint >= '8'
UNION ALL BY NAME SELECT *, 3 AS version FROM forced""")
def stored_ledger(t):
    """A ledger on storage after two appends, two refused ones and a forced one: the newest entry per fingerprint."""
    path, runs, cut = scratch_path(t.spark, "ledger"), t.run_ledger, F.lit("1998-01-01").cast("timestamp_ntz")
    early = L.first_runs(runs.filter(F.col("finished_at") < cut))
    append_runs(early, path)
    for refused in (early, L.first_runs(runs)):  # all known; some known
        try:
            append_runs(refused, path)
        except LedgerConflict:
            continue
        raise AssertionError("a fingerprint was recorded twice")
    late = L.first_runs(L.runs_to_execute(
        runs.filter(F.col("finished_at") >= cut).withColumn("forced", F.lit(False)), newest_entries(t.spark, path)).drop("forced"))
    append_runs(late, path)
    append_runs(L.newest_runs(runs.filter(F.col("fingerprint") < "8")), path, force=True)
    return newest_entries(t.spark, path)
