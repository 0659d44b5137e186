"""Run fingerprints and the ledger of finished runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.constants import FIELD_SEPARATOR, FINGERPRINT_HEX, RECENT_RUNS
from evalspark.functions.text import clean
from evalspark.operators.ordering import previous_row

HASH_WORDS = 8  # 32 bits each
COMPONENTS = ("agent_hash", "corpus_hash", "judge_prompt_hash")


def sha16(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(FINGERPRINT_HEX))


def canonical_blob(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One short canonical text per key, the same form at every size: the row count and eight sums.

    Fields are stripped and joined; the sums run over the eight 32-bit words of
    every row's sha256. Equal content gives an equal text in whatever order the
    rows come, and any row or copy more or less changes it. Rows are summed where
    they are read, so a key of any size leaves one row per task. The sums detect
    changes; they are no defence against texts forged to collide.
    """
    line = F.concat_ws(FIELD_SEPARATOR, *[clean(F.col(f).cast("string")) for f in fields])
    hashed = rows.select(*keys, F.sha2(line, 256).alias("_hash"))
    sums = [
        F.sum(F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(HASH_WORDS)
    ]
    return hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("blob")
    )


def run_fingerprint(agent: Column, corpus: Column, judge_hash: Column) -> Column:
    """Hash over the blobs of submission and corpus and the judge prompt: any change gives a new run."""
    return sha16(F.concat(F.lit("agent:"), agent, F.lit("\ncorpus:"), corpus, F.lit("\njudge:"), judge_hash))


def fingerprints(agents: DataFrame, corpora: DataFrame, judge_hash: str) -> DataFrame:
    """Fingerprint and component hashes of every submission against its ``corpus``."""
    named = corpora.select("corpus", F.col("blob").alias("_corpus"))
    return agents.join(named, "corpus").withColumns({
        "agent_hash": sha16(F.col("blob")),
        "corpus_hash": sha16(F.col("_corpus")),
        "judge_prompt_hash": F.lit(judge_hash),
        "fingerprint": run_fingerprint(F.col("blob"), F.col("_corpus"), F.lit(judge_hash)),
    }).drop("_corpus", "blob")


def newest_runs(ledger: DataFrame) -> DataFrame:
    """The latest entry per fingerprint; combines before the shuffle."""
    rest = [c for c in ledger.columns if c not in ("fingerprint", "finished_at", "run_id")]
    last = F.max(F.struct("finished_at", "run_id", *rest)).alias("_last")
    return ledger.groupBy("fingerprint").agg(last).select("fingerprint", "_last.*").select(*ledger.columns)


def first_runs(ledger: DataFrame) -> DataFrame:
    """The first run per fingerprint; the later ones would have been refused."""
    rest = [c for c in ledger.columns if c not in ("fingerprint", "finished_at", "run_id")]
    first = F.min(F.struct("finished_at", "run_id", *rest)).alias("_first")
    return ledger.groupBy("fingerprint").agg(first).select("fingerprint", "_first.*").select(*ledger.columns)


def ledger_upsert(ledger: DataFrame, finished: DataFrame) -> DataFrame:
    """Ledger after recording new runs: an entry replaces the one before it."""
    return newest_runs(ledger.unionByName(finished))


def ledger_lookup(submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Submissions with the prior identical run, if any."""
    prior = newest_runs(ledger).select(
        "fingerprint", F.col("agent_name").alias("prior_agent"), F.col("finished_at").alias("prior_finished_at"),
        F.col("report_path").alias("prior_report"),
    )
    return submissions.join(prior, "fingerprint", "left").withColumn(
        "already_run", F.col("prior_report").isNotNull()
    )


def runs_to_execute(submissions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Submissions without a prior identical run, and forced ones."""
    known = ledger.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    looked = submissions.join(known, "fingerprint", "left")
    return looked.filter(F.col("_known").isNull() | F.col("forced")).drop("_known")


def recent_runs(ledger: DataFrame, top: int = RECENT_RUNS) -> DataFrame:
    return ledger.orderBy(F.desc("finished_at"), F.desc("run_id"), "fingerprint").limit(top)


def changed_components(ledger: DataFrame) -> DataFrame:
    """Per run, which inputs differ from the same agent's run before it."""
    carried = ["run_id", *COMPONENTS]
    looked = previous_row(ledger, ["agent_name"], ["finished_at", "run_id"], carried)
    changed = F.array_compact(F.array(*[
        F.when(F.col(c) != F.col(f"prev_{c}"), F.lit(c)) for c in COMPONENTS
    ]))
    return looked.select(
        "agent_name", "run_id", F.col("prev_run_id"),
        F.when(F.col("prev_run_id").isNotNull(), F.array_join(changed, ",")).alias("changed"),
    )
