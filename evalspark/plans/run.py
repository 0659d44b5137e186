"""A whole benchmark run that can stop anywhere and go on.

A run lives in one folder. Every stage writes a table there, and the writer's
success file is its entry in the manifest: a stage that has one is read back, any
other is computed anew. ``prepare`` goes from submissions to judge requests; the
judge is called elsewhere; ``finish`` takes the answers, scores, reports, and
records the run in the ledger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evalspark.constants import RESULT_HEAD_ROWS
from evalspark.operators import corpus as C, diff, judging as J, ledger as L
from evalspark.operators.ordering import null_safe_join
from evalspark.plans.benchmark import CASE_KEYS, VERDICT_COLUMNS, compare_results, execute_pairs, score_cases
from evalspark.plans.reporting import report_lines, write_reports
from evalspark.plans.scorecard import scorecard
from evalspark.sources.ledger_store import append_runs, newest_entries
from evalspark.sources.sql_runner import CELLS_SCHEMA

AGENT = ["agent_name"]
GOLDEN_FIELDS = ["id", "tier", "category", "domain", "prompt", "golden_sql", "golden_reasoning"]
ANSWER_FIELDS = ["id", "agent_sql", "agent_explanation"]
PREPARED = ("submissions", "lists", "pairs", "executed", "diffs", "stats", "requests")
FINISHED = ("verdicts", "cases", "cards", "reported", "recorded")


def csv_cell(cell: Column) -> Column:
    """An encoded cell as CSV: empty where missing, quoted where it has to be."""
    text = F.when(cell["missing"] == 1, F.lit("")).otherwise(F.coalesce(cell["txt"], F.lit("")))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text)


def golden_heads(rows: DataFrame, stats: DataFrame, head: int = RESULT_HEAD_ROWS) -> DataFrame:
    """``case_id, golden_result_csv``: the first ``head`` rows of every golden result as CSV under its header.

    Rows are those of ``execute_pairs``. An empty result is its header alone. At
    most ``head`` rows per result are gathered.
    """
    golden = rows.filter(F.col("side") == diff.GOLDEN)
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("cells"))
    line = F.array_join(F.transform("cells", csv_cell), ",")
    lines = golden.withColumn("_rank", rank).filter(F.col("_rank") <= head).groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("_rank", line.alias("line")))).alias("_lines"))
    ran = stats.filter((F.col("side") == diff.GOLDEN) & F.col("error").isNull()).select("case_id", "cols", "n_rows")
    body = F.array_join(F.transform("_lines", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    note = F.when(F.col("n_rows") > head, F.concat(
        F.lit(f"\n[truncated to first {head} of "), F.col("n_rows").cast("string"), F.lit(" rows]\n"))).otherwise(F.lit(""))
    return ran.join(lines, "case_id", "left").select("case_id", F.concat(
        F.array_join("cols", ","), F.lit("\n"), F.coalesce(body, F.lit("")), note).alias("golden_result_csv"))


class BenchmarkRun:
    """One run over any number of agents, in the folder ``path``, against the ledger in ``ledger``."""

    def __init__(self, spark: SparkSession, path: str, ledger: str, template: str = J.DEFAULT_TEMPLATE, width: int = 8):
        self.spark, self.path, self.ledger, self.template, self.width = spark, path.rstrip("/"), ledger, template, width

    def _is_done(self, stage: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{stage}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def _stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self._is_done(name):
            build().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def done(self) -> list[str]:
        """The stages in the manifest, in order."""
        return [stage for stage in (*PREPARED, *FINISHED) if self._is_done(stage)]

    def _submissions(self, goldens: DataFrame, inputs: DataFrame, force: bool) -> DataFrame:
        blobs = L.canonical_blob(inputs, AGENT, ANSWER_FIELDS).withColumn("corpus", F.lit("corpus"))
        corpus = L.canonical_blob(goldens.withColumn("corpus", F.lit("corpus")), ["corpus"], GOLDEN_FIELDS)
        judge_hash = self.spark.range(1).select(J.prompt_hash(F.lit(self.template))).first()[0]
        prints = L.fingerprints(blobs, corpus, judge_hash)
        prior = newest_entries(self.spark, self.ledger).select(
            "fingerprint", F.col("report_path").alias("prior_report"), F.col("finished_at").alias("prior_finished_at"),
            F.col("source_csv").alias("prior_source"))
        return prints.join(prior, "fingerprint", "left").select(
            "agent_name", "fingerprint", "agent_hash", "corpus_hash", "judge_prompt_hash", "prior_report", "prior_finished_at", "prior_source",
            F.lit(force).alias("forced"), (F.col("prior_finished_at").isNull() | F.lit(force)).alias("accepted"))

    def _execute(self, pairs: DataFrame) -> DataFrame:
        """Run all texts in a folder of their own; the manifest says which one counts."""
        folder = f"{self.path}/attempt-{uuid.uuid4().hex}"
        execute_pairs(pairs, width=self.width, path=folder)
        return self.spark.createDataFrame([(folder,)], "folder string")

    def _results(self, executed: DataFrame) -> tuple[DataFrame, DataFrame]:
        folder = executed.first()["folder"]
        tags = "side string, agent_name string, case_id string"
        stats = self.spark.read.parquet(f"{folder}/golden/stats", f"{folder}/agent/stats")
        parts = [self.spark.createDataFrame([], f"{CELLS_SCHEMA}, {tags}")]
        for side in (diff.GOLDEN, diff.AGENT):
            if not stats.filter((F.col("side") == side) & F.col("error").isNull()).isEmpty():
                parts.append(self.spark.read.schema(f"{CELLS_SCHEMA}, {tags}").option("recursiveFileLookup", True).parquet(f"{folder}/{side}/rows"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows, stats

    def prepare(self, goldens: DataFrame, inputs: DataFrame, force: bool = False) -> DataFrame:
        """Judge requests of all cases whose queries ran: ``agent_name, case_id, request``.

        ``goldens`` and ``inputs`` are checked tables (``golden_cases``,
        ``agent_inputs``). Submissions whose fingerprint the ledger knows are
        refused unless ``force``; ``submissions`` tells which.
        """
        submissions = self._stage("submissions", lambda: self._submissions(goldens, inputs, force))
        accepted = submissions.filter("accepted").select("agent_name")
        mine = inputs.join(accepted, "agent_name", "left_semi")
        self._stage("lists", lambda: C.unmatched_lists(goldens, mine, accepted))
        pairs = self._stage("pairs", lambda: C.pair_cases(goldens, mine).withColumnRenamed("id", "case_id"))
        rows, run_stats = self._results(self._stage("executed", lambda: self._execute(pairs)))
        compared = compare_results(pairs, rows, run_stats)
        diffs = self._stage("diffs", lambda: compared[0])
        stats = self._stage("stats", lambda: compared[1])

        def requests() -> DataFrame:
            good = stats.filter("golden_error IS NULL AND agent_error IS NULL").select(*CASE_KEYS)
            shown = F.when(F.col("detail") == "", F.col("summary")).otherwise(F.concat_ws("\n", "summary", "detail"))
            cases = null_safe_join(pairs, good, CASE_KEYS, "left_semi").withColumn("agent_answer", F.col("agent_explanation"))
            filled = null_safe_join(cases, diffs.select(*CASE_KEYS, shown.alias("exec_diff")), CASE_KEYS, "left").join(
                golden_heads(rows, run_stats), "case_id", "left")
            return J.judge_requests(filled, self.template).select(*CASE_KEYS, "request")

        return self._stage("requests", requests)

    def finish(self, answers: DataFrame, reports: str, finished_at: str, judge_model: str, sources: DataFrame | None = None) -> DataFrame:
        """Scorecards after scoring, reporting and recording.

        ``answers`` are ``agent_name, case_id, response`` and, if known,
        ``input_tokens, output_tokens``; a case without an answer counts as not
        judged. ``sources`` names the submitted file per agent (``source_csv``).
        A fingerprint that another run has recorded since is a conflict, unless
        the run was forced; nothing is recorded then.
        """
        missing = [stage for stage in PREPARED if not self._is_done(stage)]
        if missing:
            raise RuntimeError(f"not prepared yet: {', '.join(missing)}")
        read = lambda stage: self.spark.read.parquet(f"{self.path}/{stage}")
        submissions = read("submissions").filter("accepted")
        verdicts = self._stage("verdicts", lambda: J.judge_verdicts(answers, "response").withColumnRenamed("error", "judge_error"))
        cases = self._stage("cases", lambda: score_cases(
            read("pairs"), read("diffs"), read("stats"), verdicts.select(*CASE_KEYS, *VERDICT_COLUMNS)))
        cards = self._stage("cards", lambda: scorecard(cases))

        def reported() -> DataFrame:
            info = submissions.select("agent_name", "judge_prompt_hash").withColumns({
                "finished_at": F.lit(finished_at), "judge_model": F.lit(judge_model)})
            if "input_tokens" in verdicts.columns:
                info = info.join(J.judge_usage(verdicts, AGENT).select("agent_name", "usage"), "agent_name", "left")
            # a folder that a stopped attempt has left is not written into again
            target = f"{reports.rstrip('/')}/{uuid.uuid4().hex}"
            write_reports(report_lines(cases, cards.join(info, "agent_name"), AGENT, read("lists")), target, AGENT)
            return submissions.select("agent_name", F.concat(F.lit(f"{target}/agent_name="), "agent_name").alias("report_path"))

        written = self._stage("reported", reported)

        def recorded() -> DataFrame:
            entries = submissions.join(written, "agent_name").withColumns({
                "run_id": F.unix_timestamp(F.lit(finished_at).cast("timestamp")),
                "finished_at": F.lit(finished_at).cast("timestamp_ntz")})
            named = entries.withColumn("source_csv", F.lit(None).cast("string")) if sources is None else entries.join(
                sources.select("agent_name", "source_csv"), "agent_name", "left")
            forced = not submissions.filter("forced").isEmpty()
            version = append_runs(named, self.ledger, force=forced)
            return self.spark.createDataFrame([(version,)], "version bigint")

        self._stage("recorded", recorded)
        return cards
