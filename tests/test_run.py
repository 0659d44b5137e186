"""A run that stops and goes on, is recorded once, and is refused the second time."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from evalspark.operators.judging import DEFAULT_TEMPLATE
from evalspark.plans import run as R
from evalspark.plans.run import BenchmarkRun
from evalspark.sources.ledger_store import LedgerConflict, newest_entries

GOLDENS = [
    ("same", 0, "T1", "business_logic", "SELECT o_orderstatus, count(*) AS n FROM run_orders GROUP BY 1"),
    ("values", 1, "T1", "schema_selection", "SELECT count(*) AS n FROM run_orders WHERE o_orderstatus = 'F'"),
    ("empty", 2, "T2", "refusal_scope", "SELECT o_orderkey FROM run_orders WHERE false"),
    ("broken", 3, "T1", "efficiency", "SELECT nothing FROM run_orders"), ("left", 4, "T2", "temporal_logic", "SELECT 1 AS one"),
]
ANSWERS = {"same": GOLDENS[0][4] + " ORDER BY n", "values": "SELECT count(*) AS n FROM run_orders", "empty": GOLDENS[2][4], "broken": "SELECT 1 AS one"}
GOOD = '{"factual_accuracy": 1, "completeness": 1, "no_hallucination": 1, "failure_category": null, "reasoning": "fine"}'


@pytest.fixture
def tables(spark):
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").createOrReplaceTempView("run_orders")
    goldens = spark.createDataFrame(
        [(i, p, t, c, "sales", f"What of {i}?", s, "known") for i, p, t, c, s in GOLDENS],
        "id string, case_pos int, tier string, category string, domain string, prompt string, golden_sql string, golden_reasoning string")
    inputs = spark.createDataFrame(
        [("one", i, s, f"I did {i}", 0) for i, s in ANSWERS.items()] + [("two", "same", GOLDENS[0][4], "as asked", 0), ("two", "stray", "SELECT 1", "?", 1)],
        "agent_name string, id string, agent_sql string, agent_explanation string, case_pos int")
    return goldens, inputs


def answered(requests):
    return requests.filter("case_id <> 'empty'").select(
        "agent_name", "case_id", F.lit(GOOD).alias("response"), F.lit(1000).alias("input_tokens"), F.lit(10).alias("output_tokens"))


def test_stop_and_go_on(spark, tables, tmp_path, monkeypatch):
    goldens, inputs = tables
    ledger, path = str(tmp_path / "ledger"), str(tmp_path / "run")
    run = BenchmarkRun(spark, path, ledger)
    with pytest.raises(RuntimeError, match="not prepared"):
        run.finish(inputs, str(tmp_path / "reports"), "2024-05-01 10:00:00", "judge-one")

    def stop(*_, **__):
        raise RuntimeError("the driver went away")

    monkeypatch.setattr(R, "compare_results", stop)
    with pytest.raises(RuntimeError, match="went away"):
        run.prepare(goldens, inputs)
    assert run.done() == ["submissions", "lists", "pairs", "executed"]
    monkeypatch.undo()
    monkeypatch.setattr(R, "execute_pairs", stop)  # nothing runs twice
    again = BenchmarkRun(spark, path, ledger)
    requests = {(r["agent_name"], r["case_id"]): r["request"] for r in again.prepare(goldens, inputs).collect()}
    assert set(requests) == {("one", "same"), ("one", "values"), ("one", "empty"), ("two", "same")}  # not the broken golden
    assert "first mismatching rows:\nrow 1: n peak=" in requests[("one", "values")] and "Golden result:\no_orderkey\n" in requests[("one", "empty")]
    assert requests[("one", "same")].startswith(DEFAULT_TEMPLATE[:40]) and "I did same" in requests[("one", "same")]

    reports = str(tmp_path / "reports")
    sources = spark.createDataFrame([("one", "in/one.csv"), ("two", "in/two.csv")], "agent_name string, source_csv string")
    monkeypatch.setattr(R, "append_runs", stop)
    with pytest.raises(RuntimeError, match="went away"):
        again.finish(answered(again.prepare(goldens, inputs)), reports, "2024-05-01 10:00:00", "judge-one", sources)
    assert again.done()[-1] == "reported" and newest_entries(spark, ledger).count() == 0
    monkeypatch.undo()
    cards = again.finish(answered(again.prepare(goldens, inputs)), reports, "2024-05-01 10:00:00", "judge-one", sources)
    assert {r["agent_name"]: (r["headline_passed"], r["headline_total"]) for r in cards.collect()} == {"one": (1, 3), "two": (1, 1)}
    entries = {r["agent_name"]: r for r in newest_entries(spark, ledger).collect()}
    assert entries["two"]["source_csv"] == "in/two.csv" and len(entries["one"]["fingerprint"]) == 16
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(entries["one"]["report_path"].removeprefix("file:") + "/*.txt")))
    for line in ("# Benchmark run — one — 2024-05-01 10:00:00", "- **Judge model:** judge-one", "- **Usage:** 2 calls, 2,000 in / 20 out tokens",
                 "⚠ **Prompts not answered by agent:** left", "## Per-case detail", "**❌ Error:** peak_sql: dry-run failed", "row 1: n peak=",
                 "Efficiency / cost (1)", "**❌ Error:** judge: no verdict"):
        assert line in text, line
    two = "".join(open(f, encoding="utf-8").read() for f in glob.glob(entries["two"]["report_path"].removeprefix("file:") + "/*.txt"))
    assert "⚠ **Agent inputs without matching golden:** stray" in two

    # the same submissions again: refused; one changed answer: only that agent runs
    second = BenchmarkRun(spark, str(tmp_path / "second"), ledger)
    assert second.prepare(goldens, inputs).count() == 0
    told = spark.read.parquet(str(tmp_path / "second/submissions")).collect()
    assert {(r["accepted"], r["prior_source"]) for r in told} == {(False, "in/one.csv"), (False, "in/two.csv")}
    changed = inputs.withColumn("agent_explanation", F.when(F.col("agent_name") == "two", "changed").otherwise(F.col("agent_explanation")))
    third = BenchmarkRun(spark, str(tmp_path / "third"), ledger)
    assert {r["agent_name"] for r in third.prepare(goldens, changed).collect()} == {"two"}


def test_forced_runs_and_late_conflicts(spark, tables, tmp_path):
    goldens, inputs = tables
    only = inputs.filter("agent_name = 'two'")
    ledger = str(tmp_path / "ledger")
    runs = [BenchmarkRun(spark, str(tmp_path / name), ledger) for name in ("a", "b", "c")]
    wanted = [runs[k].prepare(goldens, only) for k in (0, 1)]  # both start before either has finished
    runs[0].finish(answered(wanted[0]), str(tmp_path / "ra"), "2024-05-01 10:00:00", "judge-one")
    with pytest.raises(LedgerConflict):
        runs[1].finish(answered(wanted[1]), str(tmp_path / "rb"), "2024-05-01 11:00:00", "judge-one")
    requests = runs[2].prepare(goldens, only, force=True)
    assert requests.count() == 1
    runs[2].finish(answered(requests), str(tmp_path / "rc"), "2024-05-02 10:00:00", "judge-one")
    assert [(r["version"], r["report_path"].count("/rc/")) for r in newest_entries(spark, ledger).collect()] == [(2, 1)]
