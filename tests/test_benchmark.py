"""A run from SQL texts to scorecards and report files."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from evalspark.plans.benchmark import run_benchmark
from evalspark.plans.reporting import report_lines, write_reports

CASES = {
    "same": ("SELECT o_orderstatus, count(*) AS n FROM t_orders GROUP BY 1", "SELECT o_orderstatus, sum(1) AS n FROM t_orders GROUP BY 1 ORDER BY n"),
    "filter": ("SELECT count(*) AS n FROM t_orders WHERE o_orderstatus = 'F'", "SELECT count(*) AS n FROM t_orders"),
    "columns": ("SELECT count(*) AS n FROM t_orders", "SELECT count(*) AS m FROM t_orders"),
    "comment": ("-- nothing to select", "SELECT 1 AS one"),
    "write": ("SELECT 1 AS one", "DELETE FROM t_orders"),
    "typo": ("SELECT 1 AS one", "SELECT nothing_here FROM t_orders"),
    "dump": ("SELECT 1 AS one", "SELECT * FROM t_orders CROSS JOIN range(10)"),
    "empty": ("SELECT o_orderkey FROM t_orders WHERE false", "SELECT o_orderkey FROM t_orders WHERE o_orderkey < 0"),
    "twins": ("SELECT 1 AS a", "SELECT 1 AS a, 2 AS a"),
}


def test_run_benchmark(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").createOrReplaceTempView("t_orders")
    goldens = spark.createDataFrame(
        [(c, i, "T1", "business_logic", "sales", f"Question {c}?", g) for i, (c, (g, _)) in enumerate(CASES.items())],
        "id string, case_pos int, tier string, category string, domain string, prompt string, golden_sql string",
    )
    inputs = spark.createDataFrame(
        [("one", c, a, "explained") for c, (_, a) in CASES.items()] + [("two", "same", CASES["same"][0], "e")],
        "agent_name string, id string, agent_sql string, agent_explanation string",
    )
    verdicts = inputs.filter("id <> 'empty'").select(
        "agent_name", F.col("id").alias("case_id"), F.lit(1).alias("factual_accuracy"), F.lit(1).alias("completeness"),
        F.lit(1).alias("no_hallucination"), F.lit(None).cast("string").alias("failure_category"),
        F.lit("fine").alias("reasoning"), F.lit(None).cast("string").alias("judge_error"),
    )
    cases, cards = run_benchmark(spark, goldens, inputs, verdicts)
    got = {(r["agent_name"], r["case_id"]): r for r in cases.collect()}
    assert len(got) == 10
    one = {c: got[("one", c)] for c in CASES}
    assert [c for c, r in one.items() if r["exec_match"]] == ["same", "empty"]
    assert one["filter"]["summary"] == "values differ in 1 rows (1 mismatched)"
    assert one["columns"]["summary"] == "column mismatch (peak: ['n'], agent: ['m'])"
    assert one["comment"]["error"] == "peak_sql: empty SQL" and not one["comment"]["judged"]
    assert one["write"]["error"].startswith("agent_sql: only SELECT/WITH")
    assert one["typo"]["error"].startswith("agent_sql: dry-run failed: UNRESOLVED_COLUMN")
    assert one["dump"]["error"] is None and not one["dump"]["exec_match"]  # no cap unless one is asked for
    assert one["twins"]["error"].startswith("agent_sql: duplicate column")
    assert one["empty"]["error"] == "judge: no verdict" and one["empty"]["exec_match"]
    assert one["same"]["optimization"] == "comparable" and one["filter"]["optimization"] == "n/a"
    assert one["typo"]["optimization"] is None
    assert one["same"]["golden_rows"] == one["same"]["agent_rows"] == 3
    totals = {r["agent_name"]: (r["headline_passed"], r["headline_total"]) for r in cards.collect()}
    assert totals == {"one": (2, 9), "two": (1, 1)}

    out = str(tmp_path / "reports")
    write_reports(report_lines(cases, cards, ["agent_name"]), out, ["agent_name"])
    text = ""
    for part in sorted(glob.glob(out + "/agent_name=one/*.txt")):
        with open(part, encoding="utf-8") as f:
            text += f.read()
    assert text.startswith("# Benchmark run — one\n")
    heads = [line.split()[1] for line in text.splitlines() if line.startswith("### ")]
    assert heads == list(CASES)
    assert "**❌ Error:** peak_sql: empty SQL" in text
