from __future__ import annotations

import hashlib
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from evalspark.catalog import judging
from evalspark.operators import calibration as C, judging as J, ledger as L

GOOD = {"factual_accuracy": 1, "completeness": 0, "no_hallucination": True, "failure_category": "wrong_join", "reasoning": "a {b} c"}
ANSWERS = {
    "plain": (json.dumps(GOOD), None), "fenced": (f"Sure:\n```json\n{json.dumps(GOOD)}\n```\nDone {{x}}", None),
    "bare_fence": (f"```\n{json.dumps(GOOD)}\n```", None), "prose": (f"I say {json.dumps(GOOD)} and that is it", None),
    "none": ("no idea", "no JSON object"), "broken": ('{"factual_accuracy": 1,', "no JSON object"),
    "two_broken": ('{"factual_accuracy": 1 oops}', "no JSON object"), "list": (f"[{json.dumps(GOOD)}]", "no JSON object"),
    "missing": ('{"factual_accuracy": 1, "no_hallucination": 1}', "missing completeness"),
    "null": ('{"factual_accuracy": null, "completeness": 1, "no_hallucination": 1}', "missing factual_accuracy"),
}


def test_verdicts(spark):
    table = spark.createDataFrame([(k, a) for k, (a, _) in ANSWERS.items()], "k string, raw string")
    got = {r["k"]: r for r in J.judge_verdicts(table, "raw").collect()}
    assert {k: r["error"] for k, r in got.items()} == {k: e for k, (_, e) in ANSWERS.items()}
    for k in ("plain", "fenced", "bare_fence", "prose"):
        r = got[k]
        assert (r["factual_accuracy"], r["completeness"], r["no_hallucination"]) == (1, 0, 1)
        assert (r["failure_category"], r["reasoning"]) == ("wrong_join", "a {b} c")
    assert got["missing"]["factual_accuracy"] is None


def test_unknown_category_becomes_null(spark):
    raw = json.dumps({**GOOD, "failure_category": "bad_mood"})
    assert J.judge_verdicts(spark.createDataFrame([(raw,)], "raw string"), "raw").first()["failure_category"] is None


def test_request_keeps_braces_of_values(spark):
    slots = {s: f"<{s} {{prompt}}>" for s in J.SLOTS}
    table = spark.createDataFrame([tuple(slots.values())], ", ".join(f"{s} string" for s in slots))
    template = "Q {prompt} {{literal}} A {agent_answer}"
    assert J.judge_requests(table, template).first()["request"] == template.format(**slots)
    assert J.judge_requests(table).first()["request"] == J.DEFAULT_TEMPLATE.format(**slots)


def test_budget_with_a_hot_run(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"r{i % 5}", rng.randint(0, 20), i) for i in range(300)]
    seen, expected = {}, {}
    for run, t, i in sorted(rows):
        seen[run] = seen.get(run, 0) + 1
        expected[i] = seen[run] <= 30
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "run string, t int, i int").repartition(6)
    got = {r["i"]: r["allowed"] for r in J.judge_budget(table, "run", ["t", "i"], 30).collect()}
    assert got == expected


def test_usage(spark):
    row = J.judge_usage(spark.createDataFrame([("r", 1000, 10), ("r", 500, 90)], "run string, input_tokens int, output_tokens int"), ["run"]).first()
    assert row["usage"] == "2 calls, 1,500 in / 100 out tokens, ~$0.0060"
    assert row["cost_usd"] == pytest.approx((1500 * 3 + 100 * 15) / 1e6)


def test_result_head(spark):
    rows = [("a", i) for i in range(5)] + [("b", 7)]
    heads = J.result_csv_head(spark.createDataFrame(rows, "k string, n int"), ["k"], ["n"], ["n"], head=3)
    assert {r["k"]: r["csv"] for r in heads.collect()} == {
        "a": "n\n0\n1\n2\n\n[truncated to first 3 of 5 rows]\n", "b": "n\n7\n",
    }


def test_requests_of_empty_results(spark):
    """Golden result empty, both results empty, no result known at all: each case keeps its request."""
    result = "case_id int, l_returnflag string, l_linestatus string, n bigint, sum_qty double"
    cols = "l_returnflag,l_linestatus,n,sum_qty"
    given = SimpleNamespace(
        supplier=spark.createDataFrame([(k, f"S{k}", k) for k in range(1, 5)], "s_suppkey int, s_name string, s_nationkey int"),
        golden_results=spark.createDataFrame([(1, "A", "F", 2, 3.0)], result),
        agent_results=spark.createDataFrame([(1, "A", "F", 2, 3.0), (2, "A", "F", 2, 3.0)], result),
        result_columns=spark.createDataFrame([(k, side, cols) for k in (1, 2, 3) for side in ("golden", "agent")], "case_id int, side string, cols string"))
    got = {r["case_id"]: r["request"] for r in judging.judge_requests(given).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert f"Golden result:\n{cols}\nA,F,2,3.0\n\n\nAgent SQL:" in got[1]
    assert all(f"Golden result:\n{cols}\n\n\nAgent SQL:" in got[k] for k in (2, 3, 4))
    assert "row count differs: peak=0, agent=1" in got[2] and "results match" in got[3]


# --- calibration --------------------------------------------------------------------

def scores(spark, cells, dim="d"):
    rows = [(i, dim, h, j) for i, (h, j) in enumerate(p for p, n in cells.items() for _ in range(n))]
    return spark.createDataFrame(rows, "case_id int, dim string, human int, judge int")


@pytest.mark.parametrize("cells,kappa,label", [
    ({(1, 1): 20, (1, 0): 5, (0, 1): 9, (0, 0): 16}, 0.44, "moderate"),
    ({(1, 1): 10}, 1.0, "almost perfect"),               # chance agreement 1, all agree
    ({(1, 1): 90, (1, 0): 10}, 0.0, "poor"),             # a judge with one answer per human class
    ({(1, 0): 5, (0, 1): 5}, -1.0, "poor"),
    ({(1, 1): 6, (0, 0): 4}, 1.0, "almost perfect"),
])
def test_kappa(spark, cells, kappa, label):
    row = C.cohens_kappa(scores(spark, cells), ["dim"]).first()
    assert row["kappa"] == pytest.approx(kappa, abs=1e-12) and row["label"] == label


def test_kappa_without_cases_is_zero(spark):
    row = C.agreement_counts(scores(spark, {(1, 1): 1}).limit(0), []).select(
        C.kappa(F.col("n"), F.col("agreed"), F.col("human_ones"), F.col("judge_ones")).alias("k")
    ).first()
    assert row["k"] == 0.0


def test_bootstrap_interval_covers_kappa_and_narrows(spark):
    cells = {(1, 1): 20, (1, 0): 5, (0, 1): 10, (0, 0): 15}
    small = C.kappa_bootstrap(scores(spark, cells), ["dim"]).first()
    large = C.kappa_bootstrap(scores(spark, {k: 40 * n for k, n in cells.items()}), ["dim"]).first()
    for row in (small, large):
        assert row["low"] < row["kappa"] < row["high"] and row["kappa"] == pytest.approx(0.4)
    assert large["high"] - large["low"] < (small["high"] - small["low"]) / 4
    assert not small["conclusive"] and large["conclusive"]


def test_reports_are_read_from_a_folder(spark, tmp_path):
    from evalspark.sources.files import read_reports

    for name, pct in (("2024-01-02_030405_0123abcd.md", 91), ("2024-05-02_030405_0123abcd.md", 84), ("notes.md", 1)):
        (tmp_path / name).write_text(f"# Run\n\n- **Overall agreement:** {pct}% (n)\n")
    row = C.latest_calibration(read_reports(spark, str(tmp_path))).first()
    assert (row["timestamp"], row["prompt_hash"], row["agreement_pct"]) == ("2024-05-02_030405", "0123abcd", 84)


def test_category_agreement_is_null_safe(spark):
    table = spark.createDataFrame([(None, None), ("a", None), ("a", "a"), ("a", "b")], "human_category string, judge_category string")
    assert C.category_agreement(table).first()["agreed"] == 2


def test_latest_report_and_freshness(spark):
    files = spark.createDataFrame([
        ("s", "x/2024-01-02_030405_0123abcd.md", "- **Overall agreement:** 91%"),
        ("s", "x/2025-01-02_030405_ffff0000.md", "nothing"), ("s", "x/2026-01-02_030405_xyz.md", ""), ("t", "x/readme.md", ""),
    ], "k string, path string, body string")
    latest = C.latest_calibration(files, ["k"])
    assert [(r["k"], r["prompt_hash"], r["agreement_pct"]) for r in latest.collect()] == [("s", "ffff0000", None)]
    assert C.latest_calibration(files.filter("k = 't'")).count() == 0
    current = spark.createDataFrame([("s", "ffff0000"), ("t", "ffff0000")], "k string, prompt_hash string")
    got = {r["k"]: (r["state"], r["status"]) for r in C.calibration_freshness(current, latest, ["k"]).collect()}
    assert got["s"] == ("current", "Judge calibrated: 2025-01-02 (? agreement, current prompt)")
    assert got["t"][0] == "never"


# --- fingerprints ---------------------------------------------------------------------

def blob(spark, rows):
    table = spark.createDataFrame(rows, "s string, id string, q string").repartition(5)
    return {r["s"]: (r["n_rows"], r["blob"]) for r in L.canonical_blob(table, ["s"], ["id", "q"]).collect()}


def blob_by_hand(lines):
    digests = [hashlib.sha256("\x1f".join(x).encode()).digest() for x in lines]
    return ":".join(map(str, [len(lines), *[sum(int.from_bytes(d[k: k + 4], "big") for d in digests) for k in range(0, 32, 4)]]))


def test_blob_and_fingerprint_equal_a_plain_hash(spark):
    rows = [("a", " 2 ", "x\n"), ("a", "10", None), ("a", "2b", "y"), ("a", "10", None), ("b", "1", "z")]
    expected = blob_by_hand([(i.strip(), (q or "").strip()) for s, i, q in rows if s == "a"])
    got = blob(spark, rows)
    assert got["a"] == (4, expected)
    digest = hashlib.sha256(b"agent:" + expected.encode() + b"\ncorpus:C\njudge:J").hexdigest()[:16]
    one = spark.createDataFrame([(expected,)], "blob string")
    assert one.select(L.run_fingerprint(F.col("blob"), F.lit("C"), F.lit("J")).alias("f")).first()["f"] == digest


@pytest.mark.parametrize("size", [3, 12_000])
def test_blobs_have_one_form_and_see_every_row(spark, size):
    """Order-free, sensitive to every row and to the number of copies, alike at every size."""
    rows = [("a", str(i % 400), "q") for i in range(size)] + [("a", "copy", "same")] * 5
    base = blob(spark, rows)["a"][1]
    assert base == blob_by_hand([r[1:] for r in rows]) == blob(spark, rows[::-1])["a"][1]
    changed = [rows[1:], rows[1:] + [("a", "zz", "q")], rows[:-1] + [rows[0]], rows + [rows[-1]]]
    assert len({base, *[blob(spark, c)["a"][1] for c in changed]}) == 5


def test_only_a_whole_json_array_is_a_list(spark):
    good = '{"factual_accuracy": 1, "completeness": 0, "no_hallucination": "1"}'
    texts = [f"[note] {good} [end]", f"[1] {good} [2]", f"[{good}]", good.replace(": 1,", ': "1.7",'), good.replace(": 1,", ': "true",'), good.replace(": 1,", ": true,")]
    rows = J.judge_verdicts(spark.createDataFrame(list(enumerate(texts)), "k int, raw string"), "raw").orderBy("k").collect()
    assert [r["error"] for r in rows] == [None, None, "no JSON object", "missing factual_accuracy", "missing factual_accuracy", None]
