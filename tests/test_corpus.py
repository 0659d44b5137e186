from __future__ import annotations

import csv

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark.constants import GOLDEN_OPTIONAL, GOLDEN_REQUIRED
from evalspark.functions.text import (
    fixed, parse_flag, parse_list, percent, read_only_reason, signed_percent, strip,
)
from evalspark.operators import corpus as C
from evalspark.sources import files

COLUMNS = [*GOLDEN_REQUIRED, *GOLDEN_OPTIONAL]


def golden(**over):
    base = {
        "id": "c1", "tier": "T1", "category": "business_logic", "domain": "sales", "prompt": "How many?",
        "peak_sql": "SELECT 1", "golden_reasoning": "because", "ambiguity_flag": "N", "status": "approved",
        "tables": "a, b", "sql_features": "", "evidence_required": "",
    }
    return {**base, **over}


def write(path, rows, columns):
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, fieldnames=columns, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def test_csv_round_trip_with_line_breaks_and_quotes(spark, tmp_path):
    sql = 'SELECT "a",\n  \'x;y\' -- note\nFROM t;'
    rows = [golden(peak_sql=sql, prompt='  Say "hi",\r\nplease  '), golden(id="c2", peak_sql="-- nothing to select")]
    path = write(tmp_path / "golden.csv", rows, ["note", *reversed(COLUMNS)])
    got = {r["id"]: r for r in C.golden_cases(files.read_golden(spark, path), strict=True).collect()}
    assert got["c1"]["golden_sql"] == sql
    assert got["c1"]["prompt"] == 'Say "hi",\nplease'  # line breaks are read as \n
    assert got["c1"]["tables"] == ["a", "b"] and got["c1"]["sql_features"] == []
    assert got["c2"]["golden_sql"] == "-- nothing to select"


def test_optional_columns_may_be_missing_and_required_may_not(spark, tmp_path):
    path = write(tmp_path / "g.csv", [golden()], GOLDEN_REQUIRED)
    row = C.golden_cases(files.read_golden(spark, path)).first()
    assert row["tables"] == [] and row["evidence_required"] is False
    bad = write(tmp_path / "bad.csv", [golden()], [c for c in COLUMNS if c != "tier"])
    with pytest.raises(PySparkException, match="missing required columns"):
        files.read_golden(spark, bad).collect()


def test_submissions_of_a_folder_with_different_headers(spark, tmp_path):
    write(tmp_path / "example_alpha_input.csv", [{"id": "1", "agent_sql": "SELECT 1", "agent_explanation": "x", "prompt": "p"}],
          ["id", "prompt", "agent_sql", "agent_explanation"])
    write(tmp_path / "beta.csv", [{"id": "2", "agent_sql": "SELECT\n2", "agent_explanation": "y"}],
          ["agent_explanation", "id", "agent_sql"])
    got = {r["agent_name"]: (r["id"], r["agent_sql"]) for r in files.read_submissions(spark, str(tmp_path)).collect()}
    assert got == {"alpha": ("1", "SELECT 1"), "beta": ("2", "SELECT\n2")}
    (tmp_path / "empty.csv").write_text("")
    assert files.empty_files(spark, str(tmp_path)).count() == 1


def test_the_first_record_is_the_header(spark, tmp_path):
    """Repeated header lines are rows, order is kept, of equal names the last counts, and any width will do."""
    plain = [golden(id=f"c{k}") for k in (3, 1, 2)]
    path = tmp_path / "a.csv"
    write(path, [plain[0], {c: c for c in COLUMNS}, *plain[1:]], COLUMNS)
    got = files.read_golden(spark, str(path)).orderBy("case_pos").collect()
    assert [r["id"] for r in got] == ["c3", "id", "c1", "c2"]

    wide = tmp_path / "wide.csv"
    write(wide, plain, [*[f"x{k}" for k in range(100)], *COLUMNS])
    assert [r["id"] for r in files.read_golden(spark, str(wide)).orderBy("case_pos").collect()] == ["c3", "c1", "c2"]

    twice = tmp_path / "twice.csv"
    twice.write_text("id,agent_sql,agent_explanation,id\nold,SELECT 1,x,new\n")
    assert [r["id"] for r in files.read_submissions(spark, str(twice)).collect()] == ["new"]

    bad = tmp_path / "bad.csv"
    write(bad, [{c: c for c in COLUMNS}, golden()], COLUMNS)
    bad.write_text("title\n" + bad.read_text())
    with pytest.raises(PySparkException, match="missing required columns"):
        files.read_golden(spark, str(bad)).collect()

    folder = tmp_path / "many"
    folder.mkdir()
    for name, k in (("b.csv", 1), ("a.csv", 2), ("c.csv", 3)):
        write(folder / name, [golden(id=f"{k}-{i}") for i in range(3)], COLUMNS)
    got = files.read_golden(spark, str(folder)).orderBy("case_pos").collect()
    assert [r["id"] for r in got] == [f"{k}-{i}" for k in (2, 1, 3) for i in range(3)]


def test_violations(spark):
    rows = [
        golden(), golden(), golden(id="  "), golden(id="t", tier=" t2 "), golden(id="bad_tier", tier="T7", status="draft"),
        golden(id="bad_cat", category="nope", status="draft"), golden(id="flag", ambiguity_flag="maybe"),
        golden(id="draft_flag", ambiguity_flag="maybe", status="draft"),
    ]
    raw = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], ", ".join(f"{c} string" for c in COLUMNS))
    found = {(r["id"], r["rule"]) for r in C.golden_violations(raw).collect()}
    assert found == {("c1", "duplicate_id"), ("bad_tier", "tier"), ("bad_cat", "category"), ("flag", "ambiguity_flag")}
    with pytest.raises(ValueError, match="duplicate_id|tier|category|flag"):
        C.golden_cases(raw, strict=True)
    assert ("draft_flag", "ambiguity_flag") in {(r["id"], r["rule"]) for r in C.golden_violations(raw, True).collect()}


def test_status_is_folded_in_the_loader_but_exact_in_the_template(spark):
    rows = [golden(id="a", status=" Approved "), golden(id="b", status="approved "), golden(id="c", status="draft")]
    raw = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], ", ".join(f"{c} string" for c in COLUMNS))
    assert {r["id"] for r in C.golden_cases(raw).collect()} == {"a", "b"}
    assert {r["id"] for r in C.golden_cases(raw, include_drafts=True).collect()} == {"a", "b", "c"}
    assert [r["id"] for r in C.submission_template(raw).collect()] == ["b"]


def test_pairing(spark):
    goldens = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, case_pos int")
    inputs = spark.createDataFrame([("a", "s"), ("x", "s")], "id string, agent_sql string")
    assert [r["id"] for r in C.pair_cases(goldens, inputs).collect()] == ["a"]
    assert {r["id"] for r in C.unanswered(goldens, inputs).collect()} == {"b", "c"}
    assert [r["id"] for r in C.extra_inputs(goldens, inputs).collect()] == ["x"]
    many = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "q")], "id string, agent_name string")
    got = {(r["agent_name"], r["id"]) for r in C.unanswered_by_agent(goldens, many).collect()}
    assert got == {("p", "c"), ("q", "b"), ("q", "c")}


def test_unanswered_over_many_agents_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "AGENT_BUCKET", 4)
    agents, cases = [f"a{k}" for k in range(30)], [f"c{k}" for k in range(12)]
    answers = [(c, a) for i, c in enumerate(cases) for j, a in enumerate(agents) if (i * j) % 5 == 1 or j == 3]
    goldens = spark.createDataFrame([(c, i * 700) for i, c in enumerate(cases)], "id string, case_pos int")
    inputs = spark.createDataFrame([(c, a, 9) for c, a in answers * 2] + [("stray", "a3", 5), ("c0", None, 1)], "id string, agent_name string, case_pos int")
    known = spark.createDataFrame([(a,) for a in [*agents, "silent"]], "agent_name string")
    got = {(r["id"], r["agent_name"]) for r in C.unanswered_by_agent(goldens, inputs, known).collect()}
    assert got == {(c, a) for c in cases for a in [*agents, "silent"]} - set(answers)
    lists = {(r["agent_name"], r["kind"]): (r["n"], r["ids"]) for r in C.unmatched_lists(goldens, inputs, known).collect()}
    assert lists[("silent", "unanswered")] == (12, ", ".join(cases)) and lists[("a3", "extra")] == (1, "stray")
    assert ("a3", "unanswered") not in lists and len(lists) == len({a for _, a in got}) + 1


def test_inline_result_csv(spark):
    texts = spark.createDataFrame([("v1", "month,n\n2026-04,8421\n"), ("v2", 'month,n\n"a,b",1\nx,2\n')], "case_id string, text string")
    got = files.parse_result_csv(texts, "text", "month string, n bigint", ["case_id"]).collect()
    assert sorted(map(tuple, got)) == [("v1", 0, "2026-04", 8421), ("v2", 0, "a,b", 1), ("v2", 1, "x", 2)]


def test_inline_result_csv_with_quoted_breaks(spark):
    texts = spark.createDataFrame([
        ("breaks", 's,n\n"one\ntwo",1\n"three\r\nfour, ""five""\n",2\nplain,3\n'),
        ("crlf", 's,n\r\na,1\r\n"b\r\nc",2\r\n'), ("quoted header", '"s\nx",n\na,1'), ("empty lines", "s,n\n\na,1\n\n\nb,2"),
        ("quotes", 's,n\n"""",1\n"",2\n"x""",3'), ("header", "s,n\n"), ("nothing", ""), ("null", None),
    ], "case_id string, text string")
    got: dict = {}
    for r in files.parse_result_csv(texts, "text", "s string, n bigint", ["case_id"]).orderBy("case_id", "pos").collect():
        got.setdefault(r["case_id"], []).append((r["pos"], r["s"], r["n"]))
    assert got == {
        "breaks": [(0, "one\ntwo", 1), (1, 'three\r\nfour, "five"\n', 2), (2, "plain", 3)],
        "crlf": [(0, "a", 1), (1, "b\r\nc", 2)], "quoted header": [(0, "a", 1)], "empty lines": [(0, "a", 1), (1, "b", 2)],
        "quotes": [(0, '"', 1), (1, None, 2), (2, 'x"', 3)],
    }


def test_duplicates_of_long_keys_and_nulls(spark):
    long = "x" * 100_000
    rows = [(long, 1), (long, 1), (long, 2), ("a", None), ("a", None), (None, None), (None, None), ("null", 3), (None, 3)]
    got = {(r["s"], r["n"]): r["copies"] for r in C.duplicate_ids(spark.createDataFrame(rows, "s string, n int"), ["s", "n"]).collect()}
    assert got == {(long, 1): 2, ("a", None): 2, (None, None): 2}


LINTS = [
    ("SELECT 1", None), ("  with t as (select 1) select * from t ; ", None), ("select 1;;", None),
    ("", "empty SQL"), ("-- only a comment", "empty SQL"), ("/* a */ ; ", "empty SQL"),
    ("SELECT 1; DROP TABLE t", "multi-statement queries not allowed"),
    ("SELECT ';' AS c FROM t", "multi-statement queries not allowed"),  # literals are not understood
    ("SELECT '--' AS c", None),
    ("drop table t", "only SELECT/WITH queries are allowed; got 'DROP'"),
    ("/* SELECT */ insert into t values (1)", "only SELECT/WITH queries are allowed; got 'INSERT'"),
    ("WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t", "WITH must not lead into a write"),
]


def test_read_only_lint(spark):
    table = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(LINTS)], "i int, sql string")
    got = {r["i"]: r["reason"] for r in table.select("i", read_only_reason(F.col("sql")).alias("reason")).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(LINTS)}


def test_text_functions(spark):
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("v")).first()["v"]

    everything = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert value(strip(F.lit(everything + "a b" + everything))) == "a b"
    assert value(parse_flag(F.lit(" YES "))) is True and value(parse_flag(F.lit("0"))) is False
    assert value(parse_flag(F.lit("maybe"))) is None and value(parse_flag(F.lit(None).cast("string"), True)) is True
    assert value(parse_list(F.lit(" a ,, b,"))) == ["a", "b"]
    assert value(percent(F.lit(0.125))) == f"{0.125:.0%}" == "12%"
    for number in (1.275, 0.39645, 2.675, 0.125, 0.375, 1.005, 12.5, 0.0, 99.995, 1e9 + 0.045, -2.5, -0.004):
        for digits in (0, 1, 2, 4):
            assert value(fixed(F.lit(number), digits)) == f"{number:.{digits}f}"
    assert value(signed_percent(F.lit(-0.376))) == f"{-0.376:+.0%}"


def test_lint_and_coverage(spark):
    cases = spark.createDataFrame(
        [("a", "Who  pays?", "r", "T1", "x", "d"), ("b", " who pays? ", "r", "T1", "y", "d"), ("c", "Other", "", "T2", "x", "d")],
        "id string, prompt string, golden_reasoning string, tier string, category string, domain string",
    )
    found = {(r["id"], r["rule"], r["value"]) for r in C.corpus_lint(cases).collect()}
    assert found == {("a", "duplicate_prompt", "2"), ("b", "duplicate_prompt", "2"), ("c", "missing_reasoning", "")}
    totals = {(r["tier"], r["category"], r["domain"]): r["cases"] for r in C.coverage(cases).collect()}
    assert totals[(None, None, None)] == 3 and totals[("T1", None, None)] == 2
