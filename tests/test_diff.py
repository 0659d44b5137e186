"""Result comparison: the facts that are easy to get wrong, and brute force."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evalspark.functions.encode import encode_rows
from evalspark.operators import diff
from evalspark.operators.multiset import multiset_match
from evalspark.operators.ordering import align_sorted


def outcome(golden, agent):
    return diff.diff_frames(golden, agent).first().asDict()


def frames(spark, golden, agent, schema):
    return spark.createDataFrame(golden, schema), spark.createDataFrame(agent, schema)


# --- brute force in plain Python ------------------------------------------------

def missing(v):
    return v is None or (isinstance(v, float) and math.isnan(v))


def key(row):
    return tuple((missing(v), 0 if missing(v) else v) for v in row)


def cell_ok(a, b):
    if missing(a) or missing(b):
        return missing(a) and missing(b)
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-8)
    return a == b


def brute(golden, agent):
    """(matched, mismatched rows) by sorting and comparing position by position."""
    if len(golden) != len(agent):
        return False, None
    pairs = list(zip(sorted(golden, key=key), sorted(agent, key=key)))
    ok = all(cell_ok(a, b) for p in pairs for a, b in zip(*p))
    unequal = sum(any(missing(a) or missing(b) or a != b for a, b in zip(*p)) for p in pairs)
    return ok, unequal


def random_rows(rng, n):
    """Rows in which a third are copies of one row and numbers are close together."""
    rows = []
    for _ in range(n):
        if rng.random() < 0.33:
            rows.append(("x", 1.0, 5))
        else:
            rows.append((
                rng.choice(["x", "y", None]),
                rng.choice([1.0, 1.0 + 4e-6, 1.0 + 8e-6, 2.0, float("nan"), None, float("inf")]),
                rng.choice([5, 1_000_000, 1_000_005, None]),
            ))
    return rows


def nudge(rng, rows, change):
    out = []
    for s, x, n in rows:
        if x is not None and math.isfinite(x) and rng.random() < 0.5:
            x = x * (1 + rng.choice([0, 1e-7, change]))
        out.append((s, x, n))
    rng.shuffle(out)
    return out


SCHEMA = "s string, x double, n bigint"


@pytest.mark.parametrize("seed,change", [(1, 0.0), (2, 3e-6), (3, 0.5), (4, 1e-7), (5, 4e-6)])
def test_pair_mode_equals_brute_force(spark, seed, change):
    rng = random.Random(seed)
    golden = random_rows(rng, 400)
    agent = nudge(rng, golden, change)
    got = outcome(*frames(spark, golden, agent, SCHEMA))
    matched, unequal = brute(golden, agent)
    assert (got["matched"], got["mismatched_rows"]) == (matched, unequal)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_spans_cut_at_blocks_cover_every_position_once(spark, block):
    rng = random.Random(block)
    golden, agent = random_rows(rng, 150), random_rows(rng, 150)
    values = ["s", "x", "n"]
    tally = diff.tally_rows(diff.both_sides(*frames(spark, golden, agent, SCHEMA)), [], values)
    judged = diff.judged_rows(align_sorted(tally, values, block=block), values)
    rows = judged.orderBy("start").collect()
    assert [r["start"] for r in rows] == [sum(r["length"] for r in rows[:i]) for i in range(len(rows))]
    assert sum(r["length"] for r in rows) == 150
    assert sum(r["length"] for r in rows if not r["same"]) == brute(golden, agent)[1]


def test_batch_mode_equals_brute_force(spark):
    """One result holds a third of all rows."""
    rng = random.Random(11)
    golden, agent, expected = [], [], {}
    for case in range(12):
        rows = random_rows(rng, 150 if case == 0 else rng.randint(1, 30))
        other = nudge(rng, rows, rng.choice([0.0, 1e-7, 0.3]))
        if case % 5 == 4:
            other = other[1:]
        golden += [(case, *r) for r in rows]
        agent += [(case, *r) for r in other]
        expected[case] = brute(rows, other)
    schema = "case_id int, " + SCHEMA
    rows = diff.both_sides(*frames(spark, golden, agent, schema))
    for table, values in ((rows, ["s", "x", "n"]), (encode_rows(rows, ["case_id", "side"]), ["cells"])):
        result = diff.diff_batch(table, ["case_id"], values).collect()
        got = {r["case_id"]: (r["matched"], r["mismatched_rows"] if r["row_delta"] == 0 else None) for r in result}
        assert got == expected


def test_results_of_any_size(spark):
    """Results above 10,000 rows with nulls, NaN, repeats and ties in the first column are compared to the last row."""
    rng = random.Random(12)
    big = [(rng.choice(["t", None]), rng.choice([1.0, float("nan"), None, rng.random()]), rng.choice([0, i])) for i in range(12_000)]
    apart = [(s, x, n + 1 if i % 3000 == 7 else n) for i, (s, x, n) in enumerate(big)]
    cases = {1: (big, big), 2: (big, apart), 3: (big, big[:-20]), 4: (big[:3], big[:3] + big), 5: (big[:2], []), 6: ([], big[:2])}
    golden, agent = ([(k, *r) for k, both in cases.items() for r in both[side]] for side in (0, 1))
    rows = diff.both_sides(*frames(spark, golden, agent, "case_id int, " + SCHEMA))
    values = ["s", "x", "n"]
    got = {r["case_id"]: r for r in diff.diff_batch(rows, ["case_id"], values).collect()}
    for k, both in cases.items():
        want = brute(*both)
        assert (got[k]["matched"], got[k]["n_golden"], got[k]["n_agent"]) == (want[0], len(both[0]), len(both[1]))
        if len(both[0]) == len(both[1]):
            assert got[k]["mismatched_rows"] == want[1]
    aligned = diff.aligned_rows(rows, ["case_id"], values)
    count = {r["case_id"]: r for r in aligned.groupBy("case_id").agg(
        F.count("g").alias("g"), F.count("a").alias("a"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n")).collect()}
    for k, (g, a) in cases.items():
        size = max(len(g), len(a))
        assert tuple(count[k])[1:] == (len(g), len(a), 1, size, size)
    sample = diff.diff_sample(rows, ["case_id"], values).collect()
    assert {r["case_id"] for r in sample} == {2} and 1 <= len({r["pos"] for r in sample}) <= 5


# --- facts ------------------------------------------------------------------------

def test_integers_are_tolerant_too(spark):
    assert outcome(*frames(spark, [(1_000_000,)], [(1_000_005,)], "n bigint"))["matched"]
    assert not outcome(*frames(spark, [(1_000_000,)], [(1_000_050,)], "n bigint"))["matched"]


def test_tolerance_boundary(spark):
    assert not outcome(*frames(spark, [(1.0,)], [(1 + 1.0005e-5,)], "x double"))["matched"]
    assert outcome(*frames(spark, [(1.0,)], [(1 + 0.999e-5,)], "x double"))["matched"]
    assert outcome(*frames(spark, [(0.0,)], [(1e-9,)], "x double"))["matched"]


def test_infinity_only_equals_itself(spark):
    inf = float("inf")
    assert outcome(*frames(spark, [(inf,)], [(inf,)], "x double"))["matched"]
    assert not outcome(*frames(spark, [(inf,)], [(1e300,)], "x double"))["matched"]


def test_noise_in_a_leading_column_swaps_rows(spark):
    """Positional comparison fails on a tolerant multiset match; the multiset form does not."""
    golden, agent = frames(spark, [(1.0, "a"), (1 + 1e-12, "b")], [(1 + 1e-12, "a"), (1.0, "b")], "x double, s string")
    assert not outcome(golden, agent)["matched"]
    tagged = [f.withColumn("k", F.lit(1)) for f in (golden, agent)]
    assert multiset_match(*tagged, ["k"], ["s"], ["x"]).first()["matched"]


def test_reordered_columns_mismatch_without_detail(spark):
    golden = spark.createDataFrame([(1, 2)], "a int, b int")
    got = outcome(golden, golden.select("b", "a"))
    assert got["outcome"] == "columns" and got["detail"] == ""
    assert got["summary"] == "column mismatch (peak: ['a', 'b'], agent: ['b', 'a'])"


def test_missing_and_extra_columns(spark):
    golden = spark.createDataFrame([(1, 2)], "a int, b int")
    got = outcome(golden, golden.select("a", F.col("b").alias("c")))
    assert got["detail"] == "missing in agent: ['b']\nextra in agent: ['c']"


def test_row_count_text(spark):
    got = outcome(*frames(spark, [(1,), (2,)], [(1,), (2,), (3,)], "a int"))
    assert got["summary"] == "row count differs: peak=2, agent=3 (+1)"
    assert got["detail"] == "agent returned 1 extra rows"
    got = outcome(*frames(spark, [(1,), (2,)], [(1,)], "a int"))
    assert got["summary"] == "row count differs: peak=2, agent=1 (-1)"
    assert got["detail"] == "agent returned 1 fewer rows"


def test_missing_cells_match_but_count_as_unequal(spark):
    nan = float("nan")
    golden, agent = frames(spark, [(nan, 1), (1.0, 2)], [(None, 1), (1.5, 2)], "x double, n int")
    got = outcome(golden, agent)
    assert got["summary"] == "values differ in 2 rows (2 mismatched)"
    assert outcome(*frames(spark, [(nan, 1)], [(None, 1)], "x double, n int"))["matched"]


def test_decimals_text_and_dates_are_exact(spark):
    assert not outcome(*frames(spark, [(Decimal("100000.00"),)], [(Decimal("100000.01"),)], "d decimal(12,2)"))["matched"]
    golden = spark.createDataFrame([(1,)], "a int")
    assert outcome(golden, golden.withColumn("a", F.col("a").cast("double")))["matched"]
    assert outcome(golden, golden.withColumn("a", F.lit(True)))["matched"]
    assert not outcome(golden, golden.withColumn("a", F.lit("1")))["matched"]
    assert outcome(
        spark.createDataFrame([(Decimal("1.10"),)], "d decimal(12,2)"),
        spark.createDataFrame([(Decimal("1.1"),)], "d decimal(12,1)"),
    )["matched"]
    day = spark.sql("SELECT DATE '2020-01-01' AS d")
    assert not outcome(day, day.withColumn("d", F.col("d").cast("string")))["matched"]


def test_empty_results_match(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert outcome(empty, empty)["matched"]
    layouts = spark.createDataFrame([(1, "golden", ["a"]), (1, "agent", ["a"])], "case_id int, side string, cols array<string>")
    rows = spark.createDataFrame([], "case_id int, side string, a int")
    assert diff.diff_batch(rows, ["case_id"], ["a"], layouts).first()["matched"]


def test_duplicate_column_names_are_an_error(spark):
    golden = spark.createDataFrame([(1, 2)], "a int, b int").select("a", F.col("b").alias("a"))
    with pytest.raises(ValueError, match="duplicate column"):
        diff.diff_frames(golden, golden)


def test_null_keys_are_results_of_their_own(spark):
    rows = [(None, 1.0), (None, 2.0), (1, 1.0)]
    golden, agent = frames(spark, rows, [(None, 1.0), (None, 2.5), (1, 1.0)], "case_id int, x double")
    got = {r["case_id"]: r["matched"] for r in diff.diff_batch(diff.both_sides(golden, agent), ["case_id"]).collect()}
    assert got == {None: False, 1: True}


def test_sample_shows_only_differing_cells(spark):
    golden = [(1, i, float(i), None) for i in range(9)]
    agent = [(1, i, float(i) + (0.5 if i % 2 else 0), None) for i in range(9)]
    table = diff.both_sides(*frames(spark, golden, agent, "case_id int, i int, x double, empty string"))
    rows = diff.diff_sample(table, ["case_id"], ["i", "x", "empty"], size=3).orderBy("pos").collect()
    assert [(r["pos"], r["column"], r["golden_value"], r["agent_value"]) for r in rows] == [
        (2, "x", "1.0", "1.5"), (4, "x", "3.0", "3.5"), (6, "x", "5.0", "5.5"),
    ]


def test_multiset_match_with_hot_group(spark):
    rows = [("k", "hot", 1.0 + i * 1e-3) for i in range(60)] + [("k", "cold", 3.0)]
    near = [(k, e, x * (1 + 1e-8)) for k, e, x in rows]
    golden, agent = frames(spark, rows, near, "k string, e string, x double")
    got = multiset_match(golden, agent, ["k"], ["e"], ["x"]).first()
    assert got["matched"] and got["n_golden"] == 61
    far = agent.withColumn("x", F.when(F.col("x") > 1.05, F.col("x") * 2).otherwise(F.col("x")))
    got = multiset_match(golden, far, ["k"], ["e"], ["x"]).first()
    assert not got["matched"] and got["differing_groups"] == 2
    counted = multiset_match(golden, golden.limit(60), ["k"], ["e"], []).first()
    assert not counted["matched"]


def test_shuffled_copy_matches_and_dropped_row_does_not(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 120)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    assert outcome(*frames(spark, rows, shuffled, SCHEMA))["matched"]
    assert not outcome(*frames(spark, rows, shuffled[1:], SCHEMA))["matched"]
    assert not outcome(*frames(spark, shuffled[1:], rows, SCHEMA))["matched"]


def test_column_names_may_be_anything(spark):
    golden = spark.createDataFrame([(1, 2.0), (2, 3.0)], "`avg(a.b)` int, `x y` double")
    assert outcome(golden, golden)["matched"]
    assert not outcome(golden, golden.withColumn("x y", F.lit(7.0)))["matched"]


def test_detail_shows_the_first_differing_rows(spark):
    golden = [(i, float(i), None) for i in range(9)]
    agent = [(i, float(i) + (0.5 if i % 2 else 0), None if i < 5 else "new") for i in range(9)]
    got = outcome(*frames(spark, golden, agent, "i int, x double, `odd name` string"))
    assert got["detail"].split("\n") == [
        "first mismatching rows:", "row 2: x peak=1.0 agent=1.5", "row 4: x peak=3.0 agent=3.5",
        "row 6: x peak=5.0 agent=5.5; odd name peak=null agent=new", "row 7: odd name peak=null agent=new",
        "row 8: x peak=7.0 agent=7.5; odd name peak=null agent=new"]
    # copies are rows of their own
    got = outcome(*frames(spark, [("a", 1)] * 8, [("a", 2)] * 8, "s string, n int"))
    assert got["detail"].split("\n")[1:] == [f"row {k}: n peak=1 agent=2" for k in range(1, 6)]
    # two missing cells are counted, but there is nothing to show
    assert outcome(*frames(spark, [(None, 1.0), ("a", 1.0)], [(None, 1.0), ("a", 2.0)], "s string, x double"))["detail"].endswith(
        "row 1: x peak=1.0 agent=2.0")


def test_detail_of_many_results_names_encoded_cells(spark):
    golden = [(k, j, float(j)) for k in range(4) for j in range(300)]
    agent = [(k, j, float(j) + (j % 3 == 2) * k) for k in range(4) for j in range(300)]
    table = diff.both_sides(*frames(spark, golden, agent, "case_id int, j int, x double"))
    cols = spark.createDataFrame([(k, s, ["j", "total"]) for k in range(4) for s in ("golden", "agent")], "case_id int, side string, cols array<string>")
    encoded = encode_rows(table, ["case_id", "side"])
    for rows, values, name in ((table, ["j", "x"], "x"), (encoded, [diff.CELLS], "total")):
        got = {r["case_id"]: r["detail"] for r in diff.diff_batch(rows, ["case_id"], values, cols).collect()}
        assert got[0] == ""
        for k in (1, 2, 3):
            shown = [f"row {j + 1}: {name} peak={float(j)} agent={float(j + k)}" for j in (2, 5, 8, 11, 14)]
            assert got[k].split("\n") == ["first mismatching rows:", *shown]
