"""Order-free matching with several numbers against brute force."""

from __future__ import annotations

import itertools
import math
import random

import pytest

from evalspark.operators.linked import linked
from evalspark.operators.multiset import multiset_match

SCHEMA = "k int, e string, x double, y double"


def near(a, b):
    if a is None or b is None or math.isnan(a) or math.isnan(b):
        return (a is None or math.isnan(a)) and (b is None or math.isnan(b))
    return a == b or (math.isfinite(a) and math.isfinite(b) and abs(a - b) <= max(1e-5 * max(abs(a), abs(b)), 1e-8))


def pairs_off(golden, agent):
    """Augmenting paths over single rows."""
    if len(golden) != len(agent):
        return False
    taken: dict[int, int] = {}

    def place(g, seen):
        for a, row in enumerate(agent):
            if a not in seen and golden[g][:1] == row[:1] and all(map(near, golden[g][1:], row[1:])):
                seen.add(a)
                if a not in taken or place(taken[a], seen):
                    taken[a] = g
                    return True
        return False

    return all(place(g, set()) for g in range(len(golden)))


def check(spark, cases, numbers=("x", "y"), schema=SCHEMA):
    """``cases``: golden and agent rows (e, numbers...) by key."""
    sides = [spark.createDataFrame([(k, *r) for k, both in cases.items() for r in both[s]], schema).repartition(3) for s in (0, 1)]
    got = {r["k"]: r for r in multiset_match(*sides, ["k"], ["e"], list(numbers)).collect()}
    for k, (golden, agent) in cases.items():
        exact = {r[0] for r in golden + agent}
        apart = sum(not pairs_off([r for r in golden if r[0] == e], [r for r in agent if r[0] == e]) for e in exact)
        assert (got[k]["n_golden"], got[k]["n_agent"], got[k]["differing_groups"], got[k]["matched"]) == (
            len(golden), len(agent), apart, apart == 0), k
    return got


def test_two_numbers_told_apart_by_the_second(spark):
    golden, agent = [("a", 1.0, 10.0), ("a", 1.0000001, 20.0)], [("a", 1.0000001, 10.0), ("a", 1.0, 20.0)]
    assert check(spark, {1: (golden, agent)})[1]["matched"]


def test_equal_rows_may_have_to_part(spark):
    """The one pairing gives each of the equal rows another partner."""
    step = 0.9e-5
    golden = [("a", 1.0, 5.0), ("a", 1 + step, 5.0)]
    agent = [("a", 1.0, 5.0), ("a", 1 - step, 5.0)]
    assert check(spark, {1: (golden, agent), 2: (golden, agent[:1] * 2), 3: (golden, agent[1:] * 2)})[1]["matched"]


def test_missing_and_infinite_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", None, 1.0), ("a", nan, 1.000001), ("a", 1.0, None), ("a", inf, 2.0), ("a", -inf, 2.0), ("a", 0.0, 0.0), (None, 3.0, None)]
    moved = [("a", nan, 1.0), ("a", None, 1.000001), ("a", 1.000001, nan), ("a", inf, 2.00001), ("a", -inf, 2.0), ("a", -1e-9, 1e-9), (None, 3.0, nan)]
    wrong = [*moved[:3], ("a", -inf, 2.0), *moved[4:]]
    assert check(spark, {1: (rows, moved), 2: (rows, wrong), 3: (rows, rows)})[1]["matched"]


def chain(pick, n, spread):
    """Numbers close enough that neighbours match and others do not, on both signs and below the absolute tolerance."""
    base = pick.choice([1.0, -250.0, 1e-7, 3e12])
    unit = max(abs(base) * 1e-5, 1e-8)
    return [("a", base + unit * pick.randint(0, spread) * 0.45, 7.0 + 7e-5 * 0.45 * pick.randint(0, 2)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_rows(spark, seed):
    pick = random.Random(seed)
    cases = {}
    for k in range(60):
        golden = chain(pick, pick.randint(1, 9), pick.choice([2, 5, 12]))
        unit = max(abs(golden[0][1]) * 1e-5, 1e-8)
        agent = [(e, x + unit * pick.choice([-0.9, -0.5, 0, 0, 0.5, 0.9]), y + 7e-5 * pick.choice([-0.9, 0, 0.9])) for e, x, y in golden]
        pick.shuffle(agent)
        if k % 10 == 9:
            agent = agent[1:] + [agent[-1]]
        cases[k] = (golden, agent)
    got = check(spark, cases)
    assert len({r["matched"] for r in got.values()}) == 2


def test_three_and_four_numbers(spark):
    pick = random.Random(3)
    cases = {}
    for k in range(30):
        golden = [("a", *[pick.choice([0.0, 1.0, -1.0, None]) for _ in range(4)]) for _ in range(12)]
        noise = lambda v: None if v is None else v * (1 + pick.choice([-1, 0, 1]) * 4e-6)
        agent = [(e, *map(noise, v)) for e, *v in golden]
        pick.shuffle(agent)
        if k % 3 == 0:
            agent[0] = (*agent[0][:4], 9.0)
        cases[k] = (golden, agent)
    check(spark, cases, "xyzw", "k int, e string, x double, y double, z double, w double")


def test_large_group_with_ties_and_copies(spark):
    """Thousands of rows in one group: by column sums it differs, by rounding it does not."""
    pick = random.Random(4)
    grid = list(itertools.product(range(1, 40), range(1, 40)))
    noisy = lambda v: v * (1 + 1e-6 * pick.randint(-3, 3))
    chosen = [pick.choice(grid) for _ in range(6000)] + [(1, 1)] * 2000
    golden = [("hot", noisy(x), noisy(y)) for x, y in chosen]
    agent = [("hot", noisy(x), noisy(y)) for x, y in chosen]
    swapped = [*agent[:-1], ("hot", 1.0, 2.0)]
    sides = lambda g, a: [spark.createDataFrame([(1, *r) for r in s], SCHEMA) for s in (g, a)]
    assert multiset_match(*sides(golden, agent), ["k"], ["e"], ["x", "y"]).first()["matched"]
    got = multiset_match(*sides(golden, swapped), ["k"], ["e"], ["x", "y"]).first()
    assert not got["matched"] and got["differing_groups"] == 1 and got["n_golden"] == got["n_agent"] == 8000


def test_linked(spark):
    pick = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(pick.randint(200, 260), pick.randint(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in linked(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in root.items() if k not in lone}
    assert linked(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
