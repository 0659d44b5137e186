from __future__ import annotations

import random
from statistics import median

import pytest

from evalspark.functions.quantile import unit_median
from evalspark.operators.ordering import previous_row


def test_previous_row_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 50), i, f"v{i % 5}") for i in range(600)]
    rng.shuffle(rows)
    expected, last = {}, {}
    for k, t, i, v in sorted(rows):
        expected[i] = last.get(k)
        last[k] = v
    table = spark.createDataFrame(rows, "k string, t int, i int, v string").repartition(8)
    got = previous_row(table, ["k"], ["t", "i"], ["v"]).collect()
    assert {r["i"]: r["prev_v"] for r in got} == expected
    assert len(got) == len(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_median_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for group in range(6):
        for _ in range(rng.randint(1, 200)):
            rows.append((group, rng.choice([1.0, 1.0, 0.5, rng.random(), 0.25 + rng.random() * 1e-9, None])))
    table = spark.createDataFrame(rows, "g int, x double")
    expected = {}
    for group in range(6):
        values = [x for g, x in rows if g == group and x is not None]
        if values:
            expected[group] = median(values)
    got = {r["g"]: r["median"] for r in unit_median(table, ["g"], "x").collect()}
    assert got == pytest.approx(expected, rel=1e-15)
