"""Order-free comparison: do the rows of two results pair off within tolerance?

Exact columns split the rows into groups; inside a group every golden row needs
an agent row of its own whose numbers are all within tolerance. With one number
pairing in sorted order is the best there is. With several it is not, since noise
in one number reorders rows that another number tells apart, so rows are matched
as a graph:

1. Copies collapse to counts, and exactly equal rows pair off by count.
2. What remains lies in a grid whose cells are as wide as the tolerance, so that
   partners are in the same cell or in neighbouring ones. Occupied neighbours link
   up to clusters; rows of different clusters never match.
3. A cluster with unequal counts fails. One whose rows all match each other (its
   extremes do) is settled by the counts. Only the others are matched row by row.
4. A group that fails so is matched once more with its exactly equal rows back in
   the graph, since pairing these first can cost a pair elsewhere. That is final.
"""

from __future__ import annotations

from collections import deque
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.constants import ABS_TOLERANCE, REL_TOLERANCE
from evalspark.functions.compare import close
from evalspark.operators.diff import _contested, _mismatch_counts, both_sides, result_sizes, tally_rows
from evalspark.operators.linked import linked
from evalspark.operators.ordering import null_safe_join
from evalspark.session import durable

GRID = 3  # numbers that span the grid; further ones are compared in the clusters
MISSING, HIGH, LOW = -(1 << 62), (1 << 62), -(1 << 61)  # cells of their own, far from all others


def multiset_match(golden: DataFrame, agent: DataFrame, keys: list[str], exact: list[str], numbers: list[str]) -> DataFrame:
    """One row per ``keys``: counts of either side, the groups that do not pair off, and whether there are none.

    ``exact`` columns are equal in a pair (null equals null), ``numbers`` within
    tolerance; a missing number pairs with a missing one only, an infinity with
    itself. Rows may repeat any number of times.
    """
    rows = both_sides(golden.select(*keys, *exact, *numbers), agent.select(*keys, *exact, *numbers))
    group = [*keys, *exact]
    if not numbers:
        sizes = result_sizes(rows, group).withColumn("apart", F.col("n_golden") != F.col("n_agent"))
        return _per_key(sizes, keys)
    tally = tally_rows(rows, group, numbers)
    totals = tally.groupBy(*group).agg(
        F.sum("n_golden").alias("n_golden"), F.sum("n_agent").alias("n_agent"),
        F.bool_and(F.col("n_golden") == F.col("n_agent")).alias("even"))
    contested = _contested(totals).select(*group)
    if len(numbers) == 1:
        counts = _mismatch_counts(null_safe_join(tally, contested, group, "left_semi"), group, numbers)
        failed = counts.filter("_apart > 0").select(*group)
    else:
        failed = _unmatched(tally, contested, group, numbers)
    judged = null_safe_join(totals, failed.withColumn("failed", F.lit(True)), group, "left")
    return _per_key(judged.withColumn("apart", (F.col("n_golden") != F.col("n_agent")) | F.coalesce("failed", F.lit(False))), keys)


def _per_key(groups: DataFrame, keys: list[str]) -> DataFrame:
    return groups.groupBy(*keys).agg(
        F.sum("n_golden").alias("n_golden"), F.sum("n_agent").alias("n_agent"),
        F.count_if("apart").alias("differing_groups"), F.bool_and(~F.col("apart")).alias("matched"))


def _unmatched(tally: DataFrame, contested: DataFrame, group: list[str], numbers: list[str]) -> DataFrame:
    """The contested groups whose rows do not pair off."""
    plain = [f"x{k}" for k in range(len(numbers))]
    numbered = durable(contested.withColumn("gid", F.monotonically_increasing_id()))  # written once, so the numbers stay
    held = null_safe_join(tally, numbered, group, "inner").select(
        "gid", *[F.col(c).cast("double").alias(p) for c, p in zip(numbers, plain)], F.col("n_golden").alias("g"), F.col("n_agent").alias("a"))
    held = durable(held)
    over = F.col("g") - F.col("a")
    rest = held.filter("g <> a").withColumns({"g": F.greatest(over, F.lit(0)), "a": F.greatest(-over, F.lit(0))})
    failed = durable(_failed(rest, plain))
    if failed.isEmpty():
        return contested.limit(0)
    final = _failed(held.join(failed, "gid", "left_semi"), plain)
    return numbered.join(final, "gid", "left_semi").select(*group)


def _cell(x: Column) -> Column:
    """The grid cell of a number: two numbers within tolerance are at most one cell apart.

    The scale is logarithmic, and even below the size at which the absolute
    tolerance takes over.
    """
    z = F.abs(x) / (ABS_TOLERANCE / REL_TOLERANCE)
    size = F.when(z > 1e100, F.log(z) + float(np.log(2))).otherwise(F.log(z + F.sqrt(z * z + 1)))
    place = F.floor(F.signum(x) * size / (REL_TOLERANCE * 1.001))
    return (F.when(x.isNull(), MISSING).when(x == float("inf"), HIGH).when(x == -float("inf"), LOW).otherwise(place)).cast("bigint")


def _spans(plain: list[str]) -> list[Column]:
    """The counts of a cell, and per number the extremes of either side and whether some or all are missing."""
    out = [F.sum("g").alias("g"), F.sum("a").alias("a")]
    for x in plain:
        for side in "ga":
            here = F.when(F.col(side) > 0, F.col(x))
            out += [F.min(here).alias(f"{x}_{side}_low"), F.max(here).alias(f"{x}_{side}_high")]
        out += [F.bool_or(F.col(x).isNull()).alias(f"{x}_some"), F.bool_and(F.col(x).isNull()).alias(f"{x}_all")]
    return out


def _merged(plain: list[str]) -> list[Column]:
    out = [F.sum("g").alias("g"), F.sum("a").alias("a")]
    for x in plain:
        out += [f(f"{x}_{side}_{end}").alias(f"{x}_{side}_{end}") for side in "ga" for f, end in ((F.min, "low"), (F.max, "high"))]
        out += [F.bool_or(f"{x}_some").alias(f"{x}_some"), F.bool_and(f"{x}_all").alias(f"{x}_all")]
    return out


def _tight(plain: list[str]) -> Column:
    """Every golden row matches every agent row: the farthest pairs do, number by number."""
    def one(x: str) -> Column:
        ends = close(F.col(f"{x}_g_low"), F.col(f"{x}_a_high")) & close(F.col(f"{x}_g_high"), F.col(f"{x}_a_low"))
        return F.col(f"{x}_all") | (~F.col(f"{x}_some") & F.coalesce(ends, F.lit(False)))

    return reduce(lambda p, q: p & q, map(one, plain))


def _failed(rows: DataFrame, plain: list[str]) -> DataFrame:
    """``gid`` of the groups in ``rows`` (``gid``, numbers, counts ``g`` and ``a``) that do not pair off."""
    axes = [f"c{k}" for k in range(min(GRID, len(plain)))]
    placed = rows.withColumns({c: _cell(F.col(x)) for c, x in zip(axes, plain)})
    cells = placed.groupBy("gid", *axes).agg(*_spans(plain))
    # groups whose cells are all settled by themselves need no clusters
    open_ = cells.withColumn("_fine", (F.col("g") == F.col("a")) & _tight(plain)).groupBy("gid").agg(
        F.bool_and("_fine").alias("_fine")).filter("NOT _fine").select("gid")
    cells = durable(cells.join(open_, "gid", "left_semi").withColumn("cell", F.monotonically_increasing_id()))
    if cells.isEmpty():
        return cells.select("gid")
    ahead = [s for s in product((-1, 0, 1), repeat=len(axes)) if s > (0,) * len(axes)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"s{k}") for k, v in enumerate(s)]) for s in ahead])
    near = cells.select("gid", "cell", *axes, F.explode(steps).alias("s")).select(
        "gid", F.col("cell").alias("a"), *[(F.col(c) + F.col(f"s.s{k}")).alias(c) for k, c in enumerate(axes)])
    edges = near.join(cells.select("gid", F.col("cell").alias("b"), *axes), ["gid", *axes]).select("a", "b")
    roots = linked(edges)
    cells = cells.join(roots.withColumnRenamed("node", "cell"), "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    clusters = durable(cells.groupBy("gid", "root").agg(*_merged(plain)).select(
        "gid", "root", (F.col("g") == F.col("a")).alias("even"), _tight(plain).alias("tight")))
    uneven = clusters.filter("NOT even").select("gid").distinct()
    unclear = clusters.groupBy("gid").agg(F.bool_and("even").alias("even")).filter("even").join(
        clusters.filter("NOT tight"), "gid").select("gid", "root")
    members = cells.join(unclear, ["gid", "root"], "left_semi").select("gid", *axes, "root")
    single = placed.join(members, ["gid", *axes]).select("gid", "root", *plain, "g", "a")
    short = single.groupBy("gid", "root").applyInArrow(_pair_off, "gid bigint, ok boolean").filter("NOT ok")
    return uneven.union(short.select("gid")).distinct()


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of two equally long arrays are within tolerance in all numbers."""
    with np.errstate(invalid="ignore"):
        bound = np.maximum(np.maximum(np.abs(x), np.abs(y)) * REL_TOLERANCE, ABS_TOLERANCE)
        same = (x == y) | (np.isnan(x) & np.isnan(y))
        return (same | (np.isfinite(x) & np.isfinite(y) & (np.abs(x - y) <= bound))).all(axis=1)


def _pair_off(table: pa.Table) -> pa.Table:
    """Whether the golden rows of one cluster can all be given agent rows: a maximum flow with the counts as capacities."""
    names = [c for c in table.column_names if c.startswith("x")]
    values = np.column_stack([table.column(c).to_numpy().astype(float) for c in names])
    g, a = (table.column(c).to_numpy() for c in "ga")
    golden, agent = np.flatnonzero(g > 0), np.flatnonzero(a > 0)
    agent = agent[np.argsort(values[agent, 0], kind="stable")]
    first = values[agent, 0]
    x = values[golden, 0]
    with np.errstate(invalid="ignore"):
        reach = np.maximum(np.abs(x) * (2 * REL_TOLERANCE), 2 * ABS_TOLERANCE)
        low = np.where(np.isfinite(x), x - reach, x)
        high = np.where(np.isfinite(x), x + reach, x)
    begin, end = np.searchsorted(first, low, "left"), np.searchsorted(first, high, "right")
    partners: list[list[int]] = []
    for row, b, e in zip(golden, begin, end):
        some = np.arange(b, e)
        partners.append(some[_near(np.broadcast_to(values[row], (e - b, len(names))), values[agent[some]])].tolist())
    left, right = g[golden].tolist(), a[agent].tolist()
    given: list[dict[int, int]] = [{} for _ in agent]  # per agent row the golden rows it is given to

    def give(source: int) -> bool:
        """Find a way from a golden row with rows left to an agent row with room, over pairs made before, and use it."""
        came: dict[int, tuple[int, int]] = {}  # golden row: the agent row it gives up, and the golden row that takes that
        seen, queue = set(), deque([source])
        while queue:
            u = queue.popleft()
            for v in partners[u]:
                if v in seen:
                    continue
                seen.add(v)
                if right[v]:
                    steps, at = [], u
                    while at != source:
                        held, taker = came[at]
                        steps.append((held, at, taker))
                        at = taker
                    amount = min(left[source], right[v], *[given[held][loser] for held, loser, _ in steps])
                    left[source] -= amount
                    right[v] -= amount
                    given[v][u] = given[v].get(u, 0) + amount
                    for held, loser, taker in steps:
                        given[held][taker] = given[held].get(taker, 0) + amount
                        given[held][loser] -= amount
                        if not given[held][loser]:
                            del given[held][loser]
                    return True
                for w in given[v]:
                    if w != source and w not in came:
                        came[w] = (v, u)
                        queue.append(w)
        return False

    ok = all(_all_given(k, left, give) for k in range(len(golden)))
    return pa.table({"gid": table.column("gid").slice(0, 1), "ok": pa.array([ok])})


def _all_given(row: int, left: list[int], give) -> bool:
    while left[row]:
        if not give(row):
            return False
    return True
