"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks of about equal text. With the exact target
weight w of a source, a fraction, its block ``j`` is released at slot floor(j/w)
and due by slot ceil((j+1)/w). Earliest deadline first among the released
blocks, one per slot, meets every deadline, so no source is ever a whole block
away from its target. Weights that add up to a small whole number of slots give
an order that repeats; it is scheduled once and every block's slot follows by
arithmetic. All others are scheduled block by block.

When a source runs out, the remaining ones go on with their weights scaled up:
the next phase. There are at most as many phases as sources.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evalspark.llm.tables import cut

BROADCAST_ROWS = 500_000
NEVER = 1 << 62  # deadlines of next to no weight


def shares(weights: dict, frame: int | None = None) -> dict:
    """Whole numbers in exactly the proportion of the weights, as small as they can be; no ``frame`` rounds them."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def frame_order(share: dict, left: dict | None = None) -> list:
    """The source of every slot: earliest deadline first among released blocks.

    The slots are those of one frame, or with ``left`` those up to the last block of the source that runs out first.
    """
    frame = sum(share.values())
    names = sorted(share, key=str)
    coming = [(0, k, 0) for k in range(len(names))]  # release, source, block
    due: list[tuple[int, int, int]] = []  # deadline, source, block
    order = []
    while left is not None or len(order) < frame:
        while coming and coming[0][0] <= len(order):
            _, k, j = heapq.heappop(coming)
            heapq.heappush(due, (-(-(j + 1) * frame // share[names[k]]), k, j))
        _, k, j = heapq.heappop(due)
        order.append(names[k])
        if left is not None and j + 1 == left[names[k]]:
            break
        if left is not None or j + 1 < share[names[k]]:
            heapq.heappush(coming, ((j + 1) * frame // share[names[k]], k, j + 1))
    return order


def phases(blocks: dict, weights: dict, frame: int) -> list[dict]:
    """Shares, order and first slot and blocks of every phase; ``turn`` blocks of a source fill ``size`` slots before the order repeats.

    A phase ends with the last block of the source that runs out first. Sources
    without weight come last, one after the other.
    """
    left, done, slot, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while any(left.values()):
        live = {s: weights.get(s, 0) for s, n in left.items() if n and weights.get(s, 0) > 0}
        if not live:
            live = {min((s for s, n in left.items() if n), key=str): 1}
        share = shares(live)
        repeats = sum(share.values()) <= frame
        order = frame_order(share, None if repeats else left)
        size, places = len(order), {s: [] for s in share}
        for k, s in enumerate(order):
            places[s].append(k)
        if repeats:
            last = {s: (left[s] - 1) // a * size + places[s][(left[s] - 1) % a] for s, a in share.items()}
            length = min(last.values()) + 1
            took = {s: length // size * a + sum(1 for k in places[s] if k < length % size) for s, a in share.items()}
        else:
            length, took = size, {s: len(some) for s, some in places.items()}
        out.append({"slot": slot, "length": length, "share": share, "size": size, "turn": {s: len(some) for s, some in places.items()},
                    "places": places, "first": {s: done[s] for s in share}, "took": took})
        for s, n in took.items():
            left[s] -= n
            done[s] += n
        slot += length
    return out


def mixed(docs: DataFrame, weights: dict | None = None, frame: int = 1000, block_chars: int = 65_536,
          bucket_chars: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, block, slot, release, deadline, place``.

    ``weights`` gives the target weight of each source by text; None takes the
    square root of its text, so that small sources are not drowned. Inside a
    source documents are ordered by a hash of their id. A document belongs to
    the block in which its text begins; ``slot`` is the block's turn,
    ``release`` and ``deadline`` bound it in slots, and ``place`` orders the
    documents inside a slot. Rows with a null source form a source of their own;
    null and empty texts count one character; repeated rows keep their own
    places in some order. A source with no weight given comes after all others.

    Weights whose whole proportions add up to at most ``frame`` repeat after so many slots.
    For others the driver schedules and sends out one row per block. Otherwise it sees one row per source; a source's running total is built from
    hash buckets of about ``bucket_chars`` characters, so no source meets in one task.
    """
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("bigint").alias("chars"))
    keyed = cut(sized.withColumn("turn", F.xxhash64("doc_id")))
    totals = {r["source"]: (r["chars"], r["n"]) for r in keyed.groupBy("source").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")).collect()}
    n_buckets = max(1, math.ceil(max((c for c, _ in totals.values()), default=0) / bucket_chars))
    # documents stand by (bucket, hash, id); a bucket is a range of the hash's upper half
    bucket = F.floor(F.shiftrightunsigned("turn", 32) * n_buckets / (1 << 32)).cast("int")
    placed = keyed.withColumn("bucket", bucket)
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("source", "bucket").agg(F.sum("chars").alias("held")).withColumn(
        "before", F.coalesce(F.sum("held").over(by_source), F.lit(0)))
    heads = heads.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "chars").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("ahead", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    begun = running.join(heads, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn(
        "at", F.col("ahead") + F.col("before"))
    blocked = begun.withColumn("block", F.floor(F.col("at") / block_chars).cast("bigint"))

    counts = {s: (c - 1) // block_chars + 1 for s, (c, _) in totals.items()}
    wanted = weights if weights is not None else {s: math.sqrt(c) for s, (c, _) in totals.items()}
    plan = phases(counts, wanted, frame)
    spans, slots = [], ([], [], [], [], [], [])
    for number, phase in enumerate(plan):
        whole = sum(phase["share"].values())
        for s, share in phase["share"].items():
            if phase["took"][s]:
                spans.append((s, number, phase["first"][s], phase["first"][s] + phase["took"][s], phase["slot"], phase["turn"][s], phase["size"]))
            some = phase["places"][s]
            for column, values in zip(slots, (
                    [s] * len(some), [number] * len(some), range(len(some)), some, (k * whole // share for k in range(len(some))),
                    (min(-(-(k + 1) * whole // share), NEVER) for k in range(len(some))))):
                column.extend(values)
    # one row per source and phase, and per scheduled slot; broadcast while that is small, joined beyond
    small = F.broadcast if len(slots[0]) <= BROADCAST_ROWS else (lambda frame_: frame_)
    span = spark.createDataFrame(spans, "p_source string, phase int, from_block bigint, to_block bigint, from_slot bigint, per_round bigint, size bigint")
    kinds = {"q_source": pa.string(), "q_phase": pa.int32(), "q_k": pa.int64(), "q_slot": pa.int64(), "q_release": pa.int64(), "q_deadline": pa.int64()}
    slot = spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in zip(slots, kinds.values())], names=list(kinds)))
    found = blocked.join(small(span), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") >= F.col("from_block")) & (F.col("block") < F.col("to_block")))
    j = F.col("block") - F.col("from_block")
    found = found.withColumn("k", j % F.col("per_round")).withColumn("base", F.col("from_slot") + F.floor(j / F.col("per_round")) * F.col("size"))
    found = found.join(small(slot), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("phase") == F.col("q_phase")) & (F.col("k") == F.col("q_k")))
    return found.select(
        "doc_id", "source", "block",
        (F.col("base") + F.col("q_slot")).alias("slot"),
        (F.col("base") + F.col("q_release")).alias("release"),
        (F.col("base") + F.col("q_deadline")).alias("deadline"),
        F.col("at").alias("place"),
    )


def interleave(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order, with all their columns: range-partitioned and sorted by slot and place.

    Written out, files and rows follow that order. Repeated rows of one doc_id
    share the place of the first of them.
    """
    order = mixed(docs, **options).groupBy("doc_id").agg(F.min(F.struct("slot", "place")).alias("_mix"))
    joined = docs.join(order.withColumnRenamed("doc_id", "_mix_id"), F.col("doc_id").eqNullSafe(F.col("_mix_id")))
    return joined.repartitionByRange("_mix").sortWithinPartitions("_mix").select(docs.columns)
