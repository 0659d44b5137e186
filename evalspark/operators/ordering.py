"""Orderings that hold up when one group is a large share of the data.

A window partition is one task, so a window is used here only over groups of a
known size. Everything larger is ordered by a range partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from evalspark.session import durable

BLOCK = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null; the right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _ranged(frame: DataFrame, sort: list[Column]) -> DataFrame:
    """Range-partition and write out once, with the partition number as ``_part``.

    The sampled bounds are not stable between evaluations, so everything that
    depends on them has to read the written form.
    """
    return durable(frame.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()))


def _running(ranged: DataFrame, sort: list[Column], counts: list[str]) -> DataFrame:
    """Add ``<count>_stop``: the running total of every count over the whole order.

    A window runs inside each range partition; only one number per partition and
    count visits the driver.
    """
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in counts]).orderBy("_part").collect()
    before, offsets = dict.fromkeys(counts, 0), []
    for row in totals:
        offsets.append((row["_part"], *before.values()))
        before = {c: before[c] + row[c] for c in counts}
    schema = "_part int" + "".join(f", _before_{c} bigint" for c in counts)
    offset_table = ranged.sparkSession.createDataFrame(offsets, schema)
    upto = Window.partitionBy("_part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_upto_{c}": F.sum(c).over(upto) for c in counts})
    placed = summed.join(F.broadcast(offset_table), "_part")  # one row per range partition
    return placed.withColumns({f"{c}_stop": F.col(f"_before_{c}") + F.col(f"_upto_{c}") for c in counts})


def align_sorted(tally: DataFrame, order: list[str], block: int = BLOCK, keys: list[str] | None = None) -> DataFrame:
    """Line up the two sides of ``tally`` by position in their common order.

    ``tally`` has every distinct row once with its counts ``n_golden`` and
    ``n_agent``, so a value that makes up a third of the table is one row here.
    Returns segments ``(start, length, g, a)`` in which ``length`` positions hold
    golden row ``g`` and agent row ``a``, dealt by ``_block`` of positions. Without ``keys`` both sides need the
    same total (and, when the order leads with group keys, the same in every
    group). With ``keys``, which lead the order, positions count from 0 in every
    group, the groups' columns come along, and the longer side meets nulls. Spans
    are cut at multiples of ``block``, so a window never sees more than ``block``
    spans of either side.
    """
    keys = keys or []
    sort = [F.col(c).asc_nulls_last() for c in order]
    placed = _running(_ranged(tally, sort), sort, ["n_golden", "n_agent"])
    row = F.struct(F.struct(*order).alias("r"))
    none = F.when(F.lit(False), row)
    begin = {side: F.col(f"{side}_stop") - F.col(side) for side in ("n_golden", "n_agent")}
    if keys:
        bases = placed.groupBy(*keys).agg(
            *[F.min(begin[side]).alias(f"_{side}_base") for side in begin], *[F.sum(side).alias(f"_{side}_all") for side in begin])
        placed = null_safe_join(placed, bases, keys, "inner")
    base = {side: F.col(f"_{side}_base") if keys else F.lit(0) for side in begin}

    def span(side: str, g: Column, a: Column) -> Column:
        return F.struct((begin[side] - base[side]).alias("start"), (F.col(f"{side}_stop") - base[side]).alias("stop"), g.alias("g"), a.alias("a"))

    spans = placed.select(*keys, F.inline(F.array(span("n_golden", row, none), span("n_agent", none, row))))
    if keys:  # the shorter side of a group ends in a span of no row
        kind = spans.schema["g"].dataType.simpleString()
        nothing = F.struct(F.lit(None).cast(spans.schema["g"].dataType["r"].dataType).alias("r")).cast(kind)
        short, long = F.least("_n_golden_all", "_n_agent_all"), F.greatest("_n_golden_all", "_n_agent_all")
        golden_ends = F.col("_n_golden_all") < F.col("_n_agent_all")
        spans = spans.unionByName(bases.select(
            *keys, short.alias("start"), long.alias("stop"), F.when(golden_ends, nothing).alias("g"), F.when(~golden_ends, nothing).alias("a")))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
    pieces = (
        spans.filter(F.col("stop") > F.col("start"))
        .withColumn("_block", F.explode(F.sequence(first, last)))
        .select(
            *keys, "_block", "g", "a",
            F.greatest("start", F.col("_block") * block).alias("_from"),
            F.least("stop", (F.col("_block") + 1) * block).alias("_to"),
        )
    )
    by_position = Window.partitionBy(*keys, "_block").orderBy("_from")
    filled = pieces.select(
        *keys, "_block", "_from",
        F.coalesce(F.lead("_from").over(by_position), F.col("_to")).alias("_until"),
        F.last("g", ignorenulls=True).over(by_position)["r"].alias("g"),
        F.last("a", ignorenulls=True).over(by_position)["r"].alias("a"),
    )
    return filled.filter(F.col("_until") > F.col("_from")).select(
        *keys, "_block", F.col("_from").alias("start"), (F.col("_until") - F.col("_from")).alias("length"), "g", "a"
    )


def previous_row(frame: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """Add ``prev_<c>`` for every carried column: its value in the key's row before.

    The table is cut into ranges of (keys, order), so a key with very many rows
    is spread over several. Rows look back inside their range; the first row of a
    range takes the last row of the range before, one row per range.
    """
    spark = frame.sparkSession
    sort = [F.col(c) for c in (*keys, *order)]
    ranged = _ranged(frame, sort)
    row = F.struct(*keys, *order, *[c for c in carry if c not in (*keys, *order)])
    row_type = ranged.select(row.alias("r")).schema["r"].dataType
    lasts = ranged.groupBy("_part").agg(F.max(row).alias("_last")).orderBy("_part").collect()
    handed = [(after["_part"], before["_last"]) for before, after in zip(lasts, lasts[1:])]
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_handed", row_type)])
    inside = Window.partitionBy("_part").orderBy(*sort)
    looked = ranged.withColumn("_prev", F.lag(row).over(inside)).join(
        F.broadcast(spark.createDataFrame(handed, schema)), "_part", "left"  # one row per range partition
    )
    prev = F.coalesce("_prev", "_handed")
    same_key = reduce(lambda a, b: a & b, [prev[k].eqNullSafe(F.col(k)) for k in keys])
    return looked.select(*frame.columns, *[F.when(same_key, prev[c]).alias(f"prev_{c}") for c in carry])
