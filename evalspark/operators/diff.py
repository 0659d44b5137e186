"""Result-set comparison: golden result against agent result.

Batch mode compares very many small results held in one long table, pair mode
two tables of any size. Both sort by all columns with missing values last and
compare by position, numbers with tolerance. In batch mode the rows carry a
``side`` column; their values are either plain columns of one schema or the
``cells`` column of :mod:`evalspark.functions.encode`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from evalspark.constants import AGENT_LABEL, GOLDEN_LABEL, MAX_RESULT_ROWS, SAMPLE_ROWS
from evalspark.functions.compare import cells_identical, cells_match, nan_to_null
from evalspark.functions.encode import encode_rows, encoded_identical, encoded_match
from evalspark.operators.ordering import align_sorted, null_safe_join

GOLDEN, AGENT = "golden", "agent"
CELLS = "cells"


def both_sides(golden: DataFrame, agent: DataFrame) -> DataFrame:
    """One long table from two with the same columns, told apart by ``side``."""
    return golden.withColumn("side", F.lit(GOLDEN)).unionByName(agent.withColumn("side", F.lit(AGENT)))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _normalised(rows: DataFrame, values: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in rows.schema.fields}
    changed = {v: nan_to_null(F.col(v), types[v]) for v in values if isinstance(types[v], (T.FloatType, T.DoubleType))}
    return rows.withColumns(changed) if changed else rows


def _row_match(g_type: T.StructType, a_type: T.StructType, values: list[str]) -> tuple[Column, Column]:
    """(tolerant match, exact match) of the structs ``g`` and ``a``."""
    if values == [CELLS]:
        return (
            encoded_match(F.col("g.cells"), F.col("a.cells")),
            encoded_identical(F.col("g.cells"), F.col("a.cells")),
        )
    pairs = [(F.col(f"g.`{v}`"), F.col(f"a.`{v}`"), g_type[v].dataType, a_type[v].dataType) for v in values]
    return _all([cells_match(*p) for p in pairs]), _all([cells_identical(*p) for p in pairs])


def result_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count of either side per result; counts combine before the shuffle."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("side") == GOLDEN).alias("n_golden"),
        F.count_if(F.col("side") == AGENT).alias("n_agent"),
    )


def row_cap_guard(rows: DataFrame, keys: list[str], cap: int = MAX_RESULT_ROWS) -> DataFrame:
    """Results over the row cap, with the refusal text."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn(
            "reason",
            F.when(
                F.col("n_rows") > cap,
                F.concat(
                    F.lit("returned "), F.format_number("n_rows", 0),
                    F.lit(f" rows — exceeds {cap:,} row cap"),
                ),
            ),
        )
    )


def layout_diff(layouts: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered column lists of either side, their differences, and whether they agree.

    ``layouts`` has one row per result and side with the array ``cols``. A pure
    reorder is a mismatch with both difference lists empty.
    """
    # one row per side, so max() only picks it out
    sides = layouts.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == GOLDEN, F.col("cols"))).alias("golden_cols"),
        F.max(F.when(F.col("side") == AGENT, F.col("cols"))).alias("agent_cols"),
    )
    return sides.select(
        *keys,
        "golden_cols",
        "agent_cols",
        (F.col("golden_cols") == F.col("agent_cols")).alias("columns_match"),
        F.array_except("golden_cols", "agent_cols").alias("only_golden"),
        F.array_except("agent_cols", "golden_cols").alias("only_agent"),
    )


def tally_rows(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every distinct row once with its count on either side.

    Copies combine before the shuffle and the shuffle is on the whole row, so
    neither a large result nor a frequent row loads one task.
    """
    return _normalised(rows, values).groupBy(*keys, *values).agg(
        F.count_if(F.col("side") == GOLDEN).alias("n_golden"),
        F.count_if(F.col("side") == AGENT).alias("n_agent"),
    )


def case_totals(tally: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Row counts per result, whether the sides hold exactly the same rows
    (``even``), and how many golden rows have a missing cell."""
    missing = reduce(lambda a, b: a | b, [_has_missing(v) for v in values], F.lit(False))
    return tally.groupBy(*keys).agg(
        F.sum("n_golden").alias("n_golden"), F.sum("n_agent").alias("n_agent"),
        F.bool_and(F.col("n_golden") == F.col("n_agent")).alias("even"),
        F.sum(F.when(missing, F.col("n_golden")).otherwise(0)).alias("_with_missing"),
    )


def _contested(totals: DataFrame) -> DataFrame:
    """Results whose sides have equally many but not the same rows."""
    return totals.filter(~F.col("even") & (F.col("n_golden") == F.col("n_agent")))


def _has_missing(value: str) -> Column:
    if value == CELLS:
        return F.exists(F.col(CELLS), lambda cell: cell["missing"] == 1)
    return F.col(value).isNull()


def aligned_rows(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both sides of every result by rank: ``(keys, pos, g, a)``, a side may be null. Results may have any size."""
    segments = align_sorted(tally_rows(rows, keys, values), [*keys, *values], keys=keys)
    position = F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("length")))
    return segments.select(*keys, position.alias("pos"), "g", "a")


def judged_rows(aligned: DataFrame, values: list[str]) -> DataFrame:
    """Add ``ok`` (tolerant) and ``same`` (exact) to aligned rows."""
    ok, same = _row_match(aligned.schema["g"].dataType, aligned.schema["a"].dataType, values)
    paired = F.col("g").isNotNull() & F.col("a").isNotNull()
    return aligned.withColumns({"ok": paired & ok, "same": paired & same})


def diff_batch(
    rows: DataFrame, keys: list[str], values: list[str] | None = None, layouts: DataFrame | None = None,
    size: int = SAMPLE_ROWS,
) -> DataFrame:
    """Compare every result in one plan, one output row per result of any size.

    ``detail`` of a result with other values shows its first ``size`` differing rows.

    The exact comparison comes first and needs no order: results whose sides hold
    the same rows are settled by counting. Only results with equal row counts and
    different rows are ordered, by range, and compared with tolerance. ``layouts``
    lists the columns of either side and keeps results without rows.
    """
    values = values or [c for c in rows.columns if c not in (*keys, "side")]
    tally = tally_rows(rows, keys, values)
    totals = case_totals(tally, keys, values)
    contested = _contested(totals).select(*keys)
    counts = _mismatch_counts(null_safe_join(tally, contested, keys, "left_semi"), keys, values, size)
    if layouts is None:
        none = F.array().cast("array<string>")
        cases = totals.withColumns({
            "columns_match": F.lit(True), "golden_cols": none, "agent_cols": none, "only_golden": none,
            "only_agent": none,
        })
    else:
        cases = null_safe_join(layout_diff(layouts, keys), totals, keys, "left")
    zero = F.lit(0).cast("bigint")
    merged = null_safe_join(cases, counts, keys, "left").withColumns({
        "n_golden": F.coalesce("n_golden", zero), "n_agent": F.coalesce("n_agent", zero),
        "_apart": F.coalesce("_apart", zero),
        "mismatched_rows": F.coalesce("_unequal", "_with_missing", zero),
    })
    return describe(merged, keys, values == [CELLS])


def differing_cells(values: list[str], g_type: T.StructType, a_type: T.StructType) -> Column:
    """The cells of the structs ``g`` and ``a`` that differ: column, golden and agent value as text.

    A cell missing on both sides does not differ here. Encoded cells are named by
    their number, from 0.
    """
    if values == [CELLS]:
        def both(x: Column, y: Column) -> Column:
            apart = ~encoded_identical(F.array(x), F.array(y)) & ~((x["missing"] == 1) & (y["missing"] == 1))
            return F.struct(apart.alias("apart"), x["txt"].alias("golden_value"), y["txt"].alias("agent_value"))

        numbered = F.transform(F.zip_with(F.col("g.cells"), F.col("a.cells"), both), lambda c, k: F.struct(
            c["apart"].alias("apart"), k.cast("string").alias("column"), c["golden_value"].alias("golden_value"),
            c["agent_value"].alias("agent_value")))
        return F.transform(F.filter(numbered, lambda c: c["apart"]), lambda c: F.struct(c["column"], c["golden_value"], c["agent_value"]))
    return F.array_compact(F.array(*[
        F.when(
            ~cells_identical(F.col(f"g.`{v}`"), F.col(f"a.`{v}`"), g_type[v].dataType, a_type[v].dataType)
            & ~(F.col(f"g.`{v}`").isNull() & F.col(f"a.`{v}`").isNull()),
            F.struct(
                F.lit(v).alias("column"), F.col(f"g.`{v}`").cast("string").alias("golden_value"),
                F.col(f"a.`{v}`").cast("string").alias("agent_value")))
        for v in values
    ]))


SAMPLE = "array<struct<pos:bigint,cells:array<struct<column:string,golden_value:string,agent_value:string>>>>"


def _mismatch_counts(tally: DataFrame, keys: list[str], values: list[str], size: int = SAMPLE_ROWS) -> DataFrame:
    """Mismatch counts and the first ``size`` differing rows of results whose sides have equal row counts.

    With equal counts in every result, equal positions in the two sorted tables
    belong to the same result and the same rank, so no rank per result is needed.
    A block of positions hands on its first ``size`` differing segments only.
    """
    judged = judged_rows(align_sorted(tally, [*keys, *values]), values)
    cells = differing_cells(values, judged.schema["g"].dataType, judged.schema["a"].dataType)
    named = judged.select(
        *[F.col(f"g.{k}").alias(k) for k in keys], "_block", "start", "length", "ok", "same",
        F.when(~F.col("same"), cells).alias("cells"))
    shown = F.coalesce(F.size("cells") > 0, F.lit(False))
    so_far = F.count_if(shown).over(Window.partitionBy("_block", *keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    first = F.when(shown & (so_far <= size), F.struct("start", "length", "cells"))
    found = named.withColumn("_first", first).groupBy(*keys).agg(
        F.sum(F.when(F.col("ok"), 0).otherwise(F.col("length"))).alias("_apart"),
        F.sum(F.when(F.col("same"), 0).otherwise(F.col("length"))).alias("_unequal"),
        F.min("start").alias("_base"), F.array_sort(F.collect_list("_first")).alias("_sample"))
    rows = F.flatten(F.transform(F.slice("_sample", 1, size), lambda s: F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.least(s["length"], F.lit(size))),
        lambda k: F.struct((s["start"] - F.col("_base") + k).alias("pos"), s["cells"].alias("cells")))))
    return found.select(*keys, "_apart", "_unequal", F.slice(rows, 1, size).cast(SAMPLE).alias("_sample"))


OUTCOME = """CASE WHEN NOT columns_match THEN 'columns'
  WHEN n_agent <> n_golden THEN 'row_count' WHEN _apart > 0 THEN 'values' ELSE 'match' END"""
NAMES = "concat('[', array_join(transform({0}, c -> concat('\\'', c, '\\'')), ', '), ']')"
SUMMARY = f"""CASE outcome
  WHEN 'columns' THEN concat('column mismatch ({GOLDEN_LABEL}: ', {NAMES.format("golden_cols")}, ', {AGENT_LABEL}: ',
                             {NAMES.format("agent_cols")}, ')')
  WHEN 'row_count' THEN concat('row count differs: {GOLDEN_LABEL}=', n_golden, ', {AGENT_LABEL}=', n_agent, ' (',
                               if(row_delta > 0, '+', ''), row_delta, ')')
  WHEN 'values' THEN concat('values differ in ', n_golden, ' rows (', mismatched_rows, ' mismatched)')
  ELSE 'results match' END"""
DETAIL = f"""CASE outcome
  WHEN 'columns' THEN concat_ws('\n',
    if(size(only_golden) > 0, concat('missing in agent: ', {NAMES.format("only_golden")}), NULL),
    if(size(only_agent) > 0, concat('extra in agent: ', {NAMES.format("only_agent")}), NULL))
  WHEN 'row_count' THEN concat('agent returned ', abs(row_delta), if(row_delta > 0, ' extra', ' fewer'), ' rows')
  WHEN 'values' THEN if(coalesce(size(_sample), 0) = 0, '', concat('first mismatching rows:\n', array_join(transform(_sample,
    r -> concat('row ', r.pos, ': ', array_join(transform(r.cells,
      c -> concat({{name}}, ' {GOLDEN_LABEL}=', coalesce(c.golden_value, 'null'), ' {AGENT_LABEL}=', coalesce(c.agent_value, 'null'))), '; '))),
    '\n')))
  ELSE '' END"""
# encoded cells carry their number instead of a name
CELL_NAME = "coalesce(get(golden_cols, try_cast(c.column AS INT)), concat('column ', c.column))"


def describe(cases: DataFrame, keys: list[str], encoded: bool = False) -> DataFrame:
    """Outcome, headline and detail: columns first, then row count, then values."""
    detail = DETAIL.format(name=CELL_NAME if encoded else "c.column")
    return cases.selectExpr("*", f"{OUTCOME} AS outcome", "n_agent - n_golden AS row_delta").selectExpr(
        *[f"`{k}`" for k in keys], "outcome = 'match' AS matched", "outcome", f"{SUMMARY} AS summary",
        f"{detail} AS detail", "columns_match", "only_golden", "only_agent", "n_golden", "n_agent", "row_delta",
        "mismatched_rows",
    )


def sub_signals(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Column-set, row-count and value match as separate signals (null where not reached)."""
    rows_match = F.when(F.col("columns_match"), F.col("row_delta") == 0)
    return diffs.select(
        *keys, "columns_match", rows_match.alias("row_count_match"),
        F.when(rows_match, F.col("matched")).alias("values_match"),
    )


def diff_sample(rows: DataFrame, keys: list[str], values: list[str], size: int | None = SAMPLE_ROWS) -> DataFrame:
    """The first ``size`` differing rows of every result (None: all), one output row per differing cell.

    As with the value comparison, only results with equal row counts are sampled.
    """
    tally = tally_rows(rows, keys, values)
    contested = null_safe_join(tally, _contested(case_totals(tally, keys, values)).select(*keys), keys, "left_semi")
    if size is not None:
        found = _mismatch_counts(contested, keys, values, size)
        return found.select(*keys, F.inline("_sample")).select(*keys, "pos", F.inline("cells"))
    aligned = align_sorted(contested, [*keys, *values], keys=keys)
    cells = differing_cells(values, aligned.schema["g"].dataType, aligned.schema["a"].dataType)
    differing = aligned.withColumn("_cells", cells).filter(F.size("_cells") > 0)
    placed = differing.withColumn("pos", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("length"))))
    return placed.select(*keys, "pos", F.inline("_cells"))


def diff_frames(golden: DataFrame, agent: DataFrame) -> DataFrame:
    """Pair mode: one row describing how two tables of any size differ."""
    for frame in (golden, agent):
        if len(set(frame.columns)) != len(frame.columns):
            raise ValueError(f"duplicate column names: {frame.columns}")
    names = lambda cols: F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    only_golden = [c for c in golden.columns if c not in agent.columns]
    only_agent = [c for c in agent.columns if c not in golden.columns]
    same_columns = golden.columns == agent.columns
    n_golden, n_agent = golden.count(), agent.count()
    apart = mismatched = 0
    sample: list = []
    if same_columns and n_golden == n_agent and n_golden and golden.columns:
        plain = [f"c{i}" for i in range(len(golden.columns))]  # result columns may have any name
        tally, values = pair_tally(golden.toDF(*plain), agent.toDF(*plain))
        counted = _mismatch_counts(tally, [], values).first()  # two numbers and a few rows
        apart, mismatched = counted["_apart"], counted["_unequal"]
        names_of = dict(zip(plain, golden.columns)) | {str(i): c for i, c in enumerate(golden.columns)}
        sample = [(r["pos"], [(names_of[c["column"]], c["golden_value"], c["agent_value"]) for c in r["cells"]]) for r in counted["_sample"]]
    number = lambda n: F.lit(n).cast("bigint")
    one = golden.sparkSession.createDataFrame([(sample,)], f"_sample {SAMPLE}").select(
        "_sample",
        F.lit(same_columns).alias("columns_match"), names(golden.columns).alias("golden_cols"),
        names(agent.columns).alias("agent_cols"), names(only_golden).alias("only_golden"),
        names(only_agent).alias("only_agent"), number(n_golden).alias("n_golden"), number(n_agent).alias("n_agent"),
        number(apart).alias("_apart"), number(mismatched).alias("mismatched_rows"),
    )
    return describe(one, [])


def pair_tally(golden: DataFrame, agent: DataFrame) -> tuple[DataFrame, list[str]]:
    """Distinct rows of two tables with their counts, and the columns that hold the values.

    Columns of one type on both sides are compared as they are; where a type
    differs, the rows are encoded, which keeps numbers apart from text.
    """
    values = golden.columns
    if [f.dataType for f in golden.schema.fields] != [f.dataType for f in agent.schema.fields]:
        golden, agent, values = encode_rows(golden), encode_rows(agent), [CELLS]
    return tally_rows(both_sides(golden, agent), [], values), values
