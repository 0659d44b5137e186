"""Reports as ordered line tables ``(..., section, pos, line_no, line)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.constants import AGREEMENT_BAR, CATEGORIES, DIMENSIONS, GOLDEN_LABEL, AGENT_LABEL
from evalspark.functions.text import fixed, percent
from evalspark.operators import calibration as K
from evalspark.plans.scorecard import AGGREGATES, aggregate_line, verdict_message

ORDER = ["section", "pos", "line_no"]


def _explode(frame: DataFrame, keys: list[str], section: int, pos: Column, lines: list[Column] | Column) -> DataFrame:
    """One output row per line that is not null; ``line_no`` orders them and may skip."""
    placed = frame.select(
        *keys, F.lit(section).cast("bigint").alias("section"), pos.cast("bigint").alias("pos"),
        F.posexplode(F.array(*lines) if isinstance(lines, list) else lines).alias("line_no", "line"),
    )
    return placed.filter(F.col("line").isNotNull()).withColumn("line_no", F.col("line_no").cast("bigint"))


TITLES = dict((c[0], c[1]) for c in CATEGORIES)


def titled(top_failures: Column) -> Column:
    """``slug (n), ...`` with the titles of the categories; an unknown slug stays."""
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])

    def one(item: Column) -> Column:
        slug = F.substring_index(item, " (", 1)
        return F.concat(F.coalesce(F.try_element_at(titles, slug), slug), F.substring(item, F.length(slug) + 1, F.length(item)))

    return F.array_join(F.transform(F.split(top_failures, ", "), one), ", ")


#: What a report says about its run, where the scorecards have it: column and text around it.
RUN_FIELDS = (("judge_model", "Judge model", ""), ("judge_prompt_hash", "JUDGE_PROMPT hash", "`"), ("usage", "Usage", ""))


def header_lines(cards: DataFrame, keys: list[str]) -> DataFrame:
    """Title, run fields and scorecard of every report.

    ``finished_at``, ``judge_model``, ``judge_prompt_hash`` and ``usage`` appear
    where ``cards`` has them and they are not null.
    """
    bold = lambda label, value, tail="": F.concat(F.lit(f"- **{label}:** "), value, F.lit(tail))
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    title = [F.lit("# Benchmark run — "), name]
    if "finished_at" in cards.columns:
        title.append(F.coalesce(F.concat(F.lit(" — "), F.col("finished_at").cast("string")), F.lit("")))
    given = [bold(label, F.concat(F.lit(mark), F.col(c).cast("string"), F.lit(mark))) for c, label, mark in RUN_FIELDS if c in cards.columns]
    lines = [
        F.concat(*title),
        F.lit(""),
        bold("Agent", F.concat(F.lit("`"), name, F.lit("`"))),
        bold("Cases scored", F.col("cases").cast("string")),
        *given,
        F.lit(""), F.lit("## Trust-weighted scorecard"), F.lit(""),
        *[F.concat(F.lit("- **"), aggregate_line(name), F.lit("**")) for name in AGGREGATES],
        bold("Efficiency ratio (median, on correct)", fixed(F.col("efficiency_median"), 2)),
        bold("Reasoning faithfulness (judge avg)", fixed(F.col("faithfulness"), 2), " / 3"),
        F.when(F.col("top_failures") != "", bold("Failures concentrated in", titled(F.col("top_failures")))),
        F.lit(""),
        F.concat(F.lit("> "), verdict_message()),
        F.lit(""),
    ]
    return _explode(cards, keys, 0, F.lit(0), lines).unionByName(
        _explode(cards, keys, 1, F.lit(2), [F.lit("## Per-case detail"), F.lit("")]))


def unmatched_lines(lists: DataFrame, keys: list[str]) -> DataFrame:
    first = F.col("kind") == "unanswered"
    label = F.when(first, F.lit("⚠ **Prompts not answered by agent:** ")).otherwise(
        F.lit("⚠ **Agent inputs without matching golden:** ")
    )
    return _explode(lists, keys, 1, F.when(first, 0).otherwise(1), [F.concat(label, F.col("ids")), F.lit("")])


def case_detail_lines(cases: DataFrame, keys: list[str]) -> DataFrame:
    error, match = F.col("error"), F.col("exec_match")
    nothing = F.array().cast("array<string>")

    def given(condition: Column, *lines: Column) -> Column:
        return F.when(condition, F.array(*lines)).otherwise(nothing)

    def query_line(side: str, label: str) -> Column:
        return F.concat(
            F.lit(f"**{label} query:** "), fixed(F.col(f"{side}_ms"), 0), F.lit(" ms · "),
            fixed(F.col(f"{side}_bytes") / 1e6, 1), F.lit(" MB scanned · "), F.col(f"{side}_rows").cast("string"),
            F.lit(" rows"),
        )

    blank, differs = F.lit(""), ~match & F.col("summary").isNotNull()
    scores = [F.concat(F.lit(f"{short}="), F.col(d).cast("string")) for d, short in
              zip(DIMENSIONS, ("factual", "complete", "no_halluc"))]
    heading = F.array(
        F.concat_ws("  ·  ", F.concat(F.lit("### "), "case_id"), "tier", "category"), blank,
        F.concat(F.lit("**Prompt:** "), F.coalesce("prompt", blank)), blank,
    )
    judge = F.when(
        F.col("judged"),
        F.concat(
            F.array(F.concat(F.lit("**Judge:** "), F.concat_ws(", ", *scores))),
            given(F.col("failure_category").isNotNull(),
                  F.concat(F.lit("**Failure category:** `"), "failure_category", F.lit("`"))),
            F.array(blank, F.concat(F.lit("**Judge reasoning:** "), F.coalesce("reasoning", blank)), blank),
        ),
    ).otherwise(nothing)
    scored = F.concat(
        F.array(F.concat(F.lit("**execution_match:** "), F.initcap(match.cast("string")))),
        given(differs, blank, F.concat(F.lit("**exec-diff:** "), "summary")),
        given(differs & (F.coalesce("detail", blank) != ""), blank, F.lit("```"), F.col("detail"), F.lit("```")),
        F.array(blank),
        judge,
        F.array(
            F.concat(F.lit("**Optimization:** `"), "optimization", F.lit("`")), blank,
            query_line("golden", GOLDEN_LABEL), query_line("agent", AGENT_LABEL), blank,
        ),
    )
    lines = F.concat(
        heading,
        F.when(error.isNull(), scored).otherwise(F.array(F.concat(F.lit("**❌ Error:** "), error), blank)),
    )
    return _explode(cases, keys, 2, F.col("case_pos"), lines)


def report_lines(cases: DataFrame, cards: DataFrame, keys: list[str], lists: DataFrame | None = None) -> DataFrame:
    """All lines of all reports; nothing is gathered, order is in the columns."""
    parts = [header_lines(cards, keys), case_detail_lines(cases, keys)]
    if lists is not None:
        parts.append(unmatched_lines(lists, keys))
    return reduce(DataFrame.unionByName, parts)


def write_reports(lines: DataFrame, path: str, keys: list[str]) -> None:
    """One folder of text files per report, lines in order within and across files.

    The range partitioning cuts long reports by position, so no report has to fit
    into one task.
    """
    order = [*keys, *ORDER]
    (
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(*keys, F.col("line").alias("value"))
        .write.partitionBy(*keys).text(path)
    )


def _table_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))


def calibration_report_lines(cases: DataFrame) -> DataFrame:
    """Calibration report: overall, per dimension, disagreements, all cases, reasoning."""
    scores = K.long_scores(cases, ["case_id"])
    header = _explode(K.overall_agreement(cases), [], 0, F.lit(0), [
        F.lit("# Judge calibration run"), F.lit(""),
        F.concat(
            F.lit("**Overall agreement:** "), percent(F.col("rate")), F.lit(" ("), F.col("agreed").cast("string"),
            F.lit("/"), F.col("possible").cast("string"), F.lit(")"),
        ),
    ])
    below = _explode(K.calibration_gate(scores), [], 1, F.lit(0), [
        F.when(F.col("below_agreement") != "",
               F.concat(F.lit(f"**⚠ Below {AGREEMENT_BAR:.0%} threshold:** "), "below_agreement")),
        F.concat(F.lit("Gate: "), "gate"), F.lit(""), F.lit("| dimension | agreed | rate | kappa | label |"),
    ])
    kappas = K.cohens_kappa(scores, ["dim"])
    place = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dim"))
    dims = _explode(kappas, [], 2, place, [_table_row(
        F.col("dim"), F.concat(F.col("agreed").cast("string"), F.lit("/"), F.col("n").cast("string")),
        percent(F.col("agreed") / F.col("n")), fixed(F.col("kappa"), 2), F.col("label"),
    )])
    differing = _table_row(
        F.col("case_id"), F.col("dim"), F.col("human"), F.col("judge"), F.translate("reasoning", "\n", " ")
    )
    # one slot per dimension keeps several disagreements on a case in order
    apart = _explode(K.disagreements(cases), [], 3, F.col("case_id"), [
        F.when(F.col("dim") == d, differing) for d in DIMENSIONS
    ])
    triple = lambda side: F.concat(
        F.lit("("), F.concat_ws(",", *[F.col(f"{side}_{d}").cast("string") for d in DIMENSIONS]), F.lit(")")
    )
    agreed = sum(((F.col(f"human_{d}") == F.col(f"judge_{d}")).cast("int") for d in DIMENSIONS), F.lit(0))
    everyone = _explode(cases, [], 4, F.col("case_id"), [_table_row(F.col("case_id"), triple("human"), triple("judge"), agreed)])
    reasons = _explode(cases, [], 5, F.col("case_id"), [
        F.concat(F.lit("### "), F.col("case_id").cast("string")), F.lit(""),
        F.concat(F.lit("- **Reasoning:** "), "reasoning"), F.lit(""),
    ])
    return reduce(DataFrame.unionByName, [header, below, dims, apart, everyone, reasons])
