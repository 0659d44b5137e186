"""Judge requests and answers as tables. The call itself happens elsewhere."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.constants import (
    DIMENSIONS, FAILURE_CATEGORIES, MAX_CALLS_PER_RUN, PROMPT_HASH_HEX, RESULT_HEAD_ROWS, USD_PER_MTOK_INPUT,
    USD_PER_MTOK_OUTPUT,
)
from evalspark.functions.text import fixed, strip
from evalspark.operators.ordering import null_safe_join

SLOTS = ("prompt", "golden_sql", "golden_result_csv", "agent_sql", "exec_diff", "agent_answer")
DEFAULT_TEMPLATE = """Grade how an analytics agent explains its query. Judge the explanation against the
agent's own SQL, not the numbers and not whether the SQL is right.

Give 0 or 1 for each of:
factual_accuracy - every SQL operation the explanation names is really in the agent's SQL
completeness - the explanation covers the quantities and groupings the question asks for
no_hallucination - it claims nothing beyond the SQL, the data and the schema

If the results differ, choose the failure_category that says why, else null.
Answer with a JSON object of these keys and a short "reasoning".

Question:
{prompt}

Golden SQL:
{golden_sql}

Golden result:
{golden_result_csv}

Agent SQL:
{agent_sql}

Difference of the results:
{exec_diff}

Agent explanation:
{agent_answer}
"""


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """(literal text, slot after it) pairs; doubled braces stand for themselves."""
    return [(text, slot) for text, slot, _, _ in Formatter().parse(template)]


def judge_requests(cases: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Add ``request``: the template with every slot filled from its column."""
    pieces = []
    for text, slot in template_parts(template):
        pieces.append(F.lit(text))
        if slot:
            pieces.append(F.coalesce(F.col(slot).cast("string"), F.lit("")))
    return cases.withColumn("request", F.concat(*pieces))


def prompt_hash(template: Column) -> Column:
    return F.left(F.sha2(template, 256), F.lit(PROMPT_HASH_HEX))


def csv_header(columns: list[str]) -> str:
    """The header line of a result: all of it if the result is empty."""
    return ",".join(columns) + "\n"


def result_csv_head(
    rows: DataFrame, keys: list[str], columns: list[str], order: list[str], head: int = RESULT_HEAD_ROWS
) -> DataFrame:
    """Result per key as CSV text, cut after ``head`` rows with a note of the full size. A key without rows has none.

    The rank filter prunes every input partition to ``head`` rows per key before
    the shuffle, so at most that many lines are gathered.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    lines = (
        rows.withColumn("_rank", rank)
        .filter(F.col("_rank") <= head)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", F.to_csv(F.struct(*columns)).alias("line")))).alias("_lines"))
    )
    text = F.concat(
        F.lit(csv_header(columns)),
        F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"),
        F.lit("\n"),
    )
    note = F.when(
        F.col("n_rows") > head,
        F.concat(F.lit(f"\n[truncated to first {head} of "), F.col("n_rows").cast("string"), F.lit(" rows]\n")),
    ).otherwise(F.lit(""))
    return null_safe_join(lines, sizes, keys, "inner").select(*keys, "n_rows", F.concat(text, note).alias("csv"))


# --- answers ------------------------------------------------------------------

FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"


def extract_json(answers: DataFrame, raw: str, name: str) -> DataFrame:
    """Add the JSON object in an answer: fenced block first, then the outermost braces.

    Stepwise columns, so that no pattern runs twice on the same answer.
    """
    inner = F.col("_inner")
    # in brackets, only one whole JSON value gives a list of one
    is_list = F.startswith(inner, F.lit("[")) & F.coalesce(F.json_array_length(F.concat(F.lit("["), inner, F.lit("]"))) == 1, F.lit(False))
    return (
        answers.withColumn("_text", strip(F.col(raw)))
        .withColumn("_block", F.regexp_extract("_text", FENCE, 0))
        .withColumn("_inner", F.when(F.col("_block") != "", strip(F.regexp_extract("_block", FENCE, 1))).otherwise(F.col("_text")))
        .withColumn("_braces", F.when(~is_list, F.regexp_extract(inner, r"(?s)\{.*\}", 0)))
        .withColumn(name, F.when(F.col("_braces") != "", F.col("_braces")))
        .drop("_text", "_block", "_inner", "_braces")
    )


def _to_bit(text: Column, quoted: Column) -> Column:
    """A JSON number or boolean as an integer; a JSON string only if it is written as one."""
    whole = F.when(strip(text).rlike(r"\A[+-]?[0-9]+\z"), strip(text).try_cast("int"))
    return (
        F.when(quoted, whole).when(text == "true", F.lit(1)).when(text == "false", F.lit(0))
        .otherwise(text.try_cast("double").cast("int"))
    )


def judge_verdicts(answers: DataFrame, raw: str) -> DataFrame:
    """Typed verdicts. A bad answer keeps its row with ``error`` set and no scores."""
    fields = ",".join(f"{name}:string" for name in (*DIMENSIONS, "failure_category", "reasoning", "_corrupt"))
    parsed = F.from_json("_json", F.lit(f"struct<{fields}>"), {"columnNameOfCorruptRecord": "_corrupt"})
    # as a generated row the answer is parsed once, not once per field
    read = extract_json(answers, raw, "_json").withColumn("_v", F.explode(F.array(parsed)))
    bits = {d: _to_bit(F.col(f"_v.{d}"), F.col("_json").rlike(f'"{d}"\\s*:\\s*"')) for d in DIMENSIONS}
    error = F.when(F.col("_json").isNull() | F.col("_v._corrupt").isNotNull(), F.lit("no JSON object"))
    for d in DIMENSIONS:
        error = error.when(bits[d].isNull(), F.lit(f"missing {d}"))
    category = F.col("_v.failure_category")
    good = F.col("error").isNull()
    return (
        read.withColumn("error", error)
        .withColumns({d: F.when(good, bits[d]) for d in DIMENSIONS})
        .withColumns({
            "failure_category": F.when(good & category.isin(*FAILURE_CATEGORIES), category),
            "reasoning": F.when(good, F.coalesce("_v.reasoning", F.lit(""))),
        })
        .drop("_v", "_json")
    )


# --- cost and budget ------------------------------------------------------------

def judge_usage(log: DataFrame, keys: list[str]) -> DataFrame:
    cost = (F.col("input_tokens") * USD_PER_MTOK_INPUT + F.col("output_tokens") * USD_PER_MTOK_OUTPUT) / 1_000_000
    totals = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ).withColumn("cost_usd", cost)
    return totals.withColumn(
        "usage",
        F.concat(
            F.col("calls").cast("string"), F.lit(" calls, "), F.format_number("input_tokens", 0), F.lit(" in / "),
            F.format_number("output_tokens", 0), F.lit(" out tokens, ~$"),
            fixed(F.col("cost_usd"), 4),
        ),
    )


def judge_budget(log: DataFrame, run: str, order: list[str], budget: int = MAX_CALLS_PER_RUN) -> DataFrame:
    """Mark the calls of a run beyond its budget.

    Only the first ``budget`` calls of a run are ranked (each input partition
    keeps no more than that); the last of them is the mark every call is
    compared with, so a run of any length is never gathered.
    """
    rank = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    last = (
        log.select(run, *order).withColumn("_rank", rank).filter(F.col("_rank") <= budget)
        .filter(F.col("_rank") == budget)
        .select(F.col(run).alias("_run"), F.struct(*order).alias("_mark"))
    )
    return log.join(last, F.col(run) == F.col("_run"), "left").withColumn(
        "allowed", F.coalesce(F.struct(*order) <= F.col("_mark"), F.lit(True))
    ).drop("_run", "_mark")
