"""Judge calibration: agreement with human labels, kappa, freshness, drift."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.constants import (
    AGREEMENT_BAR, AGREEMENT_LINE_PATTERN, CALIBRATION_FILE_PATTERN, DIMENSIONS, KAPPA_BAR, REASONING_PREVIEW,
)
from evalspark.functions.stats import kappa, kappa_label, rate
from evalspark.functions.text import preview
from evalspark.operators.ordering import null_safe_join, previous_row


def long_scores(cases: DataFrame, keep: list[str]) -> DataFrame:
    """One row per case and dimension from ``human_<dim>`` / ``judge_<dim>`` columns."""
    cells = F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(f"human_{d}").alias("human"), F.col(f"judge_{d}").alias("judge"))
        for d in DIMENSIONS
    ])
    return cases.select(*keep, F.inline(cells))


def human_judge_join(human: DataFrame, judge: DataFrame) -> DataFrame:
    """Human and judge scores of the same case and dimension side by side."""
    return human.join(judge, ["case_id", "dim"])


def agreement_counts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The four counts everything else follows from; one map-combined aggregation."""
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("human") == F.col("judge")).alias("agreed"),
        F.count_if(F.col("human") == 1).alias("human_ones"),
        F.count_if(F.col("judge") == 1).alias("judge_ones"),
    )


def dim_agreement(scores: DataFrame, keys: list[str]) -> DataFrame:
    agreement = rate(F.col("agreed"), F.col("n"))
    return (
        agreement_counts(scores, keys)
        .withColumn("rate", agreement)
        .withColumn("below_bar", F.coalesce(F.col("rate") < AGREEMENT_BAR, F.lit(False)))
        .select(*keys, "n", "agreed", "rate", "below_bar")
    )


def cohens_kappa(scores: DataFrame, keys: list[str]) -> DataFrame:
    value = kappa(F.col("n"), F.col("agreed"), F.col("human_ones"), F.col("judge_ones"))
    return (
        agreement_counts(scores, keys)
        .withColumn("kappa", value)
        .withColumns({"label": kappa_label(F.col("kappa")), "below_bar": F.col("kappa") < KAPPA_BAR})
        .select(*keys, "n", "agreed", "kappa", "label", "below_bar")
    )


def category_agrees() -> Column:
    return F.col("human_category").eqNullSafe(F.col("judge_category"))


def category_agreement(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return cases.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(category_agrees()).alias("agreed"),
        F.avg(category_agrees().cast("double")).alias("rate"),
    )


def agreed_of_four() -> Column:
    parts = [(F.col(f"human_{d}") == F.col(f"judge_{d}")) for d in DIMENSIONS] + [category_agrees()]
    return sum((p.cast("int") for p in parts), F.lit(0))


def case_agreement(cases: DataFrame) -> DataFrame:
    return cases.withColumn("agreed", agreed_of_four())


def overall_agreement(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Agreement over three dimensions and the category, 4n in all."""
    slots = len(DIMENSIONS) + 1
    return (
        cases.groupBy(*(keys or []))
        .agg(F.sum(agreed_of_four()).alias("agreed"), (F.count(F.lit(1)) * slots).alias("possible"))
        .withColumn("rate", rate(F.col("agreed"), F.col("possible")))
    )


def disagreements(cases: DataFrame) -> DataFrame:
    shown = cases.withColumn("reasoning", preview(F.col("reasoning"), REASONING_PREVIEW))
    return long_scores(shown, ["case_id", "reasoning"]).filter(F.col("human") != F.col("judge")).select(
        "case_id", "dim", "human", "judge", "reasoning"
    )


def calibration_gate(scores: DataFrame) -> DataFrame:
    """Dimensions below either bar, and the gate text. One row; at most three names."""
    agreement = dim_agreement(scores, ["dim"]).select("dim", F.col("below_bar").alias("low_agreement"))
    both = agreement.join(cohens_kappa(scores, ["dim"]).select("dim", F.col("below_bar").alias("low_kappa")), "dim")

    def names(flag: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col(flag), F.col("dim")))), ", ")

    gate = (
        F.when((F.col("below_agreement") == "") & (F.col("below_kappa") == ""), F.lit("all dimensions clear both bars"))
        .when(
            F.col("below_kappa") == "",
            F.concat("below_agreement", F.lit(f" below {AGREEMENT_BAR:.0%} raw agreement")),
        )
        .otherwise(F.concat("below_kappa", F.lit(f" below κ={KAPPA_BAR:.2f}")))
    )
    return both.agg(
        names("low_agreement").alias("below_agreement"), names("low_kappa").alias("below_kappa")
    ).withColumn("gate", gate)


# --- freshness --------------------------------------------------------------

def latest_calibration(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest calibration report among ``(path, body)`` rows with its agreement."""
    name = F.element_at(F.split("path", "/"), -1)
    stamped = files.select(
        *(keys or []),
        F.regexp_extract(name, CALIBRATION_FILE_PATTERN, 1).alias("timestamp"),
        F.regexp_extract(name, CALIBRATION_FILE_PATTERN, 2).alias("prompt_hash"),
        F.regexp_extract("body", AGREEMENT_LINE_PATTERN, 1).try_cast("int").alias("agreement_pct"),
        "path",
    ).filter(F.col("timestamp") != "")
    newest = F.max(F.struct("timestamp", "path", "prompt_hash", "agreement_pct")).alias("_last")
    return stamped.groupBy(*(keys or [])).agg(newest).filter(F.col("_last").isNotNull()).select(
        *(keys or []), "_last.timestamp", "_last.prompt_hash", "_last.agreement_pct", "_last.path"
    )


def calibration_freshness(current: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    """Never / current / stale for every current prompt hash, as text."""
    known = latest.select(*keys, "timestamp", F.col("prompt_hash").alias("_seen"), "agreement_pct")
    day = F.element_at(F.split("timestamp", "_"), 1)
    pct = F.coalesce(F.concat(F.col("agreement_pct").cast("string"), F.lit("%")), F.lit("?"))
    state = (
        F.when(F.col("timestamp").isNull(), F.lit("never"))
        .when(F.col("_seen") == F.col("prompt_hash"), F.lit("current"))
        .otherwise(F.lit("stale"))
    )
    text = (
        F.when(F.col("state") == "never", F.lit("⚠ Judge not yet calibrated."))
        .when(
            F.col("state") == "current",
            F.concat(F.lit("Judge calibrated: "), day, F.lit(" ("), pct, F.lit(" agreement, current prompt)")),
        )
        .otherwise(F.concat(
            F.lit("⚠ Judge calibration is stale: last calibrated "), day, F.lit(" against prompt `"), F.col("_seen"),
            F.lit("` ("), pct, F.lit(" agreement); current prompt is `"), F.col("prompt_hash"), F.lit("`."),
        ))
    )
    joined = null_safe_join(current, known, keys, "left")
    return joined.withColumn("state", state).withColumn("status", text).select(*keys, "prompt_hash", "state", "status")


# --- ensembles, drift, intervals ---------------------------------------------

def judge_spread(votes: DataFrame, keys: list[str]) -> DataFrame:
    """How far several judges lie apart on the same case and dimension."""
    score = F.col("score").cast("double")
    return votes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("judges"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("spread"),
        (F.max("score") - F.min("score")).alias("range"),
    )


def judge_pair_kappa(votes: DataFrame, judges: list[str]) -> DataFrame:
    """Kappa of every pair of the named judges per dimension.

    The votes of a case are laid side by side, one column per judge, so pairs of
    judges are pairs of columns and no row meets another row.
    """
    wide = votes.groupBy("case_id", "dim").agg(
        *[F.max(F.when(F.col("judge_name") == j, F.col("score"))).alias(f"_s{i}") for i, j in enumerate(judges)]
    )
    pairs = F.array(*[
        F.struct(
            F.lit(judges[i]).alias("judge_a"), F.lit(judges[k]).alias("judge_b"),
            F.col(f"_s{i}").alias("human"), F.col(f"_s{k}").alias("judge"),
        )
        for i, k in combinations(range(len(judges)), 2)
    ])
    both = wide.select("dim", F.inline(pairs)).filter(F.col("human").isNotNull() & F.col("judge").isNotNull())
    return cohens_kappa(both, ["dim", "judge_a", "judge_b"]).select("dim", "judge_a", "judge_b", "n", "kappa")


def calibration_drift(history: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Change of kappa from one calibration run to the next.

    ``history`` has one row per run and dimension, the output of kappa per run. A
    dimension has as many rows as there are runs, so the look-back is by ranges.
    """
    looked = previous_row(history, keys, [order], ["kappa"])
    return looked.withColumn("change", F.col("kappa") - F.col("prev_kappa")).drop("prev_kappa")


#: Cumulated Poisson(1) probabilities in parts of 2^32: how often a block is drawn follows from 32 bits.
POISSON_STEPS = tuple(int((1 << 32) * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(10))


def hash_bits(text: Column) -> Column:
    """The first 32 bits of the sha256 of a text as a number."""
    return F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("bigint")


def bootstrap_weights(spark: SparkSession, replicates: int, blocks: int, seed: int) -> DataFrame:
    """How often each block is drawn in each replicate, a table of ``replicates`` x ``blocks`` rows told by hashes alone."""
    drawn = spark.range(replicates * blocks).select(
        F.expr(f"id div {blocks}").alias("replicate"), (F.col("id") % blocks).alias("block"))
    bits = hash_bits(F.concat_ws(":", F.lit(seed), "replicate", "block"))
    times = sum(((F.col("bits") >= step).cast("bigint") for step in POISSON_STEPS), F.lit(0))
    return drawn.withColumn("bits", bits).select("replicate", "block", times.alias("times"))


def kappa_bootstrap(
    scores: DataFrame, keys: list[str], case: str = "case_id", replicates: int = 500, blocks: int = 128, seed: int = 7
) -> DataFrame:
    """Block bootstrap interval of kappa per key.

    Cases fall into fixed blocks by the hash of their id, all rows of a case into
    the same one. The data is read once into four counts per key and block; a
    replicate weighs the blocks with Poisson draws that follow from the hash of
    replicate and block, so the interval is the same wherever it is computed.
    """
    counts = agreement_counts(
        scores.withColumn("block", F.pmod(hash_bits(F.col(case).cast("string")), F.lit(blocks))), [*keys, "block"])
    names = ("n", "agreed", "human_ones", "judge_ones")
    weights = bootstrap_weights(scores.sparkSession, replicates, blocks, seed)
    drawn = counts.join(weights, "block").groupBy(*keys, "replicate").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in names])
    value = kappa(*map(F.col, names))
    spread = drawn.withColumn("kappa", value).groupBy(*keys).agg(
        F.percentile("kappa", 0.025).alias("low"), F.percentile("kappa", 0.975).alias("high"))  # one number per replicate
    point = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names]).select(*keys, value.alias("kappa"))
    return null_safe_join(point, spread, keys, "inner").withColumn(
        "conclusive", (F.col("low") >= KAPPA_BAR) | (F.col("high") < KAPPA_BAR)).select(*keys, "kappa", "low", "high", "conclusive")
