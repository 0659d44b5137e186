"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm import (
    checks, decontamination, license_scan, lloyd, lm_scoring, ngram_join, prefix_trie, quality_classifier, quality_rules, secret_scan,
    source_mixing, substring_dedup, token_counts, token_files,
)
from evalspark.llm.tables import table
from evalspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = dict(checks.CHECKS)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.licenses(table(spark, sf_dir, "documents")).drop("detections")


@query
def op2_secret_scan(spark, sf_dir):
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[secret_scan.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.repeat_digests(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark, sf_dir):
    return quality_rules.quality(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))


@query
def op7_lm_scoring(spark, sf_dir):
    found = lm_scoring.backoff_scores(table(spark, sf_dir, "documents"))
    # sums of doubles depend on their order in the last digits
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


@query
def op8_token_files(spark, sf_dir):
    return token_files.encode_table(
        table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), vocabulary("byte_bpe_50k.json"))


@query
def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_source_mixing(spark, sf_dir):
    return source_mixing.mixed(table(spark, sf_dir, "documents"))


@query
def op11_lloyd_clusters(spark, sf_dir):
    return lloyd.clusters(table(spark, sf_dir, "embeddings"), dims=64, k=40, rounds=5)


@query
def op12_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op13_conversation_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
