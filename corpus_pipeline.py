"""The corpus pipeline: documents in, token files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm import decontamination, ngram_join, quality_rules, source_mixing, token_files
from evalspark.llm.queries import vocabulary
from evalspark.llm.tables import cut, table
from evalspark.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.keep_good(docs, vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    return ngram_join.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves the sources by target weight."""
    return source_mixing.interleave(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mixed files; returns their index.

    The order is where the stage before left each row: file name, then row.
    """
    placed = docs.select(
        "doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return token_files.encode_table(
        placed, scratch_path(spark, "tokens"), vocabulary("byte_bpe_50k.json"), order=[F.col("_file"), F.col("_row")])


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Tokenisers and MinHash have no SQL form; tests/llm/test_pipeline.py states the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
