"""Given tables, written intermediate tables, and small column helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.session import durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` below the shared folder and go on from the written table.

    The lineage ends there, so a lost executor costs the current step only, and
    a table that several steps need is computed once.
    """
    return durable(frame)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, ``text`` and the named columns; all other columns are left behind at the scan.

    A null text reads as empty.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)
