"""The registered queries, each with the SQL that checks it.

Every query reads the given tables in full. ``@query`` stores the function
under its name; ``check`` is the same result in plain SQL, with ``{view}``
placeholders for the derived tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalspark.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Access to given tables and derived views by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.known)


def query(name: str, check: str | None = None):
    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_views(check)
        return function

    return register


def load() -> None:
    from evalspark.catalog import (  # noqa: F401
        calibration, cases, corpus, golden, judging, ledger, measures, reports, results, scorecards,
    )
