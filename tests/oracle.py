"""Run a registered query and its SQL check side by side."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from evalspark import catalog
from evalspark.plans.fixtures import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (decimal.Decimal, float)):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


FAMILY = {
    "HUGEINT": "hugeint", "BIGINT": "int", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "text",
    "BOOLEAN": "bool", "TIMESTAMP": "timestamp", "DATE": "date",
    "bigint": "int", "int": "int", "double": "double", "string": "text", "boolean": "bool",
    "timestamp_ntz": "timestamp", "date": "date",
}


def compare(spark, connection, name: str, sf_dir: str) -> str:
    """Empty text when both agree, otherwise what differs."""
    frame = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    if name not in catalog.CHECKS:
        return "" if ours else "no rows"
    result = connection.execute(catalog.CHECKS[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    types = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in result.description}
    for field in frame.schema.fields:
        spark_family = FAMILY.get(field.dataType.simpleString(), field.dataType.simpleString())
        if spark_family != types[field.name]:
            return f"type of {field.name}: {spark_family} against {types[field.name]}"
    index = [names.index(c) for c in columns]
    theirs = [tuple(plain(row[i]) for i in index) for row in result.fetchall()]
    if not ours:
        return "no rows" if theirs else ""
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    ours.sort(key=key)
    theirs.sort(key=key)
    if ours != theirs:
        sample = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        return f"rows {len(ours)} against {len(theirs)}; {columns}; first: {str(sample)[:1500]}"
    return ""


def main() -> None:
    from evalspark.session import local_session

    catalog.load()
    sf_dir = sys.argv[1]
    chosen = sys.argv[2:] or list(catalog.QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name in chosen:
        begin = time.time()
        try:
            problem = compare(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += bool(problem)
        checked = "checked" if name in catalog.CHECKS else "rows only"
        print(f"{name:28s} {time.time() - begin:6.2f}s {checked:9s} {problem or 'ok'}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")


if __name__ == "__main__":
    main()
