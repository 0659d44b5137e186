"""Run golden and agent SQL texts as guarded read queries.

The texts differ, so every one is its own Spark query. A bounded pool of threads
submits them from a streamed table of texts, each in a job group of its own;
results and statistics go to files as the queries end, so the driver holds the
texts in flight and a bounded batch of statistics, whatever the number of cases.
All comparing and scoring is then done for every case in one plan.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F, types as T

from evalspark.functions.encode import encode_rows
from evalspark.functions.text import read_only_reason


class QueryRefused(RuntimeError):
    """The SQL text failed a guardrail or could not be run."""


@dataclass
class QueryStats:
    bytes_scanned: int
    duration_ms: float
    row_count: int


def input_bytes(frame: DataFrame) -> int:
    """Size of the files a query reads, from their listing alone."""
    files = frame.inputFiles()
    if not files:
        return 0
    listed = frame.sparkSession.read.format("binaryFile").load(files).select("length")
    return listed.agg(F.sum("length")).first()[0]


WRITING = ("Command", "ParsedStatement")  # what a plan that does more than read consists of


def writes(spark: SparkSession, sql: str) -> bool:
    """Whether the session's own parser finds a command or a write anywhere in the text; nothing runs."""
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    kinds = [spark._jvm.java.lang.Class.forName(f"{logical}.{name}") for name in WRITING]
    open_ = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while open_:
        node = open_.pop()
        if any(kind.isInstance(node) for kind in kinds):
            return True
        for below in (node.children(), node.innerChildren()):
            open_ += [below.apply(i) for i in range(below.size())]
    return False


def guarded(spark: SparkSession, sql: str, max_bytes: int | None = None, linted: bool = False) -> tuple[DataFrame, int]:
    """The query as a DataFrame with its input size, or the reason it is refused.

    The text lint comes first, unless the text has passed it already; since it
    knows no string literals, the parsed plan decides. ``max_bytes`` refuses
    larger inputs; None sets no limit.
    """
    reason = None if linted else spark.range(1).select(read_only_reason(F.lit(sql))).first()[0]
    if reason:
        raise QueryRefused(reason)
    try:
        if writes(spark, sql.strip().rstrip(";")):
            raise QueryRefused("only read queries are allowed")
        frame = spark.sql(sql.strip().rstrip(";"))
    except PySparkException as error:
        raise QueryRefused(f"dry-run failed: {error.getCondition() or error}") from error
    size = input_bytes(frame)
    if max_bytes is not None and size > max_bytes:
        raise QueryRefused(f"would scan {size / 1e9:.2f} GB — exceeds {max_bytes / 1e9:.0f} GB ceiling")
    return frame, size


def run_query(
    spark: SparkSession, sql: str, max_bytes: int | None = None, row_cap: int | None = None
) -> tuple[DataFrame, QueryStats]:
    """Guarded query and its statistics. With a row cap, the count stops one row past it."""
    frame, size = guarded(spark, sql, max_bytes)
    begin = time.monotonic()
    try:
        rows = (frame if row_cap is None else frame.limit(row_cap + 1)).count()
    except PySparkException as error:
        raise QueryRefused(f"execution failed: {error.getCondition() or error}") from error
    if row_cap is not None and rows > row_cap:
        raise QueryRefused(f"returned more than {row_cap:,} rows — exceeds {row_cap:,} row cap")
    return frame, QueryStats(size, (time.monotonic() - begin) * 1000, rows)


CELLS_SCHEMA = "cells array<struct<missing:int,num:double,txt:string,kind:string>>"
STATS_COLUMNS = "cols array<string>, bytes bigint, duration_ms double, n_rows bigint, error string"
BATCH = 500  # statistics on the driver before they are written


def store_result(
    spark: SparkSession, sql: str, tags: Row, path: str, row_cap: int | None = None, max_bytes: int | None = None
) -> tuple[list[str], QueryStats]:
    """Run a linted query once and write its encoded rows, tagged, to the new folder ``path``.

    The rows are counted while they are written; with a row cap, writing stops
    one row past it and the result is refused.
    """
    frame, size = guarded(spark, sql, max_bytes, linted=True)
    if len(set(frame.columns)) != len(frame.columns):
        raise QueryRefused(f"duplicate column names: {frame.columns}")
    seen = Observation()
    held = frame if row_cap is None else frame.limit(row_cap + 1)
    rows = encode_rows(held).withColumns({k: F.lit(v) for k, v in tags.asDict().items()})
    begin = time.monotonic()
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    except PySparkException as error:
        raise QueryRefused(f"execution failed: {error.getCondition() or error}") from error
    duration = (time.monotonic() - begin) * 1000
    count = seen.get["rows"]
    if row_cap is not None and count > row_cap:
        raise QueryRefused(f"returned more than {row_cap:,} rows — exceeds {row_cap:,} row cap")
    return frame.columns, QueryStats(size, duration, count)


def _submitted(pool: ThreadPoolExecutor, width: int, work, rows: Iterator[Row]) -> Iterator[tuple]:
    """The results of ``work`` over ``rows`` as they come in, with at most twice ``width`` rows in hand."""
    pending: set[Future] = set()
    for row in rows:
        pending.add(pool.submit(work, row))
        if len(pending) >= 2 * width:
            done, pending = wait(pending, return_when=FIRST_COMPLETED)
            yield from (f.result() for f in done)
    yield from (f.result() for f in pending)


def execute_texts(
    texts: DataFrame, path: str, width: int = 8, row_cap: int | None = None, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run the ``sql`` of every row of ``texts``; (encoded result rows, statistics) under ``path``, a new folder.

    The other columns of ``texts`` tag both tables. Texts are linted in the plan
    that streams them. A text that is refused or fails leaves its reason in the
    statistics and no row in the results. ``width`` queries run side by side.
    """
    spark = texts.sparkSession
    tags = T.StructType([f for f in texts.schema.fields if f.name != "sql"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tags)
    linted = texts.fillna("", ["sql"]).withColumn("_reason", read_only_reason(F.col("sql")))
    names = [f.name for f in tags]

    def work(row: Row) -> tuple:
        key = Row(**{n: row[n] for n in names})
        folder = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(f"evalspark-{folder}", ", ".join(str(v) for v in key), interruptOnCancel=True)
        try:
            if row["_reason"]:
                raise QueryRefused(row["_reason"])
            cols, stats = store_result(spark, row["sql"], key, f"{path}/rows/{folder}", row_cap, max_bytes)
        except QueryRefused as refused:
            return (*key, None, None, None, None, str(refused))
        return (*key, cols, stats.bytes_scanned, stats.duration_ms, stats.row_count, None)

    def save(batch: list[tuple]) -> None:
        spark.createDataFrame(batch, f"{kinds}, {STATS_COLUMNS}").coalesce(1).write.mode("append").parquet(f"{path}/stats")

    batch: list[tuple] = []
    with ThreadPoolExecutor(width) as pool:
        for found in _submitted(pool, width, work, linted.toLocalIterator(prefetchPartitions=True)):
            batch.append(found)
            if len(batch) == BATCH:
                save(batch)
                batch = []
    save(batch)
    stats = spark.read.schema(f"{kinds}, {STATS_COLUMNS}").parquet(f"{path}/stats")
    kept = stats.filter("error IS NULL").select(*names)  # a result over the cap is on disk, but not a result
    schema = f"{CELLS_SCHEMA}, {kinds}"
    if kept.isEmpty():
        return spark.createDataFrame([], schema), stats
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
    return rows.join(kept.hint("merge"), names, "left_semi") if row_cap is not None else rows, stats
