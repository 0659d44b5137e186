"""Corpus and submission CSV files.

The files have quoted fields that span lines, so a file is one read task and the
parallelism is over files. Columns are found by name in every file, so files of
one folder may order them differently and carry extra ones. Line breaks inside a
field are read as ``\\n``, whatever the file uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from evalspark.constants import GOLDEN_OPTIONAL, GOLDEN_REQUIRED, SUBMISSION_REQUIRED

FILE_ROWS = 1 << 33  # the numbers of rows of one file stay below, as Spark numbers the rows of a task
CSV_OPTIONS = {
    "header": False, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
WRITE_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _header_width(spark: SparkSession, paths: str | list[str]) -> int:
    """The most columns any header of the files may have: the commas of its first line, plus one.

    Names do not span lines. Cells beyond the header have no name and are not read.
    """
    lines = spark.read.text(paths).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.regexp_count("value", F.lit(",")).alias("commas"),
    )
    first = lines.groupBy("path").agg(F.min_by("commas", F.struct("block", "line")).alias("commas"))
    return (first.agg(F.max("commas")).first()[0] or 0) + 1


def _raw_cells(spark: SparkSession, paths: str | list[str], partitions: list[str]) -> DataFrame:
    """Every record as ``cells``, with its ``path`` and a number that ascends within the file."""
    names = [f"_c{i}" for i in range(_header_width(spark, paths))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    read = spark.read.schema(schema).options(**CSV_OPTIONS).csv(paths)
    return read.select(
        F.array(*names).alias("cells"), F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("_row"), *[F.col(p) for p in partitions],
    )


def read_named_csv(
    spark: SparkSession,
    paths: str | list[str],
    required: tuple[str, ...],
    optional: tuple[str, ...] = (),
    partitions: list[str] | None = None,
) -> DataFrame:
    """Rows of CSV files with named columns, as text, with their ``path`` and ``case_pos``.

    The first record of a file is its header, and only that one; of equal names
    the last counts. A column is null where the file does not have it. A file
    that lacks a required column fails the query that reads it. ``case_pos``
    ascends with the path and the row in the file.
    """
    partitions = partitions or []
    raw = _raw_cells(spark, paths, partitions)
    wanted = F.array(*[F.lit(c) for c in required])
    # a file is one task, so its rows are numbered in order
    headers = raw.groupBy("path").agg(F.min_by("cells", "_row").alias("names"), F.min("_row").alias("_head"))
    missing = F.array_except(wanted, "names")
    problem = F.concat("path", F.lit(": missing required columns ["), F.array_join(missing, ", "), F.lit("]"))
    checked = headers.select(
        "path", "_head", F.row_number().over(Window.orderBy("path")).cast("bigint").alias("_file"),  # one row per file
        F.when(F.size(missing) > 0, F.raise_error(problem).cast("array<string>")).otherwise(F.col("names")).alias("names"),
    )
    body = raw.join(checked, "path").filter(F.col("_row") > F.col("_head"))

    def cell(name: str) -> Column:
        at = F.size("names") + 1 - F.array_position(F.reverse("names"), name)
        known = F.array_contains(F.transform("names", lambda n: F.coalesce(n, F.lit(""))), name)
        return F.when(known, F.try_element_at("cells", at.cast("int"))).alias(name)

    place = (F.col("_file") * FILE_ROWS + F.col("_row") - F.col("_head")).alias("case_pos")
    return body.select(*[cell(c) for c in (*required, *optional)], "path", place, *partitions)


def empty_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files without any content (and so without a header), from the listing alone."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(paths)
    plain = F.regexp_replace("path", "^file:/+", "file:/").alias("path")
    listed = spark.createDataFrame([(path,) for path in listing.inputFiles()], "path string").select(plain)
    filled = listing.select("path", "length").filter(F.col("length") > 0).select(plain)  # skips empty files itself
    return listed.join(filled, "path", "left_anti")


def read_golden(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Golden corpus as text columns, one row per case, drafts included."""
    return read_named_csv(spark, paths, GOLDEN_REQUIRED, GOLDEN_OPTIONAL)


def agent_from_path(path: Column) -> Column:
    """The agent is named by the file: its stem without the usual affixes."""
    stem = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    return F.replace(F.replace(stem, F.lit("_input"), F.lit("")), F.lit("example_"), F.lit(""))


def read_submissions(spark: SparkSession, paths: str | list[str], agent_partition: str | None = None) -> DataFrame:
    """Submissions of many agents. The agent is a partition folder or the file name."""
    partitions = [agent_partition] if agent_partition else []
    rows = read_named_csv(spark, paths, SUBMISSION_REQUIRED, partitions=partitions)
    agent = F.col(agent_partition).cast("string") if agent_partition else agent_from_path(F.col("path"))
    return rows.select(agent.alias("agent_name"), *SUBMISSION_REQUIRED, "path", "case_pos")


def write_csv(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = frame.write.options(**WRITE_OPTIONS)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def parse_result_csv(frame: DataFrame, text: str, schema: str, keep: list[str]) -> DataFrame:
    """Inline CSV text (header record first) to typed rows, numbered from 0.

    A line break ends a record where the quotes before it are even, so quoted
    fields may hold line breaks; breaks may be LF or CRLF, and empty lines are no
    records. Only a text that holds a quote is split quote by quote.
    """
    # pieces between quotes alternate: outside, inside, outside, ...; breaks count outside only
    pieces = F.split(text, '"')
    ends = F.transform(pieces, lambda piece, k: F.when(k % 2 == 0, F.regexp_replace(piece, r"\r?\n", "\u0000")).otherwise(piece))
    plain, quoted = F.split(text, r"\r?\n"), F.split(F.array_join(ends, '"'), "\u0000")
    records = F.filter(F.when(F.contains(text, F.lit('"')), quoted).otherwise(plain), lambda record: record != "")
    numbered = frame.select(*keep, F.posexplode(F.slice(records, F.lit(2), F.greatest(F.size(records), F.lit(0)))).alias("pos", "_record"))
    parsed = F.from_csv("_record", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\u0000"})
    return numbered.select(*keep, F.col("pos").cast("bigint").alias("pos"), parsed.alias("_row")).select(
        *keep, "pos", "_row.*"
    )


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Report files as (path, body), for the calibration history."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
