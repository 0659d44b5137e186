"""The run ledger on storage: Parquet data and numbered commit files.

An append writes its rows first and then claims the next version by creating that
version's commit file, which fails where the file exists. Whoever loses reads what
the winner recorded and tries again, so of two runs with one fingerprint only one
is recorded unless a run is forced. Data without a commit is never read. A crash
leaves such data, or an empty commit file, and nothing else.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER_SCHEMA = (
    "fingerprint string, agent_name string, run_id bigint, finished_at timestamp_ntz, report_path string, source_csv string, "
    "agent_hash string, corpus_hash string, judge_prompt_hash string"
)
COLUMNS = [c.split()[0] for c in LEDGER_SCHEMA.split(", ")]
COMMIT_SCHEMA = "version bigint, data string"


class LedgerConflict(RuntimeError):
    """A run with the same fingerprint is recorded already."""


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All recorded runs with the ``version`` that recorded them.

    A ledger that does not exist yet is empty, a file that cannot be read fails.
    """
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).option("mode", "FAILFAST").json(f"{path}/commits/*.json")
        data = spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", True).parquet(f"{path}/data")
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], f"{LEDGER_SCHEMA}, version bigint")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
    return data.withColumn("data", folder).join(commits, "data").select(*COLUMNS, "version")


def newest_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entry of every fingerprint that was recorded last."""
    ledger = read_ledger(spark, path)
    last = F.max(F.struct("version", "finished_at", "run_id", *[c for c in COLUMNS if c not in ("fingerprint", "finished_at", "run_id")]))
    return ledger.groupBy("fingerprint").agg(last.alias("_last")).select("fingerprint", "_last.*").select(*COLUMNS, "version")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with ``text``; False where it exists already."""
    place = urlparse(path)
    if place.scheme in ("", "file"):
        os.makedirs(os.path.dirname(place.path), exist_ok=True)
        try:
            handle = os.open(place.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(text)
        return True
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = system.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _next_version(spark: SparkSession, path: str) -> int:
    """One past the highest version whose commit file exists, readable or not."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 1
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0) + 1


def _refuse(found: DataFrame, what: str) -> None:
    some = [r["fingerprint"] for r in found.select("fingerprint").limit(3).collect()]
    if some:
        raise LedgerConflict(f"{what}: {', '.join(some)}")


def append_runs(runs: DataFrame, path: str, force: bool = False) -> int:
    """Record ``runs`` and return the version. ``force`` records over earlier entries of the same fingerprint.

    All runs are recorded or, on a conflict, none. Two runs of one fingerprint in
    ``runs`` are a conflict too, forced or not.
    """
    spark, data = runs.sparkSession, uuid.uuid4().hex
    runs.select(*COLUMNS).write.parquet(f"{path}/data/{data}")
    mine = spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/data/{data}")
    _refuse(mine.groupBy("fingerprint").count().filter("count > 1"), "more than one run of a fingerprint")
    while True:
        version = _next_version(spark, path)
        if not force:
            _refuse(mine.join(read_ledger(spark, path).select("fingerprint"), "fingerprint", "left_semi"), "already recorded")
        if create_once(spark, f"{path}/commits/{version:012d}.json", json.dumps({"version": version, "data": data})):
            return version
