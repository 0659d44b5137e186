"""The stored ledger: versions, conflicts, crashes."""

from __future__ import annotations

import datetime
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from evalspark.sources import ledger_store
from evalspark.sources.ledger_store import LEDGER_SCHEMA, LedgerConflict, append_runs, create_once, newest_entries, read_ledger


def runs(spark, *prints, run=1):
    day = datetime.datetime(2024, 1, run)
    return spark.createDataFrame([(p, "a", run, day, f"r{run}.md", "in.csv", "h", "c", "j") for p in prints], LEDGER_SCHEMA)


def held(spark, path):
    return sorted((r["fingerprint"], r["run_id"], r["version"]) for r in newest_entries(spark, path).collect())


def test_append_refuse_and_force(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert read_ledger(spark, path).count() == 0
    assert append_runs(runs(spark, "a", "b"), path) == 1
    with pytest.raises(LedgerConflict, match="already recorded: b"):
        append_runs(runs(spark, "b", "c", run=2), path)
    with pytest.raises(LedgerConflict, match="more than one run"):
        append_runs(runs(spark, "d", "d"), path, force=True)
    assert held(spark, path) == [("a", 1, 1), ("b", 1, 1)]  # all of an append or nothing
    assert append_runs(runs(spark, "b", "c", run=2), path, force=True) == 2
    assert held(spark, path) == [("a", 1, 1), ("b", 2, 2), ("c", 2, 2)] and read_ledger(spark, path).count() == 4
    # recorded last counts, not finished last
    append_runs(runs(spark, "b", run=1), path, force=True)
    assert held(spark, path)[1] == ("b", 1, 3)
    assert {r["source_csv"] for r in read_ledger(spark, path).collect()} == {"in.csv"}


def test_side_by_side_only_one_is_recorded(spark, tmp_path):
    path = str(tmp_path / "ledger")

    def record(k):
        try:
            return append_runs(runs(spark, "same", f"own{k}", run=k + 1), path)
        except LedgerConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(record, range(4)))
    assert sorted(v for v in versions if v) == [1]
    assert len(held(spark, path)) == 2


def test_the_loser_of_a_version_looks_again(spark, tmp_path, monkeypatch):
    path, armed = str(tmp_path / "ledger"), [False]

    def late(spark_, target, text):
        if armed[0]:  # another run claims this version first
            armed[0] = False
            append_runs(runs(spark, "x", run=5), path, force=True)
        return create_once(spark_, target, text)

    monkeypatch.setattr(ledger_store, "create_once", late)
    armed[0] = True
    assert append_runs(runs(spark, "y"), path) == 2
    armed[0] = True
    with pytest.raises(LedgerConflict):
        append_runs(runs(spark, "x"), path)
    armed[0] = True
    assert append_runs(runs(spark, "z"), path) == 4
    assert held(spark, path) == [("x", 5, 3), ("y", 1, 2), ("z", 1, 4)]


def test_data_without_commit_is_not_read(spark, tmp_path):
    path = str(tmp_path / "ledger")
    append_runs(runs(spark, "a"), path)
    runs(spark, "lost").write.parquet(f"{path}/data/{'0' * 32}")
    with open(f"{path}/commits/000000000002.json", "w"):
        pass  # the writer ended before it wrote
    assert held(spark, path) == [("a", 1, 1)]
    assert append_runs(runs(spark, "lost", run=2), path) == 3
    assert not create_once(spark, f"{path}/commits/000000000003.json", "{}")
    assert os.path.getsize(f"{path}/commits/000000000003.json") > 2
