"""The read-only guard runs nothing that writes."""

from __future__ import annotations

import pytest

from evalspark.sources import sql_runner
from evalspark.sources.sql_runner import QueryRefused, execute_texts, guarded, run_query

WRITES = (
    "WITH t AS (SELECT 'x' AS a) FROM t INSERT INTO guard_target SELECT a",
    "WITH t AS (SELECT '/*' AS a) INSERT INTO guard_target SELECT concat(a,'*/') FROM t",
    "WITH t AS (SELECT 'x' AS a) FROM t INSERT INTO guard_target SELECT a INSERT INTO guard_target SELECT a",
    "CREATE TABLE guard_other AS SELECT 1 AS a", "TRUNCATE TABLE guard_target", "SHOW TABLES", "SELECT 1; SELECT 2", "SELEC 1",
)


def test_writes_are_refused(spark, tmp_path):
    spark.sql(f"CREATE TABLE guard_target (a STRING) USING parquet LOCATION '{tmp_path}/guard'")
    try:
        for sql in WRITES:
            with pytest.raises(QueryRefused):
                guarded(spark, sql)
        assert spark.table("guard_target").count() == 0 and not spark.catalog.tableExists("guard_other")
    finally:
        spark.sql("DROP TABLE guard_target")


def test_limits_are_off_unless_asked_for(spark):
    sql = "WITH t AS (SELECT explode(sequence(1, 20000)) AS a) SELECT a FROM t WHERE EXISTS (SELECT 1)"
    assert run_query(spark, sql)[1].row_count == 20_000
    with pytest.raises(QueryRefused, match="row cap"):
        run_query(spark, sql, row_cap=10_000)


def test_a_table_of_texts(spark, tmp_path, monkeypatch):
    """More texts than are in hand at a time, statistics in several batches, every kind of end."""
    monkeypatch.setattr(sql_runner, "BATCH", 7)
    kinds = ["SELECT explode(sequence(1, {k})) AS a", "SELECT 1 AS a WHERE false", "DROP TABLE t", "SELECT nothing FROM nowhere",
             "SELECT 1 AS a, 2 AS a", "SELECT raise_error('late') AS a", "SELECT explode(sequence(1, 60)) AS a", None]
    texts = [(k, f"n{k}", kinds[k % 8] and kinds[k % 8].format(k=k + 1)) for k in range(40)]
    frame = spark.createDataFrame(texts, "k int, name string, sql string").repartition(6)
    rows, stats = execute_texts(frame, str(tmp_path / "run"), width=3, row_cap=50)
    got = {r["k"]: r for r in stats.collect()}
    assert sorted(got) == list(range(40)) and stats.count() == 40
    for k, name, _ in texts:
        r, kind = got[k], k % 8
        assert r["name"] == name and (r["error"] is None) == (kind in (0, 1))
        if kind in (0, 1):
            assert (r["n_rows"], r["cols"]) == ((k + 1) * (kind == 0), ["a"])
    assert got[6]["error"] == "returned more than 50 rows — exceeds 50 row cap" and got[5]["error"].startswith("execution failed")
    assert got[7]["error"] == "empty SQL" and got[4]["error"].startswith("duplicate column")
    counts = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    assert counts == {k: k + 1 for k in range(0, 40, 8)}


def test_no_text_leaves_a_result(spark, tmp_path):
    rows, stats = execute_texts(spark.createDataFrame([(1, "DROP TABLE x")], "k int, sql string"), str(tmp_path / "a"))
    assert rows.count() == 0 and stats.count() == 1 and rows.columns == ["cells", "k"]
    rows, stats = execute_texts(spark.createDataFrame([], "k int, sql string"), str(tmp_path / "b"))
    assert rows.count() == 0 and stats.count() == 0
