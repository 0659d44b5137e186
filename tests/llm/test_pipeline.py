"""The pipeline's stages against what the operators say, and against brute force."""

from __future__ import annotations

import corpus_pipeline
from evalspark.llm.tables import cut, table
from tests.llm.conftest import SF_DIR
from tests.llm.test_documents import classes_by_hand
from tests.llm.test_scans import leaks_by_hand


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF_DIR))
        out.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(rows[r["doc_id"]] == r for r in docs.collect())
    ids = [[r["doc_id"] for r in x.collect()] for x in out]
    good = [(d, rows[d]["text"]) for d in ids[0]]
    assert sorted(ids[1]) == sorted({c for c, _ in classes_by_hand(good).values()})
    items = [(r["item_id"], r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]
    leaks = leaks_by_hand([(d, rows[d]["text"]) for d in ids[1]], items)
    assert sorted(ids[2]) == sorted(d for d, x in leaks.items() if not x[1]) and len(ids[2]) < len(ids[1])
    assert sorted(ids[3]) == sorted(ids[2]) == sorted(ids[4])
    starts = {r["doc_id"]: r["start"] for r in out[4].collect()}
    placed = out[3].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r["doc_id"] for r in sorted(placed, key=lambda r: (r["file_name"], r["row_index"]))] == sorted(starts, key=starts.get)
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(ids[4])
