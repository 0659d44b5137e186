from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
# columns whose names the operators use themselves
EXTRA = ["n_words", "row", "part", "source_text", "marks", "lost", "hits", "label", "start", "block", "slot"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA],
])


def frame(spark, rows):
    """(doc_id, text[, lang[, source]]) with clashing extra columns."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), *["x"] * len(EXTRA)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_texts():
    """Empty, blank, very long, tied and repeated texts, unusual characters."""
    pick = random.Random(3)
    words = ["Der", "the", "of", "Ärger", "x1", "naïve", "日本", "don't", "A-B", "été,", "§", "***"]
    some = [" ".join(pick.choice(words) for _ in range(pick.randint(0, 60))) for _ in range(30)]
    long = " ".join(pick.choice(words) + str(pick.randint(0, 400)) for _ in range(30_000))
    passage = " ".join(f"w{k}" for k in range(45))
    return [None, "", " ", "\n\n", "\x0b\x0c", "one", "the the the the the the the the the " * 20, long, *some, some[0], some[0], some[1].upper(),
            passage, f"before {passage} after", f"{passage} {passage}", "a b 　c 😀 d\u0085e", "Und " * 400, "word " * 19 + "word"]


@pytest.fixture(scope="session")
def given(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def corpus(given):
    edges = [(100_000 + k, t, (None, "en", "xx")[k % 3], (None, "src0", "src1", "odd")[k % 4]) for k, t in enumerate(edge_texts())]
    return given + edges


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
