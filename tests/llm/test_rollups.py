"""Sharded Lloyd, token counts and the conversation trie against brute force, the library and their SQL forms."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from evalspark.llm import lloyd, merging, prefix_trie, queries, token_counts
from tests.llm.conftest import SF_DIR, edge_texts

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, block int, cells string"
TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, key string, path string, words int"


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op11_lloyd_clusters", "op13_conversation_trie"])
def test_registered_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = connection.execute(queries.CHECKS[name])
    columns = [d[0] for d in result.description]
    ours = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(ours.columns) == sorted(columns)
    assert sorted_rows(ours.select(*columns).collect()) == sorted_rows(result.fetchall())


def clusters_by_hand(rows, dims, k, rounds):
    held = [(i, [min(max(math.floor(256 * float(x)), -lloyd.BOUND), lloyd.BOUND) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(held, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in held]

    for _ in range(rounds):
        found = nearest()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(held, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = nearest()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, d, sum(x for x, y in found if y == j), sum(x for x, _ in found), digest[j]) for (i, _), (d, j) in zip(held, found)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], VECTORS)


def test_clusters_by_hand(spark):
    pick = random.Random(4)
    some = [[pick.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(some)]
    rows += [(900 + k, rows[7][1]) for k in range(70)] + [rows[3]] * 3  # a frequent vector, repeated rows
    rows += [(None, [1.0, 0.0, 0.5, -0.25, 0.125]), (2001, [1e30, -1e30, 0.0, 1.0, 2.0]), (2002, [-0.0] * 5), (2003, [1e-9, -1e-9, 0.0, 0.0, 0.0])]
    left_out = [(3000, None), (3001, []), (3002, [1.0] * 4), (3003, [1.0, None, 1.0, 1.0, 1.0]),
                (3004, [float("nan")] * 5), (3005, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    frame = vectors(spark, rows + left_out).repartition(4)
    # ties in the first centroids, empty clusters, blocks of unequal width, chunks that end inside a batch
    for k, width, chunk in ((9, 2, 16), (3, 5, 4096), (140, 3, 50)):
        want = clusters_by_hand(rows, 5, k, 3)
        got = lloyd.clusters(frame, 5, k, 3, width=width, chunk_rows=chunk)
        assert sorted_rows(got.collect()) == sorted_rows(want)


def test_clusters_of_few_or_no_vectors(spark):
    assert lloyd.clusters(vectors(spark, []), 5, 4, 2).count() == 0
    assert lloyd.clusters(vectors(spark, [(1, None)]), 5, 4, 2).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert sorted_rows(lloyd.clusters(vectors(spark, rows), 2, 4, 2).collect()) == sorted_rows(clusters_by_hand(rows, 2, 4, 2))


def test_inertia_beyond_64_bits_is_null(spark):
    rows = [(k, [(-1.0) ** k * 1e30] * 64) for k in range(40)]
    got = lloyd.clusters(vectors(spark, rows), 64, 1, 1).collect()
    assert len(got) == 40 and {r["inertia"] for r in got} == {None} and min(r["distance"] for r in got) > 1 << 59


def test_packed_integers_keep_their_values():
    for most in (0, 1, 127, 128, 40_000, 1 << 40, (1 << 62) - 1):
        values = np.array([0, most, -most, most // 3, -1])
        assert (lloyd._unpacked(lloyd._packed(values)) == values).all()
    assert len(lloyd._packed(np.zeros(10, np.int64))) == 11 and lloyd._unpacked(lloyd._packed(np.zeros(0, np.int64))).size == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))


def hard_texts(library):
    pick = random.Random(9)
    pieces = [library.id_to_piece(k) for k in range(3, library.get_piece_size())]
    out = [*edge_texts(), "<s>a</s><unk><0x0A>", "\0a\0", "▁", "a▁b", " ", "   " * 9, "a" * 3000, "the" * 2000, "thethe and ing " * 300,
           "=-" * 500, "x" * 70 + " " * 5000 + "y", "ing" * 999, "\r\n\t\x85\xa0", "ＡＢﬁ́é", "😀日本🏳️‍🌈", "ab" * 3000]
    for _ in range(1500):
        out.append("".join(pick.choice(pieces).replace("▁", pick.choice([" ", "▁", ""])) for _ in range(pick.randint(1, 30))))
    for letters in ("thend ig", "aeinost", " ▁", "=-_*"):
        out += ["".join(pick.choice(letters) for _ in range(pick.randint(1, 150))) for _ in range(250)]
    for _ in range(200):
        planes = (pick.randint(0, 0x2FF), pick.randint(0x4E00, 0x4FFF), pick.randint(0x1F300, 0x1F700))
        out.append("".join(chr(pick.choice(planes)) for _ in range(pick.randint(0, 40))))
    return out


def test_token_counts_are_the_library_s(library):
    some = hard_texts(library)
    table = token_counts.MergeTable(queries.vocabulary("piece_bpe_32k.model"))
    got = table.count(pa.array(some, pa.string())).tolist()
    assert got == [len(library.encode(t or "", num_threads=1)) for t in some]


@pytest.mark.parametrize("patience", [-1, 10**9])
def test_both_ways_of_joining_agree(library, patience, monkeypatch):
    """One by one from the first round on, and never."""
    some = [t for t in hard_texts(library) if t and len(t) < 700][:900]
    monkeypatch.setattr(merging, "PATIENCE", patience)
    table = token_counts.MergeTable(queries.vocabulary("piece_bpe_32k.model"))
    assert table.count(pa.array(some, pa.string())).tolist() == [len(library.encode(t, num_threads=1)) for t in some]


def test_long_run_of_blanks_is_not_quadratic(library):
    text = "a" + " " * 300_000 + "b"
    table = token_counts.MergeTable(queries.vocabulary("piece_bpe_32k.model"))
    assert table.count(pa.array([text]))[0] == len(library.encode(text))


def test_token_counts_of_a_table(spark, docs, corpus, nothing, library):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = token_counts.token_counts(docs, path).collect()
    want = []
    for doc, text, *_ in corpus:
        n = len(library.encode(text or "", num_threads=1))
        want.append((doc, len((text or "").encode()), n, n > 4096))
    assert sorted_rows(got) == sorted_rows(want) and any(r[3] for r in want)
    assert token_counts.token_counts(nothing, path).count() == 0
    registered = queries.QUERIES["op12_token_counts"](spark, SF_DIR)
    assert registered.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted_rows(registered.collect()) == sorted_rows(w for w in want if w[0] < 100_000)


def trie_by_hand(rows):
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = own.get(c - c % 20, [])[:h] + v[h:]
    nodes: dict = {}
    for c, v in new.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children: dict = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    below: dict = {}
    for node in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves, saved = (0 if node in children else 1), (len(nodes[node]) - 1) * words
        for child in children.get(node, []):
            leaves, saved = leaves + below[child][0], saved + below[child][1]
        below[node] = (leaves, saved)
    out = []
    for node, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(new[c]) == len(node))))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children.get(node, [])),
                    *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], TURNS)


def random_turns(seed):
    pick = random.Random(seed)
    rows = [(c, None if pick.random() < 0.1 else pick.randint(0, 9000), pick.choice(["user", "a", None]), pick.choice(["x y", "z", None, ""]))
            for c in range(-30, 90) if c != 40 for _ in range(pick.randint(1, 20))]
    rows += [(c, t, "user", "x  y\n") for c, n in ((0, 60), (20, 60), (7, 75)) for t in range(n)]  # deep and shared
    rows += [rows[0]] * 3 + [(5, 1, "user", "same")] * 4 + [(None, 1, "user", "nobody's"), (300, None, None, None)]
    return rows + [(c, 1, "user", "hello there") for c in range(1000, 3500)]  # a third and more share a turn and end there


@pytest.mark.parametrize("height", [2, 3, 4, 100])
def test_trie_by_hand(spark, height):
    rows = random_turns(1)
    got = prefix_trie.prefix_trie(turns(spark, rows).repartition(5), height)
    assert sorted_rows(got.collect()) == sorted_rows(trie_by_hand(rows))


def test_turnless_and_empty_tables(spark):
    assert prefix_trie.prefix_trie(turns(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turns(spark, [(None, 1, "a", "b")])).count() == 0
    one = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(one, 0, "user", "dropped, and no base to take from")]  # turnless after the rebuild
    got = prefix_trie.prefix_trie(turns(spark, rows)).collect()
    assert sorted_rows(got) == sorted_rows(trie_by_hand(rows)) and len(got) == 1
