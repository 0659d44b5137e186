"""Near duplicates, passage removal, quality rules, scores, token files, classifier and mixing against brute force."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from evalspark.llm import lm_scoring, ngram_join, quality_classifier, quality_rules, source_mixing, substring_dedup, token_files
from evalspark.llm.components import components
from evalspark.llm.queries import vocabulary
from evalspark.llm.wavelet import WaveletMatrix
from evalspark.session import scratch_path
from tests.llm.conftest import SF_DIR, frame
from tests.llm.test_scans import words

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def sets_by_hand(rows):
    out = {}
    for doc, text, *_ in rows:
        w = words(text)
        out[doc] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4) if w else 0)}
    return out


def classes_by_hand(rows, similarity=0.8):
    sets = sets_by_hand(rows)
    by = collections.defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            by[x].append(doc)
    near = {tuple(sorted((a, b))) for some in by.values() for i, a in enumerate(some) for b in some[:i]}
    root, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in near:
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (find(d), links[d]) for d in sets}


def near_copies(seed, n, base_words, changes):
    pick = random.Random(seed)
    base = [f"b{pick.randint(0, 9999)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(pick.randint(0, changes)):
            w[pick.randrange(len(w))] = f"c{pick.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, corpus):
    rows = list(corpus) + [(200_000 + k, t) for k, t in enumerate(near_copies(1, 60, 120, 4))]
    rows += [(210_000 + k, t) for k, t in enumerate([rows[-1][1]] * 30 + ["a b", "A, b", "a b c"])]
    want = classes_by_hand(rows)
    for blocks in (512, 16):  # families in one unit, and cut into blocks
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(frame(spark, rows), block_texts=blocks).collect()}
        assert got == want
    kept = ngram_join.keep_one_of_each(frame(spark, rows + [(None, "null id")]))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for c, _ in want.values()})
    assert kept.columns == frame(spark, []).columns


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(similarity, 0.999)
        assert 1 - (1 - similarity**rows) ** bands >= 0.999 and bands * rows <= 96


def test_components(spark):
    pick = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, 900 + k) for k in range(40)] + [(pick.randint(2000, 2050), pick.randint(2000, 2050)) for _ in range(30)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges + [(5, 5), (None, 3)], "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in got.collect()} == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def repeats_by_hand(rows, size=20):
    first, removed = {}, {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = BLANK.findall(text or ""), set()
        for k in range(len(w) - size + 1):
            key = tuple(w[k: k + size])
            if key in first:
                gone |= set(range(k, k + size))
            else:
                first[key] = (doc, k)
        removed[doc] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return removed


def test_repeats(spark, corpus):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = list(corpus) + [(-5, passage)] + [(220_000 + k, f"x{k} y{k} {passage[: 100 + 7 * k]} z{k}") for k in range(30)]
    want = repeats_by_hand(rows)
    for hot in (50_000, 3):  # runs of windows, and single windows for frequent minimisers
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in
               substring_dedup.repeat_digests(frame(spark, rows), hot=hot).collect()}
        assert got == want
    kept = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.without_repeats(frame(spark, rows)).collect()}
    assert all(hashlib.sha256(kept[d]).hexdigest() == x[2] for d, x in want.items())


def test_repeats_of_repeated_rows(spark):
    """As many rows out as in: equal rows get the same result, different texts of one id count as documents of their own."""
    p, q = (" ".join(f"{c}{k}" for k in range(50)) for c in "pq")
    rows = [(1, p), (2, p), (2, p), (3, q), (3, q), (4, f"{p} {q}"), (5, f"new {q}"), (5, f"other {q} words"), (5, f"new {q}"), (6, None), (6, ""), (6, None)]
    got = substring_dedup.without_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = lambda d: sorted((r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in got if r["doc_id"] == d)
    assert text(1) == [(50, 0, p)] and text(2) == [(50, 50, "")] * 2 and text(3) == [(50, 0, q)] * 2 and text(4) == [(100, 100, "")]
    assert text(5) == [(51, 50, "new")] * 2 + [(52, 50, "other words")] and text(6) == [(0, 0, "")] * 3
    # nobody earlier: of two texts of one id one keeps the passage, its copies with it
    twins = [(7, f"a {p}"), (7, f"b {p}"), (7, f"a {p}")]
    again = substring_dedup.without_repeats(frame(spark, twins)).collect()
    assert len(again) == 3 and {r["n_removed"] for r in again} == {0, 50}
    assert len({(r["n_removed"], bytes(r["kept"])) for r in again}) == 2


def test_window_ranks():
    codes = np.random.default_rng(1).integers(0, 3, 500)
    for size in (1, 2, 5, 8):
        ranks = substring_dedup.window_ranks(codes, size)
        keys = [tuple(codes[k: k + size]) for k in range(500 - size + 1)]
        assert len(set(zip(ranks.tolist(), keys))) == len(set(keys)) == len(set(ranks.tolist()))


def base_by_hand(text):
    text = text or ""
    w = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k: k + 8]) for k in range(len(w) - 7)]
    times, hit = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if times[x] > 1:
            hit |= set(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality(spark, corpus):
    import base64

    import sentencepiece
    import tiktoken

    rows = list(corpus) + [(230_000, "a\n\na\n b\n b\nb\n \n \n"), (230_001, "a\r\na\r\n" * 30), (230_002, "日本語 " * 3 + "テスト" * 30), (230_003, "\U0001f600" * 200 + " x" * 30)]
    paths = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in quality_rules.quality(frame(spark, rows), *paths).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(paths[0], "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    for doc, text, *_ in rows:
        r, base = got[doc], base_by_hand(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base, doc
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r["base_failed"] and r["kept"])
        w = BLANK.findall(text or "")
        ids = [i for x in w for i in bpe.encode_ordinary(" " + x)]
        assert r["n_tokens"] == len(ids) and math.isclose(r["chars_per_token"], base[1] / max(1, len(ids)))
        times = collections.Counter(ids).values()
        assert math.isclose(r["token_entropy"], -sum(t / len(ids) * math.log2(t / len(ids)) for t in times) if ids else 0, abs_tol=1e-9)
        some = [i for x in w for i in pieces.encode(x)]
        assert math.isclose(r["byte_share"], sum(map(pieces.is_byte, some)) / max(1, len(some)), abs_tol=1e-12)
    kept = quality_rules.keep_good(frame(spark, rows), *paths)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]} and kept.columns == frame(spark, []).columns
    assert not got[230_003]["kept"] and quality_rules.quality(frame(spark, []), *paths).count() == 0


def test_quality_keeps_clean_documents(spark, given):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = quality_rules.quality(frame(spark, given), vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model")).collect()
    assert all(r["kept"] for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"])


def scores_by_hand(rows, most):
    texts = {}
    for doc, text, *_ in rows:
        texts.setdefault(doc, []).append(words(text))
    times = collections.Counter(w for some in texts.values() for t in some for w in t)
    top = sorted(times.values(), reverse=True)
    least = top[most] if len(top) > most else 0
    mapped = {d: [[w if times[w] > least else None for w in t] for t in some] for d, some in texts.items()}
    one = collections.Counter(w for some in mapped.values() for t in some for w in t)
    two = collections.Counter(p for some in mapped.values() for t in some for p in zip(t, t[1:]))
    n, out = sum(one.values()), {}
    for doc, some in mapped.items():
        own, total = collections.Counter(p for t in some for p in zip(t, t[1:])), 0.0
        for t in some:
            total += math.log(one[t[0]] / n) if t else 0
            for v, w in zip(t, t[1:]):
                left = two[v, w] - own[v, w]
                total += math.log(left / one[v]) if left > 0 else math.log(0.4 * one[w] / n)
        out[doc] = (sum(map(len, some)), total)
    return out


@pytest.mark.parametrize("most, part_words, frequent", [(65_535, 4_000_000, 512), (900, 5_000, 512), (900, 5_000, 20)])
def test_backoff_scores(spark, corpus, most, part_words, frequent):
    want = scores_by_hand(corpus, most)
    found = lm_scoring.backoff_scores(frame(spark, corpus), most, part_words, 10_000, frequent)
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for doc, (n, score) in want.items():
        assert got[doc][0] == n and math.isclose(got[doc][1], score, rel_tol=1e-9, abs_tol=1e-6), doc


def test_backoff_keeps_rare_words(spark, corpus):
    """More distinct words than are broadcast: each keeps its own count."""
    pick = random.Random(11)
    rare = [" ".join(f"r{k}" for k in range(at, at + 7_000)) for at in range(0, 70_000, 7_000)]
    rare += ["r5 r6 r7 the r5 r6", "r69999", " ".join(f"r{pick.randrange(70_000)}" for _ in range(3_000)), "r8 r8 r8", "r8 r8"]
    rows = list(corpus) + [(500_000 + k, t) for k, t in enumerate(rare)]
    want = scores_by_hand(rows, 1 << 40)
    for some in ({}, {"part_words": 9_000, "bundle_words": 20_000, "frequent_words": 20, "broadcast_words": 300}):
        got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in lm_scoring.backoff_scores(frame(spark, rows), **some).collect()}
        assert got.keys() == want.keys()
        for doc, (n, score) in want.items():
            assert got[doc][0] == n and math.isclose(got[doc][1], score, rel_tol=1e-9, abs_tol=1e-6), (some, doc)


def test_backoff_on_an_empty_table(spark, nothing):
    assert lm_scoring.backoff_scores(nothing).count() == 0
    assert [tuple(r)[:2] for r in lm_scoring.backoff_scores(frame(spark, [(1, None), (None, "a b")])).collect()] == [(1, 0)]


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = list(corpus) + [(240_000, "I'll don't we've x's 'sa  two   blanks\n\n end \n"), (240_001, "<|endoftext|>")]
    path = scratch_path(spark, "tokens")
    got = {r["doc_id"]: r for r in token_files.encode_table(
        frame(spark, rows), path, vocabulary("byte_bpe_50k.json"), part_chars=100_000, shard_tokens=20_000).collect()}
    read = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, path).collect()}
    start = 0
    for doc, text, *_ in sorted(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert read[doc] == ids
        assert (got[doc]["start"], got[doc]["n_tokens"], got[doc]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shards = spark.read.parquet(path)
    assert shards.select("part").distinct().count() > 1 and shards.count() > shards.select("part").distinct().count()
    assert token_files.encode_table(frame(spark, []), scratch_path(spark, "tokens"), vocabulary("byte_bpe_50k.json")).count() == 0


def test_wavelet_matrix():
    pick = np.random.default_rng(4)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        ids = pick.integers(0, 40, n)
        m = WaveletMatrix(*WaveletMatrix.build(ids, 6).parts())
        assert m.decode().tolist() == ids.tolist()
        assert [m.access(i) for i in range(min(n, 300))] == ids[:300].tolist()
        for token in (0, 3, 39, 41, 64):
            places = np.flatnonzero(ids == token).tolist()
            assert m.count(token) == len(places) and m.occurrences(token) == places
            assert all(m.rank(token, i) == sum(p < i for p in places) for i in range(0, n + 1, 97))
        with pytest.raises(IndexError):
            m.access(n)
    with pytest.raises(ValueError):
        WaveletMatrix.build(np.array([64]), 6)


def edf_by_hand(share, slots):
    """Slot by slot: the released block with the earliest deadline."""
    size, names, used, order = sum(share.values()), sorted(share, key=str), dict.fromkeys(share, 0), []
    for slot in range(slots):
        ready = [(-(-(used[s] + 1) * size // share[s]), k, s) for k, s in enumerate(names) if used[s] * size // share[s] <= slot]
        heapq.heapify(ready)
        s = ready[0][2]
        order.append(s)
        used[s] += 1
    return order


def test_frame_keeps_every_share():
    for share in ({"a": 1, "b": 2, "c": 7}, {"a": 5}, {"a": 333, "b": 333, "c": 334}, {"a": 1, "b": 1, "c": 98}):
        size = sum(share.values())
        order = source_mixing.frame_order(share)
        assert order == edf_by_hand(share, size)
        used = dict.fromkeys(share, 0)
        for slot, s in enumerate(order, 1):
            used[s] += 1
            assert all(abs(used[x] - slot * share[x] / size) < 1 for x in share)


def test_mixing(spark, corpus):
    rows = list(corpus) + [(None, "no id", "en", "src0"), corpus[3], corpus[3]]
    for weights, frame_size in ((None, 1000), ({"src0": 5, "src1": 1, None: 2}, 40), ({}, 10)):
        got = source_mixing.mixed(frame(spark, rows), weights, frame_size, block_chars=3000, bucket_chars=10_000).collect()
        assert len(got) == len(rows)
        chars = collections.Counter()
        for _, text, *rest in rows:
            chars[rest[1] if len(rest) > 1 else None] += max(1, len(text or ""))
        wanted = {s: math.sqrt(c) for s, c in chars.items()} if weights is None else weights
        left, want, slot = {s: -(-c // 3000) for s, c in chars.items()}, {}, 0
        done = dict.fromkeys(left, 0)
        while any(left.values()):  # slot by slot over all blocks
            live = {s: wanted[s] for s, n in left.items() if n and wanted.get(s)}
            live = live or {min((s for s, n in left.items() if n), key=str): 1}
            share = source_mixing.shares(live, max(frame_size, len(live)))
            for s in edf_by_hand(share, 100_000 if len(share) == 1 and False else sum(left.values())):
                want[s, done[s]] = slot
                done[s] += 1
                left[s] -= 1
                slot += 1
                if not left[s]:
                    break
        spots = {}
        for r in got:
            assert want[r["source"], r["block"]] == r["slot"] and r["release"] <= r["slot"] < r["deadline"]
            spots.setdefault(r["slot"], r["source"])
            assert spots[r["slot"]] == r["source"]
        by = collections.defaultdict(list)
        for r in got:
            by[r["source"]].append((r["place"], r["doc_id"]))
        size = {d: max(1, len(t or "")) for d, t, *_ in rows}
        for some in by.values():
            at = 0
            for place, doc in sorted(some, key=lambda x: x[0]):
                assert place == at
                at += size[doc]
    assert source_mixing.mixed(frame(spark, [])).count() == 0


def test_targets_hold_over_many_blocks(spark):
    """Against the target weight itself no source is a block ahead or behind, however long the phase."""
    chars = {f"s{k}": 4000 if k == 0 else 200 + k for k in range(20)}
    rows = [(doc, "abcde", "en", s) for doc, s in enumerate(s for s, n in chars.items() for _ in range(n))]
    at = {r["slot"]: r["source"] for r in source_mixing.mixed(frame(spark, rows), block_chars=5, bucket_chars=2000).collect()}
    assert sorted(at) == list(range(len(rows)))
    weights = {s: Fraction(math.sqrt(5 * n)) for s, n in chars.items()}
    total, used = sum(weights.values()), dict.fromkeys(chars, 0)
    for slot in range(len(rows)):
        used[at[slot]] += 1
        assert all(abs(n - (slot + 1) * weights[s] / total) < 1 for s, n in used.items()), slot
        if used[at[slot]] == chars[at[slot]]:
            break
    assert slot > 4000
    share = source_mixing.shares({k: 1 + k % 7 for k in range(2500)})  # more sources than slots of a frame
    assert all(n * sum(1 + k % 7 for k in range(2500)) == (1 + k % 7) * sum(share.values()) for k, n in share.items())


def test_interleave_writes_in_order(spark, corpus):
    order = {r["doc_id"]: (r["slot"], r["place"]) for r in source_mixing.mixed(frame(spark, corpus), block_chars=3000).collect()}
    path = scratch_path(spark, "mixed")
    source_mixing.interleave(frame(spark, corpus), block_chars=3000).write.parquet(path)
    rows = spark.read.parquet(path).select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["file_name"], r["row_index"]))] == sorted(order, key=order.get)


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.scored(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.9
    assert {r["doc_id"]: r["held_out"] for r in got.collect()} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs.collect()}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_classifier_without_two_classes(spark, docs, corpus):
    labels = spark.createDataFrame([(0, None), (1, 7), (2, 1)], "doc_id bigint, quality int")
    for some in (labels, labels.limit(0)):
        got = quality_classifier.scored(docs, some).collect()
        assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.scored(frame(spark, []), labels).count() == 0


def test_rules_from_a_printed_tree():
    text = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 1 <= -2.0E-4)
    Predict: 1.0
   Else (feature 1 > -2.0E-4)
    Predict: 0.0
  Else (feature 0 > 0.5)
   Predict: 0.0
"""
    c = quality_classifier.Condition
    assert quality_classifier.tree_rules(text, ["x", "y"]) == [
        (c("x", True, 0.5),), (c("x", True, 0.5), c("y", True, -2e-4)), (c("x", True, 0.5), c("y", False, -2e-4)), (c("x", False, 0.5),)]
