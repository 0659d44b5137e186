"""Stupid-backoff scores of documents by n-gram counts over all of them.

Words are runs of letters, digits and characters beyond ASCII, A-Z lowered. A
document is scored word by word. Let c count over all documents and o over the
bigrams of the scored document itself: where c(v w) > o(v w), so that another
document has the bigram, the word scores log (c(v w) - o(v w)) / c(v); else it
backs off to log 0.4 * c(w) / N. A first word scores log c(w) / N.

* Every word has its own exact count. The most frequent words have ids and a
  broadcast count; that is a shortcut and changes no result. All others, the
  rare words, go by a 63-bit hash.
* Frequent pairs: bigrams of two among the 512 most frequent words have a dense
  table of fixed size, summed before the shuffle and broadcast.
* Other bigrams of two words with ids hold one outside those 512, so none has
  more than 1/513 of all rows: they are partitioned by a hash of the pair.
* A rare word has a home partition, and each of its occurrences goes there: as
  the second word of its bigram (or the first word of a text), and as the first
  word. The home counts the word and its bigrams. A bigram of two rare words goes
  to both homes: that of the first word scores it where another document has it,
  that of the second where it backs off.

Partial sums travel in bundles of documents and meet there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.tables import cut, texts
from evalspark.llm.textkit import ALNUM, Words, hash_words, list_column, mix, slices

BACKOFF = 0.4
FREQUENT = 512
BROADCAST_WORDS = 65_535
SECOND, FIRST, PAIR = range(3)  # what a bigram is dealt as
NONE = np.iinfo(np.int64).max  # in front of a first word


def _keys(words: pa.Array) -> np.ndarray:
    return (hash_words(words) >> np.uint64(1)).view(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=16 << 20):
        codes, distinct = Words(part.column("text"), ALNUM, lower=True).encode()
        if len(codes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys(distinct)), pa.array(np.bincount(codes, minlength=len(distinct)))], names=["word", "n"])


class Lexicon:
    """Words to ids, 1 the most frequent word. Others are 0, one unknown word, or under ``rare`` the complement of their hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, others: int, rare: bool):
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.counts = np.concatenate([[0 if rare else others], counts]).astype(np.int64)
        self.total = int(counts.sum()) + others
        self.rare = others if rare else 0

    def ids(self, words: Words) -> np.ndarray:
        codes, distinct = words.encode()
        if not len(codes):
            return np.zeros(0, np.int64)
        hashes = _keys(distinct)
        unknown = ~hashes if self.rare else np.zeros(len(hashes), np.int64)
        if not len(self.words):
            return unknown[codes]
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[place] == hashes, self.order[place] + 1, unknown)[codes]


def _own_counts(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every entry, how often its key occurs in its row."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.lexsort((keys, rows))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (rows[order][1:] != rows[order][:-1])])
    group = np.cumsum(new) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def _pairs(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of every bigram and its row."""
    at = words.windows(2)
    return ids[at], ids[at + 1], words.row[at]


def _near(first: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    return (first >= 0) & (first <= most) & (second >= 0) & (second <= most)


def _leads(words: Words) -> np.ndarray:
    return words.first[:-1][words.counts > 0]


def _frequent_counts(lexicon, most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = most + 1
        table = np.zeros(side * side, np.int64)
        for part in slices(batches):
            words = Words(part.column("text"), ALNUM, lower=True)
            first, second, _ = _pairs(words, lexicon.value.ids(words))
            near = _near(first, second, most)
            table += np.bincount(first[near] * side + second[near], minlength=side * side)
        full = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(table[full])], names=["pair", "n"])

    return count


BUNDLE = "bundle int, docs array<bigint>, words array<bigint>, scores array<double>"


def _bundled(docs: np.ndarray, words: np.ndarray, scores: np.ndarray, bundles: int) -> pa.RecordBatch:
    """One row per bundle of documents."""
    home = (mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(bundles)).astype(np.int32)
    order = np.argsort(home, kind="stable")
    counts = np.bincount(home, minlength=bundles)
    full = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([
        pa.array(full.astype(np.int32)), list_column(docs[order], counts[full], pa.int64()),
        list_column(words[order], counts[full], pa.int64()), list_column(scores[order], counts[full], pa.float64()),
    ], names=["bundle", "docs", "words", "scores"])


def _known(lexicon, frequent, most: int, bundles: int):
    """Per row: its words, and the scores that the broadcast tables suffice for."""
    side = most + 1

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for part in slices(batches):
            words = Words(part.column("text"), ALNUM, lower=True)
            ids = lex.ids(words)
            score = np.zeros(len(ids))
            lead = _leads(words)
            lead = lead[ids[lead] >= 0]
            score[lead] = np.log(lex.counts[ids[lead]] / max(lex.total, 1))
            first, second, row = _pairs(words, ids)
            near = _near(first, second, most)
            key = first[near] * side + second[near]
            others = frequent.value[key] - _own_counts(key, row[near])
            score[words.windows(2)[near] + 1] = _score(lex.counts[first[near]], lex.counts[second[near]], others, lex.total)
            yield _bundled(part.column("doc_id").to_numpy(), words.counts.astype(np.int64), words.words_per_row(score), bundles)

    return known


def _score(first: np.ndarray, second: np.ndarray, others: np.ndarray, total: int) -> np.ndarray:
    """Scores from the counts of both words and of the bigram in other documents."""
    return np.where(others > 0, np.log(np.maximum(others, 1) / np.maximum(first, 1)), np.log(BACKOFF * np.maximum(second, 1) / max(total, 1)))


DEALT = "part int, at bigint, firsts array<bigint>, seconds array<bigint>, docs array<bigint>"


def _deal(lexicon, most: int, parts: int):
    """All other bigrams with their documents, one row per slice, partition and role (``at`` is both). Pairs of ids are packed in ``firsts``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=8 << 20):
            words = Words(part.column("text"), ALNUM, lower=True)
            ids = lexicon.value.ids(words)
            first, second, row = _pairs(words, ids)
            doc = part.column("doc_id").to_numpy()
            lead = _leads(words)
            lead = lead[ids[lead] < 0]
            rare = np.flatnonzero(second < 0)
            rows = {SECOND: (np.concatenate([ids[lead], second[rare]]), np.concatenate([np.full(len(lead), NONE), first[rare]]),
                             doc[np.concatenate([words.row[lead], row[rare]])])}
            rare = np.flatnonzero(first < 0)
            rows[FIRST] = first[rare], second[rare], doc[row[rare]]
            far = np.flatnonzero((first >= 0) & (second >= 0) & ~_near(first, second, most))
            rows[PAIR] = first[far] << 32 | second[far], None, doc[row[far]]
            for role, (key, other, docs) in rows.items():
                home = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(home, kind="stable")
                counts = np.bincount(home, minlength=parts)
                full = np.flatnonzero(counts)
                keys = list_column(key[order], counts[full], pa.int64())
                others = list_column(np.zeros(0, np.int64), 0 * full, pa.int64()) if other is None else list_column(other[order], counts[full], pa.int64())
                firsts, seconds = (others, keys) if role == SECOND else (keys, others)
                yield pa.RecordBatch.from_arrays([
                    pa.array(full.astype(np.int32)), pa.array(3 * full + role), firsts, seconds,
                    list_column(docs[order], counts[full], pa.int64())], names=["part", "at", "firsts", "seconds", "docs"])

    return deal


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each key, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a and held and keys[a] != now:
                yield held
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
                now = keys[a]
    if held:
        yield held


def _flat(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).flatten().to_numpy() for b in held])


def _by_document(docs: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every bigram in a document: its place, its count, and its count in other documents."""
    order = np.lexsort((docs, *keys))
    if not len(order):
        return order, order, order
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    pair = np.flatnonzero(new | np.concatenate([[True], docs[order][1:] != docs[order][:-1]]))
    own = np.diff(np.append(pair, len(order)))
    group = np.cumsum(new)[pair] - 1
    return order[pair], own, np.bincount(group, own).astype(np.int64)[group] - own


Scores = tuple[np.ndarray, np.ndarray]  # documents and what they get


def _of_pairs(lex: Lexicon, keys: np.ndarray, docs: np.ndarray) -> Scores:
    at, own, others = _by_document(docs, keys)
    keys = keys[at]
    return docs[at], own * _score(lex.counts[keys >> 32], lex.counts[keys & 0xFFFFFFFF], others, lex.total)


def _of_leads(lex: Lexicon, rare: np.ndarray, times: np.ndarray, first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> Scores:
    lead = first == NONE
    return docs[lead], np.log(times[np.searchsorted(rare, second[lead])] / max(lex.total, 1))


def _of_seconds(lex: Lexicon, rare: np.ndarray, times: np.ndarray, first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> Scores:
    at, own, others = _by_document(docs, first, second)
    mine = (first[at] != NONE) & ((others == 0) | (first[at] >= 0))
    at, own, others = at[mine], own[mine], others[mine]
    count = times[np.searchsorted(rare, second[at])]
    return docs[at], own * _score(lex.counts[np.maximum(first[at], 0)], count, others, lex.total)


def _of_firsts(lex: Lexicon, rare: np.ndarray, times: np.ndarray, first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> Scores:
    at, own, others = _by_document(docs, second, first)
    mine = (others > 0) | (second[at] >= 0)
    at, own, others = at[mine], own[mine], others[mine]
    count = times[np.searchsorted(rare, first[at])]  # every rare word is at home as a second word, too, or leads a text
    return docs[at], own * _score(count, lex.counts[np.maximum(second[at], 0)], others, lex.total)


def _tally(lexicon, bundles: int):
    """Counts the rare words and the bigrams of a partition and sums their scores per document, role by role."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, rare, times = lexicon.value, None, None
        for held in _groups(batches, "at"):
            role = held[0].column("at")[0].as_py() % 3
            first, second, docs = (_flat(held, name) for name in ("firsts", "seconds", "docs"))
            held.clear()
            if role == SECOND:
                rare, times = np.unique(second, return_counts=True)
                scored = [_of_leads(lex, rare, times, first, second, docs), _of_seconds(lex, rare, times, first, second, docs)]
            elif role == FIRST:
                scored = [_of_firsts(lex, rare, times, first, second, docs)]
            else:
                scored = [_of_pairs(lex, first, docs)]
            del first, second
            docs, scores = (np.concatenate(column) for column in zip(*scored))
            who, place = np.unique(docs, return_inverse=True)
            yield _bundled(who, np.zeros(len(who), np.int64), np.bincount(place, scores), bundles)

    return tally


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums per document of each bundle."""
    for held in _groups(batches, "bundle"):
        who, place = np.unique(_flat(held, "docs"), return_inverse=True)
        words, scores = np.bincount(place, _flat(held, "words")).astype(np.int64), np.bincount(place, _flat(held, "scores"))
        mean = pa.array(scores / np.maximum(words, 1), mask=words == 0)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(words), pa.array(scores), mean],
                                         names=["doc_id", "n_words", "log_score", "mean_score"])


def vocabulary(docs: DataFrame, most: int | None, broadcast_words: int = BROADCAST_WORDS) -> Lexicon:
    """The lexicon of ``docs``: all words, or with ``most`` those more frequent than the word of rank ``most`` + 1."""
    counted = cut(docs.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.orderBy(F.desc("n"), "word").limit(broadcast_words if most is None else most + 1).collect()
    least = top[most]["n"] if most is not None and len(top) > most else 0
    known = sorted(((r["n"], r["word"]) for r in top if r["n"] > least), reverse=True)
    counts = np.array([n for n, _ in known], np.int64)
    return Lexicon(np.array([w for _, w in known], np.int64), counts, int(total - counts.sum()), most is None)


def backoff_scores(docs: DataFrame, most_words: int | None = None, part_words: int = 4_000_000, bundle_words: int = 8_000_000,
                   frequent_words: int = FREQUENT, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per doc_id: ``doc_id, n_words, log_score, mean_score`` (natural logarithms; the mean is per word).

    A null or empty text has no words, score 0 and a null mean. Rows with a null
    doc_id are left out, and not counted; rows that share a doc_id are scored as
    one document of several texts. ``part_words`` sets the size of a partition
    of bigrams, ``bundle_words`` that of a bundle of documents, ``frequent_words`` the
    side of the dense table and ``broadcast_words`` the number of words with ids; none of
    them changes a result. Only a caller who gives ``most_words`` has a closed vocabulary,
    with all rarer words as one unknown word.
    """
    spark = docs.sparkSession
    rows = texts(docs).filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lexicon = vocabulary(rows, most_words, broadcast_words)
    shared = spark.sparkContext.broadcast(lexicon)
    dense = np.zeros((frequent_words + 1) ** 2, np.int64)
    pairs = rows.mapInArrow(_frequent_counts(shared, frequent_words), "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in pairs.collect():  # at most 513 * 513 by default
        dense[r["pair"]] = r["n"]
    frequent = spark.sparkContext.broadcast(dense)
    parts = max(1, math.ceil((lexicon.total + 3 * lexicon.rare) / part_words))  # a rare word travels twice, with longer keys
    bundles = max(1, math.ceil(lexicon.total / bundle_words))
    known = rows.mapInArrow(_known(shared, frequent, frequent_words, bundles), BUNDLE)
    dealt = rows.mapInArrow(_deal(shared, frequent_words, parts), DEALT)
    far = dealt.repartition(parts, "part").sortWithinPartitions("at").mapInArrow(_tally(shared, bundles), BUNDLE)
    return known.unionByName(far).repartition(bundles, "bundle").sortWithinPartitions("bundle").mapInArrow(
        _sum, "doc_id bigint, n_words bigint, log_score double, mean_score double")
