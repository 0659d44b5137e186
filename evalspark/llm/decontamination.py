"""Benchmark decontamination with an Aho-Corasick automaton.

Texts and benchmark items are normalised alike: A-Z lowered, words are runs of
letters, digits and characters beyond ASCII, joined by single spaces. Every
window of ten consecutive item words (a shorter item is one window) is a
pattern; one scan of a text finds all of them, and the words hit are mapped back
to character offsets of the original text.

An automaton's size is bounded by the item texts it holds. A benchmark beyond
that is dealt over several, which a task builds one after the other and runs over
a chunk of its texts each, so a text is read once whatever the benchmark's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.tables import texts
from evalspark.llm.textkit import ALNUM, LOWER, Words, covered, kept, release, slices

NORMAL = bytes(int(LOWER[b]) if ALNUM[b] else 0x20 for b in range(256))
FOUND = ("doc_id bigint, n_words bigint, hits array<struct<first:int,last:int>>, "
         "spans array<struct<start:int,end:int>>, items array<bigint>")
HELD_BYTES = 32 << 20  # texts that wait for the next automaton, where there are several


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def window_items(items: list[tuple[int, str]], window: int) -> dict[bytes, tuple[int, set[int]]]:
    """Every pattern with its number of words and the items it comes from."""
    patterns: dict[bytes, tuple[int, set[int]]] = {}
    for item, text in items:
        words = normal_words(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            patterns.setdefault(b" ".join(words[at: at + size]), (size, set()))[1].add(item)
    return patterns


@kept
def automaton(items: tuple[tuple[int, str], ...], window: int):
    """Built once per worker where the benchmark is one automaton, else once per chunk of texts."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for pattern, (size, owners) in window_items(list(items), window).items():
        built.add_word(f" {pattern.decode('latin-1')} ", (size, tuple(owners)))
    built.make_automaton()
    return built


def _chunks(parts: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices together until their texts reach ``limit`` bytes."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.column("text").nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _line(text: pa.Scalar) -> str:
    """The normal words of a text with a blank around each."""
    words = text.as_buffer().to_pybytes().translate(NORMAL).split() if text.is_valid else []
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def _located(text: pa.Array, line: str, matches: list) -> tuple[list, list, list]:
    """Word intervals, character intervals and items of the matches in one text (a column of one row)."""
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    after = np.searchsorted(blanks, [end for end, _ in matches])
    begin = after - np.array([size for _, (size, _) in matches])
    flags = covered(len(blanks) - 1, begin, after)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    first, last = edges[::2], edges[1::2] - 1
    place = Words(text, ALNUM)
    chars = np.concatenate([[0], np.cumsum((place.data & 0xC0) != 0x80)])
    return (
        [{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist())],
        [{"start": a, "end": b} for a, b in zip(chars[place.starts[first]].tolist(), chars[place.ends[last]].tolist())],
        sorted({i for _, (_, some) in matches for i in some}))


def _scan(passes: list, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(automaton)
        for held in _chunks(slices(batches), HELD_BYTES if len(passes) > 1 else 1):
            lines = [[_line(text) for text in part.column("text")] for part in held]
            matches: list[list[list]] = [[[] for _ in own] for own in lines]
            for items in passes:
                if not items.value:
                    continue
                found = automaton(items.value, window)
                for own, into in zip(lines, matches):
                    for row, line in enumerate(own):
                        if line:
                            into[row].extend(found.iter(line))
            for part, own, some in zip(held, lines, matches):
                rows = [_located(part.column("text").slice(row, 1), line, m) if m else ([], [], [])
                        for row, (line, m) in enumerate(zip(own, some))]
                hits, spans, owners = zip(*rows)
                counts = [line.count(" ") - 1 if line else 0 for line in own]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(owners, pa.list_(pa.int64())),
                ], names=["doc_id", "n_words", "hits", "spans", "items"])

    return scan


def _passes(benchmark: DataFrame, pass_bytes: int) -> list:
    """The items as broadcast tuples, each of about ``pass_bytes`` of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes, out = max(1, math.ceil(total / pass_bytes)), []
    for turn in range(passes):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn).distinct()
        out.append(spark.sparkContext.broadcast(tuple(sorted((r["item_id"], r["text"]) for r in some.collect()))))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_bytes: int = 512 << 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, hits, spans, items``.

    ``hits`` are the word intervals (first and last word, from 0) covered by
    occurrences of windows, ``spans`` the same as character offsets of the
    original text, end exclusive; ``items`` the ids of the items found,
    ascending. A null or empty text has no words. Items with a null id or text
    are left out; repeated items count once. ``pass_bytes`` bounds the item
    texts of one automaton; a larger benchmark takes several, a text is read once.
    """
    rows = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = rows.mapInArrow(_scan(_passes(benchmark, pass_bytes), window), FOUND)
    inside = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select("doc_id", "n_words", inside.alias("n_hit"), "hits", "spans", "items")


def _clean(passes: list, window: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(automaton)
        for held in _chunks(slices(batches), HELD_BYTES if len(passes) > 1 else 1):
            lines = [[_line(text) for text in part.column("text")] for part in held]
            stays = [np.ones(len(own), bool) for own in lines]
            for items in passes:
                if not items.value:
                    continue
                found = automaton(items.value, window)
                for own, kept in zip(lines, stays):
                    for row in np.flatnonzero(kept):
                        kept[row] = not own[row] or next(found.iter(own[row]), None) is None
            for part, kept in zip(held, stays):
                yield part.filter(pa.array(kept))

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_bytes: int = 512 << 10) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all their columns.

    The scan of a text stops at the first window found; nothing is shuffled.
    """
    return docs.mapInArrow(_clean(_passes(benchmark, pass_bytes), window), docs.schema)
