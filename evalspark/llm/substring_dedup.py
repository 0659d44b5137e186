"""Removal of repeated passages, with windows counted exactly inside minimiser buckets.

Words are runs of anything but ASCII blanks; a window is twenty consecutive
words of one document. Windows that share a minimiser (the smallest hash among
their six-word runs) and follow each other are one super-k-mer. Equal windows
have equal minimisers, so:

1. Minimisers are counted, in one text or several; only those that occur twice can
   hold a repeated window.
2. The super-k-mers of those travel as packed strings. Equal strings collapse to
   their earliest occurrence before the shuffle, so a passage in a third of all
   documents is one row per task.
3. In its minimiser's bucket every string is cut into windows, which are ranked
   exactly by sorting and doubling; the earliest occurrence of each is kept.
4. Strings tell their occurrences which windows have an earlier copy.

A minimiser with very many occurrences (a frequent run of words in ever new
surroundings) sends single windows instead, each to a bucket of its own hash:
equal windows still meet, and no bucket is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.tables import cut, texts
from evalspark.llm.textkit import NOT_BLANK, Words, covered, hash_words, mix, raw, slices, window_hashes

RUN_BYTES = 4 << 20


def super_kmers(words: Words, hashes: np.ndarray, window: int, short: int) -> tuple[np.ndarray, ...]:
    """First word, number of windows, minimiser and its places (1, or 2 for more) of every super-k-mer, in order."""
    at = words.windows(window)
    if not len(at):
        return at, at, at, at
    least = window_hashes(hashes, np.arange(len(words) - short + 1), short)
    left = right = np.arange(len(least))
    span, size = window - short + 1, 1
    while size < span:  # the minimum over a span of short runs with its first and last place, by doubling
        step = min(size, span - size)
        one, two = least[: len(least) - step], least[step:]
        left = np.where(two < one, left[step:], left[: len(left) - step])
        right = np.where(two <= one, right[step:], right[: len(right) - step])
        least = np.minimum(one, two)
        size += step
    least, left, right = least[at].view(np.int64), left[at], right[at]
    begin = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])])
    first = np.flatnonzero(begin)
    stop = np.append(first[1:], len(at))
    return at[first], stop - first, least[first], 1 + (left[first] != right[stop - 1])


def _mark(window: int, short: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every minimiser of a document once, with the number of its super-k-mers (or 2 for several places in one)."""
        for part in slices(batches):
            words = Words(part.column("text"), NOT_BLANK)
            start, _, least, places = super_kmers(words, words.hashes(), window, short)
            row = words.row[start]
            order = np.lexsort((least, row))
            row, least, places = row[order], least[order], places[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (least[1:] != least[:-1])])) if len(row) else row
            yield pa.RecordBatch.from_arrays([
                pa.array(least[new], pa.int64()), part.column("doc_id").take(pa.array(row[new])), part.column("nth").take(pa.array(row[new])),
                pa.array((np.add.reduceat(places, new) if len(new) else new).astype(np.int32)),
            ], names=["least", "doc_id", "nth", "places"])

    return mark


def _pack(window: int, short: int, hot: int, with_words: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The super-k-mers of repeated minimisers. ``with_words``: of equal ones in a slice only the earliest, with its words."""
        for part in slices(batches):
            words = Words(part.column("text"), NOT_BLANK)
            hashes = words.hashes()
            start, windows, least, _ = super_kmers(words, hashes, window, short)
            marks = part.column("marks").flatten()
            owner = np.repeat(np.arange(part.num_rows), part.column("marks").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            known, times = (marks.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("least", "times"))
            # marks and super-k-mers meet on (row, minimiser)
            wanted, own = (mix(x.view(np.uint64) ^ mix(r.astype(np.uint64))) for x, r in ((known, owner), (least, words.row[start])))
            order = np.argsort(wanted)
            place = np.minimum(np.searchsorted(wanted[order], own), max(len(wanted) - 1, 0))
            keep = wanted[order][place] == own if len(wanted) else np.zeros(len(own), bool)
            start, windows, least, times = start[keep], windows[keep], least[keep], times[order][place[keep]] if len(wanted) else start[keep]
            single = times > hot
            if single.any():
                turns = np.where(single, windows, 1)
                pick = np.repeat(np.arange(len(turns)), turns)
                start = start[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(turns) - turns, turns)
                alone = window_hashes(hashes, np.minimum(start, len(words) - window), window).view(np.int64)
                least, windows = np.where(single[pick], alone, least[pick]), np.where(single[pick], 1, windows[pick])
            row = words.row[start]
            text = words.data.tobytes()
            packed = [b" ".join(text[a:b].split()) for a, b in zip(words.starts[start].tolist(), words.ends[start + windows + window - 2].tolist())]
            keys = pa.array([hashlib.md5(x).digest() for x in packed], pa.binary())
            doc, nth = part.column("doc_id").take(pa.array(row)), part.column("nth").to_numpy()[row].astype(np.int64)
            place = nth << 32 | start - words.first[row]
            out = {"least": pa.array(least, pa.int64()), "key": keys, "doc_id": doc, "start": pa.array(place)}
            if with_words:
                out["words"] = pa.array(packed, pa.binary())
                code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                order = np.lexsort((place, doc.to_numpy(), code))
                lead = order[np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))] if len(order) else order
                yield pa.RecordBatch.from_pydict(out).take(pa.array(lead))
            else:
                del out["least"]
                yield pa.RecordBatch.from_pydict(out | {"windows": pa.array(windows.astype(np.int32))})

    return pack


def window_ranks(codes: np.ndarray, window: int) -> np.ndarray:
    """A number per position, equal exactly where ``window`` consecutive codes are equal.

    Doubling: the ranks of two runs make the rank of the run they form.
    """
    ranks, size = codes.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        pair = ranks[: len(ranks) - step] * (int(ranks.max(initial=0)) + 1) + ranks[step:]
        ranks = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size += step
    return ranks


def _count(window: int):
    def settle(strings: pa.Table) -> pa.RecordBatch:
        """Which windows of each string have an earlier copy elsewhere, as packed flags."""
        packed = strings.column("words").combine_chunks()
        words = Words(packed, NOT_BLANK)
        at = words.windows(window)
        codes, _ = words.encode()
        rank = window_ranks(codes, window)[at]
        row = words.row[at]
        place = strings.column("start").to_numpy()[row].astype(np.int64) + at - words.first[row]
        doc = strings.column("doc_id").to_numpy()[row]
        order = np.lexsort((place, doc, rank))
        lead = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
        later = np.ones(len(at), bool)
        later[order[lead]] = False
        edges = np.searchsorted(row, np.arange(packed.__len__() + 1))
        flags = [np.packbits(later[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.RecordBatch.from_arrays([
            pa.array(strings.column("key").combine_chunks()), strings.column("doc_id").combine_chunks(),
            strings.column("start").combine_chunks(), pa.array(flags, pa.binary())], names=["key", "first_doc", "first_start", "later"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimiser; whole groups of it are settled together."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            least = batch.column("least").to_numpy()
            if not len(least):
                continue
            change = np.flatnonzero(least[1:] != least[:-1]) + 1
            if held and held[-1].column("least")[-1].as_py() != least[0]:
                change = np.concatenate([[0], change])
            if size + batch.nbytes > RUN_BYTES and len(change):
                stop = int(change[-1])
                held.append(batch.slice(0, stop))
                yield settle(pa.Table.from_batches(held))
                held, size, batch = [], 0, batch.slice(stop)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield settle(pa.Table.from_batches(held))

    return count


def _lost(window: int):
    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The word intervals each occurrence loses."""
        for batch in batches:
            ids, begins, ends = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "windows", "first_doc", "first_start", "later")]
            for doc, start, windows, first_doc, first_start, later in zip(*columns):
                if (doc, start) == (first_doc, first_start):
                    flags = np.unpackbits(np.frombuffer(later, np.uint8), count=windows)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                    found = zip(edges[::2].tolist(), edges[1::2].tolist())
                else:
                    found = [(0, windows)]
                for a, b in found:
                    ids.append(doc)
                    begins.append(start + a)
                    ends.append(start + b - 1 + window)
            begin, end = np.array(begins, np.int64), np.array(ends, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array((begin >> 32).astype(np.int32)), pa.array((begin & 0xFFFFFFFF).astype(np.int32)),
                pa.array((end & 0xFFFFFFFF).astype(np.int32))], names=["doc_id", "nth", "begin", "end"])

    return lost


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = Words(part.column("text"), NOT_BLANK)
        gone, kept = np.zeros(part.num_rows, np.int64), []
        for row, spans in enumerate(part.column("lost").to_pylist()):
            begin, n = words.first[row], int(words.counts[row])
            if spans:
                flags = covered(n, np.array([s["begin"] for s in spans]), np.array([s["end"] for s in spans]))
                gone[row] = int(flags.sum())
                left = np.flatnonzero(~flags) + begin
                text = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[left], words.ends[left]))
            else:
                text = b" ".join(words.data[words.offsets[row]: words.offsets[row + 1]].tobytes().split())
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("nth"), pa.array(words.counts.astype(np.int64)), pa.array(gone), pa.array(kept, pa.binary())],
            names=["doc_id", "nth", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _rest(batches):
        digests = [hashlib.sha256(x).hexdigest() for x in part.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(digests)], names=["doc_id", "nth", "n_words", "n_removed", "kept_sha256"])


def flagged(docs: DataFrame, window: int, short: int) -> DataFrame:
    """``doc_id, nth, text, marks`` of the documents with repeated minimisers; ``marks`` lists these with their total times."""
    marks = docs.mapInArrow(_mark(window, short), "least bigint, doc_id bigint, nth int, places int")
    repeated = marks.groupBy("least").agg(F.sum("places").alias("times")).filter("times > 1")
    found = marks.select("least", "doc_id", "nth").join(repeated.hint("merge"), "least").groupBy("doc_id", "nth").agg(
        F.collect_list(F.struct("least", "times")).alias("marks"))
    return docs.join(found.hint("merge"), ["doc_id", "nth"]).select("doc_id", "nth", "text", "marks")


def lost_words(flags: DataFrame, window: int, short: int, hot: int) -> DataFrame:
    """``doc_id, nth, lost``: the word intervals [begin, end) covered by windows that also start earlier."""
    strings = flags.mapInArrow(_pack(window, short, hot, True), "least bigint, key binary, doc_id bigint, start bigint, words binary")
    # dealt by minimiser once: the strings of a slice are distinct already, and grouping and sorting keep the partitions
    first = strings.repartition("least").groupBy("least", "key").agg(
        F.min(F.struct("doc_id", "start")).alias("at"), F.first("words").alias("words"))
    settled = first.select("least", "key", "at.doc_id", "at.start", "words").sortWithinPartitions("least").mapInArrow(
        _count(window), "key binary, first_doc bigint, first_start bigint, later binary")
    places = flags.mapInArrow(_pack(window, short, hot, False), "key binary, doc_id bigint, start bigint, windows int")
    spans = places.join(settled, "key").select("doc_id", "start", "windows", "first_doc", "first_start", "later").mapInArrow(
        _lost(window), "doc_id bigint, nth int, begin int, end int")
    return spans.groupBy("doc_id", "nth").agg(F.collect_list(F.struct("begin", "end")).alias("lost"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc_id, nth, text`` and whether ids repeat; ``nth`` tells the texts of one id apart, and is 0 where none repeats."""
    rows = texts(docs).filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    again = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    nth = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)) if again else F.lit(0)
    return rows.select("doc_id", nth.cast("int").alias("nth"), "text"), again


def _changed(docs: DataFrame, function, kind: str, window: int = 20, short: int = 6, hot: int = 50_000) -> DataFrame:
    """All documents as they are, but those with something to lose as they become; only these travel with their texts."""
    schema = f"doc_id bigint, nth int, n_words bigint, n_removed bigint, {kind}"
    name = kind.split()[0]
    rows, again = _numbered(docs)
    flags = cut(flagged(rows.dropDuplicates(["doc_id", "nth"]) if again else rows, window, short))
    after = flags.select("doc_id", "nth", "text").join(
        lost_words(flags, window, short, hot).hint("merge"), ["doc_id", "nth"]).mapInArrow(function, schema)
    after = after.select("doc_id", "nth", F.col("n_removed").alias("_removed"), F.col(name).alias("_after"))
    whole = rows.withColumn("lost", F.lit(None).cast("array<struct<begin:int,end:int>>")).mapInArrow(function, schema)
    return whole.join(after, ["doc_id", "nth"], "left").select(
        "doc_id", "n_words", F.coalesce("_removed", "n_removed").alias("n_removed"), F.coalesce("_after", name).alias(name))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept`` (the kept words joined by blanks, UTF-8).

    Earlier means a smaller doc_id, or the same document and a smaller start. A
    null or empty text has no words. Rows with a null doc_id are left out. Rows
    that repeat id and text are one document given several times: they are no
    copies of each other, and each gets its result. Different texts of one id are
    documents in the order of a 31-bit hash of theirs, which tells them apart.
    Options: ``window`` words, ``short`` words of a minimiser, and ``hot``, the
    number of super-k-mers from which a minimiser sends single windows.
    """
    return _changed(docs, _rest, "kept binary", **options)


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    """As ``without_repeats``, with the sha256 of the kept words instead of the words."""
    return _changed(docs, _digest, "kept_sha256 string", **options)
