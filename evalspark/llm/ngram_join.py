"""Near-duplicate join: MinHash banding for candidates, exact Jaccard on the full shingle sets.

Words are runs of letters, digits and characters beyond ASCII, with A-Z lowered;
a shingle is five consecutive words (a text of one to four words is one
shingle). Texts without words, null and empty ones included, have no shingles
and no links.

1. Texts with the same word sequence collapse to their smallest ``doc_id``.
2. MinHash bands of the rest meet on their hashes. Band and row counts follow
   from the similarity and the recall asked for.
3. Candidates that hang together form a family; inside a family every pair is
   verified on the full shingle sets, so a pair the bands missed is still found
   when a third text connects it. Families are cut into blocks, and a pair of
   blocks is one unit of work: it yields a link count per text and a spanning
   forest, never the pairs themselves.
4. Classes are the connected components of the verified links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.components import components
from evalspark.llm.tables import cut, texts
from evalspark.llm.textkit import ALNUM, ODD, Words, list_column, mix, release, slices, window_hashes

SIGNED = "doc_id bigint, words int, fp_a bigint, fp_b bigint, bands array<bigint>"


def choose_bands(similarity: float, recall: float, most: int = 96) -> tuple[int, int]:
    """The bands and rows that find a pair of this similarity with at least this probability.

    Of all choices within ``most`` hash functions it takes the most rows, which
    keeps pairs of low similarity apart best.
    """
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no choice of bands reaches this recall")


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the row each belongs to, in row order."""
    at = words.windows(size)
    values, rows = window_hashes(hashes, at, size), words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        total = words.counts[short].astype(np.uint64)
        for i in range(size - 1):
            has = words.counts[short] > i
            total[has] = total[has] * ODD + hashes[words.first[short[has]] + i]
        values, rows = np.concatenate([values, mix(total)]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        values, rows = values[order], rows[order]
    return values, rows


def _sign(size: int, bands: int, rows: int):
    random = np.random.Generator(np.random.PCG64(11))
    factors = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    shifts = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            words = Words(part.column("text"), ALNUM, lower=True)
            hashes = words.hashes()
            values, owner = shingles(words, hashes, size)
            place = np.arange(len(words), dtype=np.int64) - words.first[words.row]
            powers = np.cumprod(np.full(int(words.counts.max(initial=0)) + 1, ODD), dtype=np.uint64)
            one = words.words_per_row(hashes * powers[place])
            two = words.words_per_row(mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(1))))
            full = np.flatnonzero(words.counts > 0)
            begin = np.searchsorted(owner, full)
            signed = np.zeros((len(full), bands), np.uint64)
            if len(full):
                for band in range(bands):
                    key = np.full(len(full), np.uint64(band))
                    for k in range(band * rows, (band + 1) * rows):
                        key = key * ODD + mix(np.minimum.reduceat(values * factors[k] + shifts[k], begin))
                    signed[:, band] = mix(key)
            counts = np.where(words.counts > 0, bands, 0)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(words.counts.astype(np.int32)), pa.array(mix(one).view(np.int64)),
                pa.array(two.view(np.int64)), list_column(signed.reshape(-1).view(np.int64), counts, pa.int64()),
            ], names=["doc_id", "words", "fp_a", "fp_b", "bands"])

    return sign


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            words = Words(part.column("text"), ALNUM, lower=True)
            values, owner = shingles(words, words.hashes(), size)
            edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
            packed = [np.unique(values[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("family", "blocks", "rep", "copies")] + [pa.array(packed, pa.binary())],
                names=["family", "blocks", "rep", "copies", "shingles"])

    return sets


def _shared(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """The sizes of all pairwise intersections, by matrix products over slices of the shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen > 1
    column, owner = (np.cumsum(keep) - 1)[column[keep[column]]], owner[keep[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(keep.sum()), chunk):
        a, b = np.searchsorted(column, [begin, begin + chunk])
        held = np.zeros((len(sets), chunk), np.float32)
        held[owner[a:b], column[a:b] - begin] = 1
        common += held @ held.T
    return common


def _forest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every text the smallest id it is connected with inside the unit."""
    root = ids.copy()
    while True:
        least = np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(root, least)
        if (least == root).all():
            return root
        root = least


def _verify(similarity: float):
    def verify(unit: pa.Table) -> pa.Table:
        release()
        ids = unit.column("rep").to_numpy()
        order = np.argsort(ids)
        ids, copies = ids[order], unit.column("copies").to_numpy()[order]
        block = unit.column("block").to_numpy()[order]
        held = unit.column("shingles").to_pylist()
        sets = [np.frombuffer(held[i], np.uint64) for i in order]
        sizes = np.array([len(s) for s in sets], np.float64)
        common = _shared(sets).astype(np.float64)
        linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        low, high = unit.column("low")[0].as_py(), unit.column("high")[0].as_py()
        if low != high:  # pairs inside one block belong to that block's own unit
            linked &= block[:, None] != block[None, :]
        return pa.table({
            "family": unit.column("family"), "rep": ids, "links": (linked * copies[None, :]).sum(axis=1).astype(np.int64),
            "root": _forest(linked, ids), "alone": np.full(len(ids), unit.column("blocks")[0].as_py() == 1),
        })

    return verify


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, recall: float = 0.9999,
                    block_texts: int = 512, block_words: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, rep_id, copies, class_id, n_links``.

    ``rep_id`` is the smallest doc_id with the same word sequence and ``copies``
    the number of rows that have it; ``class_id`` is the smallest doc_id
    connected by links of at least ``similarity``; ``n_links`` counts all other
    rows linked directly, copies included. ``recall`` is the probability with
    which the bands alone meet a pair at the threshold. Repeated rows with one
    doc_id count as copies of each other. Rows with a null doc_id are left out.
    A block of a family holds about ``block_texts`` texts and ``block_words`` words.
    """
    bands, rows = choose_bands(similarity, recall)
    docs = texts(docs).filter("doc_id IS NOT NULL")
    signed = cut(docs.mapInArrow(_sign(size, bands, rows), SIGNED))
    worded = signed.filter("words > 0")
    reps = cut(worded.groupBy("fp_a", "fp_b", "words").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))

    banded = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    heads = banded.groupBy("band", "value").agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1")
    meeting = banded.join(heads, ["band", "value"]).select(F.col("rep").alias("a"), F.col("head").alias("b"))
    families = components(meeting).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    members = cut(families.join(reps.select("rep", "copies", "words"), "rep"))
    blocks = F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("words") / block_words)).cast("int")
    sized = members.groupBy("family").agg(blocks.alias("blocks"))

    wanted = members.join(sized, "family").select(F.col("rep").alias("doc_id"), "rep", "family", "blocks", "copies")
    # a table of candidates grows with the documents: joined by sorting at every size
    candidates = docs.join(wanted.hint("merge"), "doc_id").dropDuplicates(["rep"])
    sets = candidates.select("family", "blocks", "rep", "copies", "text").mapInArrow(
        _sets(size), "family bigint, blocks int, rep bigint, copies bigint, shingles binary")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    units = (
        sets.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    )
    found = cut(units.groupBy("family", "low", "high").applyInArrow(
        _verify(similarity), "family bigint, rep bigint, links bigint, root bigint, alone boolean"))

    settled = found.filter("alone").select("rep", "links", "root")
    open_ = found.filter("NOT alone")
    joined = components(open_.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    spread = open_.groupBy("rep").agg(F.sum("links").alias("links")).join(
        joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "links", F.coalesce("root", "rep").alias("root"))
    linked = settled.unionByName(spread)

    answers = reps.join(linked, "rep", "left").select(
        "fp_a", "fp_b", "words", F.col("rep").alias("rep_id"), "copies", F.coalesce("root", "rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    keys = ["fp_a", "fp_b", "words"]
    with_words = worded.select("doc_id", *keys).join(answers, keys).drop(*keys)
    without = signed.filter("words = 0").select(
        "doc_id", F.col("doc_id").alias("rep_id"), F.lit(1).cast("bigint").alias("copies"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links"))
    return with_words.unionByName(without)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the smallest doc_id of each class stays, with all its columns.

    Repeated rows of one doc_id collapse to one row. Rows with a null doc_id stay.
    """
    stays = near_duplicates(docs, **options).filter("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)
