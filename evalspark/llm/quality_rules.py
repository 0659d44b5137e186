"""Quality rules: repetition counts and the fertility of public tokenisers.

Words are runs of anything but ASCII blanks. Two public vocabularies read every
distinct word (with a blank before it, as inside a text): a byte-level BPE gives
characters per token and the entropy of a text's token distribution, a
SentencePiece BPE the share of words' tokens that fall back to single bytes. A
text is judged against the band of its language, or of its script where the
language is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.llm.pieces import expand, rank_bpe
from evalspark.llm.textkit import NOT_BLANK, ODD, SLICE_BYTES, Words, covered, mix, raw, release, slices, window_hashes
from evalspark.llm.token_counts import merge_table

SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
STATS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
         "n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, script string")

# Bands: least and most characters per token, most byte-fallback share, least entropy per token in bits. They are
# meant to be wide: they catch text that is not of the language (encoded blobs, shredded characters, one word over
# and over), not unusual prose. Entropy counts from MIN_TOKENS tokens on, as short texts have little by nature.
BANDS = {
    "en": (1.3, 8.0, 0.10, 3.0), "de": (1.2, 8.0, 0.10, 3.0), "fr": (1.2, 8.0, 0.10, 3.0), "es": (1.2, 8.0, 0.10, 3.0),
    "latin": (1.1, 8.0, 0.20, 2.5), "other": (0.25, 8.0, 0.60, 2.5),
}
MIN_TOKENS = 100


def blank_before(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of words with a blank before each."""
    data, offsets = raw(words)
    return np.insert(data, offsets[:-1], 0x20), offsets + np.arange(len(offsets))


def entropies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Shannon entropy, in bits, of the ids of each row."""
    rows = np.repeat(np.arange(len(counts)), counts)
    key = np.sort(rows.astype(np.int64) << 32 | ids)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(key))).astype(np.float64)
    inner = np.bincount((key[begin] >> 32) if len(key) else begin, times * np.log2(times), len(counts))
    total = np.maximum(counts, 1)
    return np.maximum(np.log2(total) - inner / total, 0.0)


def _duplicate_lines(words: Words) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line."""
    data, offsets = words.data, words.offsets
    stops = np.union1d(np.flatnonzero(data == 0x0A), offsets[1:][np.diff(offsets) > 0] - 1) if len(data) else np.zeros(0, np.int64)
    ends = np.where(data[stops] == 0x0A, stops, stops + 1)
    begins = np.concatenate([[0], stops[:-1] + 1])[: len(stops)]
    inside = np.concatenate([[0], np.cumsum(words.inside)])
    has = inside[ends] > inside[begins]
    begins, ends = begins[has], ends[has]
    row = np.searchsorted(offsets, begins, "right") - 1
    lines = pa.array([data[a:b].tobytes() for a, b in zip(begins, ends)], pa.large_binary())
    code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(row << 32 | code) >> 32 if len(row) else row
    return np.bincount(row, minlength=words.rows) - np.bincount(distinct, minlength=words.rows)


def _repeat_words(words: Words, codes: np.ndarray, size: int = 8) -> np.ndarray:
    """Per row, the words inside windows that its text holds twice or more."""
    at = words.windows(size)
    if not len(at):
        return np.zeros(words.rows, np.int64)
    keys = mix(window_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), at, size) ^ (words.row[at].astype(np.uint64) * ODD))
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    hit = at[np.isin(keys, np.unique(again))] if len(again) else at[:0]
    return words.words_per_row(covered(len(words), hit, hit + size).astype(np.int64))


def _measure(bpe_path: str, piece_path: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(rank_bpe, merge_table)
        bpe, fallback = rank_bpe(bpe_path), merge_table(piece_path)
        for part in slices(batches, limit=SLICE_BYTES // 2):
            words = Words(part.column("text"), NOT_BLANK)
            codes, distinct = words.encode()
            lead = (words.data & 0xC0) != 0x80
            word_chars = words.per_row(lead & words.inside)
            ids, counts = expand(*bpe.encode(*blank_before(distinct)), codes)
            n_tokens = words.words_per_row(counts)
            pieces, bytes_ = (words.words_per_row(n[codes]) for n in fallback.count_both(distinct))
            total = np.maximum(n_tokens, 1)
            # bytes that begin a character beyond the Latin blocks (U+0250 and up)
            foreign = words.per_row(words.data >= 0xCA)
            script = np.where(2 * foreign > word_chars, "other", "latin")
            yield pa.RecordBatch.from_arrays([
                part.column("row"), part.column("lang"), pa.array(words.counts.astype(np.int64)), pa.array(word_chars),
                pa.array(words.per_row(SYMBOLS[words.data])), pa.array(_duplicate_lines(words)),
                pa.array(_repeat_words(words, codes)), pa.array(n_tokens), pa.array(word_chars / total),
                pa.array(bytes_ / np.maximum(pieces, 1)), pa.array(entropies(ids, n_tokens)), pa.array(script.tolist(), pa.string()),
            ], names=["row", "lang", *(c.split()[0] for c in STATS.split(", "))])

    return measure


def in_band(lang: Column) -> Column:
    """Whether the measured columns lie within the band of the language, or of the script."""
    key = F.when(lang.isin(*[k for k in BANDS if k not in ("latin", "other")]) & (F.col("script") == "latin"), lang).otherwise(F.col("script"))
    ok = F.lit(True)
    for name, (least, most, byte_share, entropy) in BANDS.items():
        inside = (
            F.col("chars_per_token").between(least, most) & (F.col("byte_share") <= byte_share)
            & ((F.col("n_tokens") < MIN_TOKENS) | (F.col("token_entropy") >= entropy))
        )
        ok = F.when(key == name, inside).otherwise(ok)
    return ok


def _judged(docs: DataFrame, row: Column, bpe_path: str, piece_path: str) -> DataFrame:
    """``row`` of every document with the measured columns and the verdict."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    measured = rows.mapInArrow(_measure(bpe_path, piece_path), f"row {rows.schema['row'].dataType.simpleString()}, lang string, {STATS}")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(in_band(F.col("lang")), F.lit(True)))


def quality(docs: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs`` with its counts, fertility figures and verdict.

    ``base_failed`` marks fewer than 20 words, or more than 30 % of the words in
    repeated 8-word windows; ``kept`` also needs the fertility band. A null or
    empty text has no words and fails. ``lang`` may be null, unknown or missing:
    the script decides then.
    """
    judged = _judged(docs, F.struct("doc_id"), bpe_path, piece_path)
    return judged.select("row.doc_id", *[c for c in judged.columns if c not in ("row", "lang")])


def keep_good(docs: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever these are called; nothing is shuffled."""
    return _judged(docs, F.struct(*docs.columns), bpe_path, piece_path).filter("kept").select("row.*")
