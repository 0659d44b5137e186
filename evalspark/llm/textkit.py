"""Word kernels over Arrow text columns, used inside tasks.

A batch is walked in slices of a few megabytes, so memory follows the slice (or
the longest text), not the batch. Words are runs of word bytes; a text never
shares a word with its neighbour. Byte tables work on UTF-8: every byte of a
character beyond ASCII is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
BYTE_KEYS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Letters, digits and all characters beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 0x80 else True for b in range(256)])
#: Everything but the six ASCII blanks.
NOT_BLANK = np.array([b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


_KEPT: list = []


def kept(build: Callable) -> Callable:
    """Cache what ``build`` last made for the worker's lifetime, or until another kernel releases it."""
    cached = lru_cache(1)(build)
    _KEPT.append(cached)
    return cached


def release(*but: Callable) -> None:
    """Drop all that kernels before this one keep, but for what this one needs: workers are reused from stage to stage."""
    for cached in _KEPT:
        if cached not in but:
            cached.cache_clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in their order, cut so that a slice holds at most ``limit`` text bytes or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


class Words:
    """The words of a text column: byte positions, exact codes and 64-bit hashes."""

    def __init__(self, column: pa.Array, is_word: np.ndarray = NOT_BLANK, lower: bool = False):
        self.data, self.offsets = raw(column)
        if lower:
            self.data = LOWER[self.data]
        self.rows = len(self.offsets) - 1
        self.inside = is_word[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(self.data), bool)
        before[1:] = self.inside[:-1]
        self.starts = np.flatnonzero(self.inside & (~before | edge[:-1]))
        after = np.zeros(len(self.data), bool)
        after[:-1] = self.inside[1:]
        self.ends = np.flatnonzero(self.inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """A code for every word, equal for equal words, and the words behind the codes."""
        edges = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=edges[1:])
        packed = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.starts), [None, pa.py_buffer(edges), pa.py_buffer(self.data[self.inside])]
        )
        coded = packed.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for every word."""
        codes, words = self.encode()
        return hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)

    def windows(self, size: int) -> np.ndarray:
        """The first word of every window of ``size`` words that lies within one row."""
        last = len(self) - size + 1
        return np.flatnonzero(self.row[:last] == self.row[size - 1:]) if last > 0 else np.zeros(0, np.int64)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words_per_row(self, values: np.ndarray) -> np.ndarray:
        """The sum of a per-word value over each row."""
        total = np.zeros(len(values) + 1, np.asarray(values).dtype if values.dtype != bool else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def hash_words(words: pa.Array) -> np.ndarray:
    """Polynomial hashes of non-empty byte strings, with a random key for every byte value."""
    data, offsets = raw(words)
    if not len(words):
        return np.zeros(0, np.uint64)
    lengths = np.diff(offsets)
    powers = np.full(int(lengths.max()), ODD)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    return mix(np.add.reduceat(BYTE_KEYS[data] * powers[place], offsets[:-1]) + lengths.astype(np.uint64))


def window_hashes(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of ``size`` consecutive values from each position in ``at``."""
    if not len(at):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) - size + 1, np.uint64)
    for i in range(size):
        total = total * ODD + values[i: len(values) - size + 1 + i]
    return mix(total[at])


def covered(length: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the positions inside any of the intervals [begin, end)."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number of values of each row."""
    edges = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values, type=kind))
