"""Fast exact encoding with public vocabularies: split a text into the units no token crosses, encode each unit once.

A byte-level vocabulary never merges across its pre-tokeniser's pieces, so the
ids of a text are the ids of its pieces in order. The pieces are found for a
whole slice at once, and the distinct ones are merged together. Nothing is kept
from slice to slice but the vocabulary's tables.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from evalspark.llm.merging import RankMerger
from evalspark.llm.textkit import kept, raw

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# The characters with Unicode's White_Space property.
WHITE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The suffixes that the pre-tokeniser keeps with their apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The pre-tokeniser's class of every character of the basic plane."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x10000)], np.uint8)
    table[WHITE] = SPACE
    return table


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pieces of all rows, and the number of pieces before each row and after the last.

    Characters beyond the basic plane count as OTHER here; the caller encodes
    rows that hold any with the library as a whole.
    """
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind = np.where(points < 0x10000, classes()[np.minimum(points, 0xFFFF)], OTHER).astype(np.uint8)
    size = len(points)
    rows = np.searchsorted(chars, offsets)
    flag = np.ones(size + 1, bool)
    flag[1:size] = kind[1:] != kind[:-1]
    edge = np.zeros(size + 1, bool)
    edge[rows] = True
    flag |= edge
    begins = np.flatnonzero(flag[:size])
    # blanks before a word: the last one joins the word if it is a plain space, else it stands alone
    last = begins[1:][(kind[begins[:-1]] == SPACE) & ~edge[begins[1:]]] - 1
    flag[last] = True
    flag[last[points[last] == 0x20] + 1] = False
    # an apostrophe alone before a letter suffix
    padded = np.concatenate([points, np.zeros(4, np.uint32)])
    closed = np.concatenate([edge, np.ones(4, bool)])
    mark = np.flatnonzero((points == 0x27) & flag[:size])
    mark = mark[~closed[mark + 1]]
    mark = mark[(np.concatenate([kind, [OTHER]])[mark + 1] == LETTER)]
    for suffix in SUFFIXES:
        fits = np.ones(len(mark), bool)
        for k, letter in enumerate(suffix):
            fits &= (padded[mark + 1 + k] == ord(letter)) & ~closed[mark + 1 + k]
        hit = mark[fits]
        flag[hit + 1] = False
        flag[hit + 1 + len(suffix)] = True
    starts = np.flatnonzero(flag[:size])
    return np.append(chars[starts], len(data)), np.searchsorted(starts, rows)


def expand(ids: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids behind ``codes``, flat, and the number of each; ``ids`` and ``counts`` hold them per distinct entry."""
    starts, wanted = np.cumsum(counts) - counts, counts[codes]
    ends = np.cumsum(wanted)
    place = np.repeat(starts[codes] - (ends - wanted), wanted) + np.arange(int(ends[-1]) if len(ends) else 0)
    return ids[place], wanted


class ByteVocabulary:
    """A byte-level vocabulary: the ids of single bytes, its joins, and the library's own call for whole texts."""

    def __init__(self, first: np.ndarray, merger: RankMerger, whole: Callable[[list[str]], list[list[int]]]):
        self.first, self.merger, self.whole = first, merger, whole

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, flat, and the number of ids of each row. Equal pieces are merged once a call.

        Rows with characters beyond the basic plane go to the library.
        """
        edges, rows = split_pieces(data, offsets)
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct, where = raw(coded.dictionary)
        found, sizes = self.merger.merged(self.first[distinct], where[:-1])
        ids, counts = expand(found, sizes, coded.indices.to_numpy(zero_copy_only=False))
        total = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=total[1:])
        ends = total[rows]
        lengths = np.diff(ends)
        four = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data >= 0xF0, out=four[1:])
        rare = np.flatnonzero(np.diff(four[offsets]))
        if len(rare):
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            strings = [data[offsets[r]: offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in rare]
            for r, own in zip(rare, self.whole(strings)):
                parts[r], lengths[r] = np.array(own, np.int32), len(own)
            ids = np.concatenate(parts)
        return ids, lengths


@kept
def byte_bpe(path: str) -> ByteVocabulary:
    """The vocabulary of a tokenizers file. Strings of special tokens inside a text are ordinary text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    # printable bytes stand for themselves, the others for the characters from 256 on, in order
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ids = model["vocab"]
    first = np.array([ids[names[b]] for b in range(256)], np.int32)
    pairs = [(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])]

    def whole(strings: list[str]) -> list[list[int]]:
        return [x.ids for x in library.encode_batch_fast(strings, add_special_tokens=False)]

    return ByteVocabulary(first, RankMerger(*zip(*pairs), max(ids.values()) + 1), whole)


@kept
def rank_bpe(path: str) -> ByteVocabulary:
    """The vocabulary of a tiktoken file with the usual pattern: two tokens join if their bytes are a token."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    pairs = [(ranks[t[:k]], ranks[t[k:]], rank, rank)
             for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return ByteVocabulary(
        first, RankMerger(*zip(*pairs), max(ranks.values()) + 1), lambda strings: [library.encode_ordinary(t) for t in strings])
