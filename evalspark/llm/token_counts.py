"""Token counts by rank-synchronous merging over ragged numpy arrays.

A SentencePiece BPE starts from characters and keeps joining the neighbours whose
joined piece ranks best, leftmost first, until no join is in the vocabulary. Here
all sequences of a slice take their steps together: in every round each sequence
joins the pairs of its own best rank at once, and what survives is counted.

A sequence is a pre-token: texts are cut wherever two neighbouring characters
stand side by side in no piece, which no join can cross. Equal pre-tokens of a
slice are merged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.merging import RankMerger
from evalspark.llm.tables import texts
from evalspark.llm.textkit import kept, raw, release, slices

SPACE = "▁"


class MergeTable:
    """Pieces of a SentencePiece BPE as numpy tables: characters, neighbours, ranked pairs.

    Symbols are numbered: pieces by their id, a character outside the vocabulary
    as ``size`` plus its UTF-8 bytes, which is also what it costs in tokens.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError(f"{path}: a vocabulary with byte fallback is needed")
        if any(model.is_unused(k) for k in range(size)):
            raise ValueError(f"{path}: unused pieces are not supported")
        if model.normalize(" A  ﬁ ") != SPACE + " A  ﬁ ".replace(" ", SPACE):
            raise ValueError(f"{path}: only the identity normaliser with a leading blank is supported")
        plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        number = {model.id_to_piece(k): k for k in plain}
        letters = sorted({c for piece in number for c in piece})
        if not all(c in number for c in letters):
            raise ValueError(f"{path}: a character of some piece is no piece")
        self.size = size
        self.cost = np.concatenate([np.ones(size + 1, np.int64), np.arange(1, 5)])
        # the symbol of a letter, and the letter (0: outside the vocabulary) of a code point
        self.symbol = np.array([size, *(number[c] for c in letters)], np.int32)
        self.letter = np.zeros(0x110000, np.uint16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.space = self.letter[ord(SPACE)]
        self.letter[ord(" ")] = self.space
        place = {c: k + 1 for k, c in enumerate(letters)}
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for piece in number:
            for a, b in zip(piece, piece[1:]):
                self.beside[place[a], place[b]] = True
        # pieces of equal score share a rank; two symbols join if their text is a piece
        scores = sorted({model.get_score(k) for k in plain}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        pairs = [
            (number[piece[:k]], number[piece[k:]], rank[model.get_score(whole)], whole)
            for piece, whole in number.items() for k in range(1, len(piece)) if piece[:k] in number and piece[k:] in number
        ]
        self.merger = RankMerger(*zip(*pairs), size + 5)

    def surviving(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The tokens of every sequence: ``starts`` are the first symbols of non-empty sequences in ``symbols``."""
        kept, counts = self.merger.merged(symbols, starts)
        return np.add.reduceat(self.cost[kept], np.cumsum(counts) - counts) if len(kept) else counts

    def count(self, column: pa.Array) -> np.ndarray:
        """The tokens of every text of ``column``; null counts as empty."""
        return self.count_both(column)[0]

    def count_both(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of every text, and those of them that stand for single bytes."""
        data, offsets = raw(column)
        counts, fallen = np.zeros((2, len(offsets) - 1), np.int64)
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return counts, fallen
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        width = np.diff(np.append(lead, len(data)))
        heads = np.searchsorted(lead, offsets[some])
        # a blank before every text
        letters = np.insert(self.letter[points], heads, self.space)
        width = np.insert(width, heads, 1)
        heads = heads + np.arange(len(heads))
        cut = np.ones(len(letters), bool)
        cut[1:] = ~self.beside[letters[:-1], letters[1:]]
        cut[heads] = True
        begin = np.flatnonzero(cut)
        edges = np.append(begin, len(letters)) * 2
        units = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(letters)])
        coded = units.dictionary_encode()
        distinct, where = raw(coded.dictionary)
        survived = self.surviving(self.symbol[distinct.view(np.uint16)], where[:-1] // 2)
        # a character outside the vocabulary stands alone and falls back to its bytes
        foreign = letters[begin] == 0
        bytes_ = np.where(foreign, width[begin], 0)
        each = np.where(foreign, bytes_, survived[coded.indices.to_numpy(zero_copy_only=False)])
        first = np.searchsorted(begin, heads)
        counts[some], fallen[some] = np.add.reduceat(each, first), np.add.reduceat(bytes_, first)
        return counts, fallen


@kept
def merge_table(path: str) -> MergeTable:
    """The tables of a vocabulary file, built once per worker; their size is the vocabulary's."""
    return MergeTable(path)


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(merge_table)
        table = merge_table(path)
        for part in slices(batches):
            counts = table.count(part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts)], names=[*part.schema.names[:-1], "n_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Tokens are those of the SentencePiece BPE in the file ``vocabulary``, without
    begin or end; strings of its control symbols inside a text are ordinary text.
    A null or empty text has none. Repeated rows are counted each, a null
    ``doc_id`` stays null, and other columns are left behind at the scan. Nothing
    is shuffled; memory follows a slice of two megabytes or the longest text.
    """
    found = texts(docs).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    kind = found.schema["doc_id"].dataType.simpleString()
    counted = found.mapInArrow(_counter(vocabulary), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
