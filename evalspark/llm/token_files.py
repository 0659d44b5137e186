"""Token-id files: a wavelet matrix per shard in compressed Parquet.

Documents are dealt into ranges of their order; a range is one file and one or
more shards (rows). A shard holds the ids of its documents one after the other,
each closed by the end id, as a wavelet matrix, with the documents' ids and
lengths beside it. One file alone gives token access, counts and occurrences.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.llm.pieces import byte_bpe
from evalspark.llm.tables import texts
from evalspark.llm.textkit import SLICE_BYTES, list_column, raw, release, slices
from evalspark.llm.wavelet import WaveletMatrix

SHARD = ("part int, shard int, before bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<int>, "
         "planes array<binary>, ranks array<binary>, zeros array<bigint>")


def _shard(part: int, shard: int, before: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: int) -> pa.RecordBatch:
    n, planes, ranks, zeros = WaveletMatrix.build(ids, bits).parts()
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()),
        pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int32())),
        pa.array([planes], pa.list_(pa.binary())), pa.array([ranks], pa.list_(pa.binary())), pa.array([zeros], pa.list_(pa.int64())),
    ], names=[c.split()[0] for c in SHARD.split(", ")])


def _build(tokenizer: str, end_id: int, bits: int, shard_tokens: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(byte_bpe)
        known = byte_bpe(tokenizer)
        part, shard, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        for piece in slices(batches, limit=min(SLICE_BYTES // 2, 4 * shard_tokens)):
            data, offsets = raw(piece.column("text"))
            ids, counts = known.encode(data, offsets)
            tokens.append(np.insert(ids, np.cumsum(counts), end_id))
            sizes.append(counts + 1)
            docs += piece.column("doc_id").to_pylist()
            held += len(tokens[-1])
            if held >= shard_tokens:
                yield _shard(part, shard, before, docs, np.concatenate(sizes), np.concatenate(tokens), bits)
                shard, before, held, docs, sizes, tokens = shard + 1, before + held, 0, [], [], []
        if docs:
            yield _shard(part, shard, before, docs, np.concatenate(sizes), np.concatenate(tokens), bits)

    return build


def write_tokens(docs: DataFrame, path: str, tokenizer: str, order: list[Column], end_id: int = 0, vocabulary: int = 50_257,
                 part_chars: int = 32_000_000, shard_tokens: int = 2_000_000) -> None:
    """Write the ids of every row of ``docs`` below ``path`` in ascending ``order``.

    A null or empty text is the end id alone. Rows that tie in ``order`` keep
    some order of their own. A file holds about ``part_chars`` characters, a
    shard about ``shard_tokens`` ids or one document. An empty table writes
    files without shards.
    """
    bits = max(1, (vocabulary - 1).bit_length())
    total = docs.agg(F.sum(F.length("text")).cast("bigint")).first()[0] or 0
    parts = max(1, math.ceil(total / part_chars))
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*order).alias("_order"))
    ranged = ranged.repartitionByRange(parts, "_order").sortWithinPartitions("_order").select("doc_id", "text")
    shards = ranged.mapInArrow(_build(tokenizer, end_id, bits, shard_tokens), SHARD)
    shards.write.option("compression", "zstd").parquet(path)


def matrix(row) -> WaveletMatrix:
    """The wavelet matrix of one shard, as read back."""
    return WaveletMatrix(row["n_tokens"], row["planes"], row["ranks"], row["zeros"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, matrix(row).decode(), np.array(row["doc_tokens"], np.int64)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, ids, counts in _decoded(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["doc_ids"], pa.int64()), list_column(ids.astype(np.int32), counts, pa.int32())], names=["doc_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, ids, counts in _decoded(batches):
        wide, ends = ids.astype("<u4"), np.cumsum(counts)
        checks = [zlib.crc32(wide[e - c: e]) for e, c in zip(ends.tolist(), counts.tolist())]
        yield pa.RecordBatch.from_arrays([
            pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(counts), pa.int32()),
            pa.array(row["before"] + ends - counts), pa.array(counts), pa.array(checks, pa.int64()),
        ], names=["doc_id", "part", "inner", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` of every document in the files, end id included."""
    return spark.read.schema(SHARD).parquet(path).mapInArrow(_ids, "doc_id bigint, ids array<int>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all documents before it. One total per file
    visits the driver.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    heads, before = [], 0
    for row in totals:
        heads.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(heads, "part int, head bigint")
    found = shards.mapInArrow(_digests, "doc_id bigint, part int, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(offsets), "part").select(  # one row per file
        "doc_id", (F.col("head") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_table(docs: DataFrame, path: str, tokenizer: str, order: list[Column] | None = None, **options) -> DataFrame:
    """Write the files and read their index back. Without an order, documents ascend by id, ties by a hash of the text."""
    write_tokens(texts(docs) if order is None else docs, path, tokenizer, order or [F.col("doc_id"), F.xxhash64("text")], **options)
    return token_index(docs.sparkSession, path)
