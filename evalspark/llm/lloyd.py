"""Lloyd's clustering with the dimensions dealt over tasks.

Vectors lie in chunks of rows, and a chunk in column blocks: a task that holds
blocks needs only their slices of the centroids, never whole centroids. In a round
every block gives its exact partial squared distances, the blocks of a chunk are
added and the nearest centroid is taken, and the assignment goes back to the
blocks, each of which moves its own slice to the floor of the mean. All numbers
are integers, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from evalspark.llm.tables import cut
from evalspark.llm.textkit import list_column

BOUND = 1 << 27  # components lie within +-BOUND, so that a squared distance over 64 of them fits 64 bits
BLOCKS = "chunk bigint, block int, n int, vec_ids binary, cells binary"
SLICES = "block int, cells binary"


def _packed(values: np.ndarray) -> bytes:
    """Integers as little-endian planes of bytes, the low one first and only those that hold anything but sign."""
    wide = np.ascontiguousarray(values, "<i8").reshape(-1)
    most = int(max(wide.max(initial=0), ~wide.min(initial=0)))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + wide.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(cells: bytes) -> np.ndarray:
    width = cells[0]
    planes = np.frombuffer(cells, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(-1).astype(np.int64)


def whole_vectors(vectors: DataFrame, dims: int, scale: int = 256) -> DataFrame:
    """``vec_id, cells`` of the vectors with ``dims`` finite components: ``floor(scale * x)`` of each, within ``BOUND``."""
    wide = F.col("embedding").cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = vectors.select("vec_id", wide.alias("embedding")).filter((F.size("embedding") == dims) & finite)
    cell = lambda x: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x * scale)))
    return held.select("vec_id", F.transform("embedding", cell).alias("cells"))


def _deal(chunk_rows: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack rows into chunks, one row per chunk and column block."""
    task, made = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    rows: list[np.ndarray] = []

    def chunk() -> pa.RecordBatch:
        nonlocal made
        cells, vec_ids = np.concatenate(rows), pa.chunked_array(ids).combine_chunks()
        number = (task << 32) + made
        made += 1
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("vec_id", vec_ids.type)])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([vec_ids], names=["vec_id"]))
        at = range(0, cells.shape[1], width)
        return pa.RecordBatch.from_arrays([
            pa.array([number] * len(at), pa.int64()), pa.array(range(len(at)), pa.int32()), pa.array([len(cells)] * len(at), pa.int32()),
            pa.array([sink.getvalue().to_pybytes() if k == 0 else None for k in at], pa.binary()),
            pa.array([_packed(cells[:, k: k + width]) for k in at], pa.binary()),
        ], names=[c.split()[0] for c in BLOCKS.split(", ")])

    for batch in batches:
        values = batch.column("cells")
        flat = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
        at = 0
        while at < batch.num_rows:
            take = min(batch.num_rows - at, chunk_rows - sum(map(len, rows)))
            ids.append(batch.column("vec_id").slice(at, take))
            rows.append(flat[at: at + take])
            at += take
            if sum(map(len, rows)) == chunk_rows:
                yield chunk()
                ids, rows = [], []
    if rows:
        yield chunk()


def _partial_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact squared distances of every block to its slices: ``n`` rows of one number per centroid."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = {c: batch.column(c)[row].as_py() for c in ("chunk", "n", "cells", "slice")}
            cells = _unpacked(one["cells"]).reshape(one["n"], -1)
            centres = _unpacked(one["slice"]).reshape(-1, cells.shape[1])
            most = int(max(np.abs(cells).max(initial=0), np.abs(centres).max(initial=0)))
            # doubles hold these sums exactly while they stay below 2^53
            kind = np.float64 if 4 * cells.shape[1] * most * most < 1 << 53 else np.int64
            a, b = cells.astype(kind), centres.astype(kind)
            apart = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)
            yield pa.RecordBatch.from_arrays([
                pa.array([one["chunk"]], pa.int64()), pa.array([one["n"]], pa.int32()), pa.array([_packed(apart.astype(np.int64))], pa.binary()),
            ], names=["chunk", "n", "apart"])


def _nearest(table: pa.Table) -> pa.Table:
    """Add the blocks of one chunk and take the nearest centroid of every row, the smaller number among equals."""
    total, n = 0, table.column("n")[0].as_py()
    for part in table.column("apart"):
        total = total + _unpacked(part.as_py()).reshape(n, -1)
    cluster = total.argmin(1)
    return pa.table({
        "chunk": pa.array([table.column("chunk")[0].as_py()], pa.int64()),
        "cluster": pa.array([_packed(cluster)], pa.binary()),
        "distance": pa.array([_packed(total[np.arange(n), cluster])], pa.binary()),
    })


def assign(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """``chunk, cluster, distance`` (packed, in row order) of every chunk under the centroids in ``slices``.

    A chunk meets in one task as one row of at most chunk rows x centroids
    numbers per block, whatever its vectors are.
    """
    centres = F.broadcast(slices.withColumnRenamed("cells", "slice"))  # centroids x dimensions numbers
    near = blocks.select("chunk", "block", "n", "cells").join(centres, "block")
    apart = near.select("chunk", "n", "cells", "slice").mapInArrow(_partial_distances, "chunk bigint, n int, apart binary")
    return apart.groupBy("chunk").applyInArrow(_nearest, "chunk bigint, cluster binary, distance binary")


def _block_sums(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the number of vectors of every cluster and their sums, over all chunks that the task sees."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            block, n = batch.column("block")[row].as_py(), batch.column("n")[row].as_py()
            cells = _unpacked(batch.column("cells")[row].as_py()).reshape(n, -1)
            cluster = _unpacked(batch.column("cluster")[row].as_py())
            count, total = held.setdefault(block, (np.zeros(k, np.int64), np.zeros((k, cells.shape[1]), np.int64)))
            count += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            total[present] += np.add.reduceat(cells[order], first)
    for block, (count, total) in sorted(held.items()):
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array([block] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(count[some]),
            list_column(total[some].reshape(-1), np.full(len(some), total.shape[1]), pa.int64()),
        ], names=["block", "cluster", "n", "sums"])


def _move(moved: pa.Table, before: pa.Table) -> pa.Table:
    """The slice of one block: the moved components, and the old ones of empty clusters."""
    cells = _unpacked(before.column("cells")[0].as_py()).copy()
    cells[moved.column("place").to_numpy()] = moved.column("x").to_numpy()
    return pa.table({"block": before.column("block").slice(0, 1), "cells": pa.array([_packed(cells)], pa.binary())})


def move(blocks: DataFrame, assigned: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """The slices after every block has moved its own to the means of the assigned vectors."""
    joined = blocks.select("chunk", "block", "n", "cells").join(assigned.select("chunk", "cluster"), "chunk")
    sums = joined.select("block", "n", "cells", "cluster").mapInArrow(
        partial(_block_sums, k), "block int, cluster int, n bigint, sums array<bigint>")
    wide = sums.select(
        "block", "n", (F.col("cluster") * F.size("sums")).alias("row"), F.posexplode("sums").alias("dim", "x"))
    # exact whatever the number of vectors: one row per task, centroid and component before the shuffle
    total = wide.groupBy("block", (F.col("row") + F.col("dim")).alias("place")).agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").cast("decimal(38,0)").alias("n"))
    means = total.select("block", "place", F.expr("(x - pmod(x, n)) div n").alias("x"))
    # centroids x width rows of a block
    return means.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(_move, SLICES)


def first_slices(held: DataFrame, k: int, width: int, salt: str) -> DataFrame:
    """The slices of the first centroids: the ``k`` vectors with the smallest sha256 of ``salt`` and their id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = held.select(digest.alias("digest"), "cells").orderBy("digest", "cells").limit(k)
    rows = chosen.toArrow()  # k vectors
    if not rows.num_rows:
        return held.sparkSession.createDataFrame([], SLICES)
    cells = np.array(rows.column("cells").to_pylist(), np.int64)
    order = sorted(range(len(cells)), key=lambda r: (rows.column("digest")[r].as_py(), cells[r].tolist()))
    cells = cells[order]
    return held.sparkSession.createDataFrame(
        [(b, bytearray(_packed(cells[:, at: at + width]))) for b, at in enumerate(range(0, cells.shape[1], width))], SLICES)


def _members(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids = pa.ipc.open_stream(batch.column("vec_ids")[row].as_py()).read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([
                ids.cast(kind), pa.array(_unpacked(batch.column("cluster")[row].as_py()), pa.int32()),
                pa.array(_unpacked(batch.column("distance")[row].as_py()), pa.int64()),
            ], names=["vec_id", "cluster", "distance"])


def lloyd(vectors: DataFrame, dims: int, k: int, rounds: int, salt: str = "2:", scale: int = 256, width: int = 32,
          chunk_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Cluster ``vectors`` (``vec_id, embedding``): the members and the final slices of the centroids.

    Members are ``vec_id, cluster, distance`` of every vector with ``dims``
    components, none null or not finite; others have no row. Components become
    ``floor(scale * x)``, held at ``BOUND`` beyond it. Centroids start as the
    ``k`` vectors with the smallest hash of salt and id (ties by components, a
    null id reads as empty text; fewer vectors give fewer centroids), and
    ``rounds`` times all vectors are assigned and all centroids moved; an empty
    one stays. Repeated rows and ids are vectors of their own; other columns are
    left behind. Every step ends in a written table, and all shuffles move chunks
    of ``chunk_rows`` vectors, so no vector, however frequent, is a key.
    """
    if dims > 64:
        raise ValueError("squared distances are exact in 64 bits for up to 64 components")
    held = whole_vectors(vectors, dims, scale)
    blocks = cut(held.mapInArrow(partial(_deal, chunk_rows, width), BLOCKS))
    slices = cut(first_slices(held, k, width, salt))
    for _ in range(rounds):
        slices = cut(move(blocks, cut(assign(blocks, slices)), slices, k))
    found = cut(assign(blocks, slices))
    kind = held.schema["vec_id"].dataType.simpleString()
    arrow = vectors.select("vec_id").limit(0).toArrow().schema.field("vec_id").type
    ids = blocks.filter("block = 0").select("chunk", "vec_ids")
    members = found.join(ids, "chunk").select("vec_ids", "cluster", "distance").mapInArrow(
        partial(_members, arrow), f"vec_id {kind}, cluster int, distance bigint")
    return members, slices


def _slice_texts(width: int, dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
            rows = _unpacked(cells).reshape(-1, min(width, dims - block * width)).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()),
                pa.array([",".join(map(str, r)) for r in rows], pa.string()),
            ], names=["block", "cluster", "text"])


def clusters(vectors: DataFrame, dims: int, k: int, rounds: int, width: int = 32, **options) -> DataFrame:
    """Members of ``lloyd`` with their cluster's and the whole inertia and a digest of their centroid.

    ``centroid_sha256`` is the sha256 of the centroid's components as decimal
    integers joined by commas. An inertia beyond 64 bits is null.
    """
    members, slices = lloyd(vectors, dims, k, rounds, width=width, **options)
    parts = slices.mapInArrow(partial(_slice_texts, width, dims), "block int, cluster int, text string")
    names = parts.groupBy("cluster").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"]), ","), 256).alias("centroid_sha256"))
    inertia = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    total = F.sum("d").over(Window.partitionBy())  # one row per cluster
    held = inertia.select(
        "cluster", F.col("d").try_cast("bigint").alias("cluster_inertia"), total.try_cast("bigint").alias("inertia"))
    return members.join(F.broadcast(held.join(names, "cluster")), "cluster").select(  # one row per cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
