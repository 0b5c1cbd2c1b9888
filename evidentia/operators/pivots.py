"""Exact nearest chunks by cosine similarity, through blocks around pivots that triangle bounds pass over.

Vectors are scaled to length 1, where the distance d follows from the similarity s: d * d = 2 - 2 * s. Each goes to its
nearest pivot (a bounded sample of the vectors), and the rows sorted by pivot and distance are cut into blocks, each with
the least and largest distance to its pivot. A block can't hold a chunk nearer than t to a question whose distance to the
pivot is more than t below the least, or above the largest.

A search takes two passes: the blocks of each question's nearest pivot give an upper bound of its k-th distance, and then
all blocks within that bound are compared. Nothing is left out that the bound doesn't exclude, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.retrieval import BLOCK, DIGITS, ranked
from evidentia.staging import stage

#: Pivots at most, and vectors of a block.
PIVOTS, SIZE = 256, 2_048
#: Added to bounds for the rounding of similarities and of distances.
SLACK, TINY = 10.0**-DIGITS, 1e-9


@dataclass
class Index:
    """Blocks (pivot, least, largest, keys, vectors), staged, and the pivots."""

    blocks: DataFrame
    pivots: np.ndarray
    key: str


def _usable(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has the size, no null and a finite length above 0, and those vectors at length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fine = np.flatnonzero(sizes == size) if size else np.zeros(0, np.int64)
    own = column.take(pa.array(fine)).flatten()
    x = np.asarray(own.to_numpy(zero_copy_only=False), np.float64).reshape(len(fine), size)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((x * x).sum(1))
    good = np.isfinite(length) & (length > 0)
    return fine[good], x[good] / length[good, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def index(chunks: DataFrame, key: str = "chunk_id", vector: str = "embedding", pivots: int = PIVOTS, size: int = SIZE) -> Index:
    """The blocks of all usable vectors of the most common dimension; pivots are chosen by a hash of the key."""
    rows = chunks.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(F.col("key").isNotNull())
    counts = rows.groupBy(F.size("vector").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), "d").first()
    dimension, n = (counts.d, counts["count"]) if counts else (0, 0)
    share = min(1.0, 4 * pivots / max(n, 1))
    own = rows.filter((F.size("vector") == dimension) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))))
    some = own.orderBy(F.xxhash64("key"), "key").limit(pivots).select("vector").toArrow()  # so many rows at most
    _, at = _usable(some["vector"], dimension)
    at = np.unique(at, axis=0) if len(at) else np.ones((1, max(dimension, 1))) / np.sqrt(max(dimension, 1))
    kind = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("distance", T.DoubleType()), *rows.schema.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine, x = _usable(b.column(1), dimension)
            d = _distances(x, at)
            best = d.argmin(1) if len(x) else np.zeros(0, np.int64)
            take = pa.array(fine)
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), pa.array(d[np.arange(len(x)), best]), b.column(0).take(take), b.column(1).take(take)], ["pivot", "distance", "key", "vector"])

    out = T.StructType([
        T.StructField("pivot", T.IntegerType()), T.StructField("least", T.DoubleType()), T.StructField("largest", T.DoubleType()),
        T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), T.StructField("vectors", rows.schema["vector"].dataType),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one pivot, fewer than a block

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            d = t.column(1).to_numpy()
            flat = t.column(3).flatten()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([t.column(0).slice(0, 1), pa.array([d[0]]), pa.array([d[-1]]), one(t.column(2)), one(flat)], out.fieldNames())

        for b in batches:
            edges = np.flatnonzero(np.diff(b.column(0).to_numpy())) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
                while begin < end:
                    if held and held[0].column(0)[0] != b.column(0)[begin]:
                        yield block()
                    room = size - sum(h.num_rows for h in held)
                    held.append(b.slice(begin, min(room, end - begin)))
                    begin += held[-1].num_rows
                    if room == held[-1].num_rows:
                        yield block()
        if held:
            yield block()

    dealt = rows.mapInArrow(assign, kind).repartitionByRange("pivot", "distance", "key").sortWithinPartitions("pivot", "distance", "key")
    return Index(stage(dealt.mapInArrow(cut, out), "pivots"), at, key)


def _compared(blocks: DataFrame, shared, k: int, first: bool) -> DataFrame:
    """(_n, key, similarity) of each task's k best of each question, and (_n, read, passed).

    first: only the blocks of a question's nearest pivot; else all that its bound doesn't exclude.
    """
    kind = blocks.schema["keys"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, to_pivot, bound = shared.value
        best: list[list[tuple[float, object]]] = [[] for _ in q]  # (-similarity, key)
        read, passed, key_type = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), None
        nearest = to_pivot.argmin(1) if len(q) else np.zeros(0, np.int64)
        for b in batches:
            for pivot, least, largest, keys, vectors in zip(*b.columns, strict=True):
                d, keys = to_pivot[:, pivot.as_py()], keys.values
                key_type = keys.type
                wanted = nearest == pivot.as_py() if first else (d - bound <= largest.as_py() + TINY) & (d + bound >= least.as_py() - TINY)
                read += wanted
                passed += ~wanted
                rows = np.flatnonzero(wanted)
                if not len(rows):
                    continue
                x = np.asarray(vectors.values.to_numpy(zero_copy_only=False), np.float64).reshape(len(keys), -1)
                order = pc.sort_indices(keys)
                keys, x = keys.take(order), x[order.to_numpy()] / np.sqrt((x * x).sum(1))[order.to_numpy(), None]
                for i, own in zip(rows.tolist(), np.round(q[rows] @ x.T, DIGITS) + 0.0, strict=True):
                    have = best[i]
                    good = np.flatnonzero(own >= -have[-1][0]) if len(have) == k else np.arange(len(own))
                    if len(good) > k:
                        good = good[own[good] >= np.partition(own[good], len(good) - k)[len(good) - k]]
                        good = good[np.argsort(-own[good], kind="stable")[:k]]  # keys ascend
                    if len(good):
                        best[i] = sorted([*have, *zip((-own[good]).tolist(), keys.take(pa.array(good)).to_pylist(), strict=True)])[:k]
        if key_type is None:
            return
        rows = [(n, key, -s, None, None) for n, own in enumerate(best) for s, key in own]
        rows += [(n, None, None, int(r), int(p)) for n, (r, p) in enumerate(zip(read, passed, strict=True))]
        kinds = (pa.int32(), key_type, pa.float64(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["_n", "_key", "similarity", "read", "passed"])

    out = T.StructType([T.StructField("_n", T.IntegerType()), T.StructField("_key", kind), T.StructField("similarity", T.DoubleType()), T.StructField("read", T.LongType()), T.StructField("passed", T.LongType())])
    return blocks.mapInArrow(run, out)


def search(at: Index, questions: DataFrame, k: int, by: str = "question_id", vector: str = "q") -> tuple[DataFrame, DataFrame]:
    """(by, key, similarity, vector_rank) of each question's k nearest chunks, and (by, blocks_read, blocks_passed).

    Questions with an unusable vector get no rows. They are sent to all tasks in blocks of ``BLOCK``.
    """
    spark = questions.sparkSession
    asked = stage(questions.select(F.monotonically_increasing_id().alias("_id"), by, F.col(vector).alias("_q")), "asked")
    n_blocks = max(1, -(-asked.count() // BLOCK))
    found, reads = [], []
    for b in range(n_blocks):
        own = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("_id"), F.lit(n_blocks)) == b)
        got = own.orderBy("_id").select("_id", "_q").toArrow()  # BLOCK rows, about
        fine, q = _usable(got["_q"], at.pivots.shape[1])
        ids = got["_id"].to_numpy()[fine].tolist()
        to_pivot = _distances(q, at.pivots)
        bound = np.full(len(q), np.inf)
        blocks = at.blocks
        if len(q):
            near = sorted(set(to_pivot.argmin(1).tolist()))
            first = spark.sparkContext.broadcast((q, to_pivot, bound))
            best = ranked(_compared(blocks.filter(F.col("pivot").isin(near)), first, k, True).filter("read is null"), "_n", [F.desc("similarity")], "_rank", k)
            for row in best.groupBy("_n").agg(F.count("*").alias("c"), F.min("similarity").alias("s")).collect():  # one for each question of the block
                if row.c == k:
                    bound[row._n] = np.sqrt(max(0.0, 2 - 2 * (row.s - SLACK))) + TINY
            first.destroy()
        shared = spark.sparkContext.broadcast((q, to_pivot, bound))
        best = stage(_compared(blocks, shared, k, False), "nearest")
        shared.destroy()
        names = spark.createDataFrame(list(enumerate(ids)), "_n int, _id long").join(asked.select("_id", by), "_id")
        best = best.join(F.broadcast(names), "_n")  # BLOCK rows at most
        found.append(best.filter("read is null").select("_id", by, F.col("_key").alias(at.key), "similarity"))
        reads.append(best.filter("read is not null").select("_id", by, "read", "passed"))
    whole, seen = found[0], reads[0]
    for f, r in zip(found[1:], reads[1:], strict=True):
        whole, seen = whole.unionByName(f), seen.unionByName(r)
    whole = ranked(whole, "_id", [F.desc("similarity"), F.col(at.key)], "vector_rank", k).drop("_id")
    return whole, seen.groupBy("_id", by).agg(F.sum("read").alias("blocks_read"), F.sum("passed").alias("blocks_passed")).drop("_id")
