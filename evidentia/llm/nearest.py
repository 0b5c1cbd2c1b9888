"""Approximate nearest neighbours with an inverted multi-index.

Both halves of the vectors are quantised with a codebook of their own, fitted by k-means on at most SAMPLE vectors; every
vector is indexed in the cell of its two centroids. A query visits centroid pairs by summed distance with a heap (the
multi-sequence traversal) until the visited cells hold SHARE of all vectors (a cell with more than CROWDED times the mean
counts as one of that size, so that one vector's many copies don't end the search), then the entries are reranked by exact
Euclidean distance in double precision. Cells are dealt to shards of bounded size, a cell that is too large to several
shards, and a shard's queries meet its vectors there; queries are dealt to blocks of bounded size.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, neither as queries nor as candidates; rows with the query's own id are no candidates; a query id that occurs more
than once is one query (its smallest vector); equal distances go to the smaller id, equal vectors with different ids are
different candidates; with fewer candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.staging import stage

#: Vectors that the codebooks are fitted on, at most (chosen by a hash of the id).
SAMPLE = 20_000
#: Share of all vectors that a query's visited cells hold.
SHARE = 0.38
#: Vectors that they hold at least.
LEAST = 3_000
CROWDED = 4
#: Vectors of a shard (a SHARDS-th of all between these bounds), and queries of a block and of a task that traverses the index, about.
SHARD = (2_048, 65_536)
SHARDS = 64
BLOCK = 4_096
PROBES = 64
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vector: Column) -> Column:
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(wrong, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from k distinct rows (fewer, if there are fewer); an empty cluster takes the row worst served."""
    own = np.unique(x, axis=0)
    centres = own[np.random.default_rng(1).permutation(len(own))[:k]].copy()
    for _ in range(rounds):
        d = distances(x, centres)
        of = d.argmin(1)
        n = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        worst = np.argsort(-d.min(1))[: (n == 0).sum()]
        centres[n == 0] = x[worst]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


@dataclass
class Index:
    half: int
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # vectors of each cell
    shard: np.ndarray  # first shard of each cell
    spread: np.ndarray  # shards of each cell
    weight: np.ndarray  # what each cell counts for in a search

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = distances(x[:, : self.half], self.first).argmin(1), distances(x[:, self.half :], self.second).argmin(1)
        return a * len(self.second) + b

    def visit(self, q: np.ndarray, share: float) -> list[int]:
        """Cells that hold anything, by summed distance of their centroids, until they hold a share of all weight and LEAST vectors."""
        want = share * self.weight.sum()
        a, b = distances(q[None, : self.half], self.first)[0], distances(q[None, self.half :], self.second)[0]
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, width = a[i].tolist(), b[j].tolist(), len(j)
        heap, seen, found, have, vectors = [(a[0] + b[0], 0, 0)], {0}, [], 0.0, 0
        while heap and (have < want or vectors < LEAST):
            _, x, y = heapq.heappop(heap)
            cell = int(i[x] * width + j[y])
            if self.counts[cell]:
                found.append(cell)
                have += self.weight[cell]
                vectors += int(self.counts[cell])
            for u, v in ((x + 1, y), (x, y + 1)):
                if u < len(a) and v < width and u * width + v not in seen:
                    seen.add(u * width + v)
                    heapq.heappush(heap, (a[u] + b[v], u, v))
        return found


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of ``vectors`` found for each of ``queries`` (columns ``key`` and ``vector`` of both)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("v") == most["d"])
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
    asked = asked.filter(usable(F.col("q")) & (F.size("q") == most["d"]) & F.col("query_id").isNotNull()).groupBy("query_id").agg(F.min("q").alias("q"))

    part = min(1.0, SAMPLE / most["count"])
    some = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    sample = matrix(some.select("v").toArrow()["v"])
    if not len(sample):
        sample = matrix(rows.select("v").limit(1).toArrow()["v"])
    half = max(1, sample.shape[1] // 2)
    size = int(np.clip(round((most["count"] / 1.2) ** 0.5), 4, 256))
    first = kmeans(sample[:, :half], size)
    second = kmeans(sample[:, half:], size) if sample.shape[1] > half else np.zeros((1, 0))
    n_cells = len(first) * len(second)
    index = Index(half, first, second, *(np.zeros(n_cells, np.int64) for _ in range(4)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(matrix(b.column(1))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.astype(np.int32))], ["vec_id", "v", "cell"])

    coded = stage(rows.mapInArrow(code, "vec_id long, v array<double>, cell int"), "index")
    for r in coded.groupBy("cell").count().collect():  # as many rows as cells
        index.counts[r.cell] = r["count"]
    index.weight = np.minimum(index.counts, CROWDED * index.counts[index.counts > 0].mean())
    per_shard = int(np.clip(most["count"] // SHARDS, *SHARD))
    index.spread = np.maximum(1, -(-index.counts // per_shard))
    shard, load = 0, 0
    for cell in range(n_cells):  # neighbouring cells share a shard until it is full
        if load and load + index.counts[cell] > per_shard:
            shard, load = shard + 1, 0
        index.shard[cell] = shard
        if index.spread[cell] > 1:
            shard += int(index.spread[cell])
        else:
            load += int(index.counts[cell])
    n_asked = asked.count()
    blocks = max(1, -(-n_asked // BLOCK))
    asked = asked.repartition(max(1, -(-n_asked // PROBES)), "query_id")
    shared = spark.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []
            x = matrix(b.column(1)) if b.num_rows else np.zeros((0, 1))
            for i, q in enumerate(x):
                by: dict[int, list[int]] = {}
                for cell in own.visit(q, share):
                    for s in range(int(own.shard[cell]), int(own.shard[cell] + own.spread[cell])):
                        by.setdefault(s, []).append(cell)
                out += [(i, s, cells) for s, cells in by.items()]
            at = pa.array([o[0] for o in out], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["query_id", "q", "shard", "cells"]
            )

    probes = asked.mapInArrow(probe, "query_id long, q array<double>, shard long, cells array<int>")
    probes = probes.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            cell = b.column(2).to_numpy()
            turn = spread_of(b.column(0).to_numpy(), own.spread[cell])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.shard[cell] + turn)], ["vec_id", "v", "cell", "shard"])

    dealt = coded.mapInArrow(deal, "vec_id long, v array<double>, cell int, shard long")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, x, cell = right["vec_id"].to_numpy(), matrix(right["v"]), right["cell"].to_numpy()
            for qid, q, cells in zip(left["query_id"].to_pylist(), matrix(left["q"]), left["cells"].to_pylist(), strict=True):
                at = np.flatnonzero(np.isin(cell, cells) & (ids != qid))
                gap = x[at] - q
                d = np.sqrt((gap * gap).sum(1))
                if len(d) > k:
                    keep = d <= np.partition(d, k - 1)[k - 1]
                    at, d = at[keep], d[keep]
                best = np.lexsort((ids[at], d))[:k]
                found += [(qid, v, s) for v, s in zip(ids[at[best]].tolist(), d[best].tolist(), strict=True)]
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    pairs = probes.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInArrow(near, "query_id long, vec_id long, score double")
    w = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def spread_of(ids: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The shard of several that an id of a large cell is dealt to."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % spread.astype(np.uint64)).astype(np.int64)
