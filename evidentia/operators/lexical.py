"""Candidates of questions by their words: postings in blocks, traversed with maximum scores.

A task turns its chunks into blocks of postings: for each asked word the places, in order of the key, of the chunks that
hold it. No posting is exchanged, only the numbers of chunks that hold each word, and then k rows of each question and task.

Scoring goes through a task's blocks and keeps the k best of each question. Words weigh the same in every chunk, so a
block's maximum for a question is the sum of the weights of its words that the block holds at all; a block below the worst
kept score is passed over. In the others the lightest words, which together can't lift a chunk to that score, only add to
the candidates that heavier words bring, and a candidate goes as soon as what is left can't lift it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.retrieval import BLOCK, DIGITS, ranked, words
from evidentia.staging import discard, stage

#: Chunks of a block, and postings after which it is closed early.
PLACES, POSTINGS = 8_192, 1_000_000
#: Words of questions (each question's count) that are sent to every task at most.
WORDS = 1_000_000
#: Sums are rounded, so what is pruned must be lower by more than this.
SLACK = 10.0**-DIGITS


def postings(chunks: DataFrame, vocabulary: list[str], key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """(n, keys, words, counts, places): blocks of a task's chunks; words are numbers in ``vocabulary``, places ascend."""
    known = pa.array(vocabulary, pa.string())
    kind = chunks.schema[key].dataType

    def block(keys: pa.Array, places: np.ndarray, own: np.ndarray, n: int) -> dict:
        order = pc.sort_indices(keys).to_numpy()
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        places = at[places]
        by = np.lexsort((places, own))
        held, counts = np.unique(own, return_counts=True)
        return {"n": n, "keys": keys.take(pa.array(order)), "words": held.astype(np.int32), "counts": counts.astype(np.int32), "places": places[by]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin = 0
            lists = b.column(1)
            while begin < b.num_rows:
                part = lists.slice(begin, PLACES)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy())
                size = max(1, int(np.searchsorted(ends, POSTINGS, side="right")))
                part, keys = part.slice(0, size), b.column(0).slice(begin, size)
                own = pc.index_in(part.flatten(), value_set=known)
                fine = own.is_valid().to_numpy(zero_copy_only=False)
                places = pc.list_parent_indices(part).to_numpy()[fine].astype(np.int32)
                row = block(keys, places, own.drop_null().to_numpy(), len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["n"]], pa.int64())] + [pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), row[c] if c == "keys" else pa.array(row[c], pa.int32())) for c in ("keys", "words", "counts", "places")],
                    ["n", "keys", "words", "counts", "places"],
                )
                begin += size

    numbers = T.ArrayType(T.IntegerType())
    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(kind)), *(T.StructField(c, numbers) for c in ("words", "counts", "places"))])
    return chunks.select(key, words(F.col(text)).alias("words")).mapInArrow(run, out)


class Question:
    """A question's words, heaviest first, and its best chunks so far: (-sum, key)."""

    def __init__(self, own: np.ndarray, weights: np.ndarray, k: int) -> None:
        order = np.lexsort((own, -weights[own]))
        self.own, self.weights, self.k = own[order], weights[own[order]], k
        self.best: list[tuple[float, object]] = []
        self.read = self.passed = 0

    def worst(self) -> float:
        return -self.best[-1][0] if len(self.best) == self.k else 0.0

    def traverse(self, at: np.ndarray, lists: list[np.ndarray], keys: list, sums: np.ndarray) -> None:
        """One block. at: the list of each word (-1: none); sums: zeros, and left so."""
        rows = at[self.own]
        here = rows >= 0
        weights, rows = self.weights[here], rows[here]
        least = self.worst() - SLACK
        if not len(rows) or weights.sum() < least:
            self.passed += 1
            return
        self.read += 1
        left = weights[::-1].cumsum()[::-1]  # of this word and the lighter ones
        essential = max(1, int(np.searchsorted(-left, -least, side="right")))  # the rest alone stays below
        brought = [lists[r] for r in rows[:essential].tolist()]
        for places, w in zip(brought, weights[:essential].tolist(), strict=True):
            sums[places] += w
        places = np.unique(np.concatenate(brought)) if len(brought) > 1 else brought[0]
        got = sums[places]
        sums[places] = 0
        for k in range(essential, len(rows)):
            fine = got + left[k] >= least
            places, got = places[fine], got[fine]
            if not len(places):
                return
            own = lists[rows[k]]
            found = np.minimum(np.searchsorted(own, places), len(own) - 1)
            got = got + np.where(own[found] == places, weights[k], 0.0)
        got = np.round(got, DIGITS)
        fine = np.flatnonzero(got >= self.worst())
        if len(fine) > self.k:
            fine = fine[got[fine] >= np.partition(got[fine], len(fine) - self.k)[len(fine) - self.k]]
            fine = fine[np.argsort(-got[fine], kind="stable")[: self.k]]  # places ascend with keys
        new = [(-s, keys[p]) for s, p in zip(got[fine].tolist(), places[fine].tolist(), strict=True)]
        if new:
            self.best = sorted([*self.best, *new])[: self.k]


def _scored(blocks: DataFrame, shared, k: int) -> DataFrame:
    kind = blocks.schema["keys"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns, weights = shared.value
        asked = [Question(own, weights, k) for own in owns]
        at, sums, key_type = np.full(len(weights), -1, np.int32), np.zeros(PLACES), None
        for b in batches:
            key_type = key_type or b.column(0).type.value_type
            for keys, held, counts, places in zip(*(b.column(c) for c in range(4)), strict=True):
                held, counts, places = (x.values.to_numpy(zero_copy_only=False) for x in (held, counts, places))
                at[held] = np.arange(len(held), dtype=np.int32)
                lists, own = np.split(places, np.cumsum(counts)[:-1]), keys.as_py()
                for q in asked:
                    q.traverse(at, lists, own, sums)
                at[held] = -1
        if key_type is not None:
            rows = [(n, key, -s) for n, q in enumerate(asked) for s, key in q.best]
            reads = [(n, q.read, q.passed) for n, q in enumerate(asked)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in [*rows, *reads]], pa.int32()), pa.array([r[1] for r in rows] + [None] * len(reads), key_type), pa.array([r[2] for r in rows] + [None] * len(reads), pa.float64()),
                 pa.array([None] * len(rows) + [r[1] for r in reads], pa.int64()), pa.array([None] * len(rows) + [r[2] for r in reads], pa.int64())],
                ["_n", "_key", "_sum", "read", "passed"],
            )

    out = T.StructType([T.StructField("_n", T.IntegerType()), T.StructField("_key", kind), T.StructField("_sum", T.DoubleType()), T.StructField("read", T.LongType()), T.StructField("passed", T.LongType())])
    return blocks.select("keys", "words", "counts", "places").mapInArrow(run, out)


def search(chunks: DataFrame, questions: DataFrame, k: int, key: str = "chunk_id", by: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(by, key, word_sum, vector_rank) of the k best chunks of each question, and (by, blocks_read, blocks_passed)."""
    spark, chunks = chunks.sparkSession, chunks.filter(F.col(key).isNotNull())
    asked = stage(questions.select(F.monotonically_increasing_id().alias("_id"), by, words(F.col("question")).alias("_words")), "asked")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_words")), F.lit(0)).alias("w")).first()
    n_blocks = max(1, math.ceil(size.n / BLOCK), math.ceil(size.w / WORDS))
    found, reads = [], []
    for b in range(n_blocks):
        own = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("_id"), F.lit(n_blocks)) == b)
        got = own.orderBy("_id").select("_id", "_words").toArrow()  # BLOCK questions and WORDS words, about
        ids, lists = got["_id"].to_pylist(), [x or [] for x in got["_words"].to_pylist()]
        vocabulary = sorted({w for x in lists for w in x})
        number = {w: i for i, w in enumerate(vocabulary)}
        blocks = stage(postings(chunks, vocabulary, key), "postings")
        total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        weights = np.zeros(len(vocabulary))
        pairs = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("x.words").agg(F.sum("x.counts").alias("n"))
        for w, n in pairs.collect():  # one row for each word of the vocabulary at most
            weights[w] = math.log1p(total / n)
        shared = spark.sparkContext.broadcast(([np.array([number[w] for w in x], np.int64) for x in lists], weights))
        best = stage(_scored(blocks, shared, k), "candidates")
        shared.destroy()
        discard(blocks)
        names = spark.createDataFrame(list(enumerate(ids)), "_n int, _id long").join(asked.select("_id", by), "_id")
        best = best.join(F.broadcast(names), "_n")  # BLOCK rows at most
        found.append(best.filter("read is null").select("_id", by, F.col("_key").alias(key), F.col("_sum").alias("word_sum")))
        reads.append(best.filter("read is not null").select("_id", by, "read", "passed"))
    whole, seen = found[0], reads[0]
    for f, r in zip(found[1:], reads[1:], strict=True):
        whole, seen = whole.unionByName(f), seen.unionByName(r)
    whole = ranked(whole, "_id", [F.desc("word_sum"), F.col(key)], "vector_rank", k).drop("_id")
    return whole, seen.groupBy("_id", by).agg(F.sum("read").alias("blocks_read"), F.sum("passed").alias("blocks_passed")).drop("_id")


def top_k_by_words(chunks: DataFrame, questions: DataFrame, k: int, key: str = "chunk_id", by: str = "question_id") -> DataFrame:
    """The k chunks (``key``, ``chunk_text``) that hold the most of each question's (``by``, ``question``) words, rare ones first.

    A word weighs ln(1 + chunks / chunks that hold it); equal sums go to the smaller key; a chunk without any of the
    words is no candidate, nor is one without a key. Columns of both sides are kept.
    """
    best, _ = search(chunks, questions, k, key, by)
    return chunks.join(best.drop("word_sum"), key).join(questions, by)
