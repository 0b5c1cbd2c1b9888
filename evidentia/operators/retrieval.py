"""Exact retrieval by cosine similarity and reranking, for batches of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Similarities are compared to so many digits, so that the order of additions decides nothing; ties go to the smaller id.
DIGITS = 6
#: Questions that are sent to every task at most; more are dealt to blocks of this size.
BLOCK = 4_096


def searchable(silver: DataFrame, gold: DataFrame, model_id: str, model_version: str) -> DataFrame:
    """Chunks with an embedding of the given model."""
    own = gold.filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version)).select("chunk_id", "embedding")
    return silver.join(own, "chunk_id")


def with_searchable_flag(silver: DataFrame, gold: DataFrame, model_id: str, model_version: str) -> DataFrame:
    own = gold.filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version)).select("chunk_id").distinct()
    rows = silver.join(own.withColumn("_own", F.lit(True)), "chunk_id", "left")
    return rows.withColumn("searchable", F.col("_own").isNotNull()).drop("_own")


def ranked(rows: DataFrame, by: str, order: list[Column], name: str, most: int) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col(name) <= most)


def top_k_blocks(chunks: DataFrame, questions: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding", by: str = "question_id") -> DataFrame:
    """(by, key, similarity, vector_rank): the k chunks of the greatest cosine similarity for each question (by, query vector ``q``).

    By matrix products, a batch of chunks against all questions of a block.

    Every task keeps its k best of each question, so what is exchanged doesn't grow with the number of pairs.
    """
    asked = questions.select(by, F.col("q").cast("array<double>").alias("q"))
    out: DataFrame | None = None
    blocks = max(1, -(-asked.count() // BLOCK))
    for block in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(by), F.lit(blocks)) == block)
        part = _against(chunks, own, k, key, vector, by)
        out = part if out is None else out.unionByName(part)
    return ranked(out, by, [F.desc("similarity"), F.col(key)], "vector_rank", k)


def _against(chunks: DataFrame, asked: DataFrame, k: int, key: str, vector: str, by: str) -> DataFrame:
    got = asked.toArrow()  # BLOCK rows at most
    ids = got[by].combine_chunks()
    kinds = {f.name: f.dataType.simpleString() for f in [*chunks.schema.fields, *asked.schema.fields]}
    vectors = got["q"].to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vectors[0]) if vectors else 0
        q = np.array([v if v is not None and len(v) == size else [np.nan] * size for v in vectors], np.float64).reshape(len(vectors), size)
        q = q / np.where((n := np.sqrt((q * q).sum(1, keepdims=True))) > 0, n, np.nan)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0)) for _ in vectors]
        for b in batches:
            rows = [i for i, v in enumerate(b.column(1).to_pylist()) if v is not None and len(v) == size and None not in v]
            if not rows or not size:
                continue
            at = pa.array(rows)
            x = np.asarray(b.column(1).take(at).flatten(), np.float64).reshape(-1, size)
            own = np.array(b.column(0).take(at).to_pylist(), object)
            x = x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, np.nan)
            s = np.round(q @ x.T, DIGITS) + 0.0
            for i in range(len(q)):
                fine = np.flatnonzero(np.isfinite(s[i]))
                keys, score = np.concatenate([best[i][0], own[fine]]), np.concatenate([best[i][1], s[i][fine]])
                if len(score) > k:
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                    keys, score = keys[keep], score[keep]
                order = sorted(range(len(keys)), key=lambda j: (-score[j], keys[j]))[:k]
                best[i] = (keys[order], score[order])
        n = [len(keys) for keys, _ in best]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate([b[0] for b in best]).tolist() if n else [], chunk_type), pa.array(np.concatenate([b[1] for b in best]) if n else np.zeros(0))],
            [by, key, "similarity"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    chunk_type = to_arrow_type(chunks.schema[key].dataType)
    return chunks.select(key, vector).mapInArrow(run, f"{by} {kinds[by]}, {key} {kinds[key]}, similarity double")


#: The columns of a piece of evidence, in order.
EVIDENCE = [
    "chunk_id", "document_id", "document_name", "chunk_order", "chunk_text", "section_type", "section_reference", "section_title", "page_start", "page_end",
    "chunking_version", "cosine_distance", "vector_similarity", "vector_rank",
]


def evidence_rows(best: DataFrame, chunks: DataFrame, by: str = "question_id", key: str = "chunk_id") -> DataFrame:
    """(by, the columns of evidence) of retrieved chunks (by, key, similarity, vector_rank); chunks have the others."""
    own = best.select(by, key, F.col("similarity").alias("vector_similarity"), F.round(1 - F.col("similarity"), DIGITS).alias("cosine_distance"), "vector_rank")
    return own.join(chunks, key).select(by, *EVIDENCE)


def words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's different words that the text holds: the reranker that needs no model."""
    own = words(question)
    return F.round(F.size(F.array_intersect(own, words(text))) / F.greatest(F.size(own), F.lit(1)), DIGITS)


def rerank(candidates: DataFrame, k: int, score: Column | Callable[[DataFrame], DataFrame], by: str = "question_id") -> DataFrame:
    """The k candidates of the greatest score; equal scores keep the order of ``vector_rank``.

    score: an expression over the candidates, or a function that adds ``reranker_score`` (a model, in Arrow batches).
    """
    rows = score(candidates) if callable(score) and not isinstance(score, Column) else candidates.withColumn("reranker_score", score)
    return ranked(rows, by, [F.desc("reranker_score"), F.col("vector_rank")], "rerank_rank", k)


def candidate_violations(candidates: DataFrame, most: int, score: str, by: str = "question_id") -> DataFrame:
    """Candidates that no reader could use: too many, or without id, text, name or a finite score."""
    counts = candidates.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(by, F.lit("too many candidates").alias("problem"))
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    wrong = (
        F.when(F.col("chunk_id").isNull(), "no chunk_id")
        .when(blank("chunk_text"), "no chunk_text")
        .when(blank("document_name"), "no document_name")
        .when(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "score is not finite")
    )
    return counts.unionByName(candidates.withColumn("problem", wrong).filter("problem is not null").select(by, "problem"))
