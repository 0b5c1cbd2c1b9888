"""Exact nearest chunks through pivots: equal to all pairs, with blocks passed over."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import pivots, retrieval


def clustered(n, size=16, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, size))
    return at[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, size))


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)], f"chunk_id long, embedding array<{kind}>")


def found(df):
    return {(r.question_id, r.chunk_id, r.similarity, r.vector_rank) for r in df.collect()}


@pytest.mark.parametrize("kind, n_pivots, size", [("float", 40, 32), ("double", 3, 7), ("float", 1, 4096)])
def test_equal_to_all_pairs(spark, kind, n_pivots, size):
    x = clustered(1500)
    x[100:130] = x[99]  # copies, whose ties go to the smaller key
    x[7] = 0
    chunks = frame(spark, x, kind).repartition(4)
    odd = spark.createDataFrame([(9001, None), (9002, [1.0]), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (None, [1.0] * 16), (9005, [float("inf")] * 16)], chunks.schema)
    questions = chunks.filter("chunk_id % 40 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("q"))
    questions = questions.union(spark.createDataFrame([(99, [float(v) for v in x[99]]), (-1, [0.0] * 16), (-2, None), (-3, [1.0])], questions.schema))
    got, reads = pivots.search(pivots.index(chunks.union(odd), pivots=n_pivots, size=size), questions, 10)
    assert found(got) == found(retrieval.top_k_blocks(chunks, questions, 10))
    read, passed = reads.agg(F.sum("blocks_read"), F.sum("blocks_passed")).first()
    if n_pivots == 40:
        assert read < 0.4 * (read + passed), (read, passed)  # of clustered vectors


def test_blocks_hold_every_vector_once(spark):
    x = clustered(700)
    x[:300] = x[0]  # a third of all rows around one pivot
    at = pivots.index(frame(spark, x).repartition(3), pivots=20, size=32)
    rows = at.blocks.collect()
    assert sorted(k for r in rows for k in r["keys"]) == list(range(700))
    assert all(len(r["keys"]) <= 32 and len(r.vectors) == 16 * len(r["keys"]) and r.least <= r.largest for r in rows)
    assert len(at.pivots) <= 20


def test_questions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 5)
    chunks = frame(spark, clustered(300))
    questions = chunks.filter("chunk_id < 23").select(F.col("chunk_id").cast("string").alias("question_id"), F.col("embedding").alias("q"))
    got, reads = pivots.search(pivots.index(chunks, pivots=8, size=16), questions, 3)
    assert found(got) == found(retrieval.top_k_blocks(chunks, questions, 3)) and reads.count() == 23


def test_nothing(spark):
    chunks = frame(spark, clustered(20))
    questions = chunks.select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("q"))
    assert pivots.search(pivots.index(chunks.limit(0)), questions, 3)[0].count() == 0
    assert pivots.search(pivots.index(chunks), questions.limit(0), 3)[0].count() == 0
    assert pivots.search(pivots.index(chunks), questions, 30)[0].count() == 400
