"""Retrieval over all questions and rows, against brute force."""

import collections
import math
import re

import numpy as np
import pytest

from evidentia import catalog
from evidentia.operators import retrieval


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r.vec_id: np.array(r.embedding, np.float64) for r in rows}


def nearest(vectors, q, k):
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i] for i in ids])
    s = np.round(x @ vectors[q] / np.sqrt((x * x).sum(1)) / np.sqrt((vectors[q] ** 2).sum()), 6)
    return [(float(s[i]), int(ids[i])) for i in np.lexsort((ids, -s))[:k]]


def found(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.question_id, r.vector_rank)):
        got.setdefault(r.question_id, []).append((r.similarity, r.chunk_id))
    return got


def test_every_fiftieth_vector_is_asked(spark, sf_dir, vectors):
    got = found(catalog.queries()["knn_topk_whole"](spark, sf_dir).collect())
    assert set(got) == {i for i in vectors if i % 50 == 0}
    for q, own in got.items():
        want = nearest(vectors, q, 20)
        assert [s for s, _ in own] == pytest.approx([s for s, _ in want], abs=2e-6)
        assert len({i for _, i in own} & {i for _, i in want}) >= 19


def test_more_questions_than_a_block(spark, sf_dir, vectors, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    chunks = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as chunk_id", "embedding")
    questions = chunks.filter("chunk_id % 50 = 0").selectExpr("chunk_id as question_id", "embedding as q")
    got = found(retrieval.top_k_blocks(chunks, questions, 5).collect())
    assert set(got) == {i for i in vectors if i % 50 == 0}
    assert all([s for s, _ in own] == pytest.approx([s for s, _ in nearest(vectors, q, 5)], abs=2e-6) for q, own in got.items())


def words(t):
    return {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}


def test_all_questions_meet_all_chunks(spark, sf_dir):
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    chunks = {r.doc_id: words(r.text) for r in documents if r.doc_id in ids}
    lang = {r.doc_id: r.lang for r in documents}
    times = collections.Counter(w for c in chunks.values() for w in c)
    got = {}
    for r in catalog.queries()["rerank_topk"](spark, sf_dir).collect():
        got.setdefault(r.question_id, {})[r.rerank_rank] = (r.chunk_id, r.vector_rank)
    assert len(asked) > 20
    want, hit = {}, {}
    for q, text in asked.items():
        own = words(text)
        score = {c: round(sum(math.log1p(len(chunks) / times[w]) for w in own & held), 6) for c, held in chunks.items() if own & held}
        rank = {c: k + 1 for k, c in enumerate(sorted(score, key=lambda c: (-score[c], c))[:20])}
        best = sorted(rank, key=lambda c: (-round(len(own & chunks[c]) / max(1, len(own)), 6), rank[c]))[:4]
        if rank:
            want[q] = {k + 1: (c, rank[c]) for k, c in enumerate(best)}
        if q + 20 in lang:
            hit[q] = min((k for c, k in rank.items() if lang[c] == lang[q + 20] and c % 5 + 1 <= 3), default=None)
    assert got == want
    assert {r.id: r.first_rank for r in catalog.queries()["first_hit_rank"](spark, sf_dir).collect()} == hit
    assert {r.question_id for r in catalog.queries()["context_blocks"](spark, sf_dir).collect()} == set(want)
    assert {r.id for r in catalog.queries()["evaluation_records"](spark, sf_dir).collect()} == set(hit)
    assert catalog.queries()["evaluation_summary"](spark, sf_dir).first().questions == len(hit)
    assert sum(r.n for r in catalog.queries()["evaluation_status"](spark, sf_dir).collect()) == len(hit)
    assert {r.id for r in catalog.queries()["anchor_hits"](spark, sf_dir).collect()} == {q for q, k in hit.items() if k}
    answers = catalog.queries()["grounded_answers"](spark, sf_dir).collect()
    assert {r.question_id for r in answers} == set(want) and all(r.citation_status == "ok" for r in answers)
