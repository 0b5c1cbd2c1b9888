"""Candidates by words: postings, pruning and ties against a plain version."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators import lexical


def plain(chunks, questions, k):
    words = lambda t: {w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w}
    own = [(c, words(t)) for c, t in chunks if c is not None]
    out = set()
    for q, text in questions:
        asked = words(text)
        weight = {w: math.log1p(len(own) / n) for w in asked if (n := sum(w in x for _, x in own))}
        sums = [(-round(sum(weight[w] for w in asked & x), 6), c) for c, x in own if asked & x]
        out |= {(q, c, -s, rank + 1) for rank, (s, c) in enumerate(sorted(sums)[:k])}
    return out


def made(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    text = lambda m: " ".join(rnd.choice(words[: rnd.choice([3, 10, 60])]) + rnd.choice(["", ",", "-é"]) for _ in range(m))
    chunks = [(c, text(rnd.randrange(0, 25))) for c in rnd.sample(range(10 * n), n)] + [(-1, None), (-2, ""), (None, "w1 w2"), (-3, "w1 " * 3), (-4, "w1 w1")]
    return chunks, [(q, text(rnd.randrange(0, 9))) for q in range(40)] + [(100, None), (101, "nothing here"), (102, "w1"), (102, "w59 w1")]


@pytest.mark.parametrize("places, posted, block, words", [(8192, 10**6, 4096, 10**6), (16, 60, 4096, 10**6), (8, 10**6, 7, 10**6), (64, 10**6, 4096, 20)])
def test_candidates_against_a_plain_version(spark, monkeypatch, places, posted, block, words):
    for name, value in (("PLACES", places), ("POSTINGS", posted), ("BLOCK", block), ("WORDS", words)):
        monkeypatch.setattr(lexical, name, value)
    chunks, questions = made(3, 500)
    c = spark.createDataFrame(chunks, "chunk_id long, chunk_text string").withColumn("other", F.lit(1)).repartition(3)
    q = spark.createDataFrame(questions, "question_id int, question string")
    got, reads = lexical.search(c, q, 5)
    want = set().union(*(plain(chunks, [x], 5) for x in questions))
    assert {(r.question_id, r.chunk_id, r.word_sum, r.vector_rank) for r in got.collect()} == want
    read, passed = reads.agg(F.sum("blocks_read"), F.sum("blocks_passed")).first()
    assert read and passed
    joined = lexical.top_k_by_words(c, q.filter("question_id < 100"), 5)
    assert set(joined.columns) == {"question_id", "chunk_id", "chunk_text", "other", "vector_rank", "question"}
    assert joined.count() == sum(w[0] < 100 for w in want)


def test_blocks_below_the_worst_kept_are_passed_over(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PLACES", 50)
    rows = [(k, "rare common" if k < 10 else "common") for k in range(2_000)]
    c = spark.createDataFrame(rows, "chunk_id long, chunk_text string").coalesce(1)
    got, reads = lexical.search(c, spark.createDataFrame([(1, "rare common")], "question_id int, question string"), 5)
    assert [r.chunk_id for r in got.orderBy("vector_rank").collect()] == [0, 1, 2, 3, 4]
    assert tuple(reads.select("blocks_read", "blocks_passed").first()) == (1, 39)


def test_what_is_exchanged_follows_k(spark):
    chunks, questions = made(4, 3_000)
    c = spark.createDataFrame(chunks, "chunk_id long, chunk_text string").repartition(4)
    q = spark.createDataFrame(questions, "question_id int, question string")
    got, reads = lexical.search(c, q, 3)
    staged = got.inputFiles()
    assert staged and spark.read.parquet(*staged).count() <= 4 * len(questions) * (3 + 1)
    assert reads.count() == len(questions)


def test_text_keys_and_nothing(spark):
    c = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "x")], "chunk_id string, chunk_text string")
    q = spark.createDataFrame([("q", "x y")], "question_id string, question string")
    assert [r.chunk_id for r in lexical.search(c, q, 2)[0].orderBy("vector_rank").collect()] == ["a", "b"]
    assert lexical.search(c.limit(0), q, 2)[0].count() == 0 and lexical.search(c, q.limit(0), 2)[0].count() == 0
