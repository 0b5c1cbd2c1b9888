"""Behaviour of upserts, retrieval, evaluation, audit, files and streams at their edges."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import providers
from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.operators import answers, evaluation, layers, retrieval, validation
from evidentia.sources import files, manifest, sinks
from evidentia.streaming import incremental

VECTORS = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, None), (7, [1.0, 2.0, 3.0]), (8, [None, 1.0]), (9, [0.5, 0.5])]


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(VECTORS, "chunk_id int, embedding array<float>")


def test_vectors(spark, vectors):
    assert [r.chunk_id for r in vectors.filter(V.usable(F.col("embedding"), 2)).collect()] == [1, 2, 3, 9]
    q = F.array(F.lit(1.0), F.lit(0.0))
    got = {r.chunk_id: r.s for r in vectors.select("chunk_id", V.cosine(F.col("embedding"), q).alias("s")).collect()}
    assert got[1] == 1 and math.isnan(got[2]) and got[7] is None


@pytest.mark.parametrize("search", [retrieval.top_k_blocks])
def test_nearest(spark, vectors, search):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "question_id int, q array<double>")
    got = search(vectors.filter("chunk_id not in (5)"), q, 2).orderBy("question_id", "vector_rank").collect()
    assert [(r.question_id, r.chunk_id, r.vector_rank) for r in got] == [(1, 1, 1), (1, 3, 2)]  # ties to the smaller id; none for a zero query
    assert search(vectors.limit(0), q, 2).count() == 0
    assert search(vectors, q.limit(0), 2).count() == 0


def test_rerank_keeps_order_of_ties(spark):
    rows = spark.createDataFrame([(1, 10, 1, "a b", "a"), (1, 11, 2, "a b", "a b"), (1, 12, 3, "a b", "b")], "question_id int, chunk_id int, vector_rank int, question string, chunk_text string")
    got = retrieval.rerank(rows, 2, retrieval.overlap_score(F.col("question"), F.col("chunk_text"))).orderBy("rerank_rank").collect()
    assert [r.chunk_id for r in got] == [11, 10]
    scored = retrieval.rerank(rows, 3, lambda d: providers.score_pairs(d, lambda pairs: [len(t) for _, t in pairs]))
    assert [r.chunk_id for r in scored.orderBy("rerank_rank").collect()] == [11, 10, 12]
    assert retrieval.rerank(rows.limit(0), 2, F.lit(1.0)).count() == 0


def anchor(spark, chunk, expected, document="Doc.PDF"):
    q = spark.createDataFrame([("q", document, [expected])], "id string, expected_document string, expected_sources array<struct<section_type: string, section_reference: string, pdf_pages: array<int>>>")
    c = spark.createDataFrame([("q", 1, *chunk)], "id string, vector_rank int, document_name string, section_type string, section_reference string, page_start int, page_end int")
    return evaluation.first_hit_rank(c, q, "vector_rank").first().first_rank == 1


@pytest.mark.parametrize(
    "chunk, expected, hit",
    [
        (("doc", "article", "Article 6", None, None), ("article", "Article 6", None), True),
        ((" DOC.pdf", "ARTICLE", "article   6", None, None), ("article", "Article 6", None), True),
        (("doc", "article", "Article 60", None, None), ("article", "Article 6", None), False),
        (("other", "article", "Article 6", None, None), ("article", "Article 6", None), False),
        (("doc", "recital", "Article 6", None, None), ("article", "Article 6", None), False),
        (("doc", "article", "Article 6", 2, 4), ("article", "Article 6", [4]), True),
        (("doc", "article", "Article 6", 2, 4), ("article", "Article 6", [1, 5]), False),
        (("doc", "article", "Article 6", None, 4), ("article", "Article 6", [4]), False),
        (("doc", "article", "Article 6", 5, 4), ("article", "Article 6", [4]), False),
        (("doc", "article", "Article ﬁ", 1, 1), ("article", "Article fi", [1]), True),
    ],
)
def test_anchors(spark, chunk, expected, hit):
    assert anchor(spark, chunk, expected) is hit


def test_rates_without_measurements(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("b", None, None, None)], "status string, vector_hit boolean, vector_top_k_hit boolean, reranked_hit boolean")
    got = evaluation.summarize(rows).first()
    assert got.vector_hit_rate is None and got.paired == 0 and got.gained == 0


def test_duplicates_ignore_nulls(spark):
    rows = spark.createDataFrame([(None,), (None,), ("a",), ("a",)], "file_hash string")
    assert [tuple(r) for r in validation.duplicates(rows, ["file_hash"]).collect()] == [("a", 2)]


def test_upserts_of_nothing(spark):
    t = spark.createDataFrame([(1, "a", "h")], "document_id int, document_name string, file_hash string")
    assert layers.upsert_documents(t, t.drop("document_id").limit(0)).collect() == t.collect()
    new = spark.createDataFrame([("c", "1"), ("b", "2")], "document_name string, file_hash string")
    assert sorted((r.document_id, r.document_name) for r in layers.upsert_documents(t.limit(0), new).collect()) == [(1, "b"), (2, "c")]


@pytest.mark.parametrize("answer, status, cited", [("none", "none", []), ("[S0]", "invalid", [0]), ("[S5]", "invalid", [5]), ("[s1]", "none", []), ("[S2][S1] [S2]", "ok", [1, 2]), ("[S" + "9" * 30 + "]", "invalid", [None])])
def test_citations(spark, answer, status, cited):
    got = answers.check_citations(spark.createDataFrame([(answer, 4)], "answer string, n_sources int")).first()
    assert got.citation_status == status and got.cited == cited
    if status != "ok":
        with pytest.raises(Exception, match="citations"):
            answers.answer(spark.createDataFrame([(4,)], "n_sources int"), lambda d: d.withColumn("answer", F.lit(answer))).collect()


def test_texts(spark):
    row = spark.createDataFrame([("  a 　b\x1c c\n", "ﬁ ß", None)], "a string, b string, c string")
    got = row.select(X.squeeze(F.col("a")).alias("a"), X.fold(F.col("b")).alias("b"), X.fold(F.col("c")).alias("c"), X.or_unknown(F.lit("")).alias("d")).first()
    assert tuple(got) == ("a b c", "fi ss", "", "unknown")


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id int, chunk_text string")
    got = {r.id: r.embedding for r in providers.embed(rows, "chunk_text", 16).collect()}
    assert got[1] == got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2])
    with pytest.raises(Exception, match="shape"):
        providers.embed(rows, "chunk_text", 16, lambda t: np.zeros((len(t), 3))).collect()


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "B.PDF").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"y")
    got = files.list_pdfs(spark, str(tmp_path), True).collect()
    assert {r.file_name for r in got} == {"a.pdf", "B.PDF"} and all(len(r.sha256) == 64 for r in got)
    pages = files.pages(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()
    assert sorted((r.file_name, r.page_number, r.page_text) for r in pages) == [("B.PDF", 1, "x"), ("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1", "corpus_id": "c", "corpus_version": "1", "documents": [{"document_id": "a", "file_name": "a.pdf", "enabled": True}]}))
    docs = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    assert docs.first().document_id == "a" and manifest.violations(docs).count() == 10
    with pytest.raises(ValueError):
        manifest.select(docs)
    with pytest.raises(Exception, match="unknown or disabled"):
        manifest.select(docs, ["zz"]).collect()
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        manifest.read_manifest(spark, str(tmp_path / "bad.json")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1", 1), ("b", 2)], "a string, b int")
    sinks.write_csv(df, str(tmp_path / "csv"), ["a", "b"])
    assert {r.a for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=1", "b"}
    sinks.write_report(spark, {"x": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"x": 1}
    sinks.replace_partitions(df, str(tmp_path / "p"), "b")
    sinks.replace_partitions(df.filter("b = 2").withColumn("a", F.lit("c")), str(tmp_path / "p"), "b")
    assert {(r.a, r.b) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("=1", 1), ("c", 2)}
    sinks.write_version(df, str(tmp_path / "t"), 1)
    with pytest.raises(Exception):
        sinks.write_version(df, str(tmp_path / "t"), 1)


def test_stream_of_upserts(spark, tmp_path):
    kind = "document_name string, file_hash string"
    seen = []

    def apply(batch, number):
        target = spark.createDataFrame([], "document_id int, " + kind) if not seen else spark.read.parquet(seen[-1])
        seen.append(sinks.write_version(layers.upsert_documents(target, batch), str(tmp_path / "bronze"), number + 1))

    for rows in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]):  # a hash belongs to one document
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.ingest(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, apply, str(tmp_path / "state")).awaitTermination(120)
    got = {(r.document_id, r.document_name, r.file_hash) for r in spark.read.parquet(seen[-1]).collect()}
    assert got == {(1, "a", "1"), (2, "b", "3"), (3, "c", "4")}
