"""Whole jobs with their guards, upserts of wide rows, and small operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import providers
from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.operators import audit, evaluation, jobs, layers, lexical, retrieval, structure
from evidentia.schemas import EVALUATION, MANIFEST
from evidentia.sources import files, manifest, sinks


@pytest.fixture()
def small_partitions(spark):
    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_upsert_loses_no_wide_row(spark, small_partitions):
    n = 40_000
    name = F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 6, "0"))
    source = spark.range(n).select(name.alias("document_name"), F.sha2(name, 256).alias("file_hash"), F.repeat(F.sha2(name, 512), 6).alias("full_text"))
    target = spark.createDataFrame([(7, "d000003", "old", "x"), (9, "other", "h", "y")], "document_id int, document_name string, file_hash string, full_text string")
    got = layers.upsert_documents(target, source).select("document_id", "document_name", F.length("full_text").alias("n")).collect()
    assert len(got) == n + 1 and len({r.document_id for r in got}) == n + 1
    ids = {r.document_name: r.document_id for r in got}
    assert ids["d000003"] == 7 and ids["other"] == 9
    new = [k for k in sorted(ids) if k not in ("d000003", "other")]
    assert [ids[k] for k in new] == list(range(10, 10 + len(new)))
    assert {r.n for r in got if r.document_name != "other"} == {768}


def test_upsert_stops_on_conflicts(spark):
    kind = "document_id int, document_name string, file_hash string"
    target = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2"), (3, "b", "h3")], kind)
    for rows, problem in (([("b", "h9")], "duplicate identity"), ([("c", "h1")], "hash of another document"), ([("c", "h8"), ("c", "h7")], "several source rows")):
        with pytest.raises(ValueError, match=problem):
            layers.upsert_documents(target, spark.createDataFrame(rows, "document_name string, file_hash string"))
    fine = layers.upsert_documents(target.filter("document_id < 3").withColumn("loaded_at", F.lit("old")), spark.createDataFrame([("a", "h1"), ("z", "h9")], "document_name string, file_hash string"), loaded_at=F.lit("now"))
    assert {(r.document_id, r.document_name, r.loaded_at) for r in fine.collect()} == {(1, "a", "now"), (2, "b", "old"), (3, "z", "now")}
    assert layers.upsert_documents(target.limit(0), target.limit(0).drop("document_id")).count() == 0


@pytest.fixture()
def corpus(spark):
    documents = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "document_id int, document_name string, page_count int")
    pages = spark.createDataFrame([(1, 1, "x y z"), (2, 1, "u v")], "document_id int, page_number int, page_text string")
    wanted = documents.select("document_name", F.lit(structure.GENERIC).alias("parser_type"))
    return documents, pages, wanted


def test_build_silver(spark, corpus):
    documents, pages, wanted = corpus
    empty = jobs.build_silver(wanted, documents, pages, spark.createDataFrame([], jobs_schema(spark, corpus)))
    assert {(r.document_id, r.status) for r in empty.status.collect()} == {(1, "rebuilt"), (2, "rebuilt")} and empty.table.count() == 2
    stored = empty.table.withColumn("chunk_text", F.when(F.col("document_id") == 2, "old").otherwise(F.col("chunk_text")))
    again = jobs.build_silver(wanted, documents, pages, stored)
    assert {(r.document_id, r.status) for r in again.status.collect()} == {(1, "unchanged"), (2, "rebuilt")}
    assert {r.chunk_text for r in again.table.collect()} == {"x y z", "u v"}
    dry = jobs.build_silver(wanted, documents, pages, stored, dry_run=True)
    assert {(r.document_id, r.status) for r in dry.status.collect()} == {(1, "unchanged"), (2, "would_rebuild")} and {r.chunk_text for r in dry.table.collect()} == {"x y z", "old"}


def jobs_schema(spark, corpus):
    from evidentia.operators import chunking

    documents, pages, _ = corpus
    return chunking.chunks(structure.parse_generic(structure.line_records(pages))).schema


@pytest.mark.parametrize("change, problem", [("pages", "page_count"), ("twice", "is stored 2 times"), ("none", "is stored 0 times"), ("blank", "no chunks"), ("parser", "no such parser"), ("counts", "structure differs")])
def test_build_silver_guards(spark, corpus, change, problem):
    documents, pages, wanted = corpus
    stored, expected = spark.createDataFrame([], jobs_schema(spark, corpus)), None
    if change == "pages":
        documents = documents.withColumn("page_count", F.lit(2))
    if change == "twice":
        documents = documents.unionByName(documents.filter("document_id = 1").withColumn("document_id", F.lit(5)))
    if change == "none":
        wanted = wanted.withColumn("document_name", F.lit("unknown"))
    if change == "blank":
        pages = pages.withColumn("page_text", F.lit(" "))
    if change == "parser":
        wanted = wanted.withColumn("parser_type", F.lit("table_layout"))
    if change == "counts":
        expected = spark.createDataFrame([(1, "article", 3)], "document_id int, section_type string, expected int")
    with pytest.raises(Exception, match=problem):
        jobs.build_silver(wanted, documents, pages, stored, expected=expected).status.collect()


def test_build_gold_guards(spark):
    gold = spark.createDataFrame([], "chunk_id int, chunk_hash string, embedding_input_hash string, model_id string, model_version string, embedding array<float>")
    embed = lambda d: providers.embed(d, "chunk_text", 4)
    rows = [(1, "d", "text", "h"), (2, "d", "more", "h2"), (3, "e", "other", "h3")]
    silver = spark.createDataFrame(rows, "chunk_id int, document_name string, chunk_text string, chunk_hash string")
    built = jobs.build_gold(silver, gold, "m", "1", embed, ["d"])
    assert {r.chunk_id for r in built.table.collect()} == {1, 2}
    assert {r.status for r in jobs.build_gold(silver, built.table, "m", "1", embed, ["d"]).status.collect()} == {"current"}
    assert jobs.build_gold(silver, gold, "m", "1", embed, limit=1).rows.count() == 1
    for column, problem in (("chunk_hash", "no chunk_hash"), ("chunk_text", "no chunk_text")):
        with pytest.raises(Exception, match=problem):
            jobs.build_gold(silver.withColumn(column, F.lit(" ")), gold, "m", "1", embed).status.collect()


def test_answer_guards(spark):
    chunks = spark.createDataFrame([(1, "d", "red green blue", "t", "r", "n", 1, 2)], "chunk_id int, document_name string, chunk_text string, section_type string, section_reference string, section_title string, page_start int, page_end int")
    search = lambda q, k: lexical.top_k_by_words(chunks, q, k)
    asked = spark.createDataFrame([(1, "which green"), (2, "nothing known")], "question_id int, question string")
    score = retrieval.overlap_score(F.col("question"), F.col("chunk_text"))
    for sizes in ((20, 0), (0, 1), (3, 4)):
        with pytest.raises(ValueError):
            jobs.evidence(asked, search, score, *sizes)
    with pytest.raises(Exception, match="blank question"):
        jobs.evidence(asked.withColumn("question", F.lit(" ")), search, score).collect()
    model = lambda d: providers.generate(d, lambda prompts: ["fine [S1]" for _ in prompts])
    got = jobs.grounded(asked, search, score, model).collect()
    assert [(r.question_id, r.answer, r.citation_status) for r in got] == [(1, "fine [S1]", "ok")]
    for wrong, problem in ((lambda p: ["[S9]"] * len(p), "citations"), (lambda p: [" "] * len(p), "empty answer"), (lambda p: [], "empty answer")):
        with pytest.raises(Exception, match=problem):
            jobs.grounded(asked, search, score, lambda d, w=wrong: providers.generate(d, w)).collect()


def test_evaluate_guards(spark):
    kind = "id string, expected_document string, expected_sources array<struct<section_type: string, section_reference: string, pdf_pages: array<int>>>"
    questions = spark.createDataFrame([(q, "d.pdf", [("article", "A 1" if q != "lost" else "A 9", None)]) for q in ("ok", "lost", "strange", "many")], kind)
    inventory = spark.createDataFrame([(1, "d", "article", "A 1", 1, 1, True)], "chunk_id int, document_name string, section_type string, section_reference string, page_start int, page_end int, searchable boolean")
    found = spark.createDataFrame([("ok", 1), ("lost", 1), ("strange", 1), *[("many", 1)] * 3], "id string, chunk_id int").join(inventory, "chunk_id")
    found = found.withColumns({"vector_rank": F.lit(1), "chunk_text": F.lit("t"), "similarity": F.lit(0.5)})
    after = found.withColumns({"rerank_rank": F.lit(1), "reranker_score": F.lit(0.5), "chunk_id": F.when(F.col("id") == "strange", 77).otherwise(F.col("chunk_id"))}).dropDuplicates(["id"])
    got = {r.id: (r.status, r.error_stage, r.error, r.vector_hit, r.reranked_hit) for r in jobs.evaluate(questions, inventory, found, after, 2, 1).collect()}
    assert got == {
        "ok": ("completed", None, None, True, True),
        "lost": ("unresolved_ground_truth", None, None, None, None),
        "strange": ("error", "reranking", "source is no candidate", None, None),
        "many": ("error", "vector_retrieval", "too many candidates", None, None),
    }


def test_manifest_and_evaluation_files(spark, tmp_path):
    raw = spark.createDataFrame([("1", " ", None, [])], MANIFEST)
    assert {r.problem for r in manifest.corpus_violations(raw).collect()} == {"corpus_id must be a text", "corpus_version must be a text", "documents must be a list that isn't empty"}
    data = {"schema_version": "2", "documents": {"k": {"document_name": "d"}}, "questions": [{"id": "q1", "document_key": "k", "question": "?"}, {"id": "q2", "document_key": "x", "question": "?"}]}
    path = tmp_path / "e.json"
    path.write_text(json.dumps(data), encoding="utf-8-sig")
    found = evaluation.file_violations(spark.read.schema(EVALUATION).json(str(path), multiLine=True))
    assert {(r.id, r.problem) for r in found.collect()} == {(None, "schema_version is not 1.0"), ("q2", "document of the key has no name")}
    import hashlib

    assert files.file_hash(spark, str(path)) == hashlib.sha256(path.read_bytes()).hexdigest()
    lines = tmp_path / "q.json"
    lines.write_text('{"question_id": "a", "question": "b"}\n{"question_id": "a", "question": "c"}\n')
    with pytest.raises(Exception, match="repeats"):
        files.read_questions(spark, str(lines)).collect()


def test_audit_findings(spark):
    report = spark.createDataFrame([("a", ["w"], []), ("b", [], [])], "document_id string, warnings array<string>, failures array<string>")
    none = spark.createDataFrame([], "file_name string")
    assert audit.exit_code(audit.findings(report, none)) == 0
    found = audit.findings(report, spark.createDataFrame([("z.pdf",), ("y.pdf",)], "file_name string"), "Timeout: x")
    assert {(r.level, r.message) for r in found.collect()} == {("failure", "files unknown to the manifest: y.pdf, z.pdf"), ("warning", "a: w"), ("warning", "stored layers can't be read: Timeout: x")}
    assert audit.exit_code(found) == 1 and audit.exit_code(found, spark.createDataFrame([("p",)], "problem string")) == 2
    assert [d["document_id"] for d in audit.as_json(report, found)["documents"]] == ["a", "b"]


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("q2", "=1+1", True, None), ("q1", "plain", None, 3)], "id string, question string, vector_hit boolean, first_vector_hit_rank int")
    for _ in range(2):
        sinks.write_summary(records, str(tmp_path / "s.csv"))
        sinks.write_report(spark, {"a": 1}, str(tmp_path / "r.json"))
    data = (tmp_path / "s.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbfid,status,question") and data.count(b"\r\n") == 3 and b"q2,,'=1+1" in data and data.index(b"q1") < data.index(b"q2")
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1} and not (tmp_path / "r.json.part").exists()
    schema = spark.createDataFrame([], "id string, question string, vector_hit boolean, first_vector_hit_rank int, more double").schema
    assert sinks.evolved(records, schema).filter("more is null").count() == 2
    for wrong in ("id string", "id int, question string, vector_hit boolean, first_vector_hit_rank int"):
        with pytest.raises(ValueError):
            sinks.evolved(records, spark.createDataFrame([], wrong).schema)


def test_small_functions(spark):
    assert providers.in_order([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    for items in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(1, [1.0]), (2, [1.0])]):
        with pytest.raises(ValueError):
            providers.in_order(items, 2)
    assert len(providers.embed_question("a b", 8)) == 8
    for reply in ([[1.0], [1.0]], [[math.nan]], []):
        with pytest.raises(ValueError):
            providers.embed_question("a", 1, lambda t, r=reply: r)
    vectors = spark.createDataFrame([(1, [3.0, 4.0], [3.0, 4.0]), (2, [0.0], [1.0]), (3, [1.0], [1.0, 2.0]), (4, None, [1.0])], "id int, a array<double>, b array<double>")
    own = V.strict_cosine(F.col("a"), F.col("b"))
    assert vectors.filter("id = 1").select(own.alias("c")).first().c == pytest.approx(1)
    for i, problem in ((2, "zero"), (3, "dimensions"), (4, "missing")):
        with pytest.raises(Exception, match=problem):
            vectors.filter(F.col("id") == i).select(own).collect()
    r = spark.sql("SELECT timestamp '2026-08-28 13:24:09' AS t, 0.123456D AS x, CAST(NULL AS DOUBLE) AS n").select(
        X.run_id(F.col("t"), F.lit("ab")).alias("run"), X.utc_text(F.col("t")).alias("utc"), X.seconds(F.col("x")).alias("s"), X.four_digits(F.col("x")).alias("f"), X.percent(F.col("x")).alias("p"), X.percent(F.col("n")).alias("n")
    )
    assert tuple(r.first()) == ("20260828T132409Z_ab", "2026-08-28T13:24:09+00:00", 0.1235, "0.1235", "12.3%", "n/a")
