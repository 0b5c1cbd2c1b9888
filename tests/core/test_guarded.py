"""Replies and manifests that may be malformed: a problem for each fault instead of an error; parsers by name."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import providers, replies
from evidentia.operators import structure
from evidentia.schemas import MANIFEST_DOCUMENT
from evidentia.sources import manifest


def test_replies_with_every_fault(spark):
    rows = [
        ('{"choices": [{"message": {"content": " a\\nb "}}]}', "a\nb", None), (None, None, "reply is no JSON"), ("", None, "reply is no JSON"), ("{", None, "reply is no JSON"), ("null", None, "reply has no choices"),
        ('{"choices": {}}', None, "reply has no choices"), ('{"choices": [5]}', None, "first choice has no message"), ('{"choices": [{"message": null}]}', None, "first choice has no message"),
        ('{"choices": [{"message": {}}]}', None, "answer is empty"), ('{"choices": [{"message": {"content": true}}]}', None, "answer is empty"),
    ]
    df = spark.createDataFrame([(r[0], k) for k, r in enumerate(rows)], "reply string, k int")
    got = {r.k: (r.answer, r.problem) for r in df.select("k", replies.completion(F.col("reply")).alias("r")).select("k", "r.*").collect()}
    assert got == {k: r[1:] for k, r in enumerate(rows)}


def test_vectors_of_replies_in_order(spark):
    body = '{"data": [{"index": 1, "embedding": [2, 3.5]}, {"index": 0, "embedding": [1, 1e2]}]}'
    df = spark.createDataFrame([(body, 2), (body, 3), ('{"data": []}', 0), ('{"data": [{"index": 0.0, "embedding": [1]}]}', 1), ('{"data": [{"index": 0, "embedding": [null]}]}', 1), ('{"data": [{"index": 0, "embedding": []}]}', 1)], "reply string, n int")
    got = [(r.vectors, r.problem) for r in df.select(replies.embeddings(F.col("reply"), F.col("n")).alias("r")).select("r.*").collect()]
    assert got == [([[1.0, 100.0], [2.0, 3.5]], None), (None, "reply has another number of embeddings"), ([], None), (None, "indices aren't 0 to n - 1"), (None, "an embedding is no list of numbers"), (None, "an embedding is no list of numbers")]

    def service(texts):
        items = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(texts)]
        return json.dumps({"data": items[::-1]})

    rows = spark.createDataFrame([(k, "x" * k) for k in range(7)], "k int, t string").coalesce(1)
    assert {r.k: list(r.embedding) for r in providers.embed(rows, "t", 2, service, batch=3).collect()} == {k: [float(k), 1.0] for k in range(7)}
    for bad in ({"data": [{"index": 1, "embedding": [1, 1]}]}, {"data": 3}, {"data": []}, {"data": [{"index": True, "embedding": [1, 1]}]}):
        with pytest.raises(ValueError):
            providers.reply_vectors(bad, 1)


def test_manifests_that_are_malformed(spark, tmp_path):
    whole = {f.name: "x" for f in MANIFEST_DOCUMENT.fields} | {"enabled": False}
    good = {"schema_version": "1", "corpus_id": "c", "corpus_version": "2", "documents": [whole, {**whole, "enabled": 1}, {k: v for k, v in whole.items() if k != "language"}, "text", {**whole, "parser_type": None}]}
    for name, text in (("a", json.dumps(good)), ("b", "{"), ("c", '{"documents": []}'), ("d", "7")):
        (tmp_path / f"{name}.json").write_text(text)
    documents, faults = manifest.checked(manifest.read_texts(spark, str(tmp_path)))
    assert [(r.name.rsplit("/", 1)[1], r.document_index, r.enabled, r.language) for r in documents.collect()] == [("a.json", 0, False, "x")]
    got = {(r.name.rsplit("/", 1)[1][0], r.document_index, r.problem) for r in faults.collect()}
    texts = {("c", None, f"{c} must be a text") for c in ("schema_version", "corpus_id", "corpus_version")}
    assert got == texts | {("a", 1, "enabled must be true or false"), ("a", 2, "language is missing"), ("a", 3, "document must be an object"), ("a", 4, "parser_type must be a text"), ("b", None, "manifest is no JSON"), ("c", None, "documents must be a list that isn't empty"), ("d", None, "manifest must be an object")}
    with pytest.raises(Exception, match="[Nn]o manifest|does not exist|not exist"):
        manifest.read_texts(spark, str(tmp_path / "*.none")).count()


def test_dispatch_by_name(spark):
    docs = spark.createDataFrame([(1, "gdpr_2016_679", None), (2, "other", None), (3, "gdpr_2016_679", structure.GENERIC), (4, None, None), (5, "edpb_opinion_202428_ai-models_en", None)], "document_id int, document_name string, parser_type string")
    assert {r.document_id: r.parser_type for r in structure.dispatched(docs).collect()} == {1: structure.REGULATION, 2: structure.GENERIC, 3: structure.GENERIC, 4: structure.GENERIC, 5: structure.OPINION}
    records = spark.createDataFrame([(1, 1, 1, "WHEREAS:"), (1, 2, 1, "(1) x"), (2, 1, 1, "(1) x")], "document_id int, line_no int, page_number int, text string")
    parsed = structure.parse(records, docs.filter("document_id < 3"))
    assert {(r.document_id, r.section_type) for r in parsed.collect()} == {(1, "front_matter"), (1, "recital"), (2, "document")}
    with pytest.raises(ValueError, match="no such parser: odd"):
        structure.parse(records, docs.withColumn("parser_type", F.lit("odd")))
