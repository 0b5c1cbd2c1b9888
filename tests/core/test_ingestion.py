"""Guards of ingestion."""

import pytest

from evidentia.operators import ingestion


def test_prepared(spark):
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "document_id int, file_name string")
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (2, 1, " \n")], "document_id int, page_number int, page_text string")
    files = spark.createDataFrame([("a.pdf", "h"), ("b.pdf", "g")], "file_name string, sha256 string")
    got = ingestion.prepared(docs.filter("document_id = 1"), pages, files).first()
    assert (got.file_hash, got.full_text, got.page_count) == ("h", "one\n\ntwo\n\n", 2)
    for wrong, why in ((docs, "no text"), (docs.filter("document_id = 1").selectExpr("9 as document_id", "file_name"), "no pages"), (docs.selectExpr("document_id", "'z' as file_name"), "no file")):
        with pytest.raises(Exception, match=why):
            ingestion.prepared(wrong, pages, files).collect()


def test_exactly_one(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "document_name string, x int")
    ask = lambda *names: ingestion.exactly_one(spark.createDataFrame([(n,) for n in names], "document_name string"), stored).collect()
    assert [r.x for r in ask("a", "a")] == [1]
    for name, times in (("b", 2), ("c", 0)):
        with pytest.raises(Exception, match=f"{name} is stored {times} times"):
            ask(name)


def test_not_contained(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "question_id int, chunk_id int")
    assert [tuple(r) for r in ingestion.not_contained(rows, rows.filter("chunk_id = 1"), ["question_id", "chunk_id"]).collect()] == [(1, 2)]
