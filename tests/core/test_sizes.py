"""Jobs at size: what is exchanged, listed and kept on disk; and numbers at the edges of what they count."""

import hashlib
import re

from pyspark.sql import functions as F

from evidentia.operators import layers, stores, structure
from evidentia.sources import files


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_lines_are_exchanged_by_document_alone(spark):
    lines = ["WHEREAS:", "(0) no", "(1) yes", "(3) no", "(2) yes", "HAVE ADOPTED THIS REGULATION:", "Article 0", "Article 1", "Article 99999999999999999999", "Article 3", "Article 2", "Article 2"]
    pages = spark.createDataFrame([(1, 1, "\n".join(lines)), (2, 1, "Article 1")], "document_id int, page_number int, page_text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = structure.parse_regulation(structure.line_records(pages))
        assert not [x for x in exchanges(got) if "line_no" in x]
        new = spark.createDataFrame([(1, 1, "a" * 9), (2, 1, "b"), (3, 1, None)], "document_id int, chunk_order int, chunk_text string")
        old = new.withColumn("chunk_text", F.when(F.col("document_id") != 2, F.col("chunk_text")))
        status = layers.chunk_status(old, new, ["chunk_text"])
        assert "named_struct(chunk_text, chunk_text" not in status._jdf.queryExecution().optimizedPlan().toString()
        assert {(r.document_id, r.status) for r in status.collect()} == {(1, "unchanged"), (2, "rebuilt"), (3, "unchanged")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = {(r.document_id, r.line_no): r.section_reference for r in got.collect()}
    own = [found[1, k] for k in range(1, len(lines) + 1)]
    assert own == ["Front matter", "Front matter", "Recital 1", "Recital 1", "Recital 2", "Enacting formula", "Enacting formula", "Article 1", "Article 1", "Article 1", "Article 2", "Article 2"]
    assert found[2, 1] == "Front matter"


def test_tasks_list_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LISTED", 3)
    rows = spark.range(40).select(F.concat(F.lit("d "), "id", F.when(F.col("id") % 2 == 0, ".pdf").otherwise(".PdF")).alias("file_name"), F.repeat(F.lit("ä"), F.col("id").cast("int")).alias("content"))
    want = {r.file_name: (len(r.content.encode()), hashlib.sha256(r.content.encode()).hexdigest()) for r in rows.collect()}
    for levels, at in ((0, tmp_path / "flat"), (1, tmp_path / "deep")):
        assert files.write_files(rows, str(at), folders=5 * levels).count() == 40
        inner = next(at.iterdir()) if levels else at
        for n in ("_x.pdf", ".x.pdf", "x.txt"):
            (inner / n).write_text("x")
        (inner / "folder.pdf").mkdir()
        got = files.list_pdfs(spark, f"file://{at}", True, levels)
        assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
        found = got.collect()
        assert len(found) == 40 and {r.file_name: (r.length, r.sha256) for r in found} == want
        assert {r.path for r in found} == {r.path for r in files.list_pdfs(spark, f"file://{at}", levels=levels).collect()}
    assert len(list((tmp_path / "deep").iterdir())) == 5
    (tmp_path / "none").mkdir()
    assert files.list_pdfs(spark, str(tmp_path / "none"), True).count() == 0


def test_texts_of_a_build_are_not_exchanged_to_number_them(spark, tmp_path):
    kind = "document_id int, document_name string, file_hash string, full_text string"
    source = spark.createDataFrame([("b", "h2", "text b"), ("a", "h1", "text a")], "document_name string, file_hash string, full_text string")
    got = layers.upsert_documents(spark.createDataFrame([], kind), source)
    assert "_range" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.document_id, r.document_name, r.full_text) for r in got.collect()} == {(1, "a", "text a"), (2, "b", "text b")}
    rows = [(d, k, None, f"{d}/{k}") for d in (5_000, 3, 70_000, 3_999) for k in range(1, d % 7 + 3)] + [(9, 1, 4, "stored")]
    chunks = spark.createDataFrame(rows, "document_id int, chunk_order int, chunk_id int, chunk_text string")
    numbered = stores._with_ids(chunks, chunks.filter("document_id = 9"))
    assert "chunk_text" not in str(exchanges(numbered)) and not [x for x in exchanges(numbered) if "_range" in x]
    new = sorted((r.document_id, r.chunk_order, r.chunk_id) for r in numbered.collect() if r.document_id != 9)
    assert [i for _, _, i in new] == list(range(5, 5 + len(new))) and len(new) == len(rows) - 1
