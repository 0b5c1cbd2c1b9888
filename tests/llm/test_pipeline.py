"""The pipeline over the smallest tables: every stage's decisions against the operator's own verdicts."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from evidentia.llm import jaccard
from evidentia.llm.staging import stage, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [table(spark, sf_dir, "documents")]
    for name, apply in P.STAGES:
        docs.append(stage(apply(spark, docs[-1], sf_dir), name))
    return docs


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "jaccard", "mixing", "bpe"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns


def test_filters_keep_clean_documents(stages, spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    clean = stages[0].join(labels.filter("quality = 1 and toxic = 0"), "doc_id", "left_semi").filter(F.size(F.split("text", r"\s+")) >= 60)
    kept = clean.join(stages[2], "doc_id", "left_semi").count()
    assert kept >= 0.9 * clean.count()
    toxic = stages[0].join(labels.filter("toxic = 1"), "doc_id", "left_semi")
    assert toxic.join(stages[1], "doc_id", "left_semi").count() <= 0.3 * toxic.count()


def test_one_of_each_group(stages):
    found = jaccard.link(stages[2])
    assert {r.doc_id for r in stages[3].select("doc_id").collect()} == {r.component_id for r in found.select("component_id").distinct().collect()}


def test_mixture_and_ids(stages):
    assert stages[4].select("doc_id").distinct().count() >= 0.9 * stages[3].count()
    assert stages[5].count() == stages[4].count()
    assert stages[5].filter(F.size("ids") != F.col("n_tokens")).count() == 0


CLASHES = ["_toxicity", "_kept", "_quality", "_copies", "_copy", "_same", "_lone", "_gone", "n_words", "rate", "cls", "score"]


def test_stages_at_their_edges(spark, sf_dir):
    """Null and empty texts, null ids, repeated rows and ids, a very long text, and columns of the helpers' names."""
    labelled = table(spark, sf_dir, "documents").limit(60)
    long = " ".join(f"w{k} of the matter" for k in range(60_000))
    odd = spark.createDataFrame([(9001, None), (9002, ""), (None, "a b"), (None, None), (9003, " \n"), (9004, long), (9004, long), (9005, "one")], "doc_id long, text string")
    docs = labelled.select("doc_id", "text").unionByName(odd).unionByName(labelled.limit(1).select("doc_id", "text"))
    docs = docs.select("doc_id", "text", *[F.lit("z").alias(c) for c in CLASHES])
    docs = stage(docs, "edges")
    for name, apply in P.STAGES:
        got = stage(apply(spark, docs, sf_dir), name)
        if name != "bpe":
            assert got.columns == docs.columns and got.filter("_copies != 'z' or rate != 'z'").count() == 0
        if name == "toxicity":
            assert got.filter("text is null").count() == 2 and got.filter("doc_id is null").count() == 2 and got.filter("doc_id = 9004").count() == 2
        if name == "jaccard":
            assert got.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").count() == 0
        before, docs = docs, got
    assert docs.count() == before.count()


def test_stages_of_nothing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, apply in P.STAGES:
        got = stage(apply(spark, docs, sf_dir), name)
        assert got.count() == 0
        docs = got if name != "bpe" else docs
