"""A pipeline of training-data operators over ``documents``: filter, deduplicate, mix and encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Defined results, of every stage: an empty table gives an empty one; equal rows fare alike; further columns are passed on by
all stages but the last, whatever their names. Null and empty texts have no toxic evidence, so they pass ``toxicity``; they
have too few words for ``quality``, which drops them. Rows without an id, which no similarity can name, stay in ``jaccard``
and are taken once by ``mixing``. Rows that repeat an id and its text become one in ``jaccard``; an id's rows of different
texts stay or go together. Very long texts are used whole. Without labels the two filters' models reject nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, jaccard, mixing, quality, toxicity
from evidentia.llm.catalog import vocabulary
from evidentia.llm.staging import fresh, stage, table

#: Shares of tokens in the mixture; the other domains are what the filters before have missed.
WEIGHTS = {"good": 0.97, "poor": 0.02, "toxic": 0.01}


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "_toxicity")
    return toxicity.score(docs, model, column=name).filter(F.col(name) < 0.5).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the regression."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return quality.judge(docs, model, prefix=prefix).filter(F.col(f"{prefix}kept")).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: repeated, once or not at all."""
    found = mixing.mix(docs, table(spark, sf_dir, "labels"), WEIGHTS, anchor="good")
    name, copy = fresh(docs, "_copies"), fresh(docs, "_copy")
    copies = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias(name))
    times = F.coalesce(name, F.lit(1))
    joined = docs.join(copies, "doc_id", "left").filter(times > 0)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hashes of ids and decoded text."""
    return bpe.encode_and_digest(docs.select("doc_id", "text"), vocabulary()).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("quality", keep_quality),
    ("jaccard", deduplicate),
    ("mixing", mix_domains),
    ("bpe", encode),
]

#: The stages' models and the exact join have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
