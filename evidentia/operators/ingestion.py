"""Guards of ingestion: prepared documents, and documents that must exist once. Plans are lazy, so a dry run is a plan
that isn't written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import strip
from evidentia.sources.files import full_text


def prepared(documents: DataFrame, pages: DataFrame, files: DataFrame, key: str = "document_id") -> DataFrame:
    """``documents`` (key, file_name) with file_hash, full_text and page_count; a document without file, pages or text raises
    an error when the plan runs. files: (file_name, sha256)."""
    counts = pages.groupBy(key).agg(F.count("*").cast("int").alias("page_count"))
    rows = documents.join(files.select("file_name", F.col("sha256").alias("file_hash")), "file_name", "left")
    rows = rows.join(full_text(pages, key), key, "left").join(counts, key, "left")
    problem = (
        F.when(F.col("file_hash").isNull(), "no file").when(F.col("page_count").isNull(), "no pages").when(strip(F.col("full_text")) == "", "no text")
    )
    wrong = F.raise_error(F.concat(F.lit("document "), F.col(key).cast("string"), F.lit(": "), problem))
    return rows.withColumn("file_hash", F.when(problem.isNotNull(), wrong.cast("string")).otherwise(F.col("file_hash")))


def exactly_one(wanted: DataFrame, stored: DataFrame, key: str = "document_name") -> DataFrame:
    """The stored row of each wanted key; a key with none, or with several, raises an error when the plan runs."""
    counts = stored.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("_n"))
    rows = wanted.select(key).distinct().join(counts, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    wrong = F.raise_error(F.concat(F.col(key).cast("string"), F.lit(" is stored "), F.col("_n").cast("string"), F.lit(" times")))
    return stored.join(rows.filter(F.when(F.col("_n") != 1, wrong.cast("boolean")).otherwise(F.lit(True))).select(key), key)


def not_contained(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among those of ``of``: reranked candidates must all have been retrieved."""
    return rows.join(of.select(*keys).distinct(), keys, "left_anti")
