"""Validation queries: each returns the rows that violate a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = r"\A[0-9a-fA-F]{64}\z"
LOWER_HASH = r"\A[0-9a-f]{64}\z"


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def missing_required(documents: DataFrame, strings: list[str], positive: list[str]) -> DataFrame:
    """A required text that is null or blank, or a number that is null or not above 0."""
    return documents.filter(any_of([*map(blank, strings), *[F.col(c).isNull() | (F.col(c) <= 0) for c in positive]]))


def missing_source(documents: DataFrame) -> DataFrame:
    return documents.filter(any_of([blank("source_name"), blank("source_url")]))


def short_texts(rows: DataFrame, text: str, least: int) -> DataFrame:
    return rows.filter(F.col(text).isNull() | (F.length(F.trim(text)) < least))


def bad_hashes(rows: DataFrame, column: str, pattern: str = HASH) -> DataFrame:
    return rows.filter(F.col(column).isNull() | ~F.col(column).rlike(pattern))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, none of them null, that occur more than once."""
    own = rows.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    return own.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def bad_page_ranges(chunks: DataFrame) -> DataFrame:
    """Both pages are null, or both set, from 1 and in order."""
    a, b = F.col("page_start"), F.col("page_end")
    fine = (a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & (a > 0) & (b >= a))
    return chunks.filter(~F.coalesce(fine, F.lit(False)))


def page_count_mismatch(documents: DataFrame, pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents whose page_count isn't their number of pages."""
    counts = pages.groupBy(key).agg(F.count("*").alias("page_rows"))
    rows = documents.join(counts, key, "left").withColumn("page_rows", F.coalesce("page_rows", F.lit(0)))
    return rows.filter(~F.col("page_count").eqNullSafe(F.col("page_rows"))).select(key, "page_count", "page_rows")


def bad_pages(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("page_number") <= 0) | F.col("page_text").isNull() | (F.col("page_char_length") < 0))


def rounded_mean(column: str) -> Column:
    """Mean to the nearest whole number, halves away from zero."""
    return F.round(F.avg(column)).cast("int")


def size_distribution(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Number of chunks, and least, largest and mean tokens and signs, by document."""
    own = [f(c).alias(f"{n}_{c}") for c in ("chunk_token_count", "chunk_char_length") for n, f in (("min", F.min), ("max", F.max), ("avg", rounded_mean))]
    return chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), *own)


def chunk_counts(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks of every document, 0 where there are none."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    return documents.select(key).join(counts, key, "left").select(key, F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def previews(chunks: DataFrame, most: int = 3, length: int = 500) -> DataFrame:
    return chunks.filter(F.col("chunk_order") <= most).withColumn("preview", F.left("chunk_text", F.lit(length)))


def bad_embeddings(gold: DataFrame, dimension: int) -> DataFrame:
    """Hashes that aren't lower-case hex, and vectors of a wrong dimension or with elements missing or not finite."""
    from evidentia.functions.vectors import usable

    wrong = any_of([F.col(c).isNull() | ~F.col(c).rlike(LOWER_HASH) for c in ("chunk_hash", "embedding_input_hash")])
    return gold.filter(wrong | (F.col("embedding_dimension") != dimension) | ~usable(F.col("embedding"), dimension))


def report(rows: DataFrame, order: list[str], position: str = "position") -> DataFrame:
    """``rows`` as a report: numbered and sorted by several columns, without one task for all rows."""
    from evidentia.operators.layers import numbered

    return numbered(rows, order, position).orderBy(position)
