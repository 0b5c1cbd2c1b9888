"""Reconciliation of manifest, files and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import strip
from evidentia.operators.structure import PARSERS

REVIEW_MARKER = "MANUAL_REVIEW_REQUIRED"  # fixed value: marks metadata that a person has to check
REVIEWED = ["source_repository", "source_url", "legal_status", "version_or_date"]


def needs_review():
    """Whether one of the reviewed fields holds the marker."""
    return F.coalesce(F.array_contains(F.transform(F.array(*REVIEWED), lambda c: F.coalesce(F.contains(c, F.lit(REVIEW_MARKER)), F.lit(False))), True), F.lit(False))


def page_facts(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Pages, signs and pages without text of each document."""
    empty = strip(F.col("page_text")) == ""
    return pages.groupBy(key).agg(F.count("*").alias("page_count"), F.sum(F.length("page_text")).alias("char_count"), F.count_if(empty).alias("empty_page_count"))


def inventory(documents: DataFrame, pages: DataFrame, chunks: DataFrame, embeddings: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents with their numbers of pages, chunks and embeddings (0 where there are none); each layer is counted once."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    gold = chunks.select(key, "chunk_id").join(embeddings.select("chunk_id"), "chunk_id")
    names = ["page_rows", "chunk_count", "embedding_count"]
    for df, name in zip((pages, chunks, gold), names, strict=True):
        documents = documents.join(count(df, name), key, "left")
    return documents.na.fill(0, names)


def audit(manifest: DataFrame, files: DataFrame, found: DataFrame | None) -> DataFrame:
    """Manifest documents with warnings and failures.

    files: (file_name, sha256, page_count, empty_page_count) of the files that exist. found: (document_name, file_hash,
    page_count, page_rows, chunk_count, embedding_count) of the stored documents; none if they can't be read.
    """
    own = files.select(F.col("file_name"), F.lit(True).alias("exists"), "sha256", F.col("page_count").alias("file_pages"), "empty_page_count")
    rows = manifest.join(own, "file_name", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    checked = found is not None
    if checked:
        stored = found.groupBy("document_name").agg(
            F.count("*").alias("copies"), *[F.first(c).alias(f"b_{c}") for c in ("file_hash", "page_count", "page_rows", "chunk_count", "embedding_count")]
        )
        rows = rows.join(stored, F.col("document_id") == F.col("document_name"), "left")
    else:
        rows = rows.select("*", F.lit(None).cast("long").alias("copies"), *[F.lit(None).alias(f"b_{c}") for c in ("file_hash", "page_count", "page_rows", "chunk_count", "embedding_count")])
    one = F.coalesce(F.col("copies") == 1, F.lit(False))
    unsupported = ~F.col("parser_type").isin(PARSERS)
    failures = F.array_compact(
        F.array(
            F.when(~F.col("exists"), "file is missing"),
            F.when(unsupported & F.col("enabled"), "no such parser"),
            F.when(F.col("copies") > 1, "stored more than once"),
            F.when(one & F.col("sha256").isNotNull() & ~F.col("b_file_hash").eqNullSafe(F.col("sha256")), "stored hash differs from the file's"),
            F.when(one & ~F.col("b_page_count").eqNullSafe(F.col("b_page_rows")), "page_count differs from stored pages"),
            F.when(one & F.col("file_pages").isNotNull() & ~F.col("b_page_count").eqNullSafe(F.col("file_pages")), "page_count differs from the file's"),
            F.when(one & F.col("enabled") & (F.col("b_chunk_count") == 0), "enabled but without chunks"),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(needs_review(), "metadata need a review"),
            F.when(unsupported & ~F.col("enabled"), "no such parser"),
            F.when(F.lit(checked) & F.col("copies").isNull(), "not stored"),
            F.when(one & (F.col("b_embedding_count") < F.col("b_chunk_count")), "fewer embeddings than chunks"),
            F.when(F.col("empty_page_count") > 0, "pages without text"),
        )
    )
    return rows.select("document_id", "enabled", "exists", "copies", warnings.alias("warnings"), failures.alias("failures"))


def findings(report: DataFrame, unknown_files: DataFrame, stored_error: str | None = None) -> DataFrame:
    """(level, message) of the whole corpus: files that the manifest doesn't know, stored layers that can't be read, and every
    document's warnings and failures under its id. level: ``failure`` or ``warning``."""
    names = unknown_files.agg(F.array_join(F.array_sort(F.collect_set("file_name")), ", ").alias("n")).filter("n != ''")
    rows = names.select(F.lit("failure").alias("level"), F.concat(F.lit("files unknown to the manifest: "), "n").alias("message"))
    for level, column in (("failure", "failures"), ("warning", "warnings")):
        own = report.select(F.lit(level).alias("level"), F.explode(F.transform(column, lambda x: F.concat("document_id", F.lit(": "), x))).alias("message"))
        rows = rows.unionByName(own)
    if stored_error:
        one = report.sparkSession.range(1).select(F.lit("warning").alias("level"), F.lit(f"stored layers can't be read: {stored_error}").alias("message"))
        rows = rows.unionByName(one)
    return rows


def exit_code(found: DataFrame, manifest_problems: DataFrame | None = None) -> int:
    """2 if the manifest is invalid, 1 if any finding is a failure, else 0."""
    if manifest_problems is not None and manifest_problems.head(1):
        return 2
    return int(bool(found.filter("level = 'failure'").head(1)))


def as_json(report: DataFrame, found: DataFrame) -> dict:
    """The audit as one document, in order of id; a manifest's documents are few."""
    documents = [r.asDict(recursive=True) for r in report.orderBy("document_id").collect()]
    messages = {level: [r.message for r in found.filter(F.col("level") == level).orderBy("message").collect()] for level in ("failure", "warning")}
    return {"documents": documents, "validation_failures": messages["failure"], "warnings": messages["warning"]}
