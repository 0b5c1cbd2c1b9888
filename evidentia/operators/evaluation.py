"""Retrieval evaluation by source anchors: hits, first ranks, rates over measured questions, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import fold, without_suffix


def anchors(questions: DataFrame, fold_=fold) -> DataFrame:
    """(id, doc, type, reference, pages, has_pages): expected sources of each question, folded."""
    rows = questions.select("id", "expected_document", F.explode("expected_sources").alias("e"))
    return rows.select(
        "id",
        without_suffix(fold_(F.col("expected_document"))).alias("doc"),
        fold_(F.col("e.section_type")).alias("type"),
        fold_(F.col("e.section_reference")).alias("reference"),
        F.col("e.pdf_pages").alias("pages"),
    )


def anchored(chunks: DataFrame, fold_=fold) -> DataFrame:
    """``chunks`` with their folded document, section type and reference."""
    return chunks.withColumns(
        {"doc": without_suffix(fold_(F.col("document_name"))), "type": fold_(F.col("section_type")), "reference": fold_(F.col("section_reference"))}
    )


def pages_meet(pages: Column, start: Column, end: Column) -> Column:
    """Without expected pages every chunk will do; else one must lie within the chunk's, which must be in order."""
    inside = F.exists(pages, lambda p: p.between(start, end))
    return pages.isNull() | F.coalesce((start >= 1) & (end >= start) & inside, F.lit(False))


def hits(chunks: DataFrame, questions: DataFrame, on: list[str] | None = None, fold_=fold) -> DataFrame:
    """Chunks that match an expected source: of the same document, section type and reference, and on its pages.

    on: columns, such as the question's id, by which chunks already belong to questions.
    """
    keys = ["doc", "type", "reference", *(on or [])]
    found = anchored(chunks, fold_).join(anchors(questions, fold_), keys).filter(pages_meet(F.col("pages"), F.col("page_start"), F.col("page_end")))
    return found.drop("doc", "type", "reference", "pages").distinct()


def first_hit_rank(candidates: DataFrame, questions: DataFrame, rank: str, fold_=fold) -> DataFrame:
    """(id, first_rank) of every question; null without a hit."""
    found = hits(candidates, questions, ["id"], fold_).groupBy("id").agg(F.min(rank).alias("first_rank"))
    return questions.select("id").join(found, "id", "left")


def resolvable(inventory: DataFrame, questions: DataFrame, fold_=fold) -> DataFrame:
    """(id, matching, matching_searchable, status): whether a question's sources are in the corpus at all."""
    found = hits(inventory, questions, None, fold_).groupBy("id").agg(F.countDistinct("chunk_id").alias("matching"), F.countDistinct(F.when(F.col("searchable"), F.col("chunk_id"))).alias("matching_searchable"))
    rows = questions.select("id").join(found, "id", "left").na.fill(0, ["matching", "matching_searchable"])
    return rows.withColumn("status", F.when(F.col("matching_searchable") == 0, "unresolved_ground_truth").otherwise("pending"))


def evaluate(questions: DataFrame, status: DataFrame, candidates: DataFrame, reranked: DataFrame, top_k: int, fold_=fold) -> DataFrame:
    """A record of each question: status, hits and first ranks. Hits stay null where nothing was measured."""
    vector = first_hit_rank(candidates, questions, "vector_rank", fold_).withColumnRenamed("first_rank", "first_vector_hit_rank")
    after = first_hit_rank(reranked, questions, "rerank_rank", fold_).withColumnRenamed("first_rank", "first_reranked_hit_rank")
    measured = F.col("status") == "completed"
    rows = questions.join(status.select("id", "status"), "id").join(vector, "id").join(after, "id")
    rows = rows.withColumn("status", F.when(F.col("status") == "pending", "completed").otherwise(F.col("status")))
    hit = lambda rank: F.when(measured, F.coalesce(rank, F.lit(False)))
    return rows.withColumns(
        {
            "vector_hit": hit(F.col("first_vector_hit_rank").isNotNull()),
            "vector_top_k_hit": hit(F.col("first_vector_hit_rank") <= top_k),
            "reranked_hit": hit(F.col("first_reranked_hit_rank").isNotNull()),
        }
    )


def rate(column: str) -> list[Column]:
    """Hits, measured questions (not null) and their quotient, null if none was measured."""
    hit, measured = F.count_if(F.col(column)), F.count(column)
    return [hit.alias(f"{column}_hits"), measured.alias(f"{column}_measured"), F.try_divide(hit, measured).alias(f"{column}_rate")]


def summarize(records: DataFrame) -> DataFrame:
    gained = F.count_if(F.col("reranked_hit") & ~F.coalesce("vector_top_k_hit", F.lit(False)))
    lost = F.count_if(~F.col("reranked_hit") & F.coalesce("vector_top_k_hit", F.lit(False)))
    columns = [x for c in ("vector_hit", "vector_top_k_hit", "reranked_hit") for x in rate(c)]
    return records.agg(F.count("*").alias("questions"), *columns, F.count("reranked_hit").alias("paired"), gained.alias("gained"), lost.alias("lost"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


def corpus_facts(inventory: DataFrame) -> DataFrame:
    """Chunks, searchable ones, and the sorted names of documents and chunking versions."""
    return inventory.agg(
        F.count("*").alias("chunks"),
        F.count_if("searchable").alias("searchable"),
        F.array_sort(F.collect_set("document_name")).alias("documents"),
        F.array_sort(F.collect_set("chunking_version")).alias("versions"),
        (F.count("*") - F.countDistinct("chunk_id")).alias("duplicate_chunks"),
    )


def dataset_violations(questions: DataFrame) -> DataFrame:
    """(id, problem) of questions that can't be evaluated."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    sources = F.col("expected_sources")
    wrong_source = F.exists(sources, lambda s: s.isNull() | blank(s.section_type) | blank(s.section_reference))
    wrong_pages = F.exists(sources, lambda s: s.pdf_pages.isNotNull() & ((F.size(s.pdf_pages) == 0) | F.exists(s.pdf_pages, lambda p: p.isNull() | (p < 1))))
    checks = F.array(
        F.when(blank(F.col("id")), "no id"),
        F.when(blank(F.col("question")), "no question"),
        F.when(blank(F.col("expected_document")), "no document"),
        F.when(sources.isNull() | (F.size(sources) == 0), "no sources"),
        F.when(wrong_source, "incomplete source"),
        F.when(wrong_pages, "wrong pages"),
    )
    own = questions.select("id", F.explode(F.array_compact(checks)).alias("problem"))
    again = questions.groupBy("id").count().filter("count > 1 and id is not null").select("id", F.lit("id is not unique").alias("problem"))
    return own.unionByName(again)


#: Fixed value: the version of evaluation files that is understood.
SCHEMA_VERSION = "1.0"


def file_violations(raw: DataFrame) -> DataFrame:
    """(id, problem) of an evaluation file as it is read (one row): its version, its documents and its list of questions."""
    checks = [
        F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema_version is not 1.0"),
        F.when(F.col("documents").isNull(), "no documents"),
        F.when(F.col("questions").isNull() | (F.size("questions") == 0), "no questions"),
    ]
    own = raw.select(F.lit(None).cast("string").alias("id"), F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    asked = raw.select("documents", F.explode("questions").alias("q"))
    name = F.try_element_at("documents", "q.document_key").document_name
    return own.unionByName(asked.filter(F.coalesce(F.trim(name), F.lit("")) == "").select("q.id", F.lit("document of the key has no name").alias("problem")))
