"""Named queries over the driver's tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia import schemas
from evidentia import standins as S
from evidentia.functions import providers
from evidentia.functions import replies as R
from evidentia.functions import text as X
from evidentia.functions import vectors as V
from evidentia.operators import answers, audit, chunking, evaluation, hashtree, ingestion, jobs, layers, lexical, pivots, retrieval, stores, structure, validation
from evidentia.sources import files, manifest
from evidentia.sources import pages as paged
from evidentia.sources import sinks
from evidentia.sources.lake import Check, Foreign, Lake, Transaction, Unique, Violation
from evidentia.staging import discard, shared_dir, stage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- retrieval ---------------------------------------------------------------------------------------------------------

_COSINE = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))), 6)"


def _questions(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return S.table(spark, sf_dir, "embeddings").filter(rule).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"))


def _knn_sql(rule: str, k: int) -> str:
    return f"""WITH {S.GOLD}, pairs AS (SELECT q.vec_id AS question_id, g.chunk_id, {_COSINE.format(a="g.embedding", b="q.embedding")} AS similarity
 FROM gold g JOIN silver s ON s.chunk_id = g.chunk_id CROSS JOIN embeddings q WHERE g.model_version = '2' AND {rule}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS vector_rank FROM pairs)
SELECT question_id, chunk_id, similarity, CAST(vector_rank AS INTEGER) AS vector_rank FROM ranked WHERE vector_rank <= {k}"""


@query(_knn_sql("q.vec_id % 50 = 0", 20))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest chunks of a model; every 50th vector is a question."""
    chunks = retrieval.searchable(S.gold_chunks(spark, sf_dir), S.gold(spark, sf_dir), "m", "2").select("chunk_id", "embedding")
    return pivots.search(pivots.index(chunks), _questions(spark, sf_dir, "vec_id % 50 = 0"), 20)[0]


_EVIDENCE = """SELECT doc_id AS chunk_id, CAST(doc_id AS INT) AS document_id, concat('doc_', doc_id) AS document_name, CAST(doc_id % 4 + 1 AS INT) AS chunk_order, text AS chunk_text, lang AS section_type,
 source AS section_reference, CASE WHEN doc_id % 3 = 0 THEN 'title' END AS section_title, CAST(doc_id % 5 + 1 AS INT) AS page_start, CAST(doc_id % 5 + 2 AS INT) AS page_end, 'v1' AS chunking_version FROM documents"""


@query(f"SELECT question_id, {', '.join(f'e.{c}' for c in retrieval.EVIDENCE[:11])}, round(1 - similarity, 6) AS cosine_distance, similarity AS vector_similarity, vector_rank FROM ({_knn_sql('q.vec_id % 50 = 0', 20)}) k JOIN ({_EVIDENCE}) e ON e.chunk_id = k.chunk_id")
def knn_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks with all fourteen columns of evidence."""
    return retrieval.evidence_rows(knn_topk(spark, sf_dir), _over(spark, sf_dir, f"({_EVIDENCE}) AS e"))


@query()
def knn_blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of all vectors each question of ``knn_topk_whole`` has to read, and how many its bound passes over."""
    chunks = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return pivots.search(pivots.index(chunks, size=64), _questions(spark, sf_dir, "vec_id % 50 = 0"), 20)[1]


@query()
def knn_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_topk`` over all vectors, of any model. Held against brute force, without SQL."""
    chunks = S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.top_k_blocks(chunks, _questions(spark, sf_dir, "vec_id % 50 = 0"), 20)


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, len(embedding) = 64 AS usable FROM embeddings")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms, and whether a vector has the dimension and finite elements."""
    e = S.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), V.usable(F.col("embedding"), 64).alias("usable"))


@query(f"WITH {S.GOLD} SELECT s.chunk_id, s.document_name, EXISTS (SELECT 1 FROM gold g WHERE g.chunk_id = s.chunk_id AND g.model_version = '2') AS searchable FROM silver s")
def inventory_searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11, J5: chunks with a flag for those that have an embedding."""
    return retrieval.with_searchable_flag(S.gold_chunks(spark, sf_dir), S.gold(spark, sf_dir), "m", "2").select("chunk_id", "document_name", "searchable")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question meets what a search of all chunks by its words finds."""
    b = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return lexical.top_k_by_words(S.gold_chunks(spark, sf_dir), b, 20)


_WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
_CANDIDATES = f"""{S.GOLD_CHUNKS}, held AS (SELECT chunk_id, unnest({_WORDS.format("chunk_text")}) AS w FROM silver), asked AS (SELECT item_id AS question_id, unnest({_WORDS.format("text")}) AS w FROM benchmark),
 weights AS (SELECT w, ln(1 + (SELECT count(*) FROM silver) / count(*)) AS weight FROM held GROUP BY 1),
 found AS (SELECT question_id, chunk_id, round(sum(weight), 6) AS total FROM asked JOIN held USING (w) JOIN weights USING (w) GROUP BY ALL),
 candidates AS (SELECT s.*, f.question_id, b.text AS question, CAST(row_number() OVER (PARTITION BY f.question_id ORDER BY total DESC, s.chunk_id) AS INTEGER) AS vector_rank
  FROM found f JOIN silver s ON s.chunk_id = f.chunk_id JOIN benchmark b ON b.item_id = f.question_id QUALIFY vector_rank <= 20)"""
_RERANKED = f"""{_CANDIDATES}, scored AS (SELECT *, round(len(list_intersect({_WORDS.format("question")}, {_WORDS.format("chunk_text")})) / greatest(len({_WORDS.format("question")}), 1), 6) AS reranker_score FROM candidates),
 reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY reranker_score DESC, vector_rank) AS INTEGER) AS rerank_rank FROM scored QUALIFY rerank_rank <= 4)"""


def _reranked(candidates: DataFrame) -> DataFrame:
    return retrieval.rerank(candidates, 4, retrieval.overlap_score(F.col("question"), F.col("chunk_text")))


@query(f"WITH {_RERANKED} SELECT question_id, chunk_id, vector_rank, reranker_score, rerank_rank FROM reranked")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a score of (question, text); ties keep their order."""
    return _reranked(_candidates(spark, sf_dir)).select("question_id", "chunk_id", "vector_rank", "reranker_score", "rerank_rank")


# -- bronze ------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.DOCUMENTS} SELECT document_id, document_name, source_name, file_name, file_type, page_count, length(full_text) AS full_text_char_length FROM bronze")
def bronze_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2."""
    return S.documents(spark, sf_dir).select("document_id", "document_name", "source_name", "file_name", "file_type", "page_count", F.length("full_text").alias("full_text_char_length"))


@query(f"WITH {S.DOCUMENTS} SELECT count(*) AS total_documents FROM bronze")
def document_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, A1."""
    return S.documents(spark, sf_dir).agg(F.count("*").alias("total_documents"))


_DAMAGED = "CASE WHEN document_id % 9 = 0 THEN NULL WHEN document_id % 9 = 1 THEN '  ' ELSE source_name END"


@query(
    f"""WITH {S.DOCUMENTS}, d AS (SELECT document_id, {_DAMAGED} AS file_type, CASE WHEN document_id % 13 = 5 THEN 0 ELSE page_count END AS page_count FROM bronze)
SELECT document_id, file_type, page_count FROM d WHERE file_type IS NULL OR trim(file_type) = '' OR page_count IS NULL OR page_count <= 0"""
)
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, F4 over rows damaged by rule."""
    d = S.documents(spark, sf_dir).select("document_id", F.expr(_DAMAGED).alias("file_type"), F.expr("CASE WHEN document_id % 13 = 5 THEN 0 ELSE page_count END").alias("page_count"))
    return validation.missing_required(d, ["file_type"], ["page_count"])


@query(f"WITH {S.DOCUMENTS} SELECT file_hash, count(*) AS n FROM bronze GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4, A2, H1."""
    return validation.duplicates(S.documents(spark, sf_dir), ["file_hash"])


@query(f"WITH {S.DOCUMENTS} SELECT document_id, source_name, source_url FROM (SELECT document_id, {_DAMAGED} AS source_name, 'u' AS source_url FROM bronze) WHERE source_name IS NULL OR trim(source_name) = ''")
def missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, F5."""
    return validation.missing_source(S.documents(spark, sf_dir).select("document_id", F.expr(_DAMAGED).alias("source_name"), F.lit("u").alias("source_url")))


@query(f"WITH {S.DOCUMENTS} SELECT document_id, length(full_text) AS n FROM bronze WHERE length(trim(full_text, ' ')) < 1000")
def short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, F6, X7, X8."""
    return validation.short_texts(S.documents(spark, sf_dir), "full_text", 1000).select("document_id", F.length("full_text").alias("n"))


_HASHES = "CASE document_id % 6 WHEN 0 THEN NULL WHEN 1 THEN upper(file_hash) WHEN 2 THEN concat(file_hash, '0') WHEN 3 THEN concat(file_hash, chr(10)) WHEN 4 THEN substr(file_hash, 2) ELSE file_hash END"


@query(f"WITH {S.DOCUMENTS}, d AS (SELECT document_id, {_HASHES} AS file_hash FROM bronze) SELECT document_id, file_hash FROM d WHERE file_hash IS NULL OR NOT regexp_full_match(file_hash, '[0-9a-fA-F]{{64}}')")
def hash_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7, F7, R12."""
    return validation.bad_hashes(S.documents(spark, sf_dir).select("document_id", F.expr(_HASHES).alias("file_hash")), "file_hash")


@query(f"WITH {S.PAGES} SELECT document_id, page_number, page_text, CAST(length(page_text) AS INTEGER) AS page_char_length FROM pages")
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, SC7: pages of documents."""
    return S.pages(spark, sf_dir)


def _page_files(spark: SparkSession, sf_dir: str, folders: int = 0) -> str:
    """A folder with a file for each document, in subfolders if any are asked for: its pages, parted by form feeds."""
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_text"))), lambda x: x.page_text), "\f")
    rows = S.pages(spark, sf_dir).groupBy("document_id").agg(whole.alias("content"))
    files.write_files(rows.select(F.concat(F.lit("doc_"), "document_id", F.lit(".pdf")).alias("file_name"), "content"), folder, folders=folders).agg(F.sum("length")).collect()
    return folder


@query(f"WITH {S.PAGES} SELECT 'doc_' || document_id || '.pdf' AS file_name, page_number, page_text, CAST(length(page_text) AS INTEGER) AS page_char_length FROM pages")
def pages_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, U5: pages as a data source, over files written from the documents."""
    source = paged.register(spark).read.format("pages").option("extractor", "evidentia.sources.pages:form_feed").option("bytesPerPartition", 1 << 20)
    return source.load(_page_files(spark, sf_dir)).drop("path")


@query(
    f"""WITH {S.PAGES}, files AS (SELECT 'doc_' || document_id || '.pdf' AS file_name, string_agg(page_text, chr(12) ORDER BY page_number) AS content FROM pages GROUP BY 1)
SELECT file_name, CAST(octet_length(encode(content)) AS BIGINT) AS length, sha256(content) AS sha256 FROM files"""
)
def hashes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2, SC4: the listing of a folder with hashes of the files, read in blocks by the tasks."""
    return files.list_pdfs(spark, _page_files(spark, sf_dir, 1_024), with_hash=True, levels=1).select("file_name", "length", "sha256")


@query(f"WITH {S.PAGES} SELECT document_id, string_agg(page_text || chr(10) || chr(10), '' ORDER BY page_number) AS full_text FROM pages GROUP BY 1")
def full_text_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return files.full_text(S.pages(spark, sf_dir))


@query(f"WITH {S.PAGES} SELECT document_id, count(*) AS page_count, CAST(sum(length(page_text)) AS BIGINT) AS char_count, count(*) FILTER (trim(page_text, ' ' || chr(10) || chr(9) || chr(13)) = '') AS empty_page_count FROM pages GROUP BY 1")
def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5, A9."""
    return audit.page_facts(S.pages(spark, sf_dir))


@query(f"WITH {S.DOCUMENTS}, {S.PAGES} SELECT b.document_id, page_count, coalesce(n, 0) AS page_rows FROM bronze b LEFT JOIN (SELECT document_id, count(*) AS n FROM pages WHERE document_id % 4 <> 0 OR page_number > 1 GROUP BY 1) p ON p.document_id = b.document_id WHERE page_count IS DISTINCT FROM coalesce(n, 0)")
def page_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V13, with the first page of every fourth document missing."""
    return validation.page_count_mismatch(S.documents(spark, sf_dir), S.pages(spark, sf_dir).filter("document_id % 4 != 0 or page_number > 1"))


@query(f"WITH {S.PAGES} SELECT document_id, page_number FROM pages WHERE document_id % 5 = 0")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose document is gone (every fifth)."""
    pages = S.pages(spark, sf_dir).select("document_id", "page_number")
    return validation.orphans(pages, S.documents(spark, sf_dir).filter("document_id % 5 != 0"), "document_id").select("document_id", "page_number")


_BROKEN = {
    "page_number": "CASE WHEN document_id % 7 = 0 AND page_number = 1 THEN 0 ELSE page_number END",
    "page_text": "CASE WHEN document_id % 7 <> 1 OR page_number > 1 THEN page_text END",
    "page_char_length": "CAST(CASE WHEN document_id % 7 = 2 THEN -1 ELSE length(page_text) END AS INT)",
}


@query(f"WITH {S.PAGES}, b AS (SELECT document_id, {', '.join(f'{x} AS {n}' for n, x in _BROKEN.items())} FROM pages) SELECT document_id, page_number FROM b WHERE page_number < 1 OR page_text IS NULL OR page_char_length < 0")
def bad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers below 1, missing texts and negative lengths, planted by the document's number."""
    pages = S.pages(spark, sf_dir).select("document_id", *[F.expr(x).alias(n) for n, x in _BROKEN.items()])
    return validation.bad_pages(pages).select("document_id", "page_number")


@query(
    f"""WITH {S.GOLD}, b AS (SELECT chunk_id, CASE WHEN chunk_id % 13 = 1 THEN upper(chunk_hash) WHEN chunk_id % 13 = 2 THEN NULL ELSE chunk_hash END AS h, CASE WHEN chunk_id % 13 = 3 THEN 63 ELSE 64 END AS d,
 CASE WHEN chunk_id % 13 = 4 THEN embedding[1:63] ELSE embedding END AS e FROM gold) SELECT chunk_id FROM b WHERE h IS NULL OR NOT regexp_full_match(h, '[0-9a-f]{{64}}') OR d <> 64 OR len(e) <> 64"""
)
def bad_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that aren't lower-case hex, and wrong dimensions, planted by the chunk's number."""
    k = F.col("chunk_id") % 13
    planted = {
        "chunk_hash": F.when(k == 1, F.upper("chunk_hash")).when(k != 2, F.col("chunk_hash")),
        "embedding_dimension": F.when(k == 3, 63).otherwise(64),
        "embedding": F.when(k == 4, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")),
    }
    return validation.bad_embeddings(S.gold(spark, sf_dir).withColumns(planted), 64).select("chunk_id")


_OLD, _NEW = "document_id % 3 <> 0", "document_id % 2 = 0"


@query(
    f"""WITH {S.DOCUMENTS}, t AS (SELECT document_id, document_name, 'old' AS file_hash FROM bronze WHERE {_OLD}),
s AS (SELECT document_name, file_hash FROM bronze WHERE {_NEW}), m AS (SELECT coalesce(max(document_id), 0) AS most FROM t),
new AS (SELECT document_name, file_hash, row_number() OVER (ORDER BY document_name) AS n FROM s WHERE document_name NOT IN (SELECT document_name FROM t))
SELECT t.document_id, t.document_name, coalesce(s.file_hash, t.file_hash) AS file_hash FROM t LEFT JOIN s ON s.document_name = t.document_name
UNION ALL SELECT CAST(most + n AS INTEGER), document_name, file_hash FROM new, m"""
)
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1: known identities keep their ids, new ones follow."""
    d = S.documents(spark, sf_dir)
    return layers.upsert_documents(d.filter(_OLD).select("document_id", "document_name", F.lit("old").alias("file_hash")), d.filter(_NEW).select("document_name", "file_hash"))


@query(
    f"""WITH {S.PAGES}, t AS (SELECT document_id, page_number, 'old' AS page_text FROM pages UNION ALL SELECT document_id, page_number + 1000, 'old' FROM pages),
s AS (SELECT document_id, page_number, page_text FROM pages WHERE {_NEW})
SELECT document_id, page_number, page_text FROM t WHERE NOT ({_NEW}) UNION ALL SELECT * FROM s"""
)
def upsert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK2, SK3: pages are replaced, those beyond the last removed."""
    p = S.pages(spark, sf_dir).select("document_id", "page_number", "page_text")
    old = p.withColumn("page_text", F.lit("old"))
    return layers.upsert_pages(old.unionByName(old.withColumn("page_number", F.col("page_number") + 1000)), p.filter(_NEW))


@query(
    f"""WITH {S.DOCUMENTS}, one AS (SELECT document_name, file_hash FROM bronze WHERE {_OLD}), t AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE document_name LIKE '%4'), s AS (SELECT document_name, file_hash FROM bronze WHERE {_NEW})
SELECT DISTINCT s.document_name, 'hash of another document' AS problem FROM s JOIN t ON t.file_hash = s.file_hash AND t.document_name <> s.document_name
UNION ALL SELECT s.document_name, 'duplicate identity' FROM s WHERE (SELECT count(*) FROM t WHERE t.document_name = s.document_name) > 1"""
)
def hash_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of other documents, and names that are stored twice."""
    d = S.documents(spark, sf_dir).select("document_id", "document_name", "file_hash")
    stored = d.filter(_OLD)
    return layers.conflicts(stored.unionByName(stored.filter("document_name like '%4'")), d.filter(_NEW))


@query(
    f"""WITH {S.DOCUMENTS} SELECT document_id, document_name, CASE source_name WHEN 'src1' THEN 'Journal' WHEN 'src2' THEN 'Board' ELSE source_name END AS source_name, file_name FROM bronze"""
)
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK7: changes by source, without touching other rows."""
    d = S.documents(spark, sf_dir).select("document_id", "document_name", "source_name", "file_name").withColumn("key", F.col("source_name"))
    changes = spark.createDataFrame([("src1", "Journal", None), ("src2", "Board", None)], "key string, source_name string, file_name string")
    return layers.update_metadata(d, changes, "key").drop("key")


# -- silver ------------------------------------------------------------------------------------------------------------


@query(f"WITH {S.RECORDS} SELECT document_id, line_no, page_number, text FROM records")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, X1, X2, F12."""
    return structure.line_records(S.pages(spark, sf_dir))


@query(f"WITH RECURSIVE {S.ANNOTATED} SELECT * FROM annotated")
def regulation_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, W3-W6, R1-R5, M4, X5."""
    return structure.parse_regulation(S.marked(spark, sf_dir))


@query(f"WITH RECURSIVE {S.ANNOTATED} SELECT document_id, section_type, count(DISTINCT section_reference) AS n_references FROM annotated GROUP BY ALL")
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return structure.summary(structure.parse_regulation(S.marked(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {S.ANNOTATED}, e AS (SELECT document_id, t AS section_type, 3 AS expected FROM (SELECT DISTINCT document_id FROM annotated), (VALUES ('recital'), ('article')) AS v(t)),
a AS (SELECT document_id, section_type, count(DISTINCT section_reference) AS n FROM annotated GROUP BY ALL)
SELECT e.document_id, e.section_type, expected, coalesce(n, 0) AS actual FROM e LEFT JOIN a ON a.document_id = e.document_id AND a.section_type = e.section_type WHERE coalesce(n, 0) <> expected"""
)
def structure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recitals and articles are expected of every document."""
    rows = structure.parse_regulation(S.marked(spark, sf_dir))
    expected = rows.select("document_id").distinct().select("document_id", F.explode(F.array(F.lit("recital"), F.lit("article"))).alias("section_type"), F.lit(3).alias("expected"))
    return structure.count_violations(rows, expected)


@query(f"WITH RECURSIVE {S.GROUPED} SELECT document_id, group_no, section_type, section_reference, section_title, count(*) AS lines, min(page_number) AS first_page FROM grouped GROUP BY ALL")
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7, F11, W7."""
    rows = chunking.section_groups(structure.parse_regulation(S.marked(spark, sf_dir)))
    return rows.groupBy("document_id", "group_no", *chunking.META).agg(F.count("*").alias("lines"), F.min("page_number").alias("first_page"))


_CHUNKS = f"WITH RECURSIVE {S.chunk_cte(S.SIZE, S.OVERLAP)}"


@query(f"{_CHUNKS} SELECT * FROM chunks")
def silver_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8-C10, W8, W12, U4, M6, AR2, AR3, H1."""
    return S.silver(spark, sf_dir)


@query(
    f"""{_CHUNKS} SELECT document_id, count(*) AS chunk_count, min(chunk_token_count) AS min_chunk_token_count, max(chunk_token_count) AS max_chunk_token_count, CAST(round(avg(chunk_token_count)) AS INTEGER) AS avg_chunk_token_count,
 min(chunk_char_length) AS min_chunk_char_length, max(chunk_char_length) AS max_chunk_char_length, CAST(round(avg(chunk_char_length)) AS INTEGER) AS avg_chunk_char_length FROM chunks GROUP BY 1"""
)
def chunk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9, A3."""
    return validation.size_distribution(S.silver(spark, sf_dir))


@query(f"{_CHUNKS} SELECT document_id, chunk_order, chunk_token_count, substr(chunk_text, 1, 500) AS preview FROM chunks WHERE chunk_order <= 3")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10, F9, X8."""
    return validation.previews(S.silver(spark, sf_dir)).select("document_id", "chunk_order", "chunk_token_count", "preview")


@query(f"{_CHUNKS} SELECT document_id, chunk_order, chunk_char_length FROM chunks WHERE length(trim(chunk_text, ' ')) < 100")
def short_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11."""
    return validation.short_texts(S.silver(spark, sf_dir), "chunk_text", 100).select("document_id", "chunk_order", "chunk_char_length")


@query(f"WITH RECURSIVE {S.chunk_cte(S.SIZE, S.OVERLAP)} SELECT count(*) AS chunks FROM chunks")
def chunk_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8."""
    return S.silver(spark, sf_dir).agg(F.count("*").alias("chunks"))


@query(f"{_CHUNKS}, {S.DOCUMENTS} SELECT b.document_id, count(c.chunk_order) AS chunk_count FROM bronze b LEFT JOIN chunks c ON c.document_id = b.document_id AND b.document_id % 5 <> 0 GROUP BY 1")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12', J3, A4, with every fifth document's chunks missing."""
    return validation.chunk_counts(S.documents(spark, sf_dir), S.silver(spark, sf_dir).filter("document_id % 5 != 0"))


_RANGES = """(SELECT doc_id AS chunk_id, CAST(CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE length(text) % 9 + 1 END AS INT) AS page_start,
 CAST(CASE doc_id % 5 WHEN 0 THEN NULL ELSE length(text) % 9 + doc_id % 5 - 1 END AS INT) AS page_end FROM documents) AS t"""


def _over(spark: SparkSession, sf_dir: str, rows: str) -> DataFrame:
    """Rows that a rule makes of the tables."""
    for name in ("documents", "benchmark"):
        S.table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {rows}")


@query(f"SELECT chunk_id, page_start, page_end FROM {_RANGES} WHERE NOT ((page_start IS NULL AND page_end IS NULL) OR coalesce(page_start > 0 AND page_end >= page_start, false))")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges with missing ends, in the wrong order and from 0, planted by the document's number."""
    return validation.bad_page_ranges(_over(spark, sf_dir, _RANGES))


_STORED_CHUNKS = f"""{S.chunk_cte(S.SIZE, S.OVERLAP)}, stored AS (SELECT * REPLACE (CASE WHEN document_id % 8 = 0 AND chunk_order = 1 THEN 'other' ELSE chunk_text END AS chunk_text) FROM chunks WHERE document_id % 8 <> 4 OR chunk_order > 1),
 compared AS (SELECT coalesce(n.document_id, o.document_id) AS document_id, bool_or(n.chunk_text IS DISTINCT FROM o.chunk_text) AS differs FROM chunks n FULL JOIN stored o ON n.document_id = o.document_id AND n.chunk_order = o.chunk_order GROUP BY 1)"""


def _silver(spark: SparkSession, sf_dir: str, dry_run: bool = False) -> jobs.Built:
    """All documents as regulations, against stored chunks of which every eighth document's first is altered, or missing."""
    lines = S.marked(spark, sf_dir)
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text), "\n")
    pages = stage(lines.groupBy("document_id", "page_number").agg(page.alias("page_text")), "pages")
    documents = S.documents(spark, sf_dir).select("document_id", "document_name").join(pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count")), "document_id")
    wanted = documents.select("document_name", F.lit(structure.REGULATION).alias("parser_type"))
    stored = stage(S.silver(spark, sf_dir), "stored").withColumn("chunk_text", F.when(F.expr("document_id % 8 = 0 and chunk_order = 1"), "other").otherwise(F.col("chunk_text")))
    built = jobs.build_silver(wanted, documents, pages, stored.filter("document_id % 8 != 4 or chunk_order > 1"), S.SIZE, S.OVERLAP, dry_run=dry_run)
    discard(pages)
    return built


@query(f"WITH RECURSIVE {_STORED_CHUNKS} SELECT document_id, CASE WHEN differs THEN 'rebuilt' ELSE 'unchanged' END AS status FROM compared")
def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6, C11, J13, SC6: every document built anew and compared with what is stored."""
    return _silver(spark, sf_dir).status.select("document_id", "status")


_NEW_PAGES = "document_id % 5 = 0"


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[jobs.Built, DataFrame, jobs.Built]:
    """A first build, its chunks with faults, and a second build that knows the first one's trees and has some new pages."""
    lines = S.marked(spark, sf_dir)
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text), "\n")
    pages = stage(lines.groupBy("document_id", "page_number").agg(page.alias("page_text")), "pages")
    documents = S.documents(spark, sf_dir).select("document_id", "document_name").join(pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count")), "document_id")
    wanted = documents.select("document_name", F.lit(structure.REGULATION).alias("parser_type"))
    first = jobs.build_silver(wanted, documents, pages, chunking.chunks(structure.parse_generic(structure.line_records(pages.limit(0)))), S.SIZE, S.OVERLAP)
    stored = stage(first.table, "stored").filter("document_id % 8 != 4 or chunk_order > 1")
    stored = stored.withColumn("chunk_text", F.when(F.expr("document_id % 8 = 0 and chunk_order = 1"), "other").otherwise(F.col("chunk_text")))
    newer = pages.withColumn("page_text", F.when(F.expr(_NEW_PAGES), F.concat("page_text", F.lit("\nOne more line"))).otherwise(F.col("page_text")))
    return first, stored, jobs.build_silver(wanted, documents, newer, stored, S.SIZE, S.OVERLAP, trees=stage(first.trees, "trees"))


@query(
    f"""WITH {S.RECORDS} SELECT document_id, CASE WHEN document_id % 8 IN (0, 4) OR {_NEW_PAGES} THEN 'rebuilt' ELSE 'unchanged' END AS status, document_id % 8 IN (0, 4) OR {_NEW_PAGES} AS parsed
FROM (SELECT DISTINCT document_id FROM records)"""
)
def unchanged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pages and stored chunks are those of the last build aren't parsed again."""
    _, _, second = _rebuilt(spark, sf_dir)
    parsed = second.rows.select("document_id").distinct().withColumn("parsed", F.lit(True))
    return second.status.join(parsed, "document_id", "left").select("document_id", "status", F.coalesce("parsed", F.lit(False)).alias("parsed"))


@query(
    f"""WITH RECURSIVE {_STORED_CHUNKS}, sides AS (SELECT 'o' AS side, document_id, section_type, section_reference, section_title, list((chunk_order, chunk_text) ORDER BY chunk_order) AS c FROM stored GROUP BY ALL
 UNION ALL SELECT 'n', document_id, section_type, section_reference, section_title, list((chunk_order, chunk_text) ORDER BY chunk_order) FROM chunks GROUP BY ALL),
 both_sides AS (SELECT document_id, section_type, section_reference, section_title, any_value(c) FILTER (side = 'o') AS o, any_value(c) FILTER (side = 'n') AS n FROM sides GROUP BY 1, 2, 3, 4)
SELECT document_id, section_type, section_reference, section_title, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM both_sides WHERE o IS DISTINCT FROM n"""
)
def changed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the roots of differing documents down to the sections that differ."""
    chunks = stage(S.silver(spark, sf_dir), "silver")
    stored = chunks.withColumn("chunk_text", F.when(F.expr("document_id % 8 = 0 and chunk_order = 1"), "other").otherwise(F.col("chunk_text"))).filter("document_id % 8 != 4 or chunk_order > 1")
    return hashtree.changed_sections(hashtree.tree(stored, jobs.COMPARED), hashtree.tree(chunks, jobs.COMPARED))


@query(f"WITH RECURSIVE {_STORED_CHUNKS} SELECT document_id, chunk_order, chunk_text, section_reference FROM chunks")
def silver_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11, SK4: the chunk table's next version."""
    return _silver(spark, sf_dir).table.select("document_id", "chunk_order", "chunk_text", "section_reference")


@query(f"WITH RECURSIVE {_STORED_CHUNKS} SELECT CASE WHEN differs THEN 'would_rebuild' ELSE 'unchanged' END AS status, count(*) AS documents FROM compared GROUP BY 1")
def silver_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK13: what a build would do; its table is the stored one."""
    return _silver(spark, sf_dir, dry_run=True).status.groupBy("status").agg(F.count("*").alias("documents"))


# -- gold --------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {S.GOLD} SELECT s.chunk_id, s.chunk_hash, sha256(s.chunk_text) AS embedding_input_hash FROM silver s LEFT JOIN gold g ON g.chunk_id = s.chunk_id AND g.model_id = 'm' AND g.model_version = '2'
WHERE g.chunk_id IS NULL OR g.chunk_hash <> s.chunk_hash OR g.embedding_input_hash <> sha256(s.chunk_text)"""
)
def gold_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12, J6, SC8, SC9, F3."""
    return layers.pending(S.gold_chunks(spark, sf_dir), S.gold(spark, sf_dir), "m", "2").select("chunk_id", "chunk_hash", "embedding_input_hash")


@query(
    f"""WITH {S.GOLD}, todo AS (SELECT s.* FROM silver s LEFT JOIN gold g ON g.chunk_id = s.chunk_id AND g.model_version = '2' AND g.chunk_hash = s.chunk_hash WHERE g.chunk_id IS NULL)
SELECT chunk_id, model_version, chunk_hash, CAST(len(embedding) AS INTEGER) AS dimension FROM gold g WHERE chunk_id NOT IN (SELECT chunk_id FROM todo)
UNION ALL SELECT chunk_id, '2', chunk_hash, 2 FROM todo"""
)
def gold_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12, SC8, SC9, J6, U1, SK5: missing and outdated embeddings made; they replace those of any version of chunk and model."""
    embed = lambda rows: rows.withColumn("embedding", F.array(F.length("chunk_text").cast("float"), (F.col("chunk_id") % 7).cast("float")))
    built = jobs.build_gold(S.gold_chunks(spark, sf_dir), S.gold(spark, sf_dir), "m", "2", embed)
    return built.table.select("chunk_id", "model_version", "chunk_hash", F.size("embedding").alias("dimension"))


@query(
    f"""WITH {S.GOLD} SELECT g.chunk_id, model_id, model_version, CASE WHEN s.chunk_id IS NULL THEN 'chunk is gone' ELSE 'chunk has changed' END AS reason
FROM gold g LEFT JOIN (SELECT * FROM silver WHERE chunk_id % 9 <> 0) s ON s.chunk_id = g.chunk_id WHERE s.chunk_id IS NULL OR s.chunk_hash <> g.chunk_hash"""
)
def gold_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of chunks that are gone or have changed."""
    return layers.stale(S.gold_chunks(spark, sf_dir).filter("chunk_id % 9 != 0"), S.gold(spark, sf_dir))


@query(f"WITH {S.GOLD} SELECT chunk_id, model_id, CASE WHEN chunk_id % 2 = 0 THEN '3' ELSE model_version END AS model_version FROM gold UNION ALL SELECT chunk_id, 'm', '3' FROM silver WHERE chunk_id % 22 = 0")
def gold_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5: new rows replace those of the same chunk and model, whatever their version."""
    new = S.gold_chunks(spark, sf_dir).filter("chunk_id % 2 = 0").select("chunk_id", F.lit("m").alias("model_id"), F.lit("3").alias("model_version"))
    return layers.replace_by(S.gold(spark, sf_dir).select("chunk_id", "model_id", "model_version"), new, ["chunk_id", "model_id"])


@query(f"WITH {S.GOLD_CHUNKS} SELECT chunk_id, document_name FROM silver WHERE document_name IN ('doc_1', 'doc_3', 'doc_7', 'doc_9') ORDER BY chunk_id LIMIT 3")
def chunks_to_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8, F2, T3: the first chunks of given documents."""
    return layers.selected_chunks(S.gold_chunks(spark, sf_dir), ["doc_1", "doc_3", "doc_7", "doc_9"], 3).select("chunk_id", "document_name")


@query("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK6, J-1: vectors to text and back."""
    e = S.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.from_text(V.to_text(F.col("embedding"))).cast("array<double>").alias("embedding"))


_PREVIEWS = "(SELECT concat('doc_', doc_id % 50) AS document_name, CAST(doc_id AS INT) AS chunk_order, substr(text, 1, 60) AS preview FROM documents) AS t"


@query(f"SELECT row_number() OVER (ORDER BY document_name, chunk_order) AS position, * FROM {_PREVIEWS}")
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a report in order of two columns, with the place of each row."""
    return validation.report(_over(spark, sf_dir, _PREVIEWS), ["document_name", "chunk_order"]).withColumn("position", F.col("position").cast("long"))


# -- guarded reads of JSON ---------------------------------------------------------------------------------------------

_REPLIES = """(SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN 'no json {' WHEN 1 THEN '{"data": []}' WHEN 2 THEN '{"choices": []}' WHEN 3 THEN '{"choices": [{"message": "text"}]}' WHEN 4 THEN '{"choices": [{"message": {"content": "  "}}]}'
 WHEN 5 THEN '{"choices": [{"message": {"content": 5}}]}' WHEN 6 THEN '[1]' ELSE concat('{"choices": [{"message": {"content": " answer ', doc_id, ' of ', source, ' "}}, {"x": 1}]}') END AS reply FROM documents) AS t"""


@query(
    f"""WITH r AS (SELECT id, CASE WHEN json_valid(reply) THEN CAST(reply AS JSON) END AS j FROM {_REPLIES}), v AS (SELECT id, j, json_type(j, '$.choices') AS c, json_array_length(j, '$.choices') AS n, json_type(j, '$.choices[0].message') AS m,
 json_type(j, '$.choices[0].message.content') AS k, trim(j ->> '$.choices[0].message.content') AS answer FROM r),
 p AS (SELECT id, answer, CASE WHEN j IS NULL THEN 'reply is no JSON' WHEN c IS DISTINCT FROM 'ARRAY' OR n = 0 THEN 'reply has no choices' WHEN m IS DISTINCT FROM 'OBJECT' THEN 'first choice has no message' WHEN k IS DISTINCT FROM 'VARCHAR' OR answer = '' THEN 'answer is empty' END AS problem FROM v)
SELECT id, CASE WHEN problem IS NULL THEN answer END AS answer, problem FROM p"""
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1, U3: answers of replies, and what is wrong with the others."""
    return _over(spark, sf_dir, _REPLIES).select("id", R.completion(F.col("reply")).alias("r")).select("id", "r.*")


_VECTOR_REPLIES = """(SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN '{"data": {}}' WHEN 1 THEN '{"data": [{"index": 0, "embedding": [1]}]}' WHEN 2 THEN '{"data": [{"index": 1, "embedding": [1]}, {"index": 1, "embedding": [2]}]}'
 WHEN 3 THEN '{"data": [{"index": 1, "embedding": [1]}, {"index": 0, "embedding": ["2"]}]}' WHEN 4 THEN '{"data": [1, 2]}' ELSE concat('{"data": [{"index": 1, "embedding": [', doc_id, ', 0.5]}, {"index": 0, "embedding": [1, -2]}]}') END AS reply FROM documents) AS t"""


@query(
    f"""SELECT id, CASE WHEN id % 8 > 4 THEN '1.0,-2.0;' || CAST(CAST(id AS DOUBLE) AS VARCHAR) || ',0.5' END AS vectors, CASE id % 8 WHEN 0 THEN 'reply has no list of data' WHEN 1 THEN 'reply has another number of embeddings' WHEN 2 THEN 'indices aren''t 0 to n - 1'
 WHEN 3 THEN 'an embedding is no list of numbers' WHEN 4 THEN 'indices aren''t 0 to n - 1' END AS problem FROM {_VECTOR_REPLIES}"""
)
def model_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1, T5: vectors of replies in the order of their texts, and what is wrong with the others."""
    rows = _over(spark, sf_dir, _VECTOR_REPLIES).select("id", R.embeddings(F.col("reply"), F.lit(2)).alias("r"))
    text = F.array_join(F.transform("r.vectors", lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ",")), ";")
    return rows.select("id", text.alias("vectors"), "r.problem")


#: Manifests of a source's documents, a hundred ids each, of documents with missing and wrong fields.
_MANIFEST_PARTS = """(SELECT doc_id, concat(source, '_', CAST(floor(doc_id / 100) AS INT)) AS source, CASE doc_id % 10 WHEN 0 THEN '5' WHEN 1 THEN concat('{"document_id": "d', doc_id, '", "enabled": true}') ELSE concat('{"document_id": ', CASE doc_id % 10 WHEN 2 THEN '7' ELSE concat('"d', doc_id, '"') END,
 ', "file_name": "', CASE doc_id % 10 WHEN 3 THEN ' ' ELSE 'f.pdf' END, '", "official_title": "t", "short_title": "t", "issuing_body": "b", "source_repository": "r", "source_url": "u", "document_type": "k", "legal_status": "s", "language": "',
 lang, '", "version_or_date": "v", "parser_type": "p", "enabled": ', CASE doc_id % 10 WHEN 4 THEN '"yes"' WHEN 5 THEN 'null' ELSE 'true' END, '}') END AS part FROM documents) AS t"""


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM {_MANIFEST_PARTS}), fields AS (SELECT unnest(['file_name', 'official_title', 'short_title', 'issuing_body', 'source_repository', 'source_url', 'document_type', 'legal_status', 'language', 'version_or_date', 'parser_type']) AS f)
SELECT source AS name, CAST(place AS INTEGER) AS document_index, CASE doc_id % 10 WHEN 0 THEN 'document must be an object' WHEN 2 THEN 'document_id must be a text' WHEN 3 THEN 'file_name must be a text' ELSE 'enabled must be true or false' END AS problem FROM n WHERE doc_id % 10 IN (0, 2, 3, 4, 5)
UNION ALL SELECT source, CAST(place AS INTEGER), f || ' is missing' FROM n, fields WHERE doc_id % 10 = 1
UNION ALL SELECT DISTINCT source, CAST(NULL AS INTEGER), 'corpus_version must be a text' FROM n UNION ALL SELECT 'bad', NULL, 'manifest is no JSON' UNION ALL SELECT 'list', NULL, 'manifest must be an object'"""
)
def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1, J-1, C18: manifests with every fault of their form, each told in a row of its own."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "part"))), lambda x: x["part"]), ",")
    texts = _over(spark, sf_dir, _MANIFEST_PARTS).groupBy(F.col("source").alias("name")).agg(F.concat(F.lit('{"schema_version": "1", "corpus_id": "c", "corpus_version": 3, "documents": ['), parts, F.lit("]}")).alias("text"))
    return manifest.checked(texts.union(spark.createDataFrame([("bad", "{"), ("list", "[1]")], "name string, text string")))[1]


# -- one log for all layers ------------------------------------------------------------------------------------------------


def _lake(spark: SparkSession) -> Lake:
    return Lake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")


_NEWER = "CASE WHEN chunk_id % 13 = 0 THEN concat(chunk_text, 'newer') ELSE chunk_text END"


@query(
    f"""WITH {S.GOLD}, silver2 AS (SELECT chunk_id, {_NEWER} AS chunk_text FROM silver),
 todo AS (SELECT s.chunk_id, sha256(s.chunk_text) AS h FROM silver2 s LEFT JOIN gold g ON g.chunk_id = s.chunk_id AND g.model_version = '2' AND g.chunk_hash = sha256(s.chunk_text) WHERE g.chunk_id IS NULL),
 gold2 AS (SELECT chunk_id, model_version, chunk_hash FROM gold WHERE chunk_id NOT IN (SELECT chunk_id FROM todo) UNION ALL SELECT chunk_id, '2', h FROM todo)
SELECT CAST(1 AS BIGINT) AS version, s.chunk_id, g.model_version, g.chunk_hash, g.chunk_hash = s.chunk_hash AS current FROM silver s JOIN gold g ON g.chunk_id = s.chunk_id
UNION ALL SELECT 2, s.chunk_id, g.model_version, g.chunk_hash, g.chunk_hash = sha256(s.chunk_text) FROM silver2 s JOIN gold2 g ON g.chunk_id = s.chunk_id"""
)
def layers_by_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK14: Silver and Gold as of each commit. A build that fails between the two leaves the pair before; the next one changes both."""
    lake = _lake(spark)

    def first(t: Transaction) -> None:
        t.write("silver", S.gold_chunks(spark, sf_dir))
        t.write("gold", S.gold(spark, sf_dir))

    def build(embed: Callable[[DataFrame], DataFrame]) -> Callable[[Transaction], None]:
        def work(t: Transaction) -> None:
            text = F.expr(_NEWER)
            t.write("silver", t.table("silver").withColumns({"chunk_text": text, "chunk_hash": F.sha2(text, 256)}))
            t.write("gold", jobs.build_gold(t.table("silver"), t.table("gold"), "m", "2", embed).table)

        return work

    def gone(rows: DataFrame) -> DataFrame:
        raise ConnectionError("the model is gone")

    lake.transact(first, "first build")
    with contextlib.suppress(ConnectionError):
        lake.transact(build(gone), "a build that fails")
    before = lake.snapshot()
    lake.transact(build(lambda rows: rows.withColumn("embedding", F.array(F.length("chunk_text").cast("float")))), "second build")

    def pair(version: int, s) -> DataFrame:
        own = s.table("silver").select("chunk_id", F.col("chunk_hash").alias("h"))
        rows = own.join(s.table("gold"), "chunk_id")
        return rows.select(F.lit(version).cast("long").alias("version"), "chunk_id", "model_version", "chunk_hash", (F.col("chunk_hash") == F.col("h")).alias("current"))

    now = lake.snapshot()
    return pair(before.version, before).unionByName(pair(now.version, now))


@query(
    f"""WITH RECURSIVE {S.chunk_cte(S.SIZE, S.OVERLAP)} SELECT 'doc_' || document_id AS document_name, chunk_order, chunk_hash, CAST(chunk_char_length AS DOUBLE) AS length, '1' AS model_version FROM chunks"""
)
def lake_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK14, SK1, SK4, SK5, SK15, W13, C11, C12: all layers under one log. Documents and pages in one commit, Silver in one, Gold by
    parts; the model goes away after the first part, and the next build goes on from there."""
    lake = stores.open_lake(spark, _lake(spark).root)
    lines = S.marked(spark, sf_dir)
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text), "\n")
    pages = stage(lines.groupBy("document_id", "page_number").agg(page.alias("page_text")).select(F.concat(F.lit("doc_"), "document_id").alias("document_name"), "page_number", "page_text"), "pages")
    whole = S.documents(spark, sf_dir).drop("document_id", "page_count").join(pages.groupBy("document_name").agg(F.count("*").cast("int").alias("page_count")), "document_name")
    # exact copies are documents of their own here, so their files differ
    stores.store_documents(lake, whole.withColumn("file_hash", F.sha2(F.concat("document_name", "full_text"), 256)), pages)
    discard(pages)
    wanted = lake.snapshot().table(stores.DOCUMENTS).select("document_name", F.lit(structure.REGULATION).alias("parser_type"))
    stores.build_silver(lake, wanted, dimension=2, size=S.SIZE, overlap=S.OVERLAP)
    asked: list[int] = []

    def embed(rows: DataFrame) -> DataFrame:
        asked.append(1)
        if len(asked) == 2:
            raise ConnectionError("the model is gone")
        return rows.withColumn("embedding", F.array(F.length("chunk_text").cast("float"), F.lit(1.0).cast("float")))

    with contextlib.suppress(ConnectionError):
        stores.build_gold(lake, "m", "1", embed, dimension=2, parts=4)
    stores.build_gold(lake, "m", "1", embed, dimension=2, parts=4)
    now = lake.snapshot()
    rows = now.table(stores.CHUNKS).select("chunk_id", "document_name", "chunk_order", "chunk_hash")
    found = now.table(stores.EMBEDDINGS).select("chunk_id", F.col("embedding")[0].cast("double").alias("length"), "model_version")
    return rows.join(found, "chunk_id").drop("chunk_id")


_KEPT_DOCUMENTS = "document_id % 5 <> 0"


@query(
    f"""WITH {S.PAGES}, b AS (SELECT document_id, {', '.join(f'{x} AS {n}' for n, x in _BROKEN.items())} FROM pages), w AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE document_id % 8 = 3),
 counts AS (SELECT 'page_number below 1' AS rule, count(*) AS broken FROM w WHERE page_number < 1 UNION ALL SELECT 'page_text is missing', count(*) FROM w WHERE page_text IS NULL
 UNION ALL SELECT 'page_char_length below 0', count(*) FROM w WHERE page_char_length < 0 UNION ALL SELECT 'page without document', count(*) FROM w WHERE NOT ({_KEPT_DOCUMENTS})
 UNION ALL SELECT 'page repeats', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM w GROUP BY document_id, page_number HAVING count(*) > 1))
SELECT rule, broken FROM counts WHERE broken > 0"""
)
def constraints_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK15, V15: planted faults of pages, counted by the job that would have written them; nothing is committed."""
    lake = _lake(spark)
    pages = S.pages(spark, sf_dir).select("document_id", *[F.expr(x).alias(n) for n, x in _BROKEN.items()])
    rules = [
        Check("page_number below 1", "page_number > 0"), Check("page_text is missing", "page_text is not null"), Check("page_char_length below 0", "page_char_length >= 0"),
        Unique("page repeats", ("document_id", "page_number")), Foreign("page without document", ("document_id",), "documents"),
    ]
    found: dict[str, int] = {}

    def work(t: Transaction) -> None:
        t.write("documents", S.documents(spark, sf_dir).filter(_KEPT_DOCUMENTS).select("document_id", "document_name"), [Unique("document repeats", ("document_id",))])
        t.write("pages", pages.unionByName(pages.filter("document_id % 8 = 3")), rules)

    try:
        lake.transact(work, "pages with faults")
    except Violation as e:
        found = e.counts
    if lake.versions():
        raise AssertionError("pages with faults were committed")
    return spark.createDataFrame(list(found.items()), "rule string, broken long")


@query(
    f"""WITH {S.DOCUMENTS} SELECT document_name, file_hash, count(*) OVER () = (SELECT count(*) FROM bronze) AS complete FROM (SELECT document_name, 'old' || document_name AS file_hash FROM bronze WHERE document_id % 3 = 0
 UNION ALL SELECT document_name, sha256(document_name || full_text) FROM bronze WHERE document_id % 3 <> 0)"""
)
def racing_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1: two writers start from one state; each one's documents are stored once, with ids of their own."""
    lake = _lake(spark)
    d = S.documents(spark, sf_dir).select("document_id", "document_name", F.sha2(F.concat("document_name", "full_text"), 256).alias("file_hash"))
    stored = d.filter("document_id % 3 = 0").withColumn("file_hash", F.concat(F.lit("old"), "document_name"))
    lake.transact(lambda t: t.write("documents", stored), "stored before")
    both, failed = threading.Barrier(2), []

    def write(rest: int) -> None:
        first = [True]

        def work(t: Transaction) -> None:
            new = layers.upsert_documents(t.table("documents"), d.filter(f"document_id % 3 = {rest}").drop("document_id"))
            if first.pop() if first else False:
                both.wait(300)
            t.write("documents", new, [Unique("id repeats", ("document_id",)), Unique("name repeats", ("document_name",))])

        try:
            lake.transact(work, f"writer {rest}")
        except BaseException as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(rest,)) for rest in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    if failed:
        raise failed[0]
    rows = lake.snapshot().table("documents")
    return rows.select("document_name", "file_hash", F.lit(rows.select("document_id").distinct().count() == d.count()).alias("complete"))


# -- manifest and audit ------------------------------------------------------------------------------------------------

#: Every document in a manifest with faults: ids that are no slugs or repeat, names that are no PDF base names or repeat, blank and missing fields.
_MANIFEST = """(SELECT CAST(doc_id AS INT) AS document_index, CASE WHEN doc_id % 13 = 5 THEN concat('doc ', doc_id) WHEN doc_id % 17 = 6 THEN concat('Doc_', doc_id - 1) ELSE concat('doc_', doc_id) END AS document_id,
 CASE WHEN doc_id % 7 = 4 THEN concat('dir/doc_', doc_id, '.pdf') WHEN doc_id % 9 = 2 THEN concat('doc_', doc_id, '.txt') WHEN doc_id % 10 = 9 THEN concat('doc_', doc_id - 1, '.PDF') ELSE concat('doc_', doc_id, '.pdf') END AS file_name,
 't' AS official_title, 't' AS short_title, source AS issuing_body, 'r' AS source_repository, 'u' AS source_url, 'k' AS document_type, CASE WHEN doc_id % 8 = 1 THEN ' ' ELSE 'in force' END AS legal_status, lang AS language,
 'v' AS version_or_date, CASE doc_id % 3 WHEN 0 THEN 'generic' WHEN 1 THEN 'eu_regulation' ELSE 'edpb_opinion' END AS parser_type, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE doc_id % 3 <> 0 END AS enabled FROM documents) AS m"""


@query(
    f"""WITH m AS (SELECT * FROM {_MANIFEST}),
d AS (SELECT document_index, min(document_index) OVER (PARTITION BY lower(document_id)) AS a, min(document_index) OVER (PARTITION BY lower(file_name)) AS b FROM m)
SELECT document_index, 'legal_status must be a text' AS problem FROM m WHERE trim(legal_status) = ''
UNION ALL SELECT document_index, 'enabled must be true or false' FROM m WHERE enabled IS NULL
UNION ALL SELECT document_index, 'document_id is no slug' FROM m WHERE NOT regexp_full_match(document_id, '[a-z0-9]+([._-][a-z0-9]+)*')
UNION ALL SELECT document_index, 'file_name is no PDF base name' FROM m WHERE file_name LIKE '%/%' OR lower(file_name) NOT LIKE '_%.pdf'
UNION ALL SELECT document_index, 'document_id repeats that of document ' || a FROM d WHERE a < document_index
UNION ALL SELECT document_index, 'file_name repeats that of document ' || b FROM d WHERE b < document_index"""
)
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18, A8, R11."""
    return manifest.violations(_over(spark, sf_dir, _MANIFEST))


@query(
    f"""SELECT CAST(NULL AS INTEGER) AS position, document_id, parser_type FROM {_MANIFEST} WHERE enabled
UNION ALL SELECT CASE document_id WHEN 'doc_8' THEN 0 WHEN 'doc_2' THEN 1 ELSE 2 END, document_id, parser_type FROM {_MANIFEST} WHERE document_id IN ('doc_8', 'doc_2', 'doc_14')"""
)
def manifest_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All enabled documents, and given ones in the order asked for, each once."""
    own = _over(spark, sf_dir, _MANIFEST)
    every = manifest.select(own, all_enabled=True).withColumn("position", F.lit(None).cast("int"))
    some = manifest.select(own, ["doc_8", "doc_2", "doc_8", "doc_14"])
    return every.select("position", "document_id", "parser_type").unionByName(some.select("position", "document_id", "parser_type"))


_FILES = "(SELECT concat('doc_', doc_id, '.pdf') AS file_name FROM documents) AS f"


@query(
    f"""SELECT file_name, 'missing' AS problem FROM {_MANIFEST} WHERE file_name NOT IN (SELECT file_name FROM {_FILES})
UNION ALL SELECT file_name, 'unknown' FROM {_FILES} WHERE lower(file_name) NOT IN (SELECT lower(file_name) FROM {_MANIFEST})"""
)
def file_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, SC2, 2.8: the manifest against the listing of a folder."""
    return manifest.reconcile(_over(spark, sf_dir, _MANIFEST), files.list_pdfs(spark, _page_files(spark, sf_dir)))


@query(
    f"""WITH {S.DOCUMENTS}, {S.PAGES}, {S.GOLD}
SELECT b.document_id, (SELECT count(*) FROM pages p WHERE p.document_id = b.document_id) AS page_rows,
 (SELECT count(*) FROM silver s WHERE s.chunk_id = b.document_id) AS chunk_count,
 (SELECT count(*) FROM silver s JOIN gold g ON g.chunk_id = s.chunk_id WHERE s.chunk_id = b.document_id) AS embedding_count FROM bronze b"""
)
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20, J4, A5."""
    chunks = S.gold_chunks(spark, sf_dir).withColumn("document_id", F.col("chunk_id").cast("int"))
    found = audit.inventory(S.documents(spark, sf_dir).select("document_id"), S.pages(spark, sf_dir), chunks, S.gold(spark, sf_dir))
    return found.select("document_id", "page_rows", "chunk_count", "embedding_count")


_AUDITED = """audited AS (SELECT 'doc_' || doc_id AS document_id, doc_id || '.pdf' AS file_name, 'r' AS source_repository, 'u' AS source_url, 'v' AS version_or_date,
  CASE WHEN doc_id % 9 = 0 THEN 'MANUAL_REVIEW_REQUIRED' ELSE 'in force' END AS legal_status, CASE WHEN doc_id % 8 = 1 THEN 'table_layout' ELSE 'generic' END AS parser_type, doc_id % 3 <> 0 AS enabled FROM documents)"""
_FILE_FACTS = "files AS (SELECT doc_id || '.pdf' AS file_name, md5(text) AS sha256, CAST(doc_id % 5 + 1 AS INTEGER) AS page_count, CAST(doc_id % 4 AS INTEGER) AS empty_page_count FROM documents WHERE doc_id % 7 <> 2)"
_STORED = """stored AS (SELECT 'doc_' || doc_id AS document_name, CASE WHEN doc_id % 6 = 4 THEN 'x' ELSE md5(text) END AS file_hash, CAST(doc_id % 5 + 1 AS INTEGER) AS page_count,
  CAST(doc_id % 5 + CASE WHEN doc_id % 10 = 3 THEN 0 ELSE 1 END AS INTEGER) AS page_rows, CAST(doc_id % 4 AS INTEGER) AS chunk_count, CAST(doc_id % 2 AS INTEGER) AS embedding_count FROM documents WHERE doc_id % 11 <> 5)"""
_RULES = """r AS (SELECT a.*, f.sha256, f.page_count AS file_pages, f.empty_page_count, s.file_hash, s.page_count AS stored_pages, s.page_rows, s.chunk_count, s.embedding_count,
  f.file_name IS NOT NULL AS file_exists, coalesce(s.n, 0) AS copies FROM audited a LEFT JOIN files f ON f.file_name = a.file_name
  LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY document_name) AS n FROM (SELECT * FROM stored UNION ALL SELECT * FROM stored WHERE document_name LIKE '%77') QUALIFY row_number() OVER (PARTITION BY document_name) = 1) s ON s.document_name = a.document_id)"""


@query(
    f"""WITH {_AUDITED}, {_FILE_FACTS}, {_STORED}, {_RULES} SELECT document_id, enabled, file_exists,
 concat_ws(';', CASE WHEN legal_status LIKE '%MANUAL_REVIEW_REQUIRED%' THEN 'metadata need a review' END, CASE WHEN parser_type = 'table_layout' AND NOT enabled THEN 'no such parser' END,
  CASE WHEN copies = 0 THEN 'not stored' END, CASE WHEN copies = 1 AND embedding_count < chunk_count THEN 'fewer embeddings than chunks' END, CASE WHEN empty_page_count > 0 THEN 'pages without text' END) AS warnings,
 concat_ws(';', CASE WHEN NOT file_exists THEN 'file is missing' END, CASE WHEN parser_type = 'table_layout' AND enabled THEN 'no such parser' END, CASE WHEN copies > 1 THEN 'stored more than once' END,
  CASE WHEN copies = 1 AND sha256 <> file_hash THEN 'stored hash differs from the file''s' END, CASE WHEN copies = 1 AND stored_pages <> page_rows THEN 'page_count differs from stored pages' END,
  CASE WHEN copies = 1 AND stored_pages <> file_pages THEN 'page_count differs from the file''s' END, CASE WHEN copies = 1 AND enabled AND chunk_count = 0 THEN 'enabled but without chunks' END) AS failures FROM r"""
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21, V16, F14, SC5: every rule, on a manifest, files and layers made of the documents."""
    S.table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    own, files, stored = (spark.sql(f"WITH {x} SELECT * FROM {x.split()[0]}") for x in (_AUDITED, _FILE_FACTS, _STORED))
    report = audit.audit(own, files, stored.unionByName(stored.filter("document_name like '%77'")))
    return report.select("document_id", "enabled", F.col("exists").alias("file_exists"), *[F.array_join(c, ";").alias(c) for c in ("warnings", "failures")])


@query(
    f"""WITH {_AUDITED}, {_FILE_FACTS}, {_STORED}, {_RULES},
 unknown AS (SELECT 1 FROM documents WHERE doc_id % 7 <> 2 AND doc_id % 31 = 0 LIMIT 1),
 f AS (SELECT CASE WHEN NOT file_exists THEN 1 ELSE 0 END + CASE WHEN parser_type = 'table_layout' AND enabled THEN 1 ELSE 0 END + CASE WHEN copies > 1 THEN 1 ELSE 0 END + CASE WHEN copies = 1 AND sha256 <> file_hash THEN 1 ELSE 0 END
  + CASE WHEN copies = 1 AND stored_pages <> page_rows THEN 1 ELSE 0 END + CASE WHEN copies = 1 AND stored_pages <> file_pages THEN 1 ELSE 0 END + CASE WHEN copies = 1 AND enabled AND chunk_count = 0 THEN 1 ELSE 0 END AS n FROM r)
SELECT 1 AS exit_code, CAST((SELECT sum(n) FROM f) + (SELECT count(*) FROM unknown) AS BIGINT) AS failures"""
)
def audit_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK12, V16: the findings of the whole audit, files unknown to the manifest among them, and its exit code."""
    S.table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    own, facts, stored = (spark.sql(f"WITH {x} SELECT * FROM {x.split()[0]}") for x in (_AUDITED, _FILE_FACTS, _STORED))
    report = audit.audit(own, facts, stored.unionByName(stored.filter("document_name like '%77'")))
    unknown = spark.sql("SELECT concat('new_', doc_id, '.pdf') AS file_name FROM documents WHERE doc_id % 7 <> 2 AND doc_id % 31 = 0")
    found = stage(audit.findings(report, unknown), "findings")
    return found.agg(F.lit(audit.exit_code(found)).alias("exit_code"), F.count_if(F.col("level") == "failure").alias("failures"))


_REQUIRED = ["document_name", "source_name", "file_name", "file_type", "file_hash", "full_text"]
_BLANKED = {c: f"CASE WHEN document_id % 17 = {k} THEN NULL WHEN document_id % 19 = {k} THEN ' ' ELSE {c} END" for k, c in enumerate(_REQUIRED)} | {"page_count": "CASE document_id % 23 WHEN 1 THEN NULL WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE page_count END"}


@query(
    f"""WITH {S.DOCUMENTS}, d AS (SELECT document_id, {', '.join(f'{x} AS {c}' for c, x in _BLANKED.items())} FROM bronze)
SELECT document_id FROM d WHERE {' OR '.join(f"{c} IS NULL OR trim({c}) = ''" for c in _REQUIRED)} OR page_count IS NULL OR page_count <= 0"""
)
def required_fields_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every required field, damaged one by one."""
    d = S.documents(spark, sf_dir).select("document_id", *[F.expr(x).alias(c) for c, x in _BLANKED.items()])
    return validation.missing_required(d, _REQUIRED, ["page_count"]).select("document_id")


# -- texts and answers -------------------------------------------------------------------------------------------------

_CONTEXT = """'[S' || rerank_rank || ']' || chr(10) || 'Document: ' || document_name || chr(10) || 'Section type: ' || lang || chr(10) || 'Section reference: ' || source || chr(10)
 || 'Section title: unknown' || chr(10) || 'Pages: ' || (chunk_id % 5 + 1) || CASE WHEN chunk_id % 2 = 0 THEN '' ELSE '-' || (chunk_id % 5 + 2) END || chr(10) || 'Passage: ' || trim(regexp_replace(chunk_text, '\\s+', ' ', 'g'))"""


def _placed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(
        {
            "section_type": F.col("lang"), "section_reference": F.col("source"), "section_title": F.lit("").cast("string"),
            "page_start": (F.col("chunk_id") % 5 + 1).cast("int"), "page_end": F.expr("cast(chunk_id % 5 + 1 + chunk_id % 2 as int)"),
        }
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(_reranked(_candidates(spark, sf_dir)))


@query(
    f"""WITH {_RERANKED}, c AS (SELECT question_id, any_value(question) AS question, string_agg({_CONTEXT}, chr(10) || chr(10) ORDER BY rerank_rank) AS context, string_agg('[S' || rerank_rank || ']', ', ' ORDER BY rerank_rank) AS allowed FROM reranked GROUP BY 1)
SELECT question_id, 'Question:' || chr(10) || trim(question) || chr(10) || chr(10) || 'Source passages:' || chr(10) || context || chr(10) || chr(10) || 'Allowed citation markers: ' || allowed || chr(10)
 || 'Cite with these markers only, at least one for each paragraph, and answer no other question.' AS prompt FROM c"""
)
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prompt of each question, with the markers that it allows."""
    return answers.prompts(_sources(spark, sf_dir)).select("question_id", "prompt")


@query(f"WITH {_RERANKED} SELECT question_id, count(*) AS n_sources, string_agg({_CONTEXT}, chr(10) || chr(10) ORDER BY rerank_rank) AS context FROM reranked GROUP BY 1")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15, X9, X10, X12, A16."""
    return answers.prompts(_sources(spark, sf_dir)).select("question_id", F.col("n_sources").cast("long").alias("n_sources"), "context")


_SOURCES = f"""{_RERANKED}, sources AS (SELECT question_id, chunk_id, rerank_rank, trim(regexp_replace(chunk_text, '\\s+', ' ', 'g')) AS passage,
 document_name || ' — ' || source || ' — page(s) ' || (chunk_id % 5 + 1) || CASE WHEN chunk_id % 2 = 0 THEN '' ELSE '-' || (chunk_id % 5 + 2) END AS label FROM reranked)"""


def _search(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame, int], DataFrame]:
    chunks = _placed(S.gold_chunks(spark, sf_dir))
    return lambda questions, k: lexical.top_k_by_words(chunks, questions, k)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query(f"WITH {_SOURCES} SELECT question_id, rerank_rank, chunk_id, label FROM sources")
def answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to ranked and labelled sources, in one job."""
    found = jobs.evidence(_asked(spark, sf_dir), _search(spark, sf_dir), retrieval.overlap_score(F.col("question"), F.col("chunk_text")))
    name = X.source_label(F.col("document_name"), F.col("section_reference"), F.col("page_start"), F.col("page_end"))
    return found.select("question_id", "rerank_rank", "chunk_id", name.alias("label"))


@query(
    f"""WITH {_SOURCES}, a AS (SELECT question_id, left(arg_min(passage, rerank_rank), 200) || ' [S1]' AS answer, arg_min(label, rerank_rank) AS best,
 string_agg('[S' || rerank_rank || '] ' || label, chr(10) ORDER BY rerank_rank) AS all_labels FROM sources GROUP BY 1)
SELECT question_id, answer, 'ok' AS citation_status, '1' AS cited, answer || chr(10) || chr(10) || 'Cited:' || chr(10) || '[S1] ' || best || chr(10) || chr(10) || 'Retrieved:' || chr(10) || all_labels AS report FROM a"""
)
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16, X11, X13, U3, AR1, SK11: questions to cited answers, with the offline provider."""
    rows = jobs.grounded(_asked(spark, sf_dir), _search(spark, sf_dir), retrieval.overlap_score(F.col("question"), F.col("chunk_text")), answers.extractive)
    return rows.select("question_id", "answer", "citation_status", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"), "report")


_ANSWERS = "concat(text, CASE turn % 5 WHEN 0 THEN ' [S1] and [S3][S1]' WHEN 1 THEN ' [S9] [S2] [S0]' WHEN 2 THEN ' [s1]' WHEN 3 THEN '' ELSE ' [S4]' END)"
_FOUND = f"list_transform(regexp_extract_all({_ANSWERS}, '\\[S(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT))"


@query(
    f"""WITH a AS (SELECT conv_id, turn, {_FOUND} AS c FROM conversations)
SELECT conv_id, turn, CASE WHEN len(c) = 0 THEN 'none' WHEN len(list_filter(c, lambda x: x < 1 OR x > 4)) > 0 THEN 'invalid' ELSE 'ok' END AS citation_status,
 array_to_string(list_transform(list_sort(list_distinct(c)), lambda x: CAST(x AS VARCHAR)), ',') AS cited FROM a"""
)
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR1, R10, T6."""
    rows = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWERS).alias("answer"), F.lit(4).alias("n_sources"))
    return answers.check_citations(rows).select("conv_id", "turn", "citation_status", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


_ROUTES = [("citations", ["citation", "source markers"]), ("memory", ["out of memory"]), ("model", ["timed out", "offline"])]
_MESSAGES = """(SELECT doc_id AS id, concat(substr(text, 1, 40), CASE doc_id % 6 WHEN 0 THEN ' bad CITATION in answer' WHEN 1 THEN ' device out of Memory' WHEN 2 THEN ' request timed out, no source markers'
 WHEN 3 THEN ' Offline' WHEN 4 THEN ' else' ELSE '' END) AS message FROM documents) AS t"""


@query(
    f"""SELECT id, CASE WHEN lower(message) LIKE '%citation%' OR lower(message) LIKE '%source markers%' THEN 'citations' WHEN lower(message) LIKE '%out of memory%' THEN 'memory'
 WHEN lower(message) LIKE '%timed out%' OR lower(message) LIKE '%offline%' THEN 'model' ELSE 'other' END AS route FROM {_MESSAGES}"""
)
def error_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    return _over(spark, sf_dir, _MESSAGES).select("id", X.route(F.col("message"), _ROUTES, "other").alias("route"))


@query(
    r"""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\[S\d+\]', '<span class="cite">\0</span>', 'g') AS html
FROM (SELECT doc_id, text || ' <a href="x">''&''</a> [S12]' AS t FROM documents)"""
)
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15."""
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.html(F.concat("text", F.lit(" <a href=\"x\">'&'</a> [S12]"))).alias("html"))


_CELLS = """(SELECT doc_id AS id, CASE WHEN doc_id % 7 < 6 THEN concat(CASE doc_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '  +' WHEN 2 THEN '-' WHEN 3 THEN ' @' WHEN 4 THEN 'x=' ELSE '' END, substr(text, 1, 30)) END AS cell FROM documents) AS t"""


@query(f"SELECT id, CASE WHEN regexp_matches(regexp_replace(cell, '\\s', '', 'g'), '^[=+\\-@]') THEN '''' || cell ELSE cell END AS cell FROM {_CELLS}")
def spreadsheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK9."""
    return _over(spark, sf_dir, _CELLS).select("id", X.spreadsheet_safe(F.col("cell")).alias("cell"))


@query("SELECT doc_id, CASE WHEN length(t) > 700 THEN substr(t, 1, 700) || '...' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK10, X1, X8."""
    return S.table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id, replace(text, 'the', '<redacted>') AS text, 'Instruct: find' || chr(10) || 'Query: ' || trim(source) AS query FROM documents")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14, X16."""
    d = S.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.redact(F.col("text"), "the").alias("text"), X.query_with_instruction(F.concat(F.lit(" "), "source", F.lit(" ")), "find").alias("query"))


_SPANS = """(SELECT doc_id AS id, source AS document_name, CASE doc_id % 3 WHEN 0 THEN concat('Article ', doc_id % 40) WHEN 1 THEN '' END AS section_reference,
 CAST(CASE WHEN doc_id % 11 <> 3 THEN doc_id % 5 + 1 END AS INT) AS page_start, CAST(CASE WHEN doc_id % 13 <> 4 THEN doc_id % 5 + 1 + doc_id % 2 END AS INT) AS page_end FROM documents) AS t"""


@query(
    f"""SELECT id, CASE document_name WHEN 'src1' THEN 'Name One' WHEN 'src2' THEN 'Name Two' ELSE document_name END || ' — ' || coalesce(nullif(section_reference, ''), 'unknown section') || ' — page(s) ' ||
 CASE WHEN page_start IS NULL OR page_end IS NULL THEN 'unknown' WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '-' || page_end END AS label FROM {_SPANS}"""
)
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9-X11, J10."""
    rows = _over(spark, sf_dir, _SPANS)
    return rows.select("id", X.source_label(X.label(F.col("document_name"), {"src1": "Name One", "src2": "Name Two"}), F.col("section_reference"), F.col("page_start"), F.col("page_end")).alias("label"))


# -- evaluation --------------------------------------------------------------------------------------------------------
# Question i expects the sources of the language that its document has, on pages 1 to 3.

_EVAL = f"""{_RERANKED}, q AS (SELECT item_id AS id, lang FROM benchmark JOIN documents ON doc_id = item_id + 20),
 hit AS (SELECT c.question_id AS id, c.chunk_id, c.vector_rank FROM candidates c JOIN q ON q.id = c.question_id AND q.lang = c.lang WHERE c.chunk_id % 5 + 1 <= 3)"""


def _eval(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    d = S.table(spark, sf_dir, "documents").select((F.col("doc_id") - 20).alias("id"), "lang")
    b = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    source = F.struct(F.col("lang").alias("section_type"), F.lit(" ANY  source").alias("section_reference"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("pdf_pages"))
    questions = b.join(d, "id").select("id", F.lit("Corpus.PDF").alias("expected_document"), F.array(source).alias("expected_sources"))
    page = (F.col("chunk_id") % 5 + 1).cast("int")
    chunks = candidates.select(
        F.col("question_id").alias("id"), "chunk_id", "vector_rank", F.lit("corpus").alias("document_name"), F.upper("lang").alias("section_type"), F.lit("any source").alias("section_reference"),
        page.alias("page_start"), page.alias("page_end"),
    )
    return questions, chunks


@query(f"WITH {_EVAL} SELECT id, chunk_id, vector_rank FROM hit")
def anchor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, F17, X3, X4."""
    questions, chunks = _eval(spark, sf_dir, _candidates(spark, sf_dir))
    return evaluation.hits(chunks, questions, ["id"]).select("id", "chunk_id", "vector_rank")


@query(f"WITH {_EVAL} SELECT q.id, min(vector_rank) AS first_rank FROM q LEFT JOIN hit ON hit.id = q.id GROUP BY 1")
def first_hit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    questions, chunks = _eval(spark, sf_dir, _candidates(spark, sf_dir))
    return evaluation.first_hit_rank(chunks, questions, "vector_rank")


_EVALUATED = f"""{_EVAL}, after AS (SELECT h.id, min(r.rerank_rank) AS first FROM hit h JOIN reranked r ON r.question_id = h.id AND r.chunk_id = h.chunk_id GROUP BY 1),
 firsts AS (SELECT q.id, min(vector_rank) AS first FROM q LEFT JOIN hit ON hit.id = q.id GROUP BY 1),
 records AS (SELECT f.id, CASE WHEN f.id % 7 = 3 THEN 'error' ELSE 'completed' END AS status, CASE WHEN f.id % 7 <> 3 THEN f.first IS NOT NULL END AS vector_hit,
  CASE WHEN f.id % 7 <> 3 THEN coalesce(f.first <= 4, false) END AS vector_top_k_hit, CASE WHEN f.id % 7 <> 3 THEN a.first IS NOT NULL END AS reranked_hit FROM firsts f LEFT JOIN after a ON a.id = f.id)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _candidates(spark, sf_dir)
    questions, chunks = _eval(spark, sf_dir, candidates)
    after = chunks.join(_reranked(candidates).select(F.col("question_id").alias("id"), "chunk_id", "rerank_rank"), ["id", "chunk_id"])
    status = questions.select("id", F.when(F.col("id") % 7 == 3, "error").otherwise("pending").alias("status"))
    rows = evaluation.evaluate(questions, status, chunks, after, 4)
    return rows.select("id", "status", "vector_hit", "vector_top_k_hit", "reranked_hit")


@query(f"WITH {_EVALUATED} SELECT * FROM records")
def evaluation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C23."""
    return _records(spark, sf_dir)


@query(
    f"""WITH {_RERANKED}{S.GOLD[len(S.GOLD_CHUNKS) :]}, q AS (SELECT item_id AS id, CASE WHEN item_id % 11 = 4 THEN 'none' ELSE lang END AS lang FROM benchmark JOIN documents ON doc_id = item_id + 20),
 state AS (SELECT id, lang, CASE WHEN NOT EXISTS (SELECT 1 FROM silver s JOIN gold g ON g.chunk_id = s.chunk_id WHERE g.model_version = '2' AND s.lang = q.lang AND s.chunk_id % 5 + 1 <= 3) THEN 'unresolved_ground_truth'
   WHEN id % 7 = 3 AND EXISTS (SELECT 1 FROM candidates c WHERE c.question_id = q.id) THEN 'error' ELSE 'completed' END AS status FROM q),
 firsts AS (SELECT t.id, any_value(t.status) AS status, min(c.vector_rank) AS v, min(r.rerank_rank) AS r FROM state t
   LEFT JOIN candidates c ON c.question_id = t.id AND c.lang = t.lang AND c.chunk_id % 5 + 1 <= 3 AND t.status = 'completed' LEFT JOIN reranked r ON r.question_id = t.id AND r.chunk_id = c.chunk_id GROUP BY 1)
SELECT id, status, v AS first_vector_hit_rank, r AS first_reranked_hit_rank, CASE WHEN status = 'completed' THEN v IS NOT NULL END AS vector_hit, CASE WHEN status = 'completed' THEN coalesce(v <= 4, false) END AS vector_top_k_hit,
 CASE WHEN status = 'completed' THEN r IS NOT NULL END AS reranked_hit, CASE WHEN status = 'error' THEN 'vector_retrieval' END AS error_stage, CASE WHEN status = 'error' THEN 'no chunk_text' END AS error FROM firsts"""
)
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run; every seventh question's first candidate has no text, every eleventh expects what no corpus holds."""
    candidates = _candidates(spark, sf_dir)
    questions, _ = _eval(spark, sf_dir, candidates)
    none = F.transform("expected_sources", lambda x: x.withField("section_type", F.lit("none")))
    questions = questions.withColumn("expected_sources", F.when(F.col("id") % 11 == 4, none).otherwise(F.col("expected_sources")))
    page = (F.col("chunk_id") % 5 + 1).cast("int")
    place = {"document_name": F.lit("corpus"), "section_type": F.upper("lang"), "section_reference": F.lit("any source"), "page_start": page, "page_end": page}
    flagged = retrieval.with_searchable_flag(S.gold_chunks(spark, sf_dir), S.gold(spark, sf_dir), "m", "2").withColumns(place)
    blank = F.when(F.expr("question_id % 7 = 3 and vector_rank = 1"), " ").otherwise(F.col("chunk_text"))
    found = candidates.withColumns(place).withColumns({"chunk_text": blank, "similarity": 1.0 / F.col("vector_rank")}).withColumnRenamed("question_id", "id")
    after = _reranked(candidates).withColumns(place).withColumnRenamed("question_id", "id")
    columns = ["id", "status", "first_vector_hit_rank", "first_reranked_hit_rank", "vector_hit", "vector_top_k_hit", "reranked_hit", "error_stage", "error"]
    return jobs.evaluate(questions, flagged, found, after).select(*columns)


_RATES = ", ".join(f"count(*) FILTER ({c}) AS {c}_hits, count({c}) AS {c}_measured, count(*) FILTER ({c}) / nullif(count({c}), 0) AS {c}_rate" for c in ("vector_hit", "vector_top_k_hit", "reranked_hit"))


@query(
    f"""WITH {_EVALUATED} SELECT count(*) AS questions, {_RATES}, count(reranked_hit) AS paired, count(*) FILTER (reranked_hit AND NOT vector_top_k_hit) AS gained,
 count(*) FILTER (NOT reranked_hit AND vector_top_k_hit) AS lost FROM records"""
)
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C25, A11, A12."""
    return evaluation.summarize(_records(spark, sf_dir))


@query(f"WITH {_EVALUATED} SELECT status, count(*) AS n FROM records GROUP BY 1")
def evaluation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return evaluation.status_counts(_records(spark, sf_dir))


@query(f"WITH {S.GOLD} SELECT count(*) AS chunks, count(*) FILTER (s.chunk_id IN (SELECT chunk_id FROM gold WHERE model_version = '2')) AS searchable, array_to_string(list_sort(list(DISTINCT source)), ',') AS documents, 'v' AS versions, 0 AS duplicate_chunks FROM silver s")
def corpus_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, A15."""
    rows = retrieval.with_searchable_flag(S.gold_chunks(spark, sf_dir), S.gold(spark, sf_dir), "m", "2").withColumns({"document_name": F.col("source"), "chunking_version": F.lit("v")})
    return evaluation.corpus_facts(rows).withColumns({c: F.array_join(c, ",") for c in ("documents", "versions")})


_WRONG = {
    "no id": "item_id % 9 = 0", "no question": "item_id % 8 = 2", "no document": "item_id % 7 = 3", "no sources": "item_id % 6 = 4",
    "incomplete source": "item_id % 6 = 5", "wrong pages": "item_id % 6 = 3",
}
_QUESTION_ID = "CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 10 = 1 THEN 'again' ELSE concat('q', item_id) END"


@query(
    " UNION ALL ".join(f"SELECT {_QUESTION_ID} AS id, '{problem}' AS problem FROM benchmark WHERE {rule}" for problem, rule in _WRONG.items())
    + f" UNION ALL SELECT id, 'id is not unique' FROM (SELECT {_QUESTION_ID} AS id FROM benchmark) WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
)
def dataset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C22, with every fault planted by the item's number."""
    reference, pages = F.when(F.expr("item_id % 6 = 5"), " ").otherwise("Article 6"), F.when(F.expr("item_id % 6 = 3"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    source = F.struct(F.lit("article").alias("section_type"), reference.alias("section_reference"), pages.alias("pdf_pages"))
    sources = F.when(F.expr("item_id % 6 != 4"), F.array(source)).otherwise(F.filter(F.array(source), lambda x: F.lit(False)))
    b = S.table(spark, sf_dir, "benchmark")
    rows = b.select(F.expr(_QUESTION_ID).alias("id"), F.when(F.expr("item_id % 8 = 2"), " ").otherwise(F.col("text")).alias("question"), F.expr("if(item_id % 7 = 3, null, 'd')").alias("expected_document"), sources.alias("expected_sources"))
    return evaluation.dataset_violations(rows)


_FOUND_CHUNKS = """SELECT doc_id % 37 AS question_id, CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS chunk_id, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE lang END AS chunk_text,
 CASE WHEN doc_id % 17 <> 0 THEN source END AS document_name, CASE WHEN doc_id % 19 = 0 THEN CAST('NaN' AS DOUBLE) WHEN doc_id % 23 <> 0 THEN CAST(0.5 AS DOUBLE) END AS score FROM documents"""


@query(
    f"""WITH c AS ({_FOUND_CHUNKS}) SELECT question_id, 'too many candidates' AS problem FROM c GROUP BY 1 HAVING count(*) > 27
UNION ALL SELECT question_id, CASE WHEN chunk_id IS NULL THEN 'no chunk_id' WHEN trim(chunk_text) = '' THEN 'no chunk_text' WHEN document_name IS NULL THEN 'no document_name' ELSE 'score is not finite' END
FROM c WHERE chunk_id IS NULL OR trim(chunk_text) = '' OR document_name IS NULL OR score IS NULL OR isnan(score)"""
)
def candidate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C24, with every fault planted by the document's number."""
    S.table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return retrieval.candidate_violations(spark.sql(_FOUND_CHUNKS), 27, "score")


_N_SECTIONS = "(1 + document_id % 4)"
_REFERENCE = "CASE i WHEN 1 THEN '1' WHEN 2 THEN '1.1' WHEN 3 THEN '2' ELSE '2.1' END"
_TITLE = "CASE i WHEN 1 THEN concat('Introduction to ', document_id) ELSE concat('Heading of part ', i) END"
#: Lines of an opinion made of each document's own: (part, i, j) orders them.
_OPINION = f"""SELECT document_id, 0 AS part, 0 AS i, 0 AS j, concat('Opinion on ', document_id) AS text FROM docs
 UNION ALL SELECT document_id, 1, 0, 0, 'Executive summary' FROM docs UNION ALL SELECT document_id, 1, 1, line_no, concat('- ', text) FROM records WHERE line_no % 5 = 4
 UNION ALL SELECT document_id, 2, 0, 0, 'Table of Contents' FROM docs UNION ALL SELECT document_id, 3, i, 0, {_REFERENCE} FROM sections
 UNION ALL SELECT document_id, 3, i, 1, CASE i WHEN 1 THEN concat({_TITLE}, ' ........ 3') ELSE 'Heading of' END FROM sections UNION ALL SELECT document_id, 3, i, 2, concat('part ', i, ' ..... ', i + 3) FROM sections WHERE i > 1
 UNION ALL SELECT document_id, 3, 9, 0, '3.3.2.1' FROM docs UNION ALL SELECT document_id, 3, 9, 1, 'Not a heading' FROM docs
 UNION ALL SELECT document_id, 4, i, 0, concat({_REFERENCE}, ' ', {_TITLE}) FROM sections UNION ALL SELECT document_id, 4, 1, 1, '2 Out of order' FROM docs WHERE document_id % 4 >= 2
 UNION ALL SELECT document_id, 4, CAST(line_no % {_N_SECTIONS} AS INT) + 1, line_no + 1, concat('- ', text) FROM records WHERE line_no % 5 <> 4"""


def _opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of opinions."""
    stage(structure.line_records(S.pages(spark, sf_dir)), "records").createOrReplaceTempView("records")
    S.documents(spark, sf_dir).select("document_id").createOrReplaceTempView("docs")
    spark.sql(f"SELECT document_id, explode(sequence(1, {_N_SECTIONS})) AS i FROM docs").createOrReplaceTempView("sections")
    number = F.row_number().over(W.partitionBy("document_id").orderBy("part", "i", "j"))
    return stage(spark.sql(_OPINION).select("document_id", number.alias("line_no"), F.lit(1).alias("page_number"), "text"), "opinions")


_OPINION_SECTIONS = f"""{S.RECORDS}, docs AS (SELECT CAST(doc_id AS INTEGER) AS document_id FROM documents), sections AS (SELECT document_id, CAST(unnest(range(1, {_N_SECTIONS} + 1)) AS INTEGER) AS i FROM docs),
 own AS (SELECT document_id, CASE WHEN line_no % 5 = 4 THEN 0 ELSE line_no % {_N_SECTIONS} + 1 END AS i, count(*) AS n FROM records GROUP BY ALL),
 counts AS (SELECT document_id, 'front_matter' AS section_type, 'Front matter' AS section_reference, CAST(NULL AS VARCHAR) AS section_title, 1 AS lines FROM docs
 UNION ALL SELECT d.document_id, 'executive_summary', 'Executive summary', 'Executive summary', 1 + coalesce(n, 0) FROM docs d LEFT JOIN own o ON o.document_id = d.document_id AND o.i = 0
 UNION ALL SELECT document_id, 'table_of_contents', 'Table of contents', 'Table of contents', 5 + 3 * ({_N_SECTIONS} - 1) FROM docs
 UNION ALL SELECT s.document_id, 'opinion_section', concat('Section ', {_REFERENCE.replace("CASE i", "CASE s.i")}), {_TITLE.replace("i WHEN", "s.i WHEN").replace("document_id", "s.document_id").replace("part ', i", "part ', s.i")}, 1 + coalesce(n, 0) + CASE WHEN s.i = 1 AND s.document_id % 4 >= 2 THEN 1 ELSE 0 END
 FROM sections s LEFT JOIN own o ON o.document_id = s.document_id AND o.i = s.i)"""


@query(f"WITH {_OPINION_SECTIONS} SELECT document_id, section_type, section_reference, section_title, CAST(lines AS INTEGER) AS lines FROM counts")
def opinion_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an opinion with contents, titles over two lines and headings out of order."""
    rows = structure.parse_opinion(_opinions(spark, sf_dir))
    return rows.groupBy("document_id", "section_type", "section_reference", "section_title").agg(F.count("*").cast("int").alias("lines"))


@query(
    f"""WITH RECURSIVE {S.ANNOTATED}, {_OPINION_SECTIONS.removeprefix(S.RECORDS + ", ")}
SELECT document_id, section_type, section_reference, CAST(lines AS INTEGER) AS lines FROM counts WHERE document_id % 3 = 2
UNION ALL SELECT document_id, section_type, section_reference, CAST(count(*) AS INTEGER) FROM annotated WHERE document_id % 3 = 1 GROUP BY ALL
UNION ALL SELECT document_id, 'document', 'Full document', CAST(count(*) AS INTEGER) FROM records WHERE document_id % 3 = 0 GROUP BY ALL"""
)
def parser_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the parser of its own type, all three in one build."""
    kind = F.element_at(F.array(F.lit(structure.GENERIC), F.lit(structure.REGULATION), F.lit(structure.OPINION)), (F.col("document_id") % 3 + 1).cast("int"))
    types = S.documents(spark, sf_dir).select("document_id", kind.alias("parser_type"))
    columns = ["document_id", "line_no", "page_number", "text"]
    rows = [r.select(*columns).filter(f"document_id % 3 = {k}") for k, r in enumerate((structure.line_records(S.pages(spark, sf_dir)), S.marked(spark, sf_dir), _opinions(spark, sf_dir)))]
    parsed = structure.parse(rows[0].unionByName(rows[1]).unionByName(rows[2]), types)
    return parsed.groupBy("document_id", "section_type", "section_reference").agg(F.count("*").cast("int").alias("lines"))


# -- files, models and formats, there and back -----------------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


@query("SELECT 'q' || item_id AS question_id, text AS question FROM benchmark")
def questions_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12: questions written as lines of JSON, and read with their guards."""
    path = _place(spark, "questions")
    S.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("question_id"), F.col("text").alias("question")).write.json(path)
    return files.read_questions(spark, path)


@query(
    """SELECT 'q' || item_id AS id, text AS question, 'k' || item_id % 3 AS document_key, 'Document ' || item_id % 3 AS expected_document, 'article' AS section_type, 'Article ' || item_id AS section_reference, item_id % 7 + 1 AS page FROM benchmark"""
)
def questions_of_an_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10: an evaluation file of all questions, with documents by key and expected sources."""
    path = _place(spark, "evaluation")
    source = F.struct(F.lit("article").alias("section_type"), F.concat(F.lit("Article "), "item_id").alias("section_reference"), F.array((F.col("item_id") % 7 + 1).cast("int")).alias("pdf_pages"))
    key = F.concat(F.lit("k"), F.col("item_id") % 3)
    rows = S.table(spark, sf_dir, "benchmark").select(F.struct(F.concat(F.lit("q"), "item_id").alias("id"), key.alias("document_key"), F.col("text").alias("question"), F.array(source).alias("expected_sources")).alias("q"))
    documents = F.create_map(*[x for k in range(3) for x in (F.lit(f"k{k}"), F.struct(F.lit(f"Document {k}").alias("document_name")))])
    whole = rows.agg(F.collect_list("q").alias("questions")).select(F.lit("1.0").alias("schema_version"), F.lit("d").alias("dataset_id"), F.lit("1").alias("version"), documents.alias("documents"), "questions")  # questions are few
    whole.write.json(path)
    read = files.read_evaluation(spark, path).select("*", F.explode("expected_sources").alias("s"))
    return read.select("id", "question", "document_key", "expected_document", "s.section_type", "s.section_reference", F.col("s.pdf_pages")[0].cast("long").alias("page"))


_SUMMARY_ROWS = "(SELECT concat('q', item_id) AS id, 'completed' AS status, CASE item_id % 4 WHEN 0 THEN concat('=', substr(text, 1, 20)) WHEN 1 THEN concat('a \"quoted\", ', chr(10), 'line ', item_id) ELSE concat('x ', item_id) END AS question, item_id % 3 = 0 AS vector_hit FROM benchmark) AS t"


@query(f"SELECT id, status, CASE WHEN question LIKE '=%' THEN '''' || question ELSE question END AS question, CAST(vector_hit AS VARCHAR) AS vector_hit, CAST(NULL AS VARCHAR) AS error FROM {_SUMMARY_ROWS}")
def summary_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK9: a summary of all questions for spreadsheets, as one file with a byte order mark, quotes and line breaks, read back."""
    path = _place(spark, "summary.csv")
    sinks.write_summary(_over(spark, sf_dir, _SUMMARY_ROWS), path)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col(rows.columns[0]).alias("id"), "status", "question", "vector_hit", "error")


@query("SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY 1")
def report_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK8: a report as one JSON file, renamed over an older one, read back."""
    path = _place(spark, "report.json")
    found = S.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))
    sinks.write_report(spark, {"languages": "none yet"}, path)
    sinks.write_report(spark, {"languages": [r.asDict() for r in found.collect()]}, path)
    kind = "languages array<struct<lang: string, documents: bigint, characters: bigint>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.explode("languages").alias("x")).select("x.*")


@query(f"WITH {S.DOCUMENTS} SELECT document_id, document_name, source_name, CAST(NULL AS VARCHAR) AS source_url, page_count FROM bronze")
def evolved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK16: rows of an older schema, written and read in the present one."""
    path = _place(spark, "documents")
    S.documents(spark, sf_dir).drop("file_type").write.parquet(path)
    return sinks.evolved(spark.read.parquet(path), schemas.BRONZE_DOCUMENTS).select("document_id", "document_name", "source_name", "source_url", "page_count")


@query(
    f"""WITH {S.DOCUMENTS}, {S.PAGES} SELECT document_name, file_name, file_hash, string_agg(page_text || chr(10) || chr(10), '' ORDER BY page_number) AS full_text, CAST(count(*) AS INTEGER) AS page_count
FROM bronze b JOIN pages p ON p.document_id = b.document_id GROUP BY document_name, file_name, file_hash"""
)
def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the hash of their file, their text and number of pages; none may lack any of them."""
    d = S.documents(spark, sf_dir)
    own = ingestion.prepared(d.select("document_id", "document_name", "file_name"), S.pages(spark, sf_dir), d.select("file_name", F.col("file_hash").alias("sha256")))
    return own.select("document_name", "file_name", "file_hash", "full_text", "page_count")


@query(f"WITH {S.DOCUMENTS} SELECT document_id, document_name FROM bronze WHERE document_id % 4 = 1")
def documents_stored_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6: the stored row of each wanted name, of which others are stored twice."""
    d = S.documents(spark, sf_dir).select("document_id", "document_name")
    return ingestion.exactly_one(d.filter("document_id % 4 = 1"), d.unionByName(d.filter("document_id % 4 = 2")))


@query(f"WITH {_RERANKED} SELECT question_id, chunk_id FROM reranked WHERE question_id % 3 = 0 AND rerank_rank = 2")
def sources_beyond_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that were no candidates; the second one of every third question is taken from the candidates."""
    candidates = stage(_candidates(spark, sf_dir), "candidates")
    after = stage(_reranked(candidates), "reranked")
    gone = after.filter("question_id % 3 = 0 and rerank_rank = 2").select("question_id", "chunk_id")
    keys = ["question_id", "chunk_id"]
    return ingestion.not_contained(after, candidates.join(gone, keys, "left_anti"), keys).select(*keys)


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS n, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e FROM documents")
def embedded_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a model that is asked in batches and replies in the reverse order."""

    def model(texts: list[str]) -> dict:
        return {"data": [{"index": i, "embedding": [len(t), t.count("e")]} for i, t in reversed(list(enumerate(texts)))]}

    rows = providers.embed(S.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 2, model, batch=7)
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("n"), F.col("embedding")[1].cast("double").alias("e"))


@query(f"WITH {_CANDIDATES} SELECT question_id, chunk_id, CAST(length(question) * 1000 + length(chunk_text) % 1000 AS DOUBLE) AS reranker_score FROM candidates")
def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a model that is asked for pairs in batches."""
    model = lambda pairs: [len(q) * 1000.0 + len(t) % 1000 for q, t in pairs]
    return providers.score_pairs(_candidates(spark, sf_dir), model).select("question_id", "chunk_id", "reranker_score")


@query("SELECT item_id, 'Answer to ' || length(text) || ' [S1]' AS answer FROM benchmark")
def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model that is asked for prompts in batches."""
    prompts = S.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return providers.generate(prompts, lambda texts: [f"Answer to {len(t)} [S1]" for t in texts], batch=9).select("item_id", "answer")


@query(f"SELECT e.vec_id, {_COSINE.format(a='e.embedding', b='f.embedding')} AS similarity FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1")
def strict_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: similarities of neighbours; a vector that is missing, zero or of another dimension would stop it."""
    e = S.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    f = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(f, "vec_id").select("vec_id", F.round(V.strict_cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    """WITH t AS (SELECT doc_id, length(text) AS n, TIMESTAMP '2024-02-28 23:59:00' + to_seconds(doc_id * 61) AS moment FROM documents)
SELECT doc_id, round(n / 7.0, 4) AS seconds, printf('%.4f', n / 8.0) AS digits, CASE WHEN doc_id % 5 = 0 THEN 'n/a' ELSE printf('%.1f%%', 100 * (doc_id % 8) / 8.0) END AS share, strftime(moment, '%Y%m%dT%H%M%SZ') || '_' || doc_id AS run,
 strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at_text FROM t"""
)
def formatted_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings, shares, run names and times as texts."""
    at = F.expr("timestamp '2024-02-28 23:59:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id * 61)")
    n = F.length("text")
    share = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 8) / 8.0)
    return S.table(spark, sf_dir, "documents").select(
        "doc_id", X.seconds(n / 7.0).alias("seconds"), X.four_digits(n / 8.0).alias("digits"), X.percent(share).alias("share"), X.run_id(at, F.col("doc_id").cast("string")).alias("run"), X.utc_text(at).alias("at_text")
    )
