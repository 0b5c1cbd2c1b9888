"""The layers' tables derived from the driver's: one DataFrame and one SQL text for each, equal by construction of the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a page.
PAGE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").cast("int").alias("document_id"), name.alias("document_name"), F.col("source").alias("source_name"),
        F.concat(name, F.lit(".pdf")).alias("file_name"), F.lit("PDF").alias("file_type"), F.sha2("text", 256).alias("file_hash"),
        F.col("text").alias("full_text"), F.ceil(F.size(F.split("text", "\n")) / PAGE).cast("int").alias("page_count"),
    )


DOCUMENTS = f"""bronze AS (SELECT CAST(doc_id AS INTEGER) AS document_id, 'doc_' || doc_id AS document_name, source AS source_name,
  'doc_' || doc_id || '.pdf' AS file_name, 'PDF' AS file_type, sha256(text) AS file_hash, text AS full_text,
  CAST(ceil(len(string_split(text, chr(10))) / {PAGE}.0) AS INTEGER) AS page_count FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("document_id", F.split("full_text", "\n").alias("l"), "page_count")
    cut = F.transform(F.sequence(F.lit(0), F.col("page_count") - 1), lambda i: F.array_join(F.slice("l", i * PAGE + 1, F.lit(PAGE)), "\n"))
    rows = d.select("document_id", F.posexplode(cut).alias("n", "page_text"))
    return rows.select("document_id", (F.col("n") + 1).alias("page_number"), "page_text", F.length("page_text").alias("page_char_length"))


PAGES = f"""raw_lines AS (SELECT CAST(doc_id AS INTEGER) AS document_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
pages AS (SELECT document_id, CAST((k - 1) // {PAGE} AS INTEGER) + 1 AS page_number, string_agg(line, chr(10) ORDER BY k) AS page_text
  FROM raw_lines GROUP BY ALL)"""

RECORDS = (
    PAGES
    + r""",
split_pages AS (SELECT document_id, page_number, unnest(string_split(page_text, chr(10))) AS raw,
  generate_subscripts(string_split(page_text, chr(10)), 1) AS k FROM pages),
squeezed AS (SELECT document_id, page_number, k, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM split_pages),
records AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, k) AS INTEGER) AS line_no,
  page_number, text FROM squeezed WHERE text <> '')"""
)

#: Lines that make a regulation of any document: markers in, out of and beyond the expected order.
MARKED = """CASE WHEN line_no = 1 THEN 'WHEREAS:'
 WHEN line_no BETWEEN 2 AND 6 AND (line_no + document_id) % 3 <> 0 THEN concat('(', line_no - 1 - document_id % 2, ') ', text)
 WHEN line_no = 7 THEN 'HAVE ADOPTED THIS REGULATION:' WHEN line_no = 8 THEN 'chapter iv'
 WHEN line_no % 40 = 39 AND document_id % 3 = 0 THEN 'Annex ix'
 WHEN line_no % 3 = 0 THEN concat('Article ', line_no % 4 + 1) WHEN line_no % 10 = 2 THEN 'SECTION 07' ELSE text END"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.operators.structure import line_records

    return line_records(pages(spark, sf_dir)).withColumn("text", F.expr(MARKED))


MARKED_RECORDS = RECORDS + f", marked AS (SELECT document_id, line_no, page_number, {MARKED} AS text FROM records)"

#: The parser of regulations as a machine over lines, one line a step.
ANNOTATED = (
    MARKED_RECORDS
    + r""",
titled AS (SELECT *, trim(rtrim(lead(text) OVER (PARTITION BY document_id ORDER BY line_no), '`')) AS title FROM marked),
machine AS (
 SELECT document_id, 0 AS line_no, 0 AS page_number, '' AS text, false AS rec, false AS act, false AS ann, 1 AS er, 1 AS ea,
   'front_matter' AS section_type, 'Front matter' AS section_reference, CAST(NULL AS VARCHAR) AS section_title
 FROM (SELECT DISTINCT document_id FROM titled)
 UNION ALL
 SELECT document_id, line_no, page_number, text, rec, act, ann,
   er + CAST(is_rec AS INTEGER), ea + CAST(is_art AS INTEGER),
   CASE WHEN is_art THEN 'article' WHEN is_sec THEN 'legal_section' WHEN is_chap THEN 'chapter' WHEN is_ann THEN 'annex'
     WHEN is_rec THEN 'recital' WHEN is_enact THEN 'enacting_formula' ELSE section_type END,
   CASE WHEN is_art THEN 'Article ' || ea WHEN is_sec THEN 'Section ' || regexp_extract(text, '(\d+)$', 1)
     WHEN is_chap THEN 'Chapter ' || upper(regexp_extract(text, '(\w+)$', 1)) WHEN is_ann THEN 'Annex ' || upper(regexp_extract(text, '(\w+)$', 1))
     WHEN is_rec THEN 'Recital ' || er WHEN is_enact THEN 'Enacting formula' ELSE section_reference END,
   CASE WHEN is_art OR is_sec OR is_chap OR is_ann THEN title WHEN is_rec OR is_enact THEN NULL ELSE section_title END
 FROM (
  SELECT *, rec AND coalesce(TRY_CAST(nullif(regexp_extract(text, '^\((\d+)\)(\s.*)?$', 1), '') AS BIGINT) = er, false) AS is_rec,
    act AND NOT ann AND coalesce(TRY_CAST(nullif(regexp_extract(text, '^(?i:article)\s+(\d+)$', 1), '') AS BIGINT) = ea, false) AS is_art,
    act AND NOT ann AND regexp_full_match(text, '(?i)section\s+\d+') AS is_sec,
    act AND NOT ann AND regexp_full_match(text, '(?i)chapter\s+[ivxlcdm]+') AS is_chap
  FROM (
   SELECT m.document_id, t.line_no, t.page_number, t.text, t.title, m.er, m.ea, m.section_type, m.section_reference, m.section_title,
     upper(t.text) = 'HAVE ADOPTED THIS REGULATION:' AS is_enact, regexp_full_match(t.text, '(?i)annex\s+[ivxlcdm]+') AS is_ann,
     CASE WHEN upper(t.text) = 'WHEREAS:' THEN true WHEN upper(t.text) = 'HAVE ADOPTED THIS REGULATION:' THEN false ELSE m.rec END AS rec,
     m.act OR upper(t.text) = 'HAVE ADOPTED THIS REGULATION:' AS act, m.ann OR regexp_full_match(t.text, '(?i)annex\s+[ivxlcdm]+') AS ann
   FROM machine m JOIN titled t ON t.document_id = m.document_id AND t.line_no = m.line_no + 1))),
annotated AS (SELECT document_id, line_no, page_number, text, section_type, section_reference, section_title FROM machine WHERE line_no > 0)"""
)

GROUPED = (
    ANNOTATED
    + """,
islands AS (SELECT *, CASE WHEN row(section_type, section_reference, coalesce(section_title, chr(1))) IS DISTINCT FROM
  lag(row(section_type, section_reference, coalesce(section_title, chr(1)))) OVER (PARTITION BY document_id ORDER BY line_no) THEN 1 ELSE 0 END AS new
  FROM annotated),
grouped AS (SELECT document_id, line_no, page_number, text, section_type, section_reference, section_title,
  CAST(sum(new) OVER (PARTITION BY document_id ORDER BY line_no) AS INTEGER) AS group_no FROM islands)"""
)


def chunk_cte(size: int, overlap: int) -> str:
    return (
        GROUPED
        + rf""",
words AS (SELECT document_id, group_no, section_type, section_reference, section_title, line_no, page_number,
  unnest(regexp_extract_all(text || chr(10), '\s*\S+|\s+')) AS token,
  generate_subscripts(regexp_extract_all(text || chr(10), '\s*\S+|\s+'), 1) AS k FROM grouped),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id, group_no ORDER BY line_no, k) - 1 AS i,
  count(*) OVER (PARTITION BY document_id, group_no) AS n FROM words),
starts AS (SELECT DISTINCT document_id, group_no, unnest(range(0, greatest(CAST(ceil((n - {size}) / {size - overlap}.0) AS BIGINT), 0) + 1)) * {size - overlap} AS f FROM numbered),
cut AS (SELECT w.document_id, w.group_no, s.f, w.section_type, w.section_reference, w.section_title,
  trim(string_agg(token, '' ORDER BY i), ' ' || chr(10)) AS chunk_text, CAST(count(*) AS INTEGER) AS chunk_token_count,
  arg_min(page_number, i) AS page_start, arg_max(page_number, i) AS page_end
  FROM numbered w JOIN starts s ON s.document_id = w.document_id AND s.group_no = w.group_no AND i >= f AND i < f + {size} GROUP BY ALL),
chunks AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY group_no, f) AS INTEGER) AS chunk_order, chunk_text,
  CAST(length(chunk_text) AS INTEGER) AS chunk_char_length, chunk_token_count, page_start, page_end, section_type, section_reference, section_title,
  sha256(chunk_text) AS chunk_hash FROM cut WHERE chunk_text <> '')"""
    )


#: A small window, so that groups of several windows occur.
SIZE, OVERLAP = 40, 10


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidentia.operators.chunking import chunks
    from evidentia.operators.structure import parse_regulation

    return chunks(parse_regulation(marked(spark, sf_dir)), SIZE, OVERLAP).drop("chunking_version")


def gold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, as chunks of the Silver layer."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id")
    rows = d.join(e, d["doc_id"] == e["vec_id"], "left_semi")
    return rows.select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("document_name"), "lang", "source", F.col("text").alias("chunk_text"), F.sha2("text", 256).alias("chunk_hash"))


GOLD_CHUNKS = """silver AS (SELECT doc_id AS chunk_id, 'doc_' || doc_id AS document_name, lang, source, text AS chunk_text, sha256(text) AS chunk_hash
  FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: every 11th chunk has none, every 7th one of an older text, every 5th one of an older model version."""
    own = gold_chunks(spark, sf_dir).join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    old = F.when(F.col("chunk_id") % 7 == 0, F.sha2(F.concat("chunk_text", F.lit("old")), 256)).otherwise(F.col("chunk_hash"))
    version = F.when(F.col("chunk_id") % 5 == 0, "1").otherwise("2")
    return own.filter("chunk_id % 11 != 0").select("chunk_id", old.alias("chunk_hash"), F.sha2("chunk_text", 256).alias("embedding_input_hash"), F.lit("m").alias("model_id"), version.alias("model_version"), "embedding")


GOLD = (
    GOLD_CHUNKS
    + """, gold AS (SELECT chunk_id, CASE WHEN chunk_id % 7 = 0 THEN sha256(chunk_text || 'old') ELSE chunk_hash END AS chunk_hash,
  sha256(chunk_text) AS embedding_input_hash, 'm' AS model_id, CASE WHEN chunk_id % 5 = 0 THEN '1' ELSE '2' END AS model_version, embedding
  FROM silver JOIN embeddings ON vec_id = chunk_id WHERE chunk_id % 11 <> 0)"""
)
