"""Schemas of the layers; constraints are checked by ``evidentia.operators.validation``."""

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()), "array<int>": T.ArrayType(T.IntegerType()),
}


def columns(text: str) -> T.StructType:
    """A schema from ``name type, ...``; needs no session, so that modules can be imported without one."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in text.split(","))])


#: The names, types and order of the tables' and files' fields.
_MANIFEST = [
    "document_id", "file_name", "official_title", "short_title", "issuing_body", "source_repository", "source_url",
    "document_type", "legal_status", "language", "version_or_date", "parser_type",
]
MANIFEST_DOCUMENT = T.StructType([*[T.StructField(n, T.StringType()) for n in _MANIFEST], T.StructField("enabled", T.BooleanType())])
MANIFEST = columns("schema_version string, corpus_id string, corpus_version string").add("documents", T.ArrayType(MANIFEST_DOCUMENT))
BRONZE_DOCUMENTS = columns(
    "document_id int, document_name string, source_name string, source_url string, file_name string, file_type string, "
    "file_hash string, full_text string, page_count int, loaded_at timestamp_ntz"
)
BRONZE_PAGES = columns("document_id int, page_number int, page_text string, page_char_length int, loaded_at timestamp_ntz")
SILVER_CHUNKS = columns(
    "chunk_id int, document_id int, document_name string, chunk_order int, chunk_text string, chunk_char_length int, "
    "chunk_token_count int, page_start int, page_end int, section_type string, section_reference string, section_title string, "
    "chunk_hash string, chunking_version string, created_at timestamp_ntz"
)
GOLD_EMBEDDINGS = columns(
    "embedding_id bigint, chunk_id int, chunk_hash string, embedding_input_hash string, model_alias string, model_id string, "
    "model_version string, embedding_dimension int, embedding array<float>, created_at timestamp, updated_at timestamp"
)
SOURCES = T.ArrayType(columns("section_type string, section_reference string, pdf_pages array<int>"))
QUESTIONS = columns("id string, question string, document_key string, expected_document string").add("expected_sources", SOURCES)
EVALUATION = (
    columns("schema_version string, dataset_id string, version string")
    .add("documents", T.MapType(T.StringType(), columns("document_name string, title string, source_url string")))
    .add("questions", T.ArrayType(columns("id string, document_key string, question string").add("expected_sources", SOURCES)))
)
