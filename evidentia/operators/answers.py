"""From ranked sources to cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import citation_status, cited, label, or_unknown, page_span, source_label, squeeze, strip


def context_block(number: Column, labels: dict[str, str]) -> Column:
    """One source of a prompt, in seven lines (their labels are fixed values)."""
    parts = [
        F.concat(F.lit("[S"), number.cast("string"), F.lit("]")),
        F.concat(F.lit("Document: "), label(F.col("document_name"), labels)),
        F.concat(F.lit("Section type: "), or_unknown(F.col("section_type"))),
        F.concat(F.lit("Section reference: "), or_unknown(F.col("section_reference"))),
        F.concat(F.lit("Section title: "), or_unknown(F.col("section_title"))),
        F.concat(F.lit("Pages: "), page_span(F.col("page_start"), F.col("page_end"))),
        F.concat(F.lit("Passage: "), squeeze(F.col("chunk_text"))),
    ]
    return F.concat_ws("\n", *parts)


def prompts(sources: DataFrame, rank: str = "rerank_rank", by: str = "question_id", labels: dict[str, str] | None = None) -> DataFrame:
    """(by, n_sources, context, prompt, source_labels) of each question, from its ranked sources with ``question``."""
    labels = labels or {}
    name = source_label(label(F.col("document_name"), labels), F.col("section_reference"), F.col("page_start"), F.col("page_end"))
    rows = sources.select(by, "question", F.struct(rank, context_block(F.col(rank), labels).alias("block"), name.alias("name")).alias("s"))
    rows = rows.groupBy(by).agg(F.first("question").alias("question"), F.array_sort(F.collect_list("s")).alias("s"))
    context = F.array_join(F.transform("s", lambda x: x["block"]), "\n\n")
    allowed = F.array_join(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.concat(F.lit("[S"), i.cast("string"), F.lit("]"))), ", ")
    prompt = F.concat(
        F.lit("Question:\n"), strip(F.col("question")), F.lit("\n\nSource passages:\n"), context, F.lit("\n\nAllowed citation markers: "), allowed,
        F.lit("\nCite with these markers only, at least one for each paragraph, and answer no other question."),
    )
    return rows.select(by, F.size("s").alias("n_sources"), context.alias("context"), prompt.alias("prompt"), F.transform("s", lambda x: x["name"]).alias("source_labels"))


def check_citations(answers: DataFrame) -> DataFrame:
    """``answers`` (answer, n_sources) with the status of their citations and the numbers cited."""
    return answers.withColumns({"citation_status": citation_status(F.col("answer"), F.col("n_sources")), "cited": cited(F.col("answer"))})


def answer(prompts_: DataFrame, generate, strict: bool = True) -> DataFrame:
    """Answers to prompts. generate: function that adds ``answer``. strict: a wrong citation raises an error."""
    rows = check_citations(generate(prompts_))
    if not strict:
        return rows
    wrong = F.raise_error(F.concat(F.lit("citations of the answer are "), F.col("citation_status")))
    return rows.withColumn("citation_status", F.when(F.col("citation_status") == "ok", F.col("citation_status")).otherwise(wrong.cast("string")))


def extractive(prompts_: DataFrame, most: int = 200) -> DataFrame:
    """The offline provider of answers: the beginning of the first source, with its marker."""
    passage = F.regexp_extract("context", r"Passage: ([^\n]*)", 1)
    return prompts_.withColumn("answer", F.concat(F.left(passage, F.lit(most)), F.lit(" [S1]")))


def answer_report(rows: DataFrame) -> DataFrame:
    """``rows`` with a text report: the answer, and its cited and retrieved sources."""
    of = lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("] "), F.try_element_at("source_labels", n.cast("int")))
    cited_lines = F.array_join(F.transform("cited", of), "\n")
    all_lines = F.array_join(F.transform(F.sequence(F.lit(1), F.size("source_labels")), of), "\n")
    return rows.withColumn("report", F.concat(F.col("answer"), F.lit("\n\nCited:\n"), cited_lines, F.lit("\n\nRetrieved:\n"), all_lines))
