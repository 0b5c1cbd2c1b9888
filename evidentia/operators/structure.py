"""Lines and their sections: line records, the parsers of regulations, opinions and other documents, and their summary.

``pages`` has (document_id, page_number, page_text); ``records`` (document_id, line_no, page_number, text), without blank
lines; annotated lines add section_type, section_reference and section_title.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.text import lines, squeeze
from evidentia.staging import stage

DOC = "document_id"
# Parser types of manifests.
REGULATION, OPINION, GENERIC = "eu_regulation", "edpb_opinion_28_2024", "generic"
PARSERS = [REGULATION, OPINION, GENERIC]
META = "struct<section_type: string, section_reference: string, section_title: string>"


def line_records(pages: DataFrame) -> DataFrame:
    """Squeezed lines that aren't blank, numbered from 1 through each document."""
    split = pages.select(DOC, "page_number", F.posexplode(lines("page_text")).alias("_at", "text")).withColumn("text", squeeze(F.col("text")))
    own = W.partitionBy(DOC).orderBy("page_number", "_at")
    return split.filter("text != ''").select(DOC, F.row_number().over(own).alias("line_no"), "page_number", "text")


def _whole(pattern: str, ignore_case: bool = True) -> Column:
    """The first group where the pattern matches the whole line; null elsewhere."""
    found = F.regexp_extract("text", ("(?i)" if ignore_case else "") + rf"\A(?:{pattern})\z", 1)
    return F.nullif(found, F.lit(""))


def _meta(kind: str, reference: Column, title: Column) -> Column:
    return F.struct(F.lit(kind).alias("section_type"), reference.alias("section_reference"), title.alias("section_title")).cast(META)


def _in_sequence(number: str) -> Column:
    """Line numbers at which ``number`` is the next expected one, counted from 1, over (line_no, number) of a document; that of
    number k is at place k.

    A fold, as a skipped or repeated number must not move the counter.
    """
    rows = F.array_sort(F.collect_list(F.when(F.col(number).isNotNull(), F.struct("line_no", F.col(number).alias("k")))))
    start = F.struct(F.lit(1).cast("bigint").alias("next"), F.array().cast("array<int>").alias("taken"))
    step = lambda a, x: F.when(
        x.k == a.next, F.struct((a.next + 1).alias("next"), F.concat(a.taken, F.array(x.line_no)).alias("taken"))
    ).otherwise(a)
    return F.aggregate(rows, start, step, lambda a: a.taken)


def parse_regulation(records: DataFrame) -> DataFrame:
    """Recitals between the opening and the enacting formula, then chapters, sections and articles, then annexes.

    Recitals and articles count only in sequence; an annex ends the articles for good and is one wherever it stands.
    """
    order = W.partitionBy(DOC).orderBy("line_no")
    sofar = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    upper = F.upper("text")
    enacting = upper == "HAVE ADOPTED THIS REGULATION:"
    rows = records.withColumns(
        {
            "enacting": enacting,
            "annex": F.upper(_whole(r"ANNEX\s+([IVXLCDM]+)")),
            "chapter": F.upper(_whole(r"CHAPTER\s+([IVXLCDM]+)")),
            "section": _whole(r"SECTION\s+([0-9]+)"),
            "title": squeeze(F.regexp_replace(F.lead("text").over(order), r"`+\z", "")),
            "recitals": F.coalesce(F.last(F.when(upper == "WHEREAS:", True).when(enacting, False), ignorenulls=True).over(sofar), F.lit(False)),
            "enacted": F.max(enacting).over(sofar),
        }
    )
    rows = rows.withColumn("annexed", F.max(F.col("annex").isNotNull()).over(sofar))
    body = F.col("enacted") & ~F.col("annexed")
    rows = rows.withColumns(
        {
            "body": body,
            "recital": F.when(F.col("recitals"), _whole(r"\(([0-9]+)\)(?:\s+.*)?").try_cast("bigint")),
            "article": F.when(body, _whole(r"Article\s+([0-9]+)").try_cast("bigint")),
        }
    )
    # joined by document alone, as lines are dealt by it already
    rows = rows.join(rows.groupBy(DOC).agg(_in_sequence("recital").alias("r"), _in_sequence("article").alias("a")), DOC, "left")
    at = lambda taken, number: F.when(F.col(number).between(1, F.size(taken)), F.element_at(taken, F.col(number).cast("int")))
    rows = rows.withColumn("w", F.when(at("a", "article") == F.col("line_no"), "a").when(at("r", "recital") == F.col("line_no"), "r")).drop("a", "r")
    none = F.lit(None).cast("string")
    marker = (
        F.when(F.col("w") == "a", _meta("article", F.concat(F.lit("Article "), F.col("article").cast("string")), F.col("title")))
        .when(F.col("body") & F.col("section").isNotNull(), _meta("legal_section", F.concat(F.lit("Section "), F.col("section")), F.col("title")))
        .when(F.col("body") & F.col("chapter").isNotNull(), _meta("chapter", F.concat(F.lit("Chapter "), F.col("chapter")), F.col("title")))
        .when(F.col("annex").isNotNull(), _meta("annex", F.concat(F.lit("Annex "), F.col("annex")), F.col("title")))
        .when(F.col("w") == "r", _meta("recital", F.concat(F.lit("Recital "), F.col("recital").cast("string")), none))
        .when(F.col("enacting"), _meta("enacting_formula", F.lit("Enacting formula"), none))
    )
    front = _meta("front_matter", F.lit("Front matter"), none)
    return _annotated(rows, F.coalesce(F.last(marker, ignorenulls=True).over(sofar), front))


def _annotated(rows: DataFrame, meta: Column) -> DataFrame:
    return rows.withColumn("_m", meta).select(DOC, "line_no", "page_number", "text", "_m.section_type", "_m.section_reference", "_m.section_title")


_NUMBER = r"\A[0-9]+(?:\.[0-9]+){0,2}\z"
_LEADER = r"\.{3,}\s*[0-9]+\s*\z"
#: Fixed value: lines of a heading in the table of contents, at most.
TITLE_LINES = 6


def contents(records: DataFrame) -> DataFrame:
    """(document_id, body_start, entries, problem) from tables of contents.

    entries: (reference, title) in order. problem: what is missing, else null. The heading of an entry runs up to the line
    with its page number, over TITLE_LINES lines at most; an entry without one is no entry, and the first of a number counts.
    """
    ordered = W.partitionBy(DOC).orderBy("line_no")
    rows = records.withColumns({"low": F.lower("text"), "after": F.lead("text").over(ordered)})
    start = rows.filter("low = 'table of contents'").groupBy(DOC).agg(F.min("line_no").alias("toc"))
    docs = records.select(DOC).distinct().join(start, DOC, "left")
    first = rows.join(start, DOC).filter("line_no > toc and text = '1'").groupBy(DOC).agg(F.min_by("line_no", "line_no").alias("first"), F.min_by("after", "line_no").alias("heading"))
    docs = docs.join(first, DOC, "left").withColumn("heading", F.trim(F.regexp_replace("heading", r"\s*" + _LEADER, "")))
    body = rows.join(docs, DOC).filter((F.col("line_no") > F.col("first")) & (F.col("low") == F.lower(F.concat(F.lit("1 "), F.col("heading")))))
    docs = docs.join(body.groupBy(DOC).agg(F.min("line_no").alias("body_start")), DOC, "left")
    part = rows.join(docs.select(DOC, "first", "body_start"), DOC).filter("line_no >= first and line_no < body_start")
    number = F.col("text").rlike(_NUMBER)
    ahead = F.collect_list(F.struct(number.alias("number"), F.col("text").rlike(_LEADER).alias("leader"), "text")).over(ordered.rowsBetween(1, TITLE_LINES))
    part = part.select(DOC, "line_no", "text", number.alias("is_number"), ahead.alias("ahead")).filter("is_number")
    seek = F.aggregate(
        "ahead",
        F.struct(F.lit("open").alias("state"), F.array().cast("array<string>").alias("parts")),
        lambda a, x: F.when(a.state != "open", a)
        .when(x.number, F.struct(F.lit("broken").alias("state"), a.parts.alias("parts")))
        .otherwise(F.struct(F.when(x.leader, "found").otherwise("open").alias("state"), F.concat(a.parts, F.array(x.text)).alias("parts"))),
    )
    entry = part.withColumn("e", seek).filter("e.state = 'found'")
    title = F.trim(F.regexp_replace(F.array_join("e.parts", " "), r"\s*" + _LEADER, ""))
    entry = entry.groupBy(DOC, F.col("text").alias("reference")).agg(F.min("line_no").alias("at"), F.min_by(title, "line_no").alias("title"))
    entries = entry.groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("at", "reference", "title"))).alias("entries"))
    docs = docs.join(entries, DOC, "left")
    problem = (
        F.when(F.col("toc").isNull(), "no table of contents").when(F.col("first").isNull(), "no first entry").when(F.col("body_start").isNull(), "no body start").when(F.col("entries").isNull(), "no entries")
    )
    return docs.select(DOC, "body_start", F.transform("entries", lambda x: F.struct(x.reference.alias("reference"), x.title.alias("title"))).alias("entries"), problem.alias("problem"))


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of numbered headings that follow the order of a document's entries, and the entries' places."""
    for b in batches:
        docs, at_lines, places = [], [], []
        for doc, lines, numbers, references in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = 0
            for line, number in zip(lines, numbers, strict=True):
                if at < len(references or ()) and references[at] == number:
                    docs.append(doc)
                    at_lines.append(line)
                    places.append(at)
                    at += 1
        yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.types[0]), pa.array(at_lines, pa.int32()), pa.array(places, pa.int32())], [DOC, "line_no", "at"])


def parse_opinion(records: DataFrame, strict: bool = True) -> DataFrame:
    """Numbered sections of the body, in the order of the table of contents and with its titles.

    strict: a document whose table of contents can't be read raises an error; else it is left out.
    """
    found = contents(records)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("document "), F.col(DOC).cast("string"), F.lit(": "), F.col("problem")))
        found = found.withColumn("body_start", F.when(F.col("problem").isNotNull(), wrong.cast("int")).otherwise(F.col("body_start")))
    else:
        found = found.filter("problem is null")
    found = stage(found, "contents")
    rows = records.join(found.select(DOC, "body_start", "entries"), DOC)
    number = F.nullif(F.regexp_extract("text", r"\A([0-9]+(?:\.[0-9]+){0,2})\s+(.+)\z", 1), F.lit(""))
    rows = rows.withColumn("number", F.when(F.col("line_no") >= F.col("body_start"), number))
    markers = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("line_no", "number"))))
    told = rows.groupBy(DOC).agg(markers.alias("m"), F.first("entries").alias("e"))
    told = told.select(DOC, F.col("m.line_no").alias("lines"), F.col("m.number").alias("numbers"), F.col("e.reference").alias("references"))
    taken = told.mapInArrow(_taken, T.StructType([rows.schema[DOC], rows.schema["line_no"], T.StructField("at", T.IntegerType())]))
    entries = found.select(DOC, F.posexplode("entries").alias("at", "entry"))
    rows = rows.drop("entries").join(taken.join(entries, [DOC, "at"]).drop("at"), [DOC, "line_no"], "left")
    low = F.lower("text")
    named = lambda kind, name: _meta(kind, F.lit(name), F.lit(name))
    marker = (
        F.when(F.col("entry").isNotNull(), _meta("opinion_section", F.concat(F.lit("Section "), F.col("entry.reference")), F.col("entry.title")))
        .when(low == "table of contents", named("table_of_contents", "Table of contents"))
        .when(low == "executive summary", named("executive_summary", "Executive summary"))
    )
    sofar = W.partitionBy(DOC).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    front = _meta("front_matter", F.lit("Front matter"), F.lit(None).cast("string"))
    return _annotated(rows, F.coalesce(F.last(marker, ignorenulls=True).over(sofar), front))


def parse_generic(records: DataFrame) -> DataFrame:
    """One section for the whole document."""
    return _annotated(records, _meta("document", F.lit("Full document"), F.lit(None).cast("string")))


#: Documents that were stored before manifests named a parser.
BY_NAME = {"eu_ai_act_2024_1689": REGULATION, "gdpr_2016_679": REGULATION, "edpb_opinion_202428_ai-models_en": OPINION}


def dispatched(documents: DataFrame, by_name: dict[str, str] = BY_NAME) -> DataFrame:
    """(document_id, parser_type): the type given; without one, that of the document's name, or else the generic one."""
    given = F.col("parser_type") if "parser_type" in documents.columns else F.lit(None).cast("string")
    known = F.coalesce(*[F.when(F.col("document_name") == n, kind) for n, kind in by_name.items()]) if "document_name" in documents.columns else F.lit(None)
    return documents.select(DOC, F.coalesce(given, known, F.lit(GENERIC)).alias("parser_type"))


def parse(records: DataFrame, documents: DataFrame, by_name: dict[str, str] = BY_NAME) -> DataFrame:
    """Every document by its own parser; documents has (document_id, parser_type, document_name), where either of the last two may
    be missing (see ``dispatched``). An unknown parser raises ValueError before any work; records are read once for each
    parser that occurs."""
    documents = dispatched(documents, by_name)
    wanted = [r.parser_type for r in documents.select("parser_type").distinct().limit(len(PARSERS) + 1).collect()]
    if unknown := sorted(str(w) for w in wanted if w not in PARSERS):
        raise ValueError(f"no such parser: {', '.join(unknown)}")
    parts = [f for f in ((REGULATION, parse_regulation), (OPINION, parse_opinion), (GENERIC, parse_generic)) if f[0] in wanted]
    if not parts:
        return parse_generic(records.limit(0))
    out = [f(records.join(documents.filter(F.col("parser_type") == name).select(DOC), DOC, "left_semi")) for name, f in parts]
    return functools.reduce(DataFrame.unionByName, out)


def summary(annotated: DataFrame) -> DataFrame:
    """Number of different references by document and section type."""
    return annotated.groupBy(DOC, "section_type").agg(F.countDistinct("section_reference").alias("n_references"))


def count_violations(annotated: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (document_id, section_type, expected) whose number of references differs."""
    found = expected.join(summary(annotated), [DOC, "section_type"], "left").withColumn("actual", F.coalesce("n_references", F.lit(0)))
    return found.filter("actual != expected").select(DOC, "section_type", "expected", "actual")
