"""Parsers on lines written by hand, windows, and their errors."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import chunking, structure


FRONT, ENACTED = ("front_matter", "Front matter", None), ("enacting_formula", "Enacting formula", None)
#: Documents written by hand, a line and the section it belongs to, one for each group of rules.
REGULATIONS = {
    "recitals count up from one, after the preamble's start only": [
        ("(1) too early", FRONT),
        ("Preamble", FRONT),
        ("WHEREAS:", FRONT),
        ("(2) not the first", FRONT),
        ("(1) first", ("recital", "Recital 1", None)),
        ("goes on", ("recital", "Recital 1", None)),
        ("(3) not the next", ("recital", "Recital 1", None)),
        ("(2)", ("recital", "Recital 2", None)),
        ("(3)no space", ("recital", "Recital 2", None)),
        ("(03) leading zero", ("recital", "Recital 3", None)),
        ("(" + "9" * 23 + ")", ("recital", "Recital 3", None)),
        ("Have adopted this Regulation:", ENACTED),
        ("(4) too late", ENACTED),
        ("whereas:", ENACTED),
        ("(4) again in the preamble", ("recital", "Recital 4", None)),
    ],
    "articles, chapters and sections after the enacting formula only": [
        ("Article 1", FRONT),
        ("CHAPTER I", FRONT),
        ("SECTION 1", FRONT),
        ("HAVE ADOPTED THIS REGULATION:", ENACTED),
        ("Article 2", ENACTED),
        ("chapter iv", ("chapter", "Chapter IV", "General")),
        ("General``", ("chapter", "Chapter IV", "General")),
        ("Section 07", ("legal_section", "Section 07", "ARTICLE 1")),
        ("ARTICLE 1", ("article", "Article 1", "Scope")),
        ("Scope", ("article", "Article 1", "Scope")),
        ("Article 1a", ("article", "Article 1", "Scope")),
        ("Article 1", ("article", "Article 1", "Scope")),
        ("Article 3", ("article", "Article 1", "Scope")),
        ("as in Article 2", ("article", "Article 1", "Scope")),
        ("Article 2", ("article", "Article 2", None)),
    ],
    "an annex may come at any time, and ends articles": [
        ("annex ix", ("annex", "Annex IX", "Forms")),
        ("Forms", ("annex", "Annex IX", "Forms")),
        ("HAVE ADOPTED THIS REGULATION:", ENACTED),
        ("Article 1", ENACTED),
        ("CHAPTER II", ENACTED),
        ("ANNEX B", ENACTED),
        ("ANNEX X", ("annex", "Annex X", None)),
    ],
}


def test_regulations(spark):
    rows = [(d, i + 1, 1, t) for d, own in enumerate(REGULATIONS.values()) for i, (t, _) in enumerate(own)]
    rows = spark.createDataFrame(rows, "document_id int, line_no int, page_number int, text string")
    got = {(r.document_id, r.line_no): (r.section_type, r.section_reference, r.section_title) for r in structure.parse_regulation(rows).collect()}
    for d, (rule, own) in enumerate(REGULATIONS.items()):
        for i, (text, section) in enumerate(own):
            assert got[d, i + 1] == section, (rule, text)


def lines(spark, text):
    return structure.line_records(spark.createDataFrame([(1, 1, text)], "document_id int, page_number int, page_text string"))


def test_line_records(spark):
    got = lines(spark, "a \t b\r\n\n  \x85c d  e\x1cf　").orderBy("line_no").collect()
    assert [r.text for r in got] == ["a b", "c", "d e", "f"]


@pytest.mark.parametrize("text, problem", [("x\ny", "no table of contents"), ("Table of contents\n2\nx", "no first entry"), ("Table of contents\n1\nA .... 2\nb", "no body start"), ("Table of contents\n1\nA\n1 A", "no entries")])
def test_opinions_without_contents(spark, text, problem):
    assert structure.contents(lines(spark, text)).first().problem == problem
    with pytest.raises(Exception, match=problem):
        structure.parse_opinion(lines(spark, text)).collect()
    assert structure.parse_opinion(lines(spark, text), strict=False).count() == 0


def test_long_title_is_no_entry(spark):
    text = "Table of contents\n1\nA ... 1\n2\n" + "\n".join(f"l{i}" for i in range(6)) + " .... 3\n3\n" + "\n".join(f"m{i}" for i in range(7)) + " .... 4\n1 A\n2 x\n3 y"
    assert [e.reference for e in structure.contents(lines(spark, text)).first().entries] == ["1", "2"]


def test_unknown_parser(spark):
    docs = spark.createDataFrame([(1, "table_layout")], "document_id int, parser_type string")
    with pytest.raises(Exception, match="no such parser"):
        structure.parse(lines(spark, "x"), docs).collect()
    docs = docs.withColumn("parser_type", F.lit(structure.GENERIC))
    assert [r.section_reference for r in structure.parse(lines(spark, "x\ny"), docs).collect()] == ["Full document"] * 2


@pytest.mark.parametrize("n, starts", [(1, [0]), (699, [0]), (700, [0]), (701, [0, 600]), (1300, [0, 600]), (1301, [0, 600, 1200]), (1900, [0, 600, 1200]), (0, [])])
def test_windows(spark, n, starts):
    assert spark.range(1).select(chunking.windows(F.lit(n), 700, 100).alias("w")).first().w == starts


def test_window_arguments(spark):
    rows = structure.parse_generic(lines(spark, "x"))
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunks(rows, size, overlap)


def test_tokens_lose_nothing(spark):
    text = "  a b c \U0001f600 ßﬁ "
    got = spark.createDataFrame([(text,)], "t string").select(F.array_join(chunking.lossless_tokens(F.col("t")), "").alias("t")).first().t
    assert got == text + "\n"


def test_groups_join_over_skipped_sections(spark):
    rows = spark.createDataFrame([(1, 1, 1, "a", "x", "r", None), (1, 2, 1, "b", "table_of_contents", "t", "t"), (1, 3, 2, "c", "x", "r", None), (1, 4, 2, "d", "x", "r", "t")],
                                 "document_id int, line_no int, page_number int, text string, section_type string, section_reference string, section_title string")
    got = chunking.chunks(rows).orderBy("chunk_order").collect()
    assert [(r.chunk_text, r.page_start, r.page_end) for r in got] == [("a\nc", 1, 2), ("d", 2, 2)]


def test_byte_vocabulary_tokens(spark):
    import public_tokenizers as P

    tokens = chunking.bpe_tokens(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = chunking.chunks(structure.parse_generic(lines(spark, "Hello world <|endoftext|>")), tokens=tokens).first()
    assert got.chunk_text == "Hello world <|endoftext|>" and got.chunk_token_count > 3
