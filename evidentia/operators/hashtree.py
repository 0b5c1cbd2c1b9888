"""Hash trees of documents, so that what hasn't changed isn't parsed, cut or written again.

A document has two trees. The input's leaves are its pages; its root also covers the parser and the settings of the build,
so an equal root means an equal result. The chunks' leaves are the chunks, which make the nodes of sections, which make the
root. Trees are compared from the root: only documents whose roots differ are looked into, and only their sections that
differ are named. A row holds one document, whose pages and sections bound it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC = "document_id"
SECTION = ["section_type", "section_reference", "section_title"]


def digest(*columns: Column) -> Column:
    """Of values and their places; a null differs from every text."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def inputs(pages: DataFrame, documents: DataFrame, settings: dict) -> DataFrame:
    """(document_id, input_root) of ``documents`` (document_id and what else decides on the result, as its parser)."""
    others = [c for c in documents.columns if c != DOC]
    leaf = F.struct("page_number", digest(F.col("page_text")).alias("hash"))
    own = pages.join(documents.select(DOC), DOC, "left_semi").select(DOC, leaf.alias("p")).groupBy(DOC).agg(F.array_sort(F.collect_list("p")).alias("p"))
    text = F.lit(repr(sorted(settings.items())))
    return documents.join(own, DOC, "left").select(DOC, digest(text, *[F.col(c) for c in sorted(others)], F.col("p")).alias("input_root"))


def tree(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(document_id, chunk_root, sections) of chunks by the ``columns`` that count; sections: their meta, first chunk and hash."""
    leaf = F.struct("chunk_order", digest(*[F.col(c) for c in columns]).alias("hash"))
    section = chunks.select(DOC, *SECTION, leaf.alias("c")).groupBy(DOC, *SECTION).agg(F.array_sort(F.collect_list("c")).alias("c"))
    node = F.struct(F.element_at("c", 1)["chunk_order"].alias("first"), *SECTION, digest(*[F.col(c) for c in SECTION], F.col("c")).alias("hash"))
    whole = section.select(DOC, node.alias("s")).groupBy(DOC).agg(F.array_sort(F.collect_list("s")).alias("sections"))
    return whole.select(DOC, digest(F.transform("sections", lambda s: s["hash"])).alias("chunk_root"), "sections")


def unchanged(roots: DataFrame, known: DataFrame, stored: DataFrame) -> DataFrame:
    """(document_id) whose input is that of the last build, and whose stored chunks are those that it made.

    roots: (document_id, input_root) now; known: (document_id, input_root, chunk_root) of the last build; stored: the tree
    of the stored chunks.
    """
    return roots.join(known.select(DOC, "input_root", "chunk_root"), [DOC, "input_root"]).join(stored.select(DOC, "chunk_root"), [DOC, "chunk_root"], "left_semi").select(DOC)


def changed_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, section_type, section_reference, section_title, change) of two trees: added, removed or changed sections."""
    rows = new.select(DOC, F.col("chunk_root").alias("_new"), F.col("sections").alias("n")).join(old.select(DOC, F.col("chunk_root").alias("_old"), F.col("sections").alias("o")), DOC, "full_outer")
    rows = rows.filter(~F.col("_new").eqNullSafe(F.col("_old")))
    empty = F.array().cast(new.schema["sections"].dataType)
    sides = [rows.select(DOC, F.explode(F.coalesce(c, empty)).alias("s")).select(DOC, *[f"s.{x}" for x in SECTION], F.lit(c).alias("side"), "s.hash") for c in ("o", "n")]
    both = sides[0].unionByName(sides[1]).groupBy(DOC, *SECTION).agg(F.max(F.when(F.col("side") == "o", F.col("hash"))).alias("o"), F.max(F.when(F.col("side") == "n", F.col("hash"))).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return both.withColumn("change", change).filter("change is not null").select(DOC, *SECTION, "change")
