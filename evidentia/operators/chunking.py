"""Section groups, tokens and overlapping token windows, with the pages and hashes of every chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.text import sha256, strip
from evidentia.operators.structure import DOC

SKIPPED = ["table_of_contents"]
SIZE, OVERLAP = 700, 100
#: Names the tokenizer and the window in every chunk.
VERSION = "section-aware-words-700-100"
META = ["section_type", "section_reference", "section_title"]


def section_groups(annotated: DataFrame, skipped: list[str] | None = None) -> DataFrame:
    """``annotated`` without skipped sections and with group_no: runs of lines of equal section, numbered from 1."""
    order = W.partitionBy(DOC).orderBy("line_no")
    key = F.struct(*META)
    rows = annotated.filter(~F.col("section_type").isin(SKIPPED if skipped is None else skipped))
    rows = rows.withColumn("_new", (~F.coalesce(key.eqNullSafe(F.lag(key).over(order)), F.lit(False))).cast("int"))
    return rows.withColumn("group_no", F.sum("_new").over(order).cast("int")).drop("_new")


def lossless_tokens(text: Column) -> Column:
    """Tokens of a line and its end: words with the space before them, and what space is left. Joined they are the text."""
    return F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(r"\s*\S+|\s+"), F.lit(0))


def bpe_tokens(path: str, pattern: str):
    """Tokens of a line by a byte-level vocabulary file (ranks in base64), as text pieces; for ``chunks(tokens=...)``."""

    @F.pandas_udf("array<string>")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in parts:
            yield texts.map(lambda t: [b.decode("utf-8", "replace") for b in own.decode_tokens_bytes(own.encode_ordinary(t + "\n"))])

    return tokens


def windows(n: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of the windows over n tokens: one if they fit, else steps of size - overlap until the end is in."""
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def chunks(annotated: DataFrame, size: int = SIZE, overlap: int = OVERLAP, tokens=lossless_tokens, version: str = VERSION, skipped: list[str] | None = None) -> DataFrame:
    """Chunks of every document: windows of tokens that never leave a section group, numbered from 1; blank ones are left out."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window needs a positive size and an overlap from 0 to below it")
    rows = section_groups(annotated, skipped).withColumn("_t", tokens(F.col("text")))
    part = F.struct("line_no", "page_number", "_t")
    groups = rows.groupBy(DOC, "group_no", *META).agg(F.array_sort(F.collect_list(part)).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda p: F.transform(p["_t"], lambda t: F.struct(t.alias("t"), p.page_number.alias("page")))))
    groups = groups.withColumn("_k", flat)
    cut = groups.select(DOC, "group_no", *META, "_k", F.explode(windows(F.size("_k"), size, overlap)).alias("_from"))
    cut = cut.withColumn("_w", F.slice("_k", F.col("_from") + 1, F.lit(size)))
    out = cut.select(
        DOC, "group_no", "_from", *META,
        strip(F.array_join(F.transform("_w", lambda x: x.t), "")).alias("chunk_text"),
        F.size("_w").alias("chunk_token_count"),
        F.element_at("_w", 1).page.alias("page_start"),
        F.element_at("_w", -1).page.alias("page_end"),
    ).filter("chunk_text != ''")
    order = W.partitionBy(DOC).orderBy("group_no", "_from")
    return out.select(
        DOC,
        F.row_number().over(order).alias("chunk_order"),
        "chunk_text",
        F.length("chunk_text").alias("chunk_char_length"),
        "chunk_token_count",
        "page_start",
        "page_end",
        *META,
        sha256(F.col("chunk_text")).alias("chunk_hash"),
        F.lit(version).alias("chunking_version"),
    )
