"""Text expressions: white space, labels, citations, escaping. All stay on the JVM but for ``fold`` (NFKC)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def lines(text: Column) -> Column:
    """Lines at any Unicode line boundary."""
    return F.split(text, r"\R|[\x1c-\x1e]")


@F.pandas_udf(T.StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").split()).casefold())


def fold(text: Column) -> Column:
    """NFKC, squeezed, case-folded; null is empty. Compatibility forms need Python."""
    return _fold(text)


def fold_ascii(text: Column) -> Column:
    """The same for texts of ASCII signs, without leaving the JVM."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def without_suffix(name: Column, suffix: str = ".pdf") -> Column:
    """A folded name without its file suffix."""
    return F.trim(F.regexp_replace(name, suffix.replace(".", r"\.") + r"\z", ""))


def or_unknown(value: Column, word: str = "unknown") -> Column:
    """``word`` for null and empty values."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(word))


def page_span(start: Column, end: Column) -> Column:
    """``unknown``, one page, or ``first-last``."""
    one = F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
    return F.when(start.isNull() | end.isNull(), "unknown").otherwise(one)


def label(name: Column, labels: dict[str, str]) -> Column:
    """The display label of a document name; the name itself where there is none."""
    if not labels:
        return name
    pairs = F.create_map(*[F.lit(x) for kv in sorted(labels.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def source_label(name: Column, reference: Column, start: Column, end: Column) -> Column:
    return F.concat(name, F.lit(" — "), or_unknown(reference, "unknown section"), F.lit(" — page(s) "), page_span(start, end))


def preview(text: Column, most: int = 700) -> Column:
    """Squeezed, cut to ``most`` signs with an ellipsis."""
    own = squeeze(text)
    return F.when(F.length(own) > most, F.concat(F.left(own, F.lit(most)), F.lit("..."))).otherwise(own)


def citations(answer: Column) -> Column:
    """Numbers of ``[S<n>]`` markers in order of appearance."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]")), lambda x: x.try_cast("bigint"))


def cited(answer: Column) -> Column:
    return F.array_sort(F.array_distinct(citations(answer)))


def invalid_citations(answer: Column, n_sources: Column) -> Column:
    """Cited numbers that name no source (and numbers too large for one, as null, last)."""
    return F.filter(cited(answer), lambda x: x.isNull() | (x < 1) | (x > n_sources))


def citation_status(answer: Column, n_sources: Column) -> Column:
    """``ok``, ``none`` (no marker at all) or ``invalid``."""
    return (
        F.when(F.size(citations(answer)) <= 0, "none").when(F.size(invalid_citations(answer, n_sources)) > 0, "invalid").otherwise("ok")
    )


def html(text: Column) -> Column:
    """Escaped for HTML, with citation markers in a span."""
    own = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], text)
    return F.regexp_replace(own, r"\[S\d+\]", '<span class="cite">$0</span>')


def spreadsheet_safe(value: Column) -> Column:
    """A value that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(F.regexp_replace(value, _SPACE, "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def redact(text: Column, secret: str | None, word: str = "<redacted>") -> Column:
    return F.replace(text, F.lit(secret), F.lit(word)) if secret else text


def route(message: Column, routes: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The first route one of whose keywords the lower-cased message holds."""
    own, out = F.lower(message), F.lit(otherwise)
    for name, keywords in reversed(routes):
        out = F.when(reduce(Column.__or__, [own.contains(k) for k in keywords]), name).otherwise(out)
    return out


def query_with_instruction(question: Column, task: str) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), strip(question))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def run_id(at: Column, suffix: Column | None = None) -> Column:
    """A run's name from its start in UTC (a timestamp of a session in UTC), with a suffix that tells runs of one second apart."""
    own = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return own if suffix is None else F.concat(own, F.lit("_"), suffix)


def utc_text(at: Column) -> Column:
    """ISO form of a timestamp of a session in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def seconds(value: Column) -> Column:
    """Timings are kept to four digits."""
    return F.round(value, 4)


def four_digits(value: Column) -> Column:
    return F.format_string("%.4f", value.cast("double"))


def percent(value: Column) -> Column:
    """A share with one digit, or ``n/a`` where nothing was measured."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f%%", 100 * value.cast("double")))
