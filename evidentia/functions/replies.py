"""Guarded reads of JSON: nested values with a problem in place of an error, so that one bad text stops nothing but itself.

Texts are parsed to VARIANT; a value of another kind than is asked for counts as wrong, it isn't converted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import strip


def parsed(text: Column) -> Column:
    """The variant of a JSON text, null if it is none."""
    return F.try_parse_json(text)


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID (a JSON null); null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def of_kind(value: Column, path: str, wanted: str, cast: str) -> Column:
    """The value at a path if it is of that kind, else null."""
    return F.when(kind(at(value, path)) == wanted, F.try_variant_get(value, path, cast))


def text_at(value: Column, path: str) -> Column:
    """A text that isn't blank, without white space at its ends; else null."""
    own = strip(of_kind(value, path, "STRING", "string"))
    return F.when(own != "", own)


def list_at(value: Column, path: str) -> Column:
    return of_kind(value, path, "ARRAY", "array<variant>")


def first_problem(*rules: tuple[Column, str]) -> Column:
    """What the first broken rule says; null if none is. A rule that can't be told is broken."""
    return reduce(lambda out, r: F.when(~F.coalesce(r[0], F.lit(False)), r[1]).otherwise(out), reversed(rules), F.lit(None).cast("string"))


def completion(reply: Column) -> Column:
    """(answer, problem) of a chat model's reply."""
    v = parsed(reply)
    answer = text_at(v, "$.choices[0].message.content")
    problem = first_problem(
        (v.isNotNull(), "reply is no JSON"), (F.size(list_at(v, "$.choices")) > 0, "reply has no choices"),
        (kind(at(v, "$.choices[0].message")) == "OBJECT", "first choice has no message"), (answer.isNotNull(), "answer is empty"),
    )
    return F.struct(F.when(problem.isNull(), answer).alias("answer"), problem.alias("problem"))


def embeddings(reply: Column, n: Column) -> Column:
    """(vectors, problem) of an embedding model's reply to ``n`` texts; its items may come in any order of their index."""
    v = parsed(reply)
    data = list_at(v, "$.data")
    items = F.transform(
        data,
        lambda x: F.struct(
            of_kind(x, "$.index", "BIGINT", "bigint").alias("index"), F.try_variant_get(x, "$.embedding", "array<double>").alias("vector"),
            F.forall(list_at(x, "$.embedding"), lambda e: kind(e).isin("BIGINT", "DECIMAL", "DOUBLE")).alias("numbers"),
        ),
    )
    items = F.array_sort(items)
    counted = F.transform(items, lambda x: x["index"])
    problem = first_problem(
        (v.isNotNull(), "reply is no JSON"), (data.isNotNull(), "reply has no list of data"), (F.size(data) == n, "reply has another number of embeddings"),
        ((n == 0) | (counted == F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint") - 1), lambda i: i)), "indices aren't 0 to n - 1"),
        (F.forall(items, lambda x: x["numbers"] & (F.size(x["vector"]) > 0)), "an embedding is no list of numbers"),
    )
    return F.struct(F.when(problem.isNull(), F.transform(items, lambda x: x["vector"])).alias("vectors"), problem.alias("problem"))
