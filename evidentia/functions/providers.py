"""Models behind the operators: each provider adds a column, in Arrow batches; the offline ones are deterministic."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def offline_embed(texts: list[str], dimension: int) -> np.ndarray:
    """Signed hashed words, of unit length (zero for texts without words)."""
    out = np.zeros((len(texts), dimension))
    for i, t in enumerate(texts):
        for w in t.casefold().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dimension] += 1 if h >> 63 else -1
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def embed(df: DataFrame, text: str, dimension: int, model: Callable[[list[str]], np.ndarray] | None = None, batch: int = 64, column: str = "embedding") -> DataFrame:
    """``df`` with embeddings of ``text``, asked for in batches; a reply of another shape, or not finite, is an error.

    model: texts to vectors in their order, or to a service's reply (see ``reply_vectors``) in any order.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.FloatType(), False))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = model or (lambda t: offline_embed(t, dimension))
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            parts = [reply_vectors(ask(own), len(own)) for own in (texts[i : i + batch] for i in range(0, len(texts), batch))]
            got = np.concatenate(parts) if parts else np.zeros((0, dimension), np.float32)
            if got.shape != (len(texts), dimension) or not np.isfinite(got).all():
                raise ValueError(f"the model's reply has the shape {got.shape} or elements that aren't finite")
            at = np.arange(0, got.size + 1, dimension, dtype=np.int32)
            made = pa.ListArray.from_arrays(pa.array(at), pa.array(got.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, column])

    return df.mapInArrow(run, schema)


def in_order(items: list[tuple[int, list[float]]], n: int) -> list[list[float]]:
    """Vectors of a reply whose items (index, vector) may come in any order; indices must be 0 to n - 1, each once."""
    items = sorted(items, key=lambda x: x[0])
    if [i for i, _ in items] != list(range(n)):
        raise ValueError(f"the reply has the indices {[i for i, _ in items][:10]}, not 0 to {n - 1}")
    return [v for _, v in items]


def reply_vectors(reply, n: int) -> np.ndarray:
    """Vectors of a model's reply to ``n`` texts: an array, or a service's JSON text or object with ``data``, a list of
    (index, embedding) in any order. Anything else is an error."""
    if isinstance(reply, (str, bytes)):
        reply = json.loads(reply)
    if isinstance(reply, dict):
        data = reply.get("data")
        if not isinstance(data, list) or not all(isinstance(x, dict) and type(x.get("index")) is int and "embedding" in x for x in data):
            raise ValueError("the reply has no list of data with index and embedding")
        if len(data) != n:
            raise ValueError(f"the reply has {len(data)} embeddings for {n} texts")
        reply = in_order([(x["index"], x["embedding"]) for x in data], n)
    return np.asarray(reply, np.float32)


def embed_question(question: str, dimension: int, model: Callable[[list[str]], np.ndarray] | None = None) -> list[float]:
    """The vector of one question; anything but exactly one finite vector is an error."""
    got = np.asarray((model or (lambda t: offline_embed(t, dimension)))([question]), np.float64)
    if got.shape != (1, dimension) or not np.isfinite(got).all():
        raise ValueError(f"the model's reply has the shape {got.shape} or elements that aren't finite")
    return got[0].tolist()


def score_pairs(df: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], question: str = "question", text: str = "chunk_text", batch: int = 8, column: str = "reranker_score") -> DataFrame:
    """``df`` with a model's scores of (question, text) pairs, asked for in batches; another number of scores, or one that isn't finite, is an error."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        pairs = list(zip(q, t, strict=True))
        found = np.array([float(s) for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])], float)
        if len(found) != len(pairs) or not np.isfinite(found).all():
            raise ValueError(f"the model gave {len(found)} scores for {len(pairs)} pairs, or one that isn't finite")
        return pd.Series(found)

    return df.withColumn(column, score(F.col(question), F.col(text)))


def generate(df: DataFrame, model: Callable[[list[str]], list[str]], column: str = "answer", batch: int = 16) -> DataFrame:
    """``df`` with a model's answers to ``prompt``, asked for in batches; an empty one is an error."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        given = prompts.tolist()
        out = [a for i in range(0, len(given), batch) for a in model(given[i : i + batch])]
        if len(out) != len(given) or not all(a and a.strip() for a in out):
            raise ValueError("the model gave an empty answer, or not one for each prompt")
        return pd.Series(out, dtype=object)

    return df.withColumn(column, ask("prompt"))
