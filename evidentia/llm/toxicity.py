"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of the signs (UTF-8 bytes) of words, one of toxic and one of ordinary labelled texts,
share their lower orders: a class's counts apply at the longest context only, and what the discount sets free goes to one
backoff distribution of continuation counts over both classes. So an expression that is rare in either class gets no
evidence from the smoothing itself: where neither class has seen a sign after its context, the two backoff masses are all
that differs. The log-likelihood ratio of a word is looked up by position, with one gram and one context each.

A text's evidence is the difference of the two log-likelihoods normalised by length (per word), with the part of it that
comes from words of strong evidence, and the length itself. A logistic curve turns it into a score; it is fitted on all
sampled labelled rows, each with the evidence of models that haven't seen it (cross-fitting), and shrunk to the prior.

Defined results: a null or blank text has no evidence and scores as its features do at length 0 (below 0.5 unless most
labelled blank texts are toxic); equal texts score alike; labels that are null are left out, and repeated labels of a
document count once (its largest); without labels of both classes every score is 0; whole texts are used, however long.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import spans
from evidentia.llm.staging import release, stage, widened

#: Signs of a gram: five of context and the next.
ORDER = 6
DISCOUNT = 0.75
#: Labelled rows of each class that the models are fitted on, about at most (chosen by a hash of the id).
SAMPLE = 4000
#: Different grams that a task holds before it adds them up.
MERGED = 2_000_000
#: Parts of the sample; each is scored by models of the others, for the curve.
FOLDS = 5
#: Ridge of the curve: with few labels its weights stay near none, and scores near the classes' prior.
SHRINK = 0.3
#: Evidence of a word (natural log) that counts as strong.
STRONG = 3.0


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed grams of all words, their contexts, and the word each belongs to.

    A word is read as space, its bytes, space; a gram holds up to ORDER of these signs, none before the first space.
    """
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)  # of words' last spaces
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    at = np.arange(1, len(data))  # every sign but the first
    inside = at - np.repeat(np.concatenate([[0], ends[:-1]]), sizes + 1)  # signs of the word before it
    gram = data[1:].copy()
    for k in range(1, ORDER):
        back = np.where(inside >= k, data[np.maximum(at - k, 0)], 0)
        gram |= back << np.uint64(8 * k)
    return gram, gram >> np.uint64(8), owner


def _sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(inverse, w, len(unique)) for w in weights)


def _shorter(gram: np.ndarray) -> np.ndarray:
    """The gram without its first sign."""
    top = np.zeros(len(gram), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        byte = (gram >> np.uint64(8 * k)) & np.uint64(255)
        top = np.where((top == 0) & (byte > 0), np.uint64(8 * k), top)
    return gram & ((np.uint64(1) << top) - np.uint64(1))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def backoff(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each wanted gram's last sign by continuation counts of the distinct grams ``seen``."""
    if not len(wanted):
        return np.zeros(0)
    short = seen[seen > 255]
    shorter, count = _sums(_shorter(short), np.ones(len(short))) if len(short) else (np.zeros(0, np.uint64), np.zeros(0))
    context, total, kinds = _sums(shorter >> np.uint64(8), count, np.ones(len(count))) if len(shorter) else (shorter, count, count)
    lower = np.full(len(wanted), 1 / 256)
    more = wanted > 255
    if more.any():
        lower[more] = backoff(shorter, _shorter(wanted[more]))
    own, of = _find(shorter, wanted), _find(context, wanted >> np.uint64(8))
    n = np.where(of >= 0, total[of] if len(total) else 0, 0.0)
    c = np.where(own >= 0, count[own] if len(count) else 0, 0.0)
    k = np.where(of >= 0, kinds[of] if len(kinds) else 0, 0.0)
    p = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * k * lower) / np.maximum(n, 1)
    return np.where(n > 0, p, lower)


@dataclass
class Model:
    """Log-likelihood ratios of grams seen in either class, and of the backoff masses of contexts."""

    gram: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(0))
    context: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    mass: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, gram: np.ndarray, t: np.ndarray, o: np.ndarray) -> Model:
        """gram: different grams, sorted; t, o: how often each occurs in toxic and in ordinary texts."""
        if not t.sum() or not o.sum():
            return cls()
        used = t + o > 0
        gram, t, o = gram[used], t[used].astype(float), o[used].astype(float)
        context, nt, no, kt, ko = _sums(gram >> np.uint64(8), t, o, (t > 0).astype(float), (o > 0).astype(float))
        low = backoff(gram, _shorter(gram))
        of = _find(context, gram >> np.uint64(8))
        mt = np.where(nt > 0, DISCOUNT * kt / np.maximum(nt, 1), 1.0)
        mo = np.where(no > 0, DISCOUNT * ko / np.maximum(no, 1), 1.0)
        pt = np.maximum(t - DISCOUNT, 0) / np.maximum(nt[of], 1) + mt[of] * low
        po = np.maximum(o - DISCOUNT, 0) / np.maximum(no[of], 1) + mo[of] * low
        return cls(gram, np.log(pt) - np.log(po), context, np.log(mt) - np.log(mo))

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood ratio (toxic to ordinary) of each word."""
        if not words:
            return np.zeros(0)
        gram, context, owner = grams(words)
        at, of = _find(self.gram, gram), _find(self.context, context)
        unseen = np.where(of >= 0, self.mass[of] if len(self.mass) else 0, 0.0)
        return np.bincount(owner, np.where(at >= 0, self.ratio[at] if len(self.ratio) else 0, unseen), len(words))

    def features(self, column: pa.Array) -> np.ndarray:
        """For each text: evidence per word, strong evidence per word, log of the length, and 1."""
        found = []
        for block in spans.blocks(column):
            hashes = block.hashes()
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            word = self.evidence([block.word(i) for i in first.tolist()])[inverse]
            doc = block.doc
            n = np.bincount(doc, minlength=block.n_docs)
            total = np.bincount(doc, word, block.n_docs)
            strong = np.bincount(doc, np.maximum(word - STRONG, 0), block.n_docs)
            found.append(np.stack([total / np.maximum(n, 1), strong / np.maximum(n, 1), np.log1p(n), np.ones(len(n))], 1))
        return np.concatenate(found) if found else np.zeros((0, 4))

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(shape(features) @ self.weights, -35, 35)))


def shape(x: np.ndarray) -> np.ndarray:
    """Inputs of the curve: evidence per word, strong evidence per word and for the whole text on log scales, and length."""
    n = np.expm1(x[:, 2])
    return np.stack([np.clip(x[:, 0], -1, 1) * 10, np.log1p(200 * x[:, 1]), np.log1p(x[:, 1] * n), x[:, 2], np.log1p(x[:, 1] * n) * x[:, 2] / 5, x[:, 3]], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight, that of the constant, is hardly shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.append(np.full(len(w) - 1, ridge), min(ridge, 1e-2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def by_hash(rows: DataFrame, label: str, sample: int, seed: int) -> DataFrame:
    """About ``sample`` rows of each class (column ``label``; all of a smaller one), chosen by a hash of doc_id.

    The threshold of the hash follows from the classes' sizes, so no class is brought together anywhere; it aims four
    standard deviations below ``sample``, which is hardly ever exceeded.
    """
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    turn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    share = {y: 1.0 if n <= sample else (sample - 4 * sample**0.5) / n for y, n in sizes.items()}
    return rows.filter(functools.reduce(lambda a, y: a | ((F.col(label) == y) & (turn < int(share[y] * (1 << 30)))), share, F.lit(False)))


def sampled(documents: DataFrame, labels: DataFrame, label: str, sample: int, keep) -> DataFrame:
    """(doc_id, text, y, fold) of about ``sample`` labelled documents of each class, chosen by a hash of the id.

    ``keep``: condition on doc_id of rows that may be learnt from. fold: 0 to FOLDS - 1 by the hash.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")
    return documents.select("doc_id", "text").join(F.broadcast(by_hash(own, "y", sample, 7)), "doc_id").withColumn("fold", fold)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, t0, o0, t1, ...): how often each gram occurs in the toxic and the ordinary texts of each fold of rows (text, y, fold)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            y, fold = b.column(1).to_numpy(), b.column(2).to_numpy()
            for block in spans.blocks(b.column(0)):
                hashes, doc = block.hashes(), block.doc + block.first
                for k in np.unique(fold[block.first : block.first + block.n_docs]).tolist():
                    of = np.flatnonzero(fold[doc] == k)
                    if not len(of):
                        continue
                    _, first, inverse = np.unique(hashes[of], return_index=True, return_inverse=True)
                    toxic = np.bincount(inverse, y[doc[of]], len(first))
                    every = np.bincount(inverse, minlength=len(first))
                    gram, _, owner = grams([block.word(i) for i in of[first].tolist()])
                    held.append(_sums(gram * np.uint64(FOLDS) + np.uint64(k), toxic[owner], (every - toxic)[owner]))
            if sum(len(h[0]) for h in held) > MERGED:
                held = [_sums(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            key, toxic, ordinary = _sums(*(np.concatenate(x) for x in zip(*held, strict=True)))
            columns = [key // np.uint64(FOLDS), key % np.uint64(FOLDS), toxic, ordinary]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["gram", "fold", "toxic", "ordinary"])

    counts = rows.select("text", "y", "fold").mapInArrow(count, "gram long, fold long, toxic long, ordinary long")
    by_fold = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c[0]}{k}") for k in range(FOLDS) for c in ("toxic", "ordinary")]
    return counts.groupBy("gram").agg(*by_fold)


def fit(documents: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE, label: str = "toxic") -> Model:
    """Fit the models on the sampled labelled rows, and the curve on the evidence of each fold by models of the others."""
    rows = stage(sampled(documents, labels, label, sample, F.lit(True) if keep is None else keep), "toxicity-sample")
    got = gram_counts(rows).orderBy("gram").toArrow()  # different grams of the sample: numbers only
    gram = got["gram"].to_numpy().astype(np.uint64)
    toxic, ordinary = (np.stack([got[f"{c}{k}"].to_numpy() for k in range(FOLDS)]).astype(np.float32) for c in "to")
    del got
    model = Model.fit(gram, toxic.sum(0), ordinary.sum(0))
    if not len(model.gram):
        return model
    parts = [Model.fit(gram, np.delete(toxic, k, 0).sum(0), np.delete(ordinary, k, 0).sum(0)) for k in range(FOLDS)]
    del gram, toxic, ordinary
    release()
    shared = documents.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(2).to_numpy()
            for k in np.unique(of).tolist():
                own = pa.array(np.flatnonzero(of == k))
                x = shared.value[k].features(b.column(0).take(own))
                yield pa.RecordBatch.from_arrays([b.column(1).take(own), *(pa.array(x[:, j]) for j in range(4))], ["y", "a", "b", "c", "d"])

    held = rows.select("text", "y", "fold").mapInArrow(run, "y int, a double, b double, c double, d double").toArrow()
    shared.destroy()
    del parts
    x = np.stack([held[c].to_numpy() for c in "abcd"], 1)
    y = held["y"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        model.weights = logistic(shape(x), y, SHRINK)
    del held, x
    release()
    return model


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the toxicity of every whole text as ``column`` (replaced if ``df`` has one of that name)."""
    df = df.drop(column)
    schema = widened(df, f"{column} double")
    place = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = shared.value
            made = own.scores(own.features(b.column(place)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.float64())], [*b.schema.names, column])

    return df.mapInArrow(run, schema)
