"""Quality rules: counts with fixed thresholds, and a hashed n-gram logistic regression.

Features are hashed into ``1 << BITS`` slots: signs, pairs and triples of signs (UTF-8 bytes, case kept), words, pairs of
words, and for every word whether it equals one of the three before it. A text's value of a slot is its share of the
text's n-grams of that kind, so that long and short texts compare. The regression is fitted on at most SAMPLE labelled
rows of each class, calibrated by a logistic curve on a fifth of them that it hasn't seen, and applied in Arrow batches
against a fixed threshold.

Defined results: a null text is an empty one; without words it fails the base rules; labels that are null are left out and
repeated ones of a document count once (the largest); without labels of both classes the regression rejects nothing;
whole texts are used; equal texts get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import spans
from evidentia.llm.staging import release, stage
from evidentia.llm.toxicity import logistic, sampled

BITS = 17
#: Labelled rows of each class that the regression is fitted on, at most (chosen by a hash of the id).
SAMPLE = 2500
#: Features that a step of the regression goes through at once.
PART = 250_000
#: Bytes of a block whose n-grams are made at once.
PIECE = 1 << 18
#: The least calibrated probability of good quality of a kept text.
THRESHOLD = 0.5
#: Base rules: at least so many words; at most such a share of words in repeated windows of three.
LEAST_WORDS = 50
MOST_REPEATED = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SHIFT = np.uint64(64 - BITS)
_ODD = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _per_doc(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive values; document k has those from ends[k - 1] to ends[k]."""
    to = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return to[ends] - to[np.concatenate([[0], ends[:-1]])]


def _narrow(values: np.ndarray) -> np.ndarray:
    return (values >> _SHIFT).astype(np.int32)


def _slots(block: spans.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, ends by document) of each kind of n-gram."""
    own = [], [], []
    starts = np.concatenate([[0], block.ends[:-1]])  # nothing of the text before counts
    for at in range(0, len(block.data), PIECE):  # pieces bound the wide numbers held at once, however long a text is
        back = block.data[max(0, at - 2) : at + PIECE]
        data = np.concatenate([np.full(2 - min(at, 2), 0x20, np.uint8), back]).astype(np.uint64)
        data, two, three = data[2:], data[1:-1], data[:-2].copy()
        here = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + PIECE)] - at
        three[here] = 0x20
        own[0].append(_narrow((data + np.uint64(1)) * _ODD[0]))
        own[1].append(_narrow((data << np.uint64(8) | two) * _ODD[1] + _ODD[2]))
        own[2].append(_narrow(spans.mix(data << np.uint64(16) | two << np.uint64(8) | three)))
    for slots in own:
        yield np.concatenate(slots) if slots else np.zeros(0, np.int32), block.ends
        slots.clear()
    words = block.hashes()
    before = np.concatenate([np.zeros(3, np.uint64), words])
    place = np.arange(len(words)) - np.repeat(np.concatenate([[0], block.words_to[:-1]]), np.diff(block.words_to, prepend=0))
    same = np.zeros(len(words), np.uint64)
    for k in (1, 2, 3):
        same |= ((before[3 - k : len(before) - k] == words) & (place >= k)).astype(np.uint64) << np.uint64(k)
    yield _narrow(words * _ODD[3]), block.words_to
    yield _narrow(spans.mix(words + np.where(place > 0, before[2:-1], np.uint64(0)) * _ODD[4])), block.words_to
    yield _narrow((same + np.uint64(1)) * _ODD[5]), block.words_to


KINDS = 6


def _lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(" \t\n\v\f\r"))
        else:
            seen.add(line)
    return n


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    for block in spans.blocks(column, lower=False):
        n = np.diff(block.words_to, prepend=0)
        found["n_words"].append(n)
        inside = ~spans._SPACE[block.data] & ((block.data & 0xC0) != 0x80)
        found["word_chars"].append(_per_doc(inside.view(np.int8), block.ends))
        found["n_symbols"].append(_per_doc(_SYMBOL[block.data].view(np.int8), block.ends))
        words, doc = block.hashes(), block.doc
        covered = np.zeros(len(words), np.int8)
        if len(words) > 2:
            window = spans.mix(words[:-2] + words[1:-1] * _ODD[6] + words[2:] * _ODD[7]) + doc[:-2].astype(np.uint64) * _ODD[8]
            whole = doc[:-2] == doc[2:]
            _, inverse, times = np.unique(window[whole], return_inverse=True, return_counts=True)
            twice = np.flatnonzero(whole)[times[inverse] > 1]
            for k in range(3):
                covered[twice + k] = 1
        found["n_repeat_words"].append(_per_doc(covered, block.words_to))
    out = {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in found.items()}
    return out | {"n_dup_lines": np.fromiter(map(_lines, column.to_pylist()), np.int64, len(column))}


@dataclass
class Model:
    """Weights by kind of n-gram and slot, and the calibration."""

    weights: np.ndarray | None = None
    curve: tuple[float, float] = (1.0, 0.0)

    def margins(self, column: pa.Array) -> np.ndarray:
        found = []
        for block in spans.blocks(column, lower=False):
            total = np.zeros(block.n_docs)
            for kind, (slots, ends) in enumerate(_slots(block)):
                n = np.diff(ends, prepend=0)
                total += _per_doc(self.weights[kind][slots], ends) / np.maximum(n, 1)
            found.append(total)
        return np.concatenate(found) if found else np.zeros(0)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Calibrated probability of good quality."""
        if self.weights is None:
            return np.ones(len(column))
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.margins(column) + b, -35, 35)))


def _sparse(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: feature numbers (kind and slot) and shares."""
    for block in spans.blocks(column, lower=False):
        kinds = list(_slots(block))
        for d in range(block.n_docs):
            index, value = [], []
            for kind, (slots, ends) in enumerate(kinds):
                own = slots[int(ends[d - 1]) if d else 0 : int(ends[d])]
                u, c = np.unique(own, return_counts=True)
                index.append(u.astype(np.int64) + (kind << BITS))
                value.append(c / max(1, len(own)))
            yield np.concatenate(index), np.concatenate(value)


def train(index: np.ndarray, value: np.ndarray, to: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Logistic regression by Adam over all rows; each feature is scaled by its root mean square.

    index, value: features of all rows, one after another; to: where each row ends (and 0). Features are gone through in
    parts of PART, so that little is held beside them.
    """
    n = KINDS << BITS
    x = value.astype(np.float32)
    cuts = np.unique(np.minimum(np.searchsorted(to, np.arange(0, to[-1] + PART, PART)), len(y)))
    parts = [(int(a), int(b), slice(int(to[a]), int(to[b]))) for a, b in zip(cuts, cuts[1:], strict=False)]
    square = np.zeros(n)
    for _, _, own in parts:
        square += np.bincount(index[own], np.square(x[own]), n)
    scale = (1 / np.sqrt(square / len(y) + 1e-5)).astype(np.float32)
    for _, _, own in parts:
        x[own] *= scale[index[own]]
    lengths = np.diff(to)
    class_weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, rounds + 1):
        g, own_w = np.zeros(n + 1), w.astype(np.float32)
        for a, b, own in parts:
            row = np.repeat(np.arange(b - a), lengths[a:b])
            z = np.bincount(row, x[own] * own_w[index[own]], b - a) + bias
            e = class_weight[a:b] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[a:b]) / len(y)
            g[:n] += np.bincount(index[own], x[own] * e[row], n)
            g[n] += e.sum()
        g[:n] += 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.03 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, bias = w - step[:n], bias - step[n]
    out = (w * scale).astype(np.float32).reshape(KINDS, 1 << BITS)
    out[0] += np.float32(bias)  # every text has a share of 1 in all over a kind
    return out


def fit(documents: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Fit on four fifths of the sampled labelled rows, calibrate on the rest."""
    rows = stage(sampled(documents, labels, label, sample, F.lit(True) if keep is None else keep), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (i, v) in enumerate(_sparse(b.column(0))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(1)[k].as_py()], pa.int32()), pa.array([b.column(2)[k].as_py()], pa.int32()), pa.array([i.astype("<i4").tobytes()]), pa.array([v.astype("<f4").tobytes()])],
                    ["y", "fold", "i", "v"],
                )

    got = rows.select("text", "y", "fold").mapInArrow(run, "y int, fold int, i binary, v binary").toArrow()
    y, fold = got["y"].to_numpy().astype(float), got["fold"].to_numpy()
    if not len(y) or not 0 < y[fold != 0].sum() < (fold != 0).sum():
        return Model()
    index = [np.frombuffer(i.as_buffer(), "<i4") for i in got["i"]]
    value = [np.frombuffer(v.as_buffer(), "<f4") for v in got["v"]]
    own, rest = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    to = np.concatenate([[0], np.cumsum([len(index[k]) for k in own])])
    learnt = np.concatenate([index[k] for k in own]), np.concatenate([value[k] for k in own])
    held = {k: (index[k].copy(), value[k].copy()) for k in rest.tolist()}
    del got, index, value
    release()
    model = Model(train(*learnt, to, y[own]))
    del learnt
    if len(rest) and 0 < y[rest].sum() < len(rest):
        flat = model.weights.reshape(-1)
        z = np.array([flat[held[k][0]] @ held[k][1] for k in rest.tolist()], float)
        a, b = logistic(np.stack([z, np.ones(len(z))], 1), y[rest])
        model.curve = (float(a), float(b)) if a > 0 else (1.0, 0.0)
    del held
    release()
    return model


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """``df`` with the counts, base_failed, quality (calibrated probability) and kept; columns of these names are replaced.

    prefix: goes before the names of the new columns.
    """
    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("quality", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
    for f in fields:
        f.name = prefix + f.name
    df = df.drop(*[f.name for f in fields])
    place = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(place)
            c = counts(column)
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            p = shared.value.scores(column)
            made = [pa.array(c[k]) for k in COUNTS] + [pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
