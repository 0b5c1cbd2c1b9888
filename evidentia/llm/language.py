"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text gives the longest match of what follows at any place. A text is parsed
into such longest phrases, across words, against every language; the language that needs the fewest phrases, normalised by
the logarithm of its text's length and the length of the text, wins. Texts are parsed in pieces, all pieces of a block of
texts at a time, with the results of texts parsed whole.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be learnt
from; equal rates go to the language that sorts first; labels that are null are left out; whole texts are used.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import spans
from evidentia.llm.staging import stage, widened
from evidentia.llm.toxicity import by_hash

#: Labelled rows of each language that are learnt from, about at most, and bytes of them (in order of a hash of the id).
SAMPLE = 300
BYTES = 60_000
#: Bytes of a piece of a text that is parsed beside others; phrases go on over its border.
PIECE = 256
#: Where the number of phrases lies in a table's entry, above the state.
COST = 28
STATE = (1 << COST) - 1
_ASCII = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a text holds a sign of a Unicode category of letters (L)."""
    return bool(text) and bool(_ASCII.search(text) or any(unicodedata.category(c)[0] == "L" for c in text))


def suffix_automaton(codes: list[int], signs: int) -> np.ndarray:
    """Transitions (state, sign) of the suffix automaton of a sequence; -1 where there is none."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
        last = new
    table = np.full((len(edges), signs), -1, np.int32)
    for s, own in enumerate(edges):
        for c, t in own.items():
            table[s, c] = t
    return table


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # of each byte; 0 for bytes that no automaton knows
    tables: list[np.ndarray]  # of each state and sign: the state after it, and above COST how many phrases end or stand alone
    log_size: np.ndarray  # of each language's text
    texts: dict[str, bytes]

    def __reduce__(self) -> tuple:
        """Sent as its texts, some hundred times smaller than the automata; a worker builds these once."""
        return _built, (tuple(sorted(self.texts.items())),)

    @classmethod
    def fit(cls, texts: dict[str, bytes]) -> Model:
        """texts: running text of each language."""
        languages = sorted(texts)
        used = sorted({b for t in texts.values() for b in t})
        code = np.zeros(256, np.int32)
        code[used] = np.arange(1, len(used) + 1)
        tables = []
        for lang in languages:
            to = suffix_automaton(code[np.frombuffer(texts[lang], np.uint8)].tolist(), len(used) + 1)
            anew = to[0]
            # what doesn't go on ends the phrase before it and begins one; a sign that none knows is a phrase of its own
            step = np.where(to >= 0, to, np.maximum(anew, 0)[None])
            cost = np.where(to >= 0, 0, (np.arange(len(to)) > 0)[:, None].astype(np.int32) + (anew < 0)[None]).astype(np.int32)
            nothing = np.arange(len(to), dtype=np.int32)[:, None]  # the sign beyond the end
            tables.append(np.ascontiguousarray(np.concatenate([step.astype(np.int32) | cost << COST, nothing], 1)))
        return cls(languages, code, tables, np.log2([len(texts[lang]) + 1 for lang in languages]), dict(texts))

    def phrases(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Longest phrases that each text is parsed into against each language; texts lie one after another in ``data``.

        Texts are cut into pieces of PIECE bytes, and the pieces of all of them are parsed together, sign by sign, as if each
        began anew. Then each piece is parsed again from the state in which the piece before it has ended, until both
        parses agree, mostly after a few signs; where they never do, the next piece is parsed again, too. So phrases go on
        over the borders of pieces, and the numbers are those of the texts parsed whole.
        """
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        pieces = -(-(ends - begins) // PIECE)
        text = np.repeat(np.arange(len(ends)), pieces)
        within = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[text] + within * PIECE
        size = np.minimum(ends[text] - start, PIECE)
        out = np.zeros((len(ends), len(self.languages)))
        if not len(text):
            return out
        sign = self.code[data]
        beyond = self.tables[0].shape[1] - 1
        at = start[:, None] + np.arange(PIECE)
        matrix = np.where(np.arange(PIECE) < size[:, None], sign[np.minimum(at, len(sign) - 1)], beyond).T.astype(np.int32)
        matrix = np.ascontiguousarray(matrix)
        final_piece = np.append(text[1:] != text[:-1], True)
        states, counts = np.empty(matrix.shape, np.int32), np.empty(matrix.shape, np.int16)
        for k, table in enumerate(self.tables):
            flat, width = table.reshape(-1), np.int64(table.shape[1])
            state, count = np.zeros(len(text), np.int64), np.zeros(len(text), np.int16)
            for j, signs in enumerate(matrix):
                found = flat[state * width + signs]
                count += (found >> COST).astype(np.int16)
                state = (found & STATE).astype(np.int64)
                states[j], counts[j] = state, count
            anew = count.astype(np.int64)  # of each piece begun anew
            total, last = anew.copy(), state
            todo = np.flatnonzero(~final_piece & (last > 0)) + 1
            while len(todo):
                rows, own, n, before = todo, last[todo - 1], np.zeros(len(todo), np.int64), last[todo].copy()
                for j, signs in enumerate(matrix):
                    found = flat[own * width + signs[rows]]
                    n += found >> COST
                    own = (found & STATE).astype(np.int64)
                    agree = own == states[j, rows]
                    if agree.any():
                        same = rows[agree]
                        total[same], last[same] = n[agree] + anew[same] - counts[j, same], states[-1, same]
                        rows, own, n = rows[~agree], own[~agree], n[~agree]
                        if not len(rows):
                            break
                total[rows], last[rows] = n, own
                changed = todo[(last[todo] != before) & ~final_piece[todo]]
                todo = changed + 1
            out[:, k] = np.bincount(text, total, len(ends)) + np.bincount(text[final_piece], last[final_piece] > 0, len(ends))
        return out

    def rates(self, column: pa.Array) -> np.ndarray:
        """Normalised phrases (bits per byte) of each text against each language."""
        found = []
        for block in spans.blocks(column):
            size = np.diff(block.ends, prepend=0)
            found.append(self.phrases(block.data, block.ends) * self.log_size / np.maximum(size, 1)[:, None])
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)))


@functools.lru_cache(1)
def _built(texts: tuple[tuple[str, bytes], ...]) -> Model:
    return Model.fit(dict(texts))


def fit(documents: DataFrame, keep=None, sample: int = SAMPLE, label: str = "lang") -> Model:
    """Learn from the texts of at most ``sample`` documents of each language with a label that is not null, in order of a
    hash of the id, up to BYTES bytes."""
    own = documents.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if keep is None else keep))
    own = own.select("doc_id", F.col(label).cast("string").alias("y")).distinct()
    own = by_hash(own, "y", sample, 3).withColumn("h", F.xxhash64("doc_id", F.lit(13)))
    rows = documents.select("doc_id", F.col(label).cast("string").alias("y"), F.substring("text", 1, BYTES).alias("text")).filter("text is not null")
    rows = stage(rows.join(F.broadcast(own), ["doc_id", "y"]).select("y", "h", "text"), "language-sample")
    held: dict[str, int] = {}
    chosen = []
    for r in rows.select("y", "h", F.octet_length("text").alias("n")).orderBy("y", "h", "n").collect():  # ``sample`` numbers for a language
        if held.get(r.y, 0) < BYTES:
            held[r.y] = held.get(r.y, 0) + r.n + 1
            chosen.append(r.h)
    texts: dict[str, bytes] = {}
    got = rows.filter(F.col("h").isin(chosen)).orderBy("y", "h", "text").toArrow() if chosen else None  # two times BYTES for a language at most
    for y, text in zip(got["y"], got["text"], strict=True) if got else ():
        block = next(iter(spans.blocks(pa.array([text.as_py()]), 1 << 40)))
        texts[y.as_py()] = (texts.get(y.as_py(), b" ") + block.data.tobytes())[:BYTES]
    return Model.fit({y: t for y, t in texts.items() if t.strip()})


#: Bits per byte by which a language's rate must lie above the best for its odds to fall to about a third.
SCALE = 0.15


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (the winner's share of odds that fall with the rate); replaced if ``df`` has them."""
    df = df.drop("lang_pred", "score")
    place = df.columns.index(text)
    schema = widened(df, "lang_pred string, score double")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            column = b.column(place)
            letters = np.array([has_letter(t) for t in column.to_pylist()], bool)
            if own.languages:
                rates = own.rates(column)
                best = rates.argmin(1) if len(rates) else np.zeros(0, int)
                score = 1 / np.exp(-(rates - rates.min(1, keepdims=True)) / SCALE).sum(1) if len(rates) else np.zeros(0)
                names = [own.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            else:
                names, score = ["und"] * len(letters), np.zeros(len(letters))
            made = [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, schema)
