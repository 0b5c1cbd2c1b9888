"""Ranked lexical search by windowed bucket scoring.

Each task cuts its documents into windows of a fixed number of places, in ascending order of their ids, and writes the
postings of a window: for each asked term the places of the documents that hold it and how often. No text and no posting is
exchanged; only sums (documents, terms, and documents that hold a term) are. Scoring goes through the windows: the postings
of an item's terms are added into an array of the window's places, which fits a core's cache, and a bitset notes the
occupied places; these are harvested into the item's heap, which a task keeps over all its windows. The heaps of all tasks
meet in a window function.

Items are asked in blocks of about ``TERMS`` terms that an item holds, each block in one pass over the documents, so what a
worker holds of the items is bounded at any number of them (one item is never split).

Statistics cover all documents and all terms. The score of a document is a sum over the item's terms t, repeats included, of
w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and
m = 25 + (75 * n * N) div L, in integers.

Defined results: a null text has no terms; a row without terms is no document and no item gets it; an item without terms, or
of words that no document holds, gets no rows. Each row of documents is a document by itself and each row of items an item,
also when rows repeat; ids may be null, which come last among equal scores. Very long texts are cut into stretches of whole
terms, counted one after another. Further columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.staging import discard, fit, stage

#: Terms are runs of ASCII digits and letters and of all other characters beyond ASCII, in lower case for A-Z.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Places of a window: 64 kB of scores and 1 kB of occupancy.
PLACES = 8_192
#: Postings after which a window is closed early.
POSTINGS = 1_000_000
#: Terms of items (an item's different terms each count) that are asked in one pass.
TERMS = 1_000_000
#: Bytes of a text that are counted at once.
STRETCH = 1 << 22

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

WINDOWS = (
    "n_docs long, n_terms long, doc_ids array<long>, sizes array<long>, terms array<int>, counts array<int>, places array<int>, times array<int>"
)


def counted(text: str | None) -> Counter:
    """How often each term occurs in a text."""
    data = (text or "").encode().translate(_LOWER)
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data) and (gap := _GAP.search(data, end)):
            end = gap.start()
        elif end < len(data):
            end = len(data)
        found.update(TERM.findall(data, at, end))
        at = end
    return found


_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        number, term, times = [], [], []
        for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = counted(t.as_py())
            number += [n] * len(own)
            term += own.keys()
            times += own.values()
        yield pa.record_batch([pa.array(number, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], ["number", "term", "times"])


class _Window:
    """Documents of a window under construction."""

    def __init__(self) -> None:
        self.n_docs = self.n_terms = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[int] = []
        self.terms: list[int] = []
        self.times: list[int] = []

    def add(self, doc_id: int | None, own: Counter, number: dict[bytes, int]) -> None:
        if not own:
            return
        size = sum(own.values())
        self.n_docs += 1
        self.n_terms += size
        asked = own.keys() & number.keys()
        if asked:
            self.ids.append(doc_id)
            self.sizes.append(size)
            self.held.append(len(asked))
            self.terms += [number[t] for t in asked]
            self.times += [own[t] for t in asked]

    def full(self) -> bool:
        return len(self.ids) >= PLACES or len(self.terms) >= POSTINGS

    def row(self) -> dict:
        """Postings by term, places in ascending order of the ids (nulls last)."""
        nulls = np.array([i is None for i in self.ids], bool)
        order = np.lexsort((np.array([i or 0 for i in self.ids], np.int64), nulls))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        places = np.repeat(place, self.held)
        terms = np.array(self.terms, np.int32)
        by = np.lexsort((places, terms))
        own, counts = np.unique(terms, return_counts=True)
        return {
            "n_docs": self.n_docs, "n_terms": self.n_terms, "doc_ids": [self.ids[k] for k in order.tolist()],
            "sizes": np.array(self.sizes, np.int64)[order], "terms": own, "counts": counts.astype(np.int32),
            "places": places[by], "times": np.minimum(np.array(self.times, np.int64), 2**31 - 1).astype(np.int32)[by],
        }


_ROW = pa.schema([
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
])


def windows(docs: DataFrame, number, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the asked terms (a broadcast dictionary of their numbers) by windows of documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, window = number.value, _Window()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                window.add(i, counted(t.as_py()), asked)
                if window.full():
                    yield pa.RecordBatch.from_pylist([window.row()], _ROW)
                    window = _Window()
        if window.n_docs:
            yield pa.RecordBatch.from_pylist([window.row()], _ROW)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(build, WINDOWS)


class _Heaps:
    """The best documents of each item so far, and one window's scores and occupancy."""

    def __init__(self, top: int, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.top, self.items, self.weights, self.n_docs, self.n_terms = top, items, weights, n_docs, n_terms
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in items]
        self.scores = np.zeros(PLACES, np.int64)
        self.mark = np.zeros(PLACES, bool)
        self.at = np.full(len(weights), -1, np.int32)  # row of a term in the window

    def traverse(self, doc_ids: list[int | None], sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, times: np.ndarray) -> None:
        ends = np.cumsum(counts)
        m = np.array([25 + 75 * n * self.n_docs // self.n_terms for n in sizes.tolist()], np.int64)
        times = times.astype(np.int64)
        gain = np.repeat(self.weights[terms], counts) * (1_000_000_000 * times // (1000 * times + 8 * m[places]))
        bits = np.zeros((len(terms), PLACES // 8), np.uint8)
        lists = []
        for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            lists.append((places[a:b], gain[a:b]))
            self.mark[places[a:b]] = True
            bits[k] = np.packbits(self.mark)
            self.mark[places[a:b]] = False
        self.at[terms] = np.arange(len(terms), dtype=np.int32)
        for heap, (_, own, repeats) in zip(self.heaps, self.items, strict=True):
            rows = self.at[own]
            here = rows >= 0
            if not here.any():
                continue
            rows = rows[here]
            for k, r in zip(rows.tolist(), repeats[here].tolist(), strict=True):
                where, add = lists[k]
                self.scores[where] += add if r == 1 else add * r
            occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[rows], axis=0)))
            self.harvest(heap, occupied, doc_ids)
            self.scores[occupied] = 0
        self.at[terms] = -1

    def harvest(self, heap: list[tuple[int, int, int]], occupied: np.ndarray, doc_ids: list[int | None]) -> None:
        scores = self.scores[occupied]
        good = scores >= (heap[0][0] if len(heap) == self.top else 1)
        occupied, scores = occupied[good], scores[good]
        if len(scores) > self.top:
            good = scores >= np.partition(scores, -self.top)[-self.top]
            occupied, scores = occupied[good], scores[good]
            best = np.argsort(-scores, kind="stable")[: self.top]  # places ascend with ids
            occupied, scores = occupied[best], scores[best]
        for p, s in zip(occupied.tolist(), scores.tolist(), strict=True):
            entry = (s, 0, 0) if doc_ids[p] is None else (s, 1, -doc_ids[p])
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def _scored(made: DataFrame, shared, top: int) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = _Heaps(top, *shared.value)
        flat = lambda column, k: column[k].values.to_numpy(zero_copy_only=False)
        for b in batches:
            names = b.schema.names
            ids, *rest = (b.column(names.index(n)) for n in ("doc_ids", "sizes", "terms", "counts", "places", "times"))
            for k in range(b.num_rows):
                if len(ids[k].values):
                    heaps.traverse(ids[k].values.to_pylist(), *(flat(c, k) for c in rest))
        rows = [(n, -d if known else None, s) for (n, _, _), heap in zip(heaps.items, heaps.heaps, strict=True) for s, known, d in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["number", "doc_id", "score"])

    return made.select("doc_ids", "sizes", "terms", "counts", "places", "times").mapInArrow(score, "number long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``top`` documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    Equal scores go by ascending id.
    """
    spark = docs.sparkSession
    numbered = stage(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "ranked-items")
    asked = stage(numbered.select("number", "text").mapInArrow(_item_terms, "number long, term binary, times long"), "ranked-terms")
    n_blocks = max(1, math.ceil(asked.count() / TERMS))
    found = []
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == block).toArrow()
        number: dict[bytes, int] = {}
        own: dict[int, list[tuple[int, int]]] = {}
        for n, term, times in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
            own.setdefault(n, []).append((number.setdefault(bytes(term), len(number)), times))
        vocabulary = spark.sparkContext.broadcast(number)
        made = stage(windows(docs, vocabulary, doc_id, text), "ranked-windows")
        vocabulary.destroy()
        n_docs, n_terms = made.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        weights = np.zeros(len(number), np.int64)
        pairs = made.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        for term, df in pairs.collect():  # one row for each of the block's terms at most
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        block_items = [(n, np.array([t for t, _ in x], np.int64), np.array([r for _, r in x], np.int64)) for n, x in sorted(own.items())]
        shared = spark.sparkContext.broadcast((block_items, weights, int(n_docs or 0), int(n_terms or 0)))
        best = stage(_scored(made, shared, top), "ranked-best")
        shared.destroy()
        discard(made)
        found.append(best)
    whole = found[0]
    for best in found[1:]:
        whole = whole.unionByName(best)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    discard(asked)
    return ranked.join(fit(numbered.select("number", "item_id")), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
