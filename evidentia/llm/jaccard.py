"""Similarity join of texts by the Jaccard similarity of their word shingles, with signature trees.

The join is exact (up to 64-bit hashes of shingles and of sets): two texts link if 100 * |A & B| >= 75 * |A | B|.

1. Texts with equal shingle sets form a class; the rest works on one member of each class.
2. Rare shingles come first in one global order. Two linked sets share one of the first n - ceil(0.75 n) + 1 shingles of
   each (the prefix). Every class asks, in packed chunks, the buckets of its shingles how many classes hold each; the
   answers go back to the chunk, where the prefix is chosen. Shingles that one class holds alone come first and bring nothing
   together, so most classes end here, however many passages they share with others. The few hot shingles (found by
   counters; their number is bounded) aren't asked for, but come last in the order. What is left of a prefix goes to
   the buckets of its shingles; classes that share one form a run.
3. Every class is compared with one hub: of the classes that stand first in its runs (a run's first is the member that is
   in most runs), the one it shares most runs with. Components of the links found settle most runs; what is left are runs
   with members of different components.
4. These runs are joined by signature trees: leaves hold bitmaps of the hashes that a set holds once and twice or more,
   inner nodes the OR of their children's bitmaps and their range of sizes. A dual traversal drops node pairs whose largest
   possible overlap is too small for a link. Long runs are cut into tiles of bounded size, pairs of which are joined apart.
   Pairs of different components that are left are compared exactly.

``link`` ends there: it gives components, and leaves out pairs that are already in one. ``join`` and ``pairs`` go on:

5. As every link lies within a component, all pairs of classes of each component are compared exactly, each once. Large
   components are cut into blocks of bounded size, pairs of which are compared apart by products of incidence matrices.

Defined results: words are lower-cased (A-Z); a set is empty for texts that are null or without words, and links with
nothing; with fewer words than a shingle has, the whole sequence is the only shingle; rows with a null id link with
nothing and have no component; repeated rows and ids form one document's class as their texts demand; an empty table gives
an empty one; further columns are not passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import spans
from evidentia.llm.components import components
from evidentia.llm.staging import BROADCAST, discard, fit, fresh, stage

WIDTH = 5
#: Counters that hot shingles are found by; times a partition's mean from which it reports one; least count of a hot one.
COUNTERS = 1 << 20
REPORTED = 4
HOT = 4_096
#: Shingles of a bucket, and of a chunk of documents, about.
BUCKET = 500_000
CHUNK = 1_500_000
#: Members of a tile of a run, and shingles of all of them, at most (but one member at least).
TILE = 1_024
TILE_SHINGLES = 1_000_000
#: Bits of a leaf's bitmaps, and children of an inner node.
BITS = 2_048
FAN = 16
#: Classes of a block of a component, and shingles of all of them, about; and columns of an incidence matrix, at least.
BLOCK = 1_024
BLOCK_SHINGLES = 1_000_000
COLUMNS = 2_048
#: Members compared with one other text in a task.
SALT = 128


def prefix_length(n: int) -> int:
    return n - math.ceil(0.75 * n) + 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def class_of(shingles: np.ndarray) -> int:
    """64-bit hash of a set; 0 for the empty one."""
    if not len(shingles):
        return 0
    total = spans.mix(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64, keepdims=True)
    return int(spans.mix(total + np.uint64(len(shingles))).view(np.int64)[0]) or 1


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for block in spans.blocks(column):
        yield from enumerate(spans.shingle_sets(block, WIDTH), block.first)


def describe(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, cls) of all documents, and rows (counter, count) of what each partition counts often.

    Shingles are counted by hash in COUNTERS counters. A partition reports those that reach REPORTED times the mean of its
    counters, so of a shingle's count over all partitions less than REPORTED times the whole mean goes unreported.
    The counter -1 holds all of a partition's shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for b in batches:
            n, cls, held = [], [], []
            for _, s in _sets(b.column(1)):
                n.append(len(s))
                cls.append(class_of(s))
                held.append(s)
            if held:
                counters += np.bincount((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            none = pa.nulls(len(n), pa.int64())
            yield batch(b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none, none)
        total = int(counters.sum())
        if total:
            often = np.flatnonzero(counters >= max(4, REPORTED * total / COUNTERS))
            none = pa.nulls(len(often) + 1, pa.int64())
            yield batch(none, none, none, pa.array(np.append(often, -1)), pa.array(np.append(counters[often], total)))

    def batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), *columns[1:]], ["doc_id", "n", "cls", "counter", "count"])

    return docs.mapInArrow(run, "doc_id long, n long, cls long, counter long, count long")


def levels(described: DataFrame) -> np.ndarray:
    """For each counter 0, or for hot shingles their place in the order: after all others, by count.

    At most COUNTERS / REPORTED counters are hot, whatever the data.
    """
    counts = described.filter("counter is not null").groupBy("counter").agg(F.sum("count").alias("count"))
    total = counts.filter("counter = -1").first()
    least = max(HOT, REPORTED * (total["count"] if total else 0) / COUNTERS)
    got = counts.filter((F.col("counter") >= 0) & (F.col("count") >= least)).toArrow()
    out = np.zeros(COUNTERS, np.uint8)
    out[got["counter"].to_numpy()] = np.clip(2 * np.log2(got["count"].to_numpy() / least), 0, 50).astype(np.uint8) + 200
    return out


def level_of(count: np.ndarray) -> np.ndarray:
    """The order's first part for counted shingles: by count, exact up to 64."""
    return np.where(count <= 64, count, np.minimum(64 + 4 * np.log2(np.maximum(count, 64) / 64), 199)).astype(np.uint8)


def _cut(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``of`` (numbers below n), and where each number begins in it."""
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(n + 1))


def _binaries(rows: list[tuple], numbers: int, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * numbers + [pa.binary()] * (len(names) - numbers)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


ASKED = ["key", "chunk", "token", "place", "cls", "size", "cool", "hot", "hot_place", "hot_level"]
TOLD = ["chunk", "bucket", "token", "place", "level", "cls", "size", "cool", "hot", "hot_place", "hot_level"]


def ask(docs: DataFrame, level: np.ndarray, buckets: int) -> DataFrame:
    """Packed rows: for each chunk of documents the shingles that fall into each bucket, and a head (bucket -1 - chunk).

    A head holds, for each document of the chunk, its class, the size of its set, how many of its shingles aren't hot, and as
    many of the hot ones as its prefix can need.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def flush(chunk: int, tokens: list, cls: list, size: list, hot: list, places: list, hot_levels: list) -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        cool = np.array([len(t) for t in tokens], "<u4")
        owner = np.repeat(np.arange(len(cls), dtype="<u2"), cool)
        order, cut = _cut(((flat & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32), buckets)
        token, owner = (flat[order] >> np.uint64(32)).astype("<u4"), owner[order]
        rows = [(k, chunk, token[cut[k] : cut[k + 1]].tobytes(), owner[cut[k] : cut[k + 1]].tobytes(), *[None] * 6) for k in np.flatnonzero(np.diff(cut)).tolist()]
        head = [np.array(cls, "<i8"), np.array(size, "<u4"), cool, *(np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((hot, "<u8"), (places, "<u2"), (hot_levels, "u1")))]
        return _binaries([*rows, (-1 - chunk, chunk, None, None, *(h.tobytes() for h in head))], 2, ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        chunk = TaskContext.get().partitionId() << 32
        held: tuple[list, ...] = [], [], [], [], [], []
        have = 0
        for b in batches:
            for _, s in _sets(b.column(0)):
                if not len(s):
                    continue
                tokens, cls, size, hot, places, hot_levels = held
                at = own[(s % np.uint64(COUNTERS)).astype(np.int64)]
                cool = s[at == 0]
                need = prefix_length(len(s)) - len(cool)
                if need > 0:
                    warm, warm_level = s[at > 0], at[at > 0]
                    first = np.lexsort((warm, warm_level))[:need]
                    hot.append(warm[first])
                    hot_levels.append(warm_level[first])
                    places.append(np.full(len(first), len(cls), "<u2"))
                tokens.append(cool)
                cls.append(class_of(s))
                size.append(len(s))
                have += len(cool) + max(0, need)
                if have >= CHUNK or len(cls) == 65_535:
                    yield flush(chunk, *held)
                    held, have, chunk = ([], [], [], [], [], []), 0, chunk + 1
        if held[1]:
            yield flush(chunk, *held)

    return docs.select("text").mapInArrow(run, ", ".join(f"{c} {'long' if k < 2 else 'binary'}" for k, c in enumerate(ASKED)))


def tell(asked: DataFrame) -> DataFrame:
    """Back to each chunk, the shingles of a bucket that more than one document holds, with their counts; heads as they are."""

    def count(rows: pa.Table) -> pa.Table:
        key = rows["key"][0].as_py()
        if key < 0:
            head = [rows[c][0].as_py() for c in ("chunk", *ASKED[4:])]
            return pa.Table.from_batches([_binaries([(head[0], None, None, None, None, *head[1:])], 2, TOLD)])
        token = [np.frombuffer(t.as_buffer(), "<u4") for t in rows["token"]]
        place = np.concatenate([np.frombuffer(t.as_buffer(), "<u2") for t in rows["place"]])
        row = np.repeat(np.arange(len(token), dtype=np.int32), [len(t) for t in token])
        token = np.concatenate(token)
        order = np.argsort(token, kind="stable")
        token, place, row = token[order], place[order], row[order]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        n = np.repeat(times := np.diff(np.append(begin, len(token))), times)
        many = n > 1
        token, place, row, level = token[many], place[many], row[many], level_of(n[many])
        order, cut = _cut(row, rows.num_rows)
        chunks = rows["chunk"].to_pylist()
        out = []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[k] : cut[k + 1]]
            out.append((chunks[k], key, token[own].tobytes(), place[own].tobytes(), level[own].tobytes(), *[None] * 6))
        return pa.Table.from_batches([_binaries(out, 2, TOLD)])

    return asked.groupBy("key").applyInArrow(count, ", ".join(f"{c} {'long' if k < 2 else 'binary'}" for k, c in enumerate(TOLD)))


def prefixes(told: DataFrame, buckets: int) -> DataFrame:
    """Packed prefixes: for each chunk and bucket the tokens (order keys), and the class and size of each.

    A shingle that no other set holds brings nothing together, so of a prefix only the shared ones are kept; most sets have
    enough shingles of their own, and so none.
    """

    def pack(flat: np.ndarray, owner: np.ndarray, cls: np.ndarray, size: np.ndarray) -> pa.Table:
        order, cut = _cut((spans.mix(flat) % np.uint64(buckets)).astype(np.int64), buckets)
        rows = []
        for k in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[k] : cut[k + 1]]
            who, place = np.unique(owner[own], return_inverse=True)
            rows.append((k, flat[own].tobytes(), place.astype("<u4").tobytes(), cls[who].tobytes(), size[who].astype("<i4").tobytes()))
        return pa.Table.from_batches([_binaries(rows, 1, ["bucket", "token", "place", "cls", "size"])])

    def choose(rows: pa.Table) -> pa.Table:
        parts = {c: [x.as_buffer() for x in rows[c] if x.is_valid] for c in ("token", "place", "level")}
        head = rows.filter(pc.is_valid(rows["cls"]))
        cls, size, cool, hot, hot_place, hot_level = (np.frombuffer(head[c][0].as_buffer(), t) for c, t in zip(TOLD[5:], ("<i8", "<u4", "<u4", "<u8", "<u2", "u1"), strict=True))
        token = [np.frombuffer(t, "<u4") for t in parts["token"]]
        bucket = np.repeat(np.array([b for b in rows["bucket"].to_pylist() if b is not None], np.uint64), [len(t) for t in token])
        place = np.concatenate([np.zeros(0, "<u2"), *(np.frombuffer(t, "<u2") for t in parts["place"])])
        level = np.concatenate([np.zeros(0, "u1"), *(np.frombuffer(t, "u1") for t in parts["level"])])
        token = bucket << np.uint64(32) | np.concatenate([np.zeros(0, "<u4"), *token])
        n = size.astype(np.int64)
        # what the prefix still wants when the shingles that one set holds alone are taken
        need = n - (3 * n + 3) // 4 + 1 - (cool - np.bincount(place, minlength=len(n)))
        wanted = need[place] > 0
        place = np.concatenate([place[wanted], hot_place])
        level = np.concatenate([level[wanted], hot_level])
        token = np.concatenate([token[wanted], hot >> np.uint64(1) | np.uint64(1 << 63)])
        order = np.lexsort((token, level, place))
        token, place = token[order], place[order]
        begin = np.searchsorted(place, np.arange(len(n)))
        first = np.arange(len(place)) - begin[place] < need[place]
        return pack(token[first], place[first], cls, size)

    return told.groupBy("chunk").applyInArrow(choose, "bucket long, token binary, place binary, cls binary, size binary")


RUNS = "run long, tile int, cls array<long>, size array<int>"


def runs(packed: DataFrame) -> DataFrame:
    """Different runs (classes that share a prefix shingle) of each bucket, in order of size and cut into tiles."""

    def find(rows: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(t.as_py(), np.uint64) for t in rows["token"]])
        ids, sizes = [], []
        for place, cls, size in zip(rows["place"], rows["cls"], rows["size"], strict=True):
            at = np.frombuffer(place.as_py(), "<u4")
            ids.append(np.frombuffer(cls.as_py(), np.int64)[at])
            sizes.append(np.frombuffer(size.as_py(), np.int32)[at])
        out: list[tuple] = []
        cls, size = np.concatenate(ids), np.concatenate(sizes)
        # only tokens that occur more than once
        order = np.argsort(token, kind="stable")
        token, cls, size = token[order], cls[order], size[order]
        equal = token[1:] == token[:-1]
        keep = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        token, cls, size = token[keep], cls[keep], size[keep]
        order = np.lexsort((cls, size, token))
        token, cls, size = token[order], cls[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, size = token[new], cls[new], size[new]  # copies from other partitions
        start = np.ones(len(token), bool)
        # a run ends where the token does, or where the next set is too large for a link
        start[1:] = (token[1:] != token[:-1]) | (4 * size[:-1].astype(np.int64) < 3 * size[1:].astype(np.int64))
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, len(token)))
        begin, length = begin[length > 1], length[length > 1]
        if len(begin):
            row = np.repeat(np.arange(len(begin)), length)
            first = np.cumsum(length) - length
            at = np.arange(len(row)) - np.repeat(first, length) + np.repeat(begin, length)
            cls, size = cls[at], size[at]
            name = np.add.reduceat(spans.mix(cls.view(np.uint64)), first) + length.astype(np.uint64)
            name, which = np.unique(spans.mix(name), return_index=True)
            for r, k in zip(name.view(np.int64).tolist(), which.tolist(), strict=True):
                own = slice(first[k], first[k] + length[k])
                c, s = cls[own], size[own]
                tile = np.floor(np.arange(len(c)) / TILE + (np.cumsum(s) - s) / TILE_SHINGLES).astype(int)
                for t in np.unique(tile).tolist():
                    out.append((r, t, c[tile == t].tolist(), s[tile == t].tolist()))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["run", "tile", "cls", "size"])

    return packed.groupBy("bucket").applyInArrow(find, RUNS)


def hubs(members: DataFrame) -> DataFrame:
    """(a, b): for each class b the hub a that it is compared with, from the rows (run, cls) of runs."""
    degree = members.groupBy("cls").agg(F.count("*").alias("degree"))
    known = members.select("run", "cls").join(degree, "cls")
    first = known.groupBy("run").agg(F.max(F.struct("degree", "cls")).alias("f")).select("run", F.col("f.cls").alias("a"), F.col("f.degree").alias("degree"))
    pairs = members.select("run", F.col("cls").alias("b")).join(first, "run").filter("a != b")
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("degree").alias("degree"))
    return shared.groupBy("b").agg(F.max(F.struct("shared", "degree", "a")).alias("f")).select(F.col("f.a").alias("a"), "b")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole texts.

    A class b goes to its a; an a with many partners is copied to several tasks.
    """
    pairs = stage(pairs.distinct(), "pairs")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("k"))
    others = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), F.col("b").alias("cls"))
    own = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.col("a").alias("cls"))
    members = stage(others.unionByName(own).join(classes.select("cls", "doc"), "cls"), "members")
    texts = docs.join(fit(members), F.col("doc_id") == F.col("doc")).select("a", "salt", "cls", "text")

    def compare(rows: pa.Table) -> pa.Table:
        a = rows["a"][0].as_py()
        wanted = rows["cls"].to_pylist()
        sets: dict[int, np.ndarray] = {}
        for k, s in _sets(rows["text"]):
            if wanted[k] == class_of(s):  # else another text under the same id
                sets[wanted[k]] = s
        left = sets.get(a)
        found = [] if left is None else [c for c, s in sets.items() if c != a and linked(left, s)]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return texts.groupBy("a", "salt").applyInArrow(compare, "a long, b long")


def bitmaps(shingles: np.ndarray) -> np.ndarray:
    """Two bitmaps of BITS bits: of hashes that occur in the set, and of those that occur twice or more."""
    count = np.bincount(((shingles >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.concatenate([np.packbits(count > 0), np.packbits(count > 1)]).view(np.uint64)


def signatures(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, bits) of the classes ``wanted``."""
    members = stage(wanted.join(classes.select("cls", "doc"), "cls"), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, bits = [], []
            want = b.column(0).to_pylist()
            for k, s in _sets(b.column(1)):
                if want[k] == class_of(s):
                    cls.append(want[k])
                    bits.append(bitmaps(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(bits, pa.binary())], ["cls", "bits"])

    texts = docs.join(fit(members), F.col("doc_id") == F.col("doc")).select("cls", "text")
    return texts.mapInArrow(run, "cls long, bits binary").groupBy("cls").agg(F.max("bits").alias("bits"))


class Tree:
    """Leaves in order of size, and levels of nodes of FAN children above them (the last has FAN nodes at most)."""

    def __init__(self, bits: np.ndarray, size: np.ndarray) -> None:
        extra = size - np.bitwise_count(bits).sum(1).astype(np.int64)  # shingles beyond two for each hash
        self.levels = [(bits, size, size, extra)]
        while len(self.levels[-1][0]) > FAN:
            b, low, high, e = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(e, at)))


def dual(left: Tree, right: Tree, skip=None) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that may link. skip: leaf pairs to leave out.

    Two sets share at most one shingle for each hash that both hold, one more for each that both hold twice or more, and
    what either holds beyond.
    """
    height = max(len(left.levels), len(right.levels))

    def level(t: Tree, h: int) -> tuple:
        return t.levels[min(h, len(t.levels) - 1)]

    i, j = np.meshgrid(np.arange(len(level(left, height - 1)[0])), np.arange(len(level(right, height - 1)[0])), indexing="ij")
    i, j = i.reshape(-1), j.reshape(-1)
    for h in range(height - 1, -1, -1):
        (bits, low, high, extra), (bits2, low2, high2, extra2) = level(left, h), level(right, h)
        ok = (4 * high[i] >= 3 * low2[j]) & (4 * high2[j] >= 3 * low[i])
        i, j = i[ok], j[ok]
        if h == 0 and skip is not None:
            ok = ~skip(i, j)
            i, j = i[ok], j[ok]
        both = np.zeros(len(i), np.int64)
        for k in range(0, len(i), 1 << 15):
            part = slice(k, k + (1 << 15))
            both[part] = np.bitwise_count(bits[i[part]] & bits2[j[part]]).sum(1)
        ok = 7 * (both + np.minimum(extra[i], extra2[j])) >= 3 * (low[i] + low2[j])
        i, j = i[ok], j[ok]
        if h == 0:
            return i, j
        i, j = _below(i, j, h < len(left.levels), len(level(left, h - 1)[0]), h < len(right.levels), len(level(right, h - 1)[0]))
    raise AssertionError


def _below(i: np.ndarray, j: np.ndarray, down: bool, n: int, down2: bool, n2: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children; a side whose tree isn't so high stays."""
    step = np.arange(FAN)
    if down:
        i, j = (i[:, None] * FAN + step).reshape(-1), np.repeat(j, FAN)
    if down2:
        i, j = np.repeat(i, FAN), (j[:, None] * FAN + step).reshape(-1)
    ok = (i < n) & (j < n2)
    return i[ok], j[ok]


def candidates(tiles: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of different components that may link, from rows (run, i, j, tile, cls, size, comp, bits)."""

    def join(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        tile, cls, size, comp = (rows[c].to_numpy() for c in ("tile", "cls", "size", "comp"))
        bits = np.stack([np.frombuffer(b.as_py(), np.uint64) for b in rows["bits"]])
        order = np.lexsort((cls, size))
        left, right = (order[tile[order] == t] for t in (i, j))
        trees = [Tree(bits[s], size[s].astype(np.int64)) for s in (left, right)]
        same = i == j
        a, b = dual(*trees, skip=lambda x, y: (comp[left[x]] == comp[right[y]]) | (same & (x >= y)))
        a, b = cls[left[a]], cls[right[b]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return tiles.groupBy("run", "i", "j").applyInArrow(join, "a long, b long").distinct()


def residual(members: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of tile pairs (see ``candidates``) of runs that hold different components."""
    rows = members.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    rows = stage(rows, "run-members")
    open_ = rows.groupBy("run").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("run")
    rows = stage(rows.join(open_, "run", "left_semi"), "open-runs")
    ranges = rows.groupBy("run", "tile").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    right = ranges.select("run", F.col("tile").alias("j"), F.col("low").alias("low2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = ranges.withColumnRenamed("tile", "i").join(right, "run").filter("i <= j and 4 * high >= 3 * low2 and (x != x2 or y != y2 or x != y)").select("run", "i", "j")
    sides = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("i", "j"))))
    wanted = sides.join(rows, ["run", "tile"])
    return wanted.join(signatures(rows.select("cls").distinct(), classes, docs), "cls")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every document, and (cls, doc, n, component_id) of every class."""
    described = stage(describe(docs), "described")
    meta = described.filter("counter is null").select("doc_id", "n", "cls")
    classes = stage(meta.filter("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    standing = docs.join(fit(classes.select("doc")), F.col("doc_id") == F.col("doc"), "left_semi")
    if classes.count() > BROADCAST:
        standing = stage(standing, "standing")  # chunks need rows in a repeatable order
    told = tell(ask(standing, levels(described), max(16, math.ceil(total / BUCKET))))
    found = stage(runs(prefixes(told, max(16, math.ceil(total / 8 / BUCKET)))), "runs")
    discard(standing)

    members = found.dropDuplicates(["run", "tile"]).select("run", "tile", F.explode(F.arrays_zip("cls", "size")).alias("m"))
    members = stage(members.select("run", "tile", "m.cls", "m.size"), "members")
    links = stage(verify(hubs(members), classes, docs), "links")
    comp = stage(components(links), "components")
    more = stage(verify(candidates(residual(members, comp, classes, docs)), classes, docs), "links")
    if more.head(1):
        comp = stage(components(links.unionByName(more)), "components")
    roots = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc", "n", F.coalesce("root", "cls").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    return meta, stage(roots.join(least, "root").select("cls", "doc", "n", "component_id"), "by-class")


def _plain(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _own_component() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def link(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id: the smallest id reachable by links."""
    meta, by_class = _grouped(_plain(docs, text, key))
    out = meta.join(by_class.select("cls", "component_id"), "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), _own_component().alias("component_id"))


def linked_all(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``left`` links with each of ``right``."""
    sets = [*left, *right]
    size = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begin = np.flatnonzero(new)
    shared = np.diff(np.append(begin, len(flat))) > 1  # what one set holds alone is in no intersection
    keep = np.repeat(shared, np.diff(np.append(begin, len(flat))))
    column, owner = (np.cumsum(new) - 1)[keep], owner[keep]
    column = (np.cumsum(shared) - 1)[column]
    both = np.zeros((len(left), len(right)), np.int64)
    wide = max(COLUMNS, (1 << 22) // len(sets))
    for low in range(0, int(shared.sum()), wide):
        part = slice(*np.searchsorted(column, [low, low + wide]))
        m = np.zeros((len(sets), min(wide, int(column[part][-1]) - low + 1)), np.float32)
        m[owner[part], column[part] - low] = 1
        both += np.rint(m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return (both > 0) & (100 * both >= 75 * (size[: len(left), None] + size[None, len(left) :] - both))


def _compared(by_class: DataFrame, docs: DataFrame, as_pairs: bool) -> DataFrame:
    """All pairs of classes of each component, compared: (a, b), the documents that stand for them, or (cls, links), the
    members of linked classes (several rows for a class). by_class: (cls, doc, n, component_id, members)."""
    groups = by_class.groupBy("component_id").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter("rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    blocks = F.least(blocks, F.col("rows")).cast("int")
    groups = stage(groups.withColumn("blocks", blocks), "groups")
    whole = groups.filter("blocks = 1").agg(F.sum("rows").alias("r"), F.sum("shingles").alias("s")).first()
    tasks = max(64, math.ceil((whole["r"] or 0) / BLOCK), math.ceil((whole["s"] or 0) / BLOCK_SHINGLES))
    own = by_class.join(fit(groups.select("component_id", "blocks")), "component_id")
    own = own.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    own = stage(own.select("cls", "doc", "members", "component_id", "blocks", "block"), "blocks")
    texts = docs.join(fit(own), F.col("doc_id") == F.col("doc")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    texts = texts.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    one = F.pmod(F.xxhash64("component_id"), F.lit(tasks))
    texts = texts.withColumn("task", F.when(F.col("blocks") == 1, one).otherwise(F.xxhash64("component_id", "i", "j")))
    many = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.lit(1))
    texts = texts.select("task", many.alias("cut"), "component_id", "i", "j", "block", "cls", "doc", "members", "text")

    def compare(rows: pa.Table) -> pa.Table:
        where = list(zip(*(rows[c].to_pylist() for c in ("component_id", "i", "j", "block", "cls", "doc", "members")), strict=True))
        groups: dict[tuple, dict[int, dict[int, tuple]]] = {}
        for k, s in _sets(rows["text"]):
            component, i, j, block, cls, doc, members = where[k]
            if cls == class_of(s):  # else another text under the same id
                groups.setdefault((component, i, j), {}).setdefault(block, {})[cls] = (s, doc, members)
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (_, i, j), sides in groups.items():
            left, right = sides.get(i, {}), sides.get(j, {})
            if not left or not right:
                continue
            link = linked_all([v[0] for v in left.values()], [v[0] for v in right.values()])
            if i == j:
                np.fill_diagonal(link, False)
            if as_pairs:
                a, b = np.nonzero(np.triu(link) if i == j else link)
                a, b = (np.array([v[1] for v in side.values()], np.int64)[at] for side, at in ((left, a), (right, b)))
                first.append(np.minimum(a, b))
                second.append(np.maximum(a, b))
                continue
            for side, other, found in ((left, right, link), (right, left, link.T))[: 1 if i == j else 2]:
                first.append(np.array(list(side), np.int64))
                second.append(found @ np.array([v[2] for v in other.values()], np.int64))
        return pa.table({names[0]: pa.array(np.concatenate(first)), names[1]: pa.array(np.concatenate(second))})

    names = ("a", "b") if as_pairs else ("cls", "links")
    return texts.groupBy("task", "cut").applyInArrow(compare, f"{names[0]} long, {names[1]} long")


def _with_members(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    meta, by_class = _grouped(docs)
    members = meta.filter("n > 0 and doc_id is not null").select("cls", "doc_id").distinct().groupBy("cls").agg(F.count("*").alias("members"))
    return meta, stage(by_class.join(members, "cls"), "by-class")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; n_links: other documents that it links with.

    An id whose rows have different sets counts once for each set; empty sets and null ids have no links.
    """
    docs = _plain(docs, text, key)
    meta, by_class = _with_members(docs)
    links = _compared(by_class, docs, as_pairs=False).groupBy("cls").agg(F.sum("links").alias("links"))
    n_links = F.col("members") - 1 + F.coalesce("links", F.lit(0))
    by_class = stage(by_class.join(links, "cls", "left").select("cls", "component_id", n_links.alias("n_links")), "by-class")
    out = meta.join(by_class, "cls", "left")
    linked_ones = F.when(F.col("doc_id").isNotNull(), F.col("n_links"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), _own_component().alias("component_id"), F.coalesce(linked_ones, F.lit(0)).alias("n_links"))


def pairs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), a and b standing for different sets, and (doc_id, representative) of every document with words.

    Documents with one representative have equal sets, and link with each other and with all that it links with.
    """
    docs = _plain(docs, text, key)
    meta, by_class = _with_members(docs)
    standing = meta.filter("n > 0 and doc_id is not null").select("doc_id", "cls").distinct().join(by_class.select("cls", "doc"), "cls")
    return _compared(by_class, docs, as_pairs=True), standing.select("doc_id", F.col("doc").alias("representative"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Rows with a null id, and texts without
    words, stay; of repeated rows (equal id and text) one stays."""
    found = stage(link(docs, text, key), "components")
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.head(1):
        same, lone = fresh(docs, "_same"), fresh(docs, "_lone")
        docs = docs.withColumn(same, F.xxhash64(text)).withColumn(lone, F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
        docs = docs.dropDuplicates([key, same, lone]).drop(same, lone)
    name = fresh(docs, "_gone")
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(fit(gone), F.col(key) == F.col(name), "left_anti")
