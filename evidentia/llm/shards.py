"""Sharding by a histogram sort.

Rows are ordered by (hash of the text, doc_id, a number), so equal texts lie together. Splitters of this order that give
shards of near equal bytes are found by counting, exactly and across all partitions, the bytes and rows below sampled
candidate keys; candidates are refined between the two nearest ones of every target until the splitter meets the
tolerance or no key lies between. Only the shards' own splitters are sought, so what is probed doesn't grow with the rows.
Rows are exchanged once, to their shard and one of its parts, a range of keys of bounded size; a part's rows are sorted and
numbered from the exact number of rows in the parts before it, so slots have no gaps and follow the order of keys: equal
texts of a shard lie together. Bounds of parts are every EVERY-th key of a sample, taken on the executors; they only deal
out the work, so they needn't be exact. A splitter that misses the tolerance after all rounds is reported by a warning.

The law is ``bytes``: sizes of shards differ by little. A boundary is moved to the start of a group of equal texts if that
costs no more than SNAP of a shard's size, so only groups larger than that are ever divided.

Defined results: a null text counts as an empty one (size 1); rows with equal ids or texts, and rows with null ids, each
take a slot of their own; with fewer rows than shards some shards stay empty; an empty table gives an empty one; further
columns are passed on unless they bear an output column's name.
"""

from __future__ import annotations

import warnings
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.staging import fresh, stage, widened

#: Largest error of a shard's boundary, as a share of a shard's bytes.
TOLERANCE = 0.0005
#: Largest error taken to keep a group of equal texts whole.
SNAP = 0.005
#: Rows and bytes of a part, about.
PART_ROWS = 250_000
PART_BYTES = 1 << 28
#: Parts of a shard, at least; a row for each is broadcast.
PARTS = 8
#: Sampled keys for each part.
EVERY = 24
#: Sampled candidates for each splitter in a round.
PROBES = 24
ROUNDS = 12
_LEAST = -(2**63)
KEY = ["h", "doc_id", "seq"]

Key = tuple[int, int, int]


def _encode(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as byte strings in the same order."""
    parts = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], 1)
    return np.ascontiguousarray(parts.astype(">u8")).view("S24").reshape(-1)


def _encode_keys(keys: list[Key]) -> np.ndarray:
    return _encode([np.array([k[i] for k in keys], np.int64) for i in range(3)])


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return _encode([batch.column(batch.schema.names.index(c)).fill_null(_LEAST).to_numpy(zero_copy_only=False) for c in KEY])


def below(keys: DataFrame, probes: list[Key]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe, and at the end of all rows."""
    edges = _encode_keys(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            place = np.searchsorted(edges, _columns(b), side="right")
            rows += np.bincount(place, minlength=len(rows))
            np.add.at(size, place, b.column(b.schema.names.index("size")).to_numpy())
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int64)), pa.array(size[has]), pa.array(rows[has])], ["k", "size", "rows"])

    got = keys.mapInArrow(count, "k long, size long, rows long").groupBy("k").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in got:
        size[r.k], rows[r.k] = r["size"], r["rows"]
    return list(zip(np.cumsum(size).tolist(), np.cumsum(rows).tolist(), strict=True))


def _sample(keys: DataFrame, share: float, spans: list[tuple[Key | None, Key | None]], turn: int) -> list[Key]:
    """A sample, by a hash, of the keys strictly within the given spans."""
    lows = _encode_keys([a or (_LEAST,) * 3 for a, _ in spans])
    highs = _encode_keys([b or (2**63 - 1,) * 3 for _, b in spans])
    order = np.argsort(lows)
    lows, highs = lows[order], highs[order]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _columns(b)
            at = np.searchsorted(lows, own, side="left") - 1
            inside = (at >= 0) & (own < highs[np.maximum(at, 0)]) & (own > lows[np.maximum(at, 0)])
            yield b.select(KEY).filter(pa.array(inside))

    some = keys.select(*KEY)
    if share < 1:
        some = some.filter(F.pmod(F.xxhash64("seq", F.lit(turn)), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = some.mapInArrow(pick, some.schema).toArrow()
    return [tuple(_LEAST if v is None else v for v in r.values()) for r in got.to_pylist()]


def splitters(keys: DataFrame, n: int) -> list[Key | None]:
    """n - 1 splitters of the shards (None: below all rows)."""
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    size, rows = total["b"] or 0, total["n"]
    targets = [size * k / n for k in range(1, n)]
    known: dict[Key, tuple[int, int]] = {}
    spans: list[tuple[Key | None, Key | None]] = [(None, None)]
    inside = rows
    for turn in range(ROUNDS):
        want = PROBES * len(targets) if turn == 0 else PROBES * max(1, len(spans))
        share = min(1.0, want / max(1, inside))
        new = {p for k in _sample(keys, share, spans, turn) for p in (k, (k[0], _LEAST, _LEAST))} - known.keys()
        if new:
            probes = sorted(new)
            known.update(zip(probes, below(keys, probes), strict=False))
        order = sorted(known)
        sizes = [known[k][0] for k in order]
        spans, inside = [], 0
        for t in targets:
            at = bisect_left(sizes, t)
            low, high = (order[at - 1] if at else None), (order[at] if at < len(order) else None)
            near = min(t - (known[low][0] if low else 0), (known[high][0] if high else size) - t)
            between = (known[high][1] if high else rows) - (known[low][1] if low else 0)
            if near > TOLERANCE * size / n and between > 1 and share < 1 and (low, high) not in spans:
                spans.append((low, high))
                inside += between
        if not spans:
            break
    else:
        warnings.warn(f"shards: {len(spans)} boundaries miss the tolerance", stacklevel=2)
    starts = [k for k in order if k[1] == _LEAST]
    start_sizes = [known[k][0] for k in starts]

    def nearest(keys_: list[Key], sizes_: list[int], t: float) -> Key | None:
        at = bisect_left(sizes_, t)
        return min(keys_[max(0, at - 1) : at + 1], key=lambda k: abs(known[k][0] - t), default=None)

    out = []
    for t in targets:
        best, whole = nearest(order, sizes, t), nearest(starts, start_sizes, t)
        if whole is not None and abs(known[whole][0] - t) <= SNAP * size / n:
            best = whole
        out.append(best)
    return sorted(out, key=lambda k: (k is not None, k))


def _part_bounds(keys: DataFrame, share: float, parts: int) -> list[Key]:
    """Every EVERY-th key of a sample of all keys, in order: one for each of about ``parts`` parts.

    The sample is sorted in ranges of the hash's first bits, so no task sees more of it than a range's share.
    """
    bits = min(8, max(0, (parts // 16).bit_length() - 1))  # a range has 16 parts at least
    some = keys.select(*KEY).filter(F.pmod(F.xxhash64("seq", F.lit(77)), F.lit(1 << 30)) < int(share * (1 << 30)))
    ranges = W.partitionBy(F.shiftright("h", 64 - bits) if bits else F.lit(0)).orderBy(*KEY)
    got = some.withColumn("_n", F.row_number().over(ranges)).filter(F.col("_n") % EVERY == 0).select(*KEY).toArrow()
    return sorted(tuple(_LEAST if v is None else v for v in r.values()) for r in got.to_pylist())


def shard(df: DataFrame, n: int = 16, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``key``, the columns ``carry`` (all, if not given), size, shard and slot of every row."""
    spark = df.sparkSession
    df = df.drop("size", "shard", "slot")
    rest = [c for c in df.columns if c != key and (carry is None or c in carry)]
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
        F.monotonically_increasing_id().alias("seq"),
        F.struct(*rest, F.lit(0).alias(fresh(df, "_"))).alias("row"),
    )
    rows = stage(rows, "shard-rows")
    keys = rows.select(*KEY, "size")
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    parts = max(PARTS, -(-total["n"] // (n * PART_ROWS)), -(-(total["b"] or 0) // (n * PART_BYTES)))
    bounds = _encode_keys([k or (_LEAST,) * 3 for k in splitters(keys, n)])

    edges = _encode_keys(_part_bounds(keys, min(1.0, EVERY * n * parts / max(1, total["n"])), n * parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _columns(b)
            of, part = np.searchsorted(bounds, own, side="right"), np.searchsorted(edges, own, side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32)), pa.array(part.astype(np.int32))], [*b.schema.names, "shard", "part"])

    def placed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(place, widened(rows, "shard int, part int"))

    # rows of a shard's parts: a small table, one row for each part
    counts = stage(placed(keys).groupBy("shard", "part").agg(F.count("*").alias("rows")), "parts")
    base = counts.select("shard", "part", (F.sum("rows").over(W.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("base"))
    slot = F.row_number().over(W.partitionBy("shard", "part").orderBy(*KEY)) - 1
    sorted_ = placed(rows).withColumn("slot", slot).join(F.broadcast(base), ["shard", "part"])
    return sorted_.select(
        F.col("doc_id").alias(key),
        "size",
        *[F.col(f"row.{c}").alias(c) for c in rest],
        "shard",
        (F.col("base") + F.col("slot")).cast("long").alias("slot"),
    )
