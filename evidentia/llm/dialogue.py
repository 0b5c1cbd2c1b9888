"""Conversation structure repair by dynamic programming over a trie of signatures.

A row's sign tells its role's initial and whether its text is truncated, or that it has to be deleted; a conversation's
signature is the text of its signs. Signatures are inserted in sorted order into a prefix trie, whose nodes hold a layer:
for each state of the pattern the cheapest edits of the prefix, and the ASCII-least of equal ones. So a layer is computed
once for each prefix that signatures share, and the answers are read at terminal nodes.

Rows are sorted by ranges of (conversation, turn, role, start of the text), so a conversation of any size is dealt over as
many tasks as it needs. A conversation that lies within one task and has no more than ``ROWS`` rows is repaired there and then. What
a border of ranges cuts, and longer ones, become pieces of so many rows; the trie gives a piece's cheapest edits from each
state to each, and a chain over the pieces, a few strings for each, composes them. Edits whose cost is more than ``SLACK``
above the least can't win any more, as any state reaches any other's continuation at that price.
A hash over a whole conversation is a sequential thing: its pieces' repaired lines are hashed one after another in one task,
which holds one piece at a time.

Defined results: null roles and texts are one space; null conversation ids make one conversation; null turns come first.
Rows of equal turns are taken by role and text. Repeated rows are rows (and duplicates). Very long texts are taken whole.
Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.staging import stage

#: Rows, and characters of text, after which a piece ends.
ROWS, CHARS = 256, 1 << 20
#: Nodes of a worker's trie; when there are more, it starts anew with the next block of conversations.
NODES = 20_000
#: Conversations whose signatures are inserted together, sorted.
BLOCK = 2_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SLACK = 2 * INSERT + DELETE
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after a system row, after a user row, after an assistant row; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that a kept row of this initial leads to.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that a rerolled or inserted row leads to.
NEW = (USER, USER, ASSISTANT, USER)
#: For each state the cheapest cost and its edits; None: can't be reached.
Layer = tuple[tuple[int, str] | None, ...]


def _put(layer: list, state: int, cost: int, edits: str) -> None:
    if layer[state] is None or (cost, edits) < layer[state]:
        layer[state] = (cost, edits)


def inserted(layer: list) -> Layer:
    """The layer with insertions behind it (a third one in a row leads back at a higher cost)."""
    for _ in range(2):
        for state, found in enumerate(list(layer)):
            if found:
                _put(layer, NEW[state], found[0] + INSERT, found[1] + "I")
    return tuple(layer)


def step(layer: Layer, sign: str) -> Layer:
    """The layer behind one more row."""
    out: list = [None] * 4
    more = TRUNCATED if sign.isupper() else 0
    for state, found in enumerate(layer):
        if not found:
            continue
        cost, edits = found
        _put(out, state, cost + DELETE, edits + "D")
        if sign != "x":
            if (to := KEPT.get((state, sign.lower()))) is not None:
                _put(out, to, cost + KEEP + more, edits + "K")
            _put(out, NEW[state], cost + REROLE + more, edits + "R")
    return inserted(out)


class Trie:
    """Prefixes of signatures with their layers; ``WHOLE`` roots whole conversations, the others pieces from one state."""

    WHOLE = 4

    def __init__(self) -> None:
        self.n = 0
        layers = [tuple((0, "") if s == k else None for s in range(4)) for k in range(4)]
        self.roots = [({}, x) for x in [*layers, inserted(list(layers[START]))]]

    def layer(self, signature: str, root: int = WHOLE) -> Layer:
        """Insert a signature; the layer at its terminal node."""
        children, layer = self.roots[root]
        for sign in signature:
            if (node := children.get(sign)) is None:
                node = children[sign] = ({}, step(layer, sign))
                self.n += 1
            children, layer = node
        return layer


def best(layer: Layer) -> tuple[int, str]:
    return min(found for s in ENDS if (found := layer[s]))


class Piece:
    """Consecutive rows of a conversation."""

    def __init__(self, turns: list[int | None], roles: list[str], texts: list[str]) -> None:
        self.turns, self.roles, self.texts = turns, roles, texts

    def examine(self, earlier: set[bytes] = frozenset()) -> None:
        """Signs and counts; ``earlier``: digests of roles and texts seen in pieces before."""
        self.blank = self.duplicate = self.truncated = 0
        signs, seen = [], set()
        for role, text in zip(self.roles, self.texts, strict=True):
            key = (role, text)
            repeated = key in seen or bool(earlier) and digest(role, text) in earlier
            seen.add(key)
            shown = text.rstrip(SPACE)
            sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not shown:
                self.blank += 1
                sign = "x"
            elif repeated:
                self.duplicate += 1
                sign = "x"
            elif shown[-1] not in ".!?":
                self.truncated += 1
                sign = sign.upper()
            signs.append(sign)
        self.signature = "".join(signs)
        heads = [r[:1] for r in self.roles]
        self.illegal = sum(a + b not in LEGAL for a, b in zip(heads, heads[1:], strict=False))
        known = sorted({t for t in self.turns if t is not None})
        self.first, self.last, self.distinct = (known[0], known[-1], len(known)) if known else (None, None, 0)

    def lines(self, start: int, edits: str) -> list[str]:
        """The repaired rows that these edits leave, from a state on."""
        out, state, row = [], start, 0
        for e in edits:
            if e == "I":
                state = NEW[state]
                out.append(("user" if state == USER else "assistant") + ":")
                continue
            role, text = self.roles[row], self.texts[row]
            row += 1
            if e == "D":
                continue
            state = KEPT[state, role[:1]] if e == "K" else NEW[state]
            out.append((role if e == "K" else "user" if state == USER else "assistant") + ":" + text)
        return out


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FOUND = [x.split()[0] for x in COUNTS.split(", ")]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _schema(own: pa.DataType, ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([("conv_id", own), *((n, kinds[k]) for n, k in (x.split() for x in ddl.split(", ")))])


def _with(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *T.StructType.fromDDL(ddl).fields])


def _whole(ids: list, pieces: list[Piece], trie: Trie) -> list[dict]:
    """Results of whole conversations, whose signatures are inserted sorted."""
    if trie.n > NODES:
        trie.__init__()
    for p in pieces:
        p.examine()
    answers = {s: best(trie.layer(s)) for s in sorted({p.signature for p in pieces})}
    out = []
    for own, p in zip(ids, pieces, strict=True):
        cost, edits = answers[p.signature]
        found = (gaps(p.first, p.last, p.distinct), p.blank, p.duplicate, p.truncated, p.illegal, cost, edits)
        out.append({"conv_id": own} | dict(zip(_FOUND, (*found, hashlib.sha256("\n".join(p.lines(START, edits)).encode()).hexdigest()), strict=True)))
    return out


PIECES = "no long, turns array<long>, roles array<string>, texts array<string>"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to results of whole conversations, and to pieces of the others."""
    task, seq = TaskContext.get().partitionId() << 32, 0
    trie, ids, whole = Trie(), [], []
    schema = None
    run: list = []  # [id, first of the task, pieces sent, turns, roles, texts, characters]

    def sent(own: list) -> dict:
        nonlocal seq
        seq += 1
        row = {"conv_id": own[0], "no": task + seq, "turns": own[3], "roles": own[4], "texts": own[5]}
        own[2], own[3:] = own[2] + 1, [[], [], [], 0]
        return row

    def ended(own: list, last: bool) -> list[dict]:
        """Rows to emit when a conversation's rows have ended."""
        if own[1] or last or own[2]:
            return [sent(own)] if own[3] else []
        ids.append(own[0])
        whole.append(Piece(*own[3:6]))
        return []

    held = 0
    for b in batches:
        schema = schema or _schema(b.schema.types[0], f"{PIECES}, {COUNTS}")
        out: list[dict] = []
        for own, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not run or own != run[0]:
                if run:
                    held += run[6]
                    out += ended(run, False)
                run = [own, not run, 0, [], [], [], 0]
                if len(whole) >= BLOCK or held >= 16 * CHARS:
                    out += _whole(ids, whole, trie)
                    ids, whole, held = [], [], 0
            elif len(run[3]) >= ROWS or run[6] >= CHARS:
                out.append(sent(run))
            run[3].append(turn)
            run[4].append(role)
            run[5].append(text)
            run[6] += len(text)
        if out:
            yield _batch(out, schema)
    if run:
        out = ended(run, True) + _whole(ids, whole, trie)
        yield _batch(out, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        schema = _schema(b.schema.types[0], "no long, digest binary")
        rows = []
        for own, no, roles, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows += [{"conv_id": own, "no": no, "digest": d} for d in {digest(r, t) for r, t in zip(roles, texts, strict=True)}]
        yield _batch(rows, schema)


MATRIX = (
    "no long, first long, last long, distinct long, head string, tail string, blank long, duplicate long, truncated long, illegal long, "
    "costs array<long>, edits array<string>"
)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest edits of each piece from each state to each."""
    trie = Trie()
    for b in batches:
        schema = _schema(b.schema.types[0], MATRIX)
        pieces = []
        for turns, roles, texts, earlier in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
            p = Piece(turns, roles, texts)
            p.examine(set(earlier or ()))
            pieces.append(p)
        if trie.n > NODES:
            trie = Trie()
        layers = {s: [trie.layer(s, k) for k in range(4)] for s in sorted({p.signature for p in pieces})}
        rows = []
        for own, no, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pieces, strict=True):
            flat = [x for layer in layers[p.signature] for x in layer]
            rows.append({
                "conv_id": own, "no": no, "first": p.first, "last": p.last, "distinct": p.distinct, "head": p.roles[0][:1], "tail": p.roles[-1][:1],
                "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal,
                "costs": [x and x[0] for x in flat], "edits": [x and x[1] for x in flat],
            })
        yield _batch(rows, schema)


class Chain:
    """Composes the pieces of one conversation in their order."""

    def __init__(self) -> None:
        # for each state: cost, and (piece, state before, edits) of the pieces that aren't settled yet
        self.live: list = [found and (found[0], []) for found in inserted([(0, ""), None, None, None])]
        self.before = ["" if found is None else found[1] for found in inserted([(0, ""), None, None, None])]
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.tail: str | None = None
        self.audit: list[str] = []

    def add(self, row: dict) -> list[tuple[int, int, str]]:
        """Take the next piece; what is settled by it."""
        nexts: list = [None] * 4
        for a, found in enumerate(self.live):
            for b in range(4):
                cost = row["costs"][4 * a + b]
                if found is None or cost is None:
                    continue
                edits = row["edits"][4 * a + b]
                cut = (row["no"], a, edits) if self.before is None else (row["no"], START, self.before[a] + edits)
                if nexts[b] is None or found[0] + cost < nexts[b][0]:
                    nexts[b] = (found[0] + cost, [*found[1], cut])
                elif found[0] + cost == nexts[b][0]:
                    nexts[b] = min(nexts[b], (found[0] + cost, [*found[1], cut]), key=_edits)
        self.before = None
        least = min(x[0] for x in nexts if x)
        self.live = [x if x and x[0] <= least + SLACK else None for x in nexts]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + row[name])
        self.illegal += self.tail is not None and self.tail + row["head"] not in LEGAL
        self.tail = row["tail"]
        if row["first"] is not None:
            self.distinct += row["distinct"] - (self.last == row["first"])
            self.first, self.last = row["first"] if self.first is None else self.first, row["last"]
        return self._settled([x[1] for x in self.live if x])

    def _settled(self, lists: list[list]) -> list[tuple[int, int, str]]:
        n = 0
        while all(len(x) > n for x in lists) and all(x[n] == lists[0][n] for x in lists):
            n += 1
        out = lists[0][:n]
        for x in lists:
            del x[:n]
        self.audit += [c[2] for c in out]
        return out

    def end(self) -> tuple[list[tuple[int, int, str]], dict]:
        cost, left = min((x for s in ENDS if (x := self.live[s])), key=lambda x: (x[0], _edits(x)))
        self.audit += [c[2] for c in left]
        found = (gaps(self.first, self.last, self.distinct), self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit))
        return left, dict(zip(_FOUND, found, strict=False))


def _edits(found: tuple[int, list]) -> str:
    return "".join(c[2] for c in found[1])


CUTS = "no long, start int, edits string"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and number, to their edits (with a number) and to results without hashes."""
    own, chain, schema = None, None, None

    def cuts(found: list[tuple[int, int, str]]) -> list[dict]:
        return [{"conv_id": own, "no": n, "start": s, "edits": e} for n, s, e in found]

    def close() -> list[dict]:
        left, found = chain.end()
        return [*cuts(left), {"conv_id": own} | found]

    for b in batches:
        schema = schema or _schema(b.schema.types[0], f"{CUTS}, {COUNTS}")
        out: list[dict] = []
        for row in b.to_pylist():
            if chain is None or row["conv_id"] != own:
                if chain is not None:
                    out += close()
                own, chain = row["conv_id"], Chain()
            out += cuts(chain.add(row))
        yield _batch(out, schema)
    if chain is not None:
        yield _batch(close(), schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        schema = _schema(b.schema.types[0], "no long, lines string")
        rows = []
        for own, no, roles, texts, start, edits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lines = Piece([], roles, texts).lines(start, edits)
            rows.append({"conv_id": own, "no": no, "lines": "\n".join(lines) if lines else None})
        yield _batch(rows, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, sha, first, schema = None, None, True, None
    for b in batches:
        schema = schema or _schema(b.schema.types[0], "repaired_sha256 string")
        out = []
        for i, lines in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if sha is None or i != own:
                if sha is not None:
                    out.append({"conv_id": own, "repaired_sha256": sha.hexdigest()})
                own, sha, first = i, hashlib.sha256(), True
            if (text := lines.as_py()) is not None:
                sha.update((text if first else "\n" + text).encode())
                first = False
        yield _batch(out, schema)
    if sha is not None:
        yield _batch([{"conv_id": own, "repaired_sha256": sha.hexdigest()}], schema)


def _same(left: DataFrame, right: DataFrame, how: str, *keys: str) -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in keys else c for c in right.columns])
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_{k}" for k in keys])


def _pieced(pieces: DataFrame) -> DataFrame:
    """Results of conversations in pieces (a staged table)."""
    held = pieces.select("conv_id", "no", "roles", "texts").mapInArrow(_digests, _with(pieces, "no long, digest binary"))
    firsts = held.groupBy("conv_id", "digest").agg(F.min("no").alias("first_no"))
    later = _same(held, firsts, "inner", "conv_id", "digest").filter("no > first_no")
    later = later.groupBy("conv_id", "no").agg(F.collect_list("digest").alias("earlier"))  # ROWS at most
    marked = _same(pieces, later, "left", "conv_id", "no").select("conv_id", "no", "turns", "roles", "texts", "earlier")
    matrices = marked.mapInArrow(_matrices, _with(pieces, MATRIX))
    sorted_ = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "no")
    chained = stage(sorted_.mapInArrow(_chained, _with(pieces, f"{CUTS}, {COUNTS}")), "dialogue-chained")
    cuts = chained.filter("no is not null").select("conv_id", "no", "start", "edits")
    lines = _same(pieces, cuts, "inner", "conv_id", "no").select("conv_id", "no", "roles", "texts", "start", "edits")
    lines = lines.mapInArrow(_repaired, _with(pieces, "no long, lines string"))
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "no").select("conv_id", "lines").mapInArrow(_hashed, _with(pieces, "repaired_sha256 string"))
    return _same(chained.filter("no is null").drop("no", "start", "edits", "repaired_sha256"), hashes, "left", "conv_id").select("conv_id", *_FOUND)


def repair(df: DataFrame) -> DataFrame:
    """One row for each conversation of ``df`` (conv_id, turn, role, text): faults, cost, edits and hash of the repaired rows."""
    text = F.coalesce("text", F.lit(" "))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    made = stage(dealt.mapInArrow(_assemble, _with(df, f"{PIECES}, {COUNTS}")), "dialogue-pieces")
    whole = made.filter("no is null").select("conv_id", *_FOUND)
    pieced = stage(_pieced(made.filter("no is not null").select("conv_id", "no", "turns", "roles", "texts")), "dialogue-pieced")
    return whole.unionByName(pieced)


def damage(df: DataFrame) -> DataFrame:
    """Rows with planted faults, by the hash of conversation and turn: dropped, emptied, without ends, repeated or rerolled."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.pmod(F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")), F.lit(20))
    role = F.when(fault == 4, "user").otherwise(spaced[2])
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced[3], "[.!?]", "")).otherwise(spaced[3])
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    made = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies")).filter("copies > 0")
    return made.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def repair_all(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``repair`` with a row for each of ``ids`` too (column conv_id): zeros, no edits and no lines where it has no rows."""
    wanted = ids.select("conv_id").distinct()
    found = _same(wanted, repair(df), "left", "conv_id")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _FOUND[:6]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
