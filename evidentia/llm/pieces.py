"""SentencePiece encoding and decoding by a table of prefixes, for models of the merge type.

The encoding of a text is told by the last token of each of its prefixes: there is one such token for each prefix, and it
is the token ending there that is compatible with the last token of the prefix before it. An automaton of all pieces yields
the tokens that end at each character; two tokens are compatible if, while both are built from their characters, no merge
across their border comes first. The ids are then recovered backwards, from the whole text's last token. The work is
linear in the text.

Compatibility is told from the tokens' edges alone. A token's right edge is the list of symbols that stand last while it is
built, each with the lowest score that a merge within the token has to reach until that symbol is merged; its left edge
likewise. Of two edges that meet, the symbol whose score is higher goes first, and a merge across the border takes place
if it is higher than both (merges of equal score go from left to right).

No piece has a space symbol behind another character (the model is checked), and a character without a piece is never
merged, so texts are cut there and each different part is encoded once.

Defined results: a null text is an empty one, with no tokens; equal rows give equal results; empty tables give empty ones;
very long texts are processed whole; further columns are passed on unless they bear an output column's name, in which case
the output replaces them. ``decode``: null ids are an empty text; ids that the model lacks and nulls are left out.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidentia.llm.bpe import DIGEST, IDS, _append, _texts, ragged

SPACE = "▁"
#: Kinds of pieces in the model's file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts whose results a worker remembers; when there are more, it starts anew with the next block.
KEPT_PARTS = 400_000
#: Slots of the table of tested pairs, a power of two.
PAIRS = 1 << 20
#: Bytes of a part from which it is encoded by itself.
LONG = 64
#: Characters of text whose unknown parts are encoded together.
BLOCK_CHARS = 4_000_000
NEVER = float("-inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a message's fields in the wire format of protocol buffers."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and normalisation of a model's file; encoding and decoding of texts."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        pieces = [dict(fields(p)) for n, p in parts if n == 1]
        trainer = dict(fields(next((p for n, p in parts if n == 2), b"")))
        rules = dict(fields(next((p for n, p in parts if n == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model isn't of the merge type")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only texts that are taken as they are, with escaped spaces in front of words, can be encoded")
        self.dummy = bool(rules.get(3, 1))
        self.text = [p[1].decode() for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        if USER in self.kind or UNUSED in self.kind:
            raise ValueError("models with pieces of users or without use aren't known")
        self.score = np.array([struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces])
        self.byte = {int(t[1:-1], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        if len(self.byte) < 256:
            raise ValueError("the model has no pieces for bytes")
        own = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        if any(SPACE in t.lstrip(SPACE) for t in own):
            raise ValueError("a piece goes on behind a space")
        self.width = len(pieces)
        #: Pairs of pieces that make a third, and that piece.
        joins = {own[t[:k]] * self.width + own[t[k:]]: i for t, i in own.items() for k in range(1, len(t)) if t[:k] in own and t[k:] in own}
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_score = self.score[[joins[k] for k in self.join_keys.tolist()]]
        edges = {i: found for t, i in own.items() if (found := self._edges(i, [own.get(c, -1) for c in t], joins))}
        self.right, self.left = (self._flat({i: e[k] for i, e in edges.items()}) for k in (0, 1))
        self._automaton({self.text[i].encode(): i for i in edges})
        self.size = np.array([len(t.encode()) for t in self.text], np.int32)
        self.known = {t for t in own if len(t) == 1}
        signs = "".join(re.escape(t) for t in self.known if t != SPACE)
        self.cut = re.compile(f"{SPACE}*[{signs}]+|{SPACE}+|[^{signs}{SPACE}]+")
        self.spoken = [self._spoken(i) for i in range(self.width)]
        self.spoken_flat, self.spoken_at = _joined(self.spoken)
        self.decimal_flat, self.decimal_at = _joined([f"{i},".encode() for i in range(self.width)])
        self.pair_key, self.pair_good = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.parts: dict[str, tuple[bytes, bytes, bytes]] = {}

    def _spoken(self, i: int) -> bytes:
        """What a piece stands for in a text."""
        if self.kind[i] == BYTE:
            return bytes([int(self.text[i][1:-1], 16)])
        if self.kind[i] == CONTROL:
            return b""
        return " ⁇ ".encode() if self.kind[i] == UNKNOWN else self.text[i].replace(SPACE, " ").encode()

    def _automaton(self, words: dict[bytes, int]) -> None:
        """States of all words' prefixes, in breadth: the next state for each byte, and the words that end in a state.

        ``token``: the longest; ``shorter``: the state whose longest word is the next shorter one (0: there is none).
        """
        level: list[tuple[int, int, int]] = []  # parent, byte, state
        nodes: dict[bytes, int] = {b"": 0}
        prefixes = sorted({w[:k] for w in words for k in range(1, len(w) + 1)}, key=len)
        self.next = np.zeros((len(prefixes) + 1, 256), np.int32)
        token, fail, depth = (np.full(len(prefixes) + 1, x, np.int32) for x in (-1, 0, 0))
        for p in prefixes:
            nodes[p] = len(nodes)
            token[nodes[p]], depth[nodes[p]] = words.get(p, -1), len(p)
            level.append((nodes[p[:-1]], p[-1], nodes[p]))
        edges = np.array(level, np.int32).reshape(-1, 3)
        hit = np.zeros(len(token), np.int32)  # the state itself, or the next of its suffixes, where a word ends
        self.shorter = np.zeros(len(token), np.int32)
        for d in range(1, depth.max(initial=0) + 1):
            parent, byte, state = edges[depth[edges[:, 2]] == d].T
            if d > 1:
                fail[state] = self.next[fail[parent], byte]
                self.next[parent, byte] = state
            else:
                self.next[0, byte] = state
            self.next[state] = self.next[fail[state]]
            self.shorter[state] = hit[fail[state]]
            hit[state] = np.where(token[state] >= 0, state, self.shorter[state])
        self.hit, self.token = hit, token

    # -- compatibility ---------------------------------------------------------------------------------------------
    def _edges(self, token: int, symbols: list[int], joins: dict[int, int]) -> tuple[list, list] | None:
        """Build a token from its characters and give its edges; None if merging doesn't lead to it."""
        if -1 in symbols:
            return None
        right: list[tuple[int, float]] = []
        left: list[tuple[int, float]] = []
        least_right = least_left = -NEVER
        while len(symbols) > 1:
            made = [joins.get(a * self.width + b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
            best = max(range(len(made)), key=lambda k: (self.score[made[k]] if made[k] >= 0 else NEVER, -k))
            if made[best] < 0:
                return None
            score = float(self.score[made[best]])
            least_right, least_left = min(least_right, score), min(least_left, score)
            if best == len(made) - 1:
                right.append((symbols[-1], least_right))
                least_right = -NEVER
            if best == 0:
                left.append((symbols[0], least_left))
                least_left = -NEVER
            symbols = [*symbols[:best], made[best], *symbols[best + 2 :]]
        return ([*right, (token, NEVER)], [*left, (token, NEVER)]) if symbols == [token] else None

    def _flat(self, edges: dict[int, list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each token's edge, and symbols and scores of all edges."""
        sizes = np.array([len(edges.get(i, ())) for i in range(self.width)])
        rows = [x for i in range(self.width) for x in edges.get(i, ())]
        return np.cumsum(sizes) - sizes, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])

    def _tested(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair stay apart when their joint text is merged."""
        good = np.ones(len(a), bool)
        rows, i, j = np.arange(len(a)), self.right[0][a], self.left[0][b]
        while len(rows):
            until_x, until_y = self.right[2][i], self.left[2][j]
            keys = self.right[1][i] * self.width + self.left[1][j]
            at = np.minimum(np.searchsorted(self.join_keys, keys), len(self.join_keys) - 1)
            score = np.where(self.join_keys[at] == keys, self.join_score[at], NEVER)
            crossed = (score > until_x) & (score >= until_y)
            good[rows[crossed]] = False
            first = until_x >= until_y
            going = ~crossed & ~(first & (until_x == NEVER))
            rows, i, j = rows[going], (i + first)[going], (j + ~first)[going]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same, by a table of the pairs tested last."""
        keys = a.astype(np.int64) * self.width + b
        slot = (keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(40) & np.int64(PAIRS - 1)
        good = self.pair_good[slot]
        new = np.flatnonzero(self.pair_key[slot] != keys)
        if len(new):
            unique, back = np.unique(keys[new], return_inverse=True)
            tested = self._tested(unique // self.width, unique % self.width)[back]
            good[new] = tested
            # of several pairs for one slot the last stays, with its own result
            self.pair_key[slot[new]] = keys[new]
            kept = self.pair_key[slot[new]] == keys[new]
            self.pair_good[slot[new][kept]] = tested[kept]
        return good

    # -- the table of prefixes ---------------------------------------------------------------------------------------
    def _rows(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row of bytes, one after another, and their numbers; all prefixes of one length at a time."""
        n, most = len(start), int(size.max())
        last = np.full((n, most + 1), -1, np.int32)  # the last token of the prefix of each length
        last[:, 0] = self.width
        state = np.zeros(n, np.int32)
        order = np.argsort(-size, kind="stable")
        for end in range(1, most + 1):
            rows = order[: np.searchsorted(-size[order], -end, side="right")]
            state[rows] = self.next[state[rows], data[start[rows] + end - 1]]
            where = self.hit[state[rows]]
            while len(rows):
                rows, where = rows[where > 0], where[where > 0]
                token = self.token[where]
                before = last[rows, end - self.size[token]]
                good = before == self.width
                tested = np.flatnonzero((before >= 0) & ~good)
                good[tested] = self.compatible(before[tested], token[tested])
                last[rows[good], end] = token[good]
                rows, where = rows[~good], self.shorter[where[~good]]
        found = np.full((n, most), -1, np.int32)
        rows, at = np.arange(n), size.copy()
        while len(rows):
            token = last[rows, at]
            at = at - self.size[token]
            found[rows, at] = token
            rows, at = rows[at > 0], at[at > 0]
        return found[found >= 0], (found >= 0).sum(1)

    def _long(self, data: bytes) -> np.ndarray:
        """Ids of one long row."""
        last, state = np.full(len(data) + 1, -1, np.int32), 0
        last[0] = self.width
        slot: dict[tuple[int, int], bool] = {}
        for end, byte in enumerate(data, 1):
            state = self.next.item(state, byte)
            where = self.hit.item(state)
            while where:
                token = self.token.item(where)
                before = last.item(end - self.size.item(token))
                if before >= 0 and before != self.width and (before, token) not in slot:
                    if len(slot) >= PAIRS:
                        slot.clear()
                    slot[before, token] = bool(self._tested(np.array([before]), np.array([token]))[0])
                if before == self.width or before >= 0 and slot[before, token]:
                    last[end] = token
                    break
                where = self.shorter.item(where)
        ids, at = [], len(data)
        while at:
            ids.append(last.item(at))
            at -= self.size.item(ids[-1])
        return np.array(ids[::-1], np.int32)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after another, and their bounds."""
        data, at = _joined([p.encode() for p in parts])
        start, size = at[:-1], np.diff(at)
        known = np.array([p[-1] in self.known for p in parts], bool)
        counts = np.zeros(len(parts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        least = 0
        for most in (4, 8, 12, 16, 24, 32, LONG):
            own = np.flatnonzero(known & (size > least) & (size <= most))
            least = most
            if len(own):
                ids, counts[own] = self._rows(data, start[own], size[own])
                found.append((own, ids))
        for w in np.flatnonzero(~known | (size > LONG)).tolist():
            whole = data[start[w] : at[w + 1]]
            ids = self._long(whole.tobytes()) if known[w] else self.byte_ids[whole]
            counts[w] = len(ids)
            found.append((np.array([w]), ids))
        to = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(to[-1], np.int32)
        for own, ids in found:
            each = counts[own]
            flat[np.arange(len(ids)) + np.repeat(to[own] - (np.cumsum(each) - each), each)] = ids
        return flat, to

    @functools.cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.byte[b] for b in range(256)], np.int32)

    # -- texts -------------------------------------------------------------------------------------------------------
    def encode_texts(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes, bytes]]]:
        """For each text its parts' ids, decimal ids with a comma behind each, and what they stand for."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK_CHARS):
                size += len(texts[end])
                end += 1
            cut = [self.cut.findall((SPACE if self.dummy else "") + t.replace(" ", SPACE)) if t else [] for t in texts[begin:end]]
            if len(self.parts) > KEPT_PARTS:
                self.parts.clear()
            get = self.parts.get
            rows = [list(map(get, parts)) for parts in cut]
            new = list(dict.fromkeys([p for parts, found in zip(cut, rows, strict=True) if None in found for p, r in zip(parts, found, strict=True) if r is None]))
            ids, to = self.encode_parts(new)
            decimal, decimal_to = ragged(self.decimal_flat, self.decimal_at, ids)
            spoken, spoken_to = ragged(self.spoken_flat, self.spoken_at, ids)
            columns = []
            for flat, at in ((ids.astype("<i4"), to), (decimal, decimal_to[to]), (spoken, spoken_to[to])):
                data, at = flat.tobytes(), (at * flat.itemsize).tolist()
                columns.append([data[a:b] for a, b in zip(at, at[1:], strict=False)])
            self.parts.update(zip(new, zip(*columns, strict=True), strict=True))
            for parts, found in zip(cut, rows, strict=True):
                yield [r or get(p) for p, r in zip(parts, found, strict=True)] if None in found else found
            begin = end

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of tokens, the hash of the ids and the hash of the decoded text."""
        for rows in self.encode_texts(texts):
            size, ids, spoken = (b"".join(x) for x in zip(*rows, strict=True)) if rows else (b"", b"", b"")
            # what is spoken is a valid text here, as its bytes stand for whole characters
            spoken = spoken[1:] if self.dummy and spoken[:1] == b" " else spoken
            yield len(size) // 4, hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(spoken).hexdigest()

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        for rows in self.encode_texts(texts):
            yield np.frombuffer(b"".join([r[0] for r in rows]), "<i4")

    def decode_ids(self, ids: list[int]) -> str:
        """The text of any ids: bytes that make no character give a replacement sign each, control pieces nothing."""
        out: list[bytes] = []
        run: list[int] = []
        begun = False
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(self.spoken[i][0])
                begun = True
                continue
            if run:
                out.append(_characters(bytes(run)))
                run = []
            spoken = self.spoken[i]
            if not begun and self.kind[i] == NORMAL and self.dummy and spoken[:1] == b" ":
                spoken, begun = spoken[1:], True
            begun = begun or bool(spoken)
            out.append(spoken)
        if run:
            out.append(_characters(bytes(run)))
        return b"".join(out).decode()


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' bytes, one after another, and their bounds."""
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _characters(data: bytes) -> bytes:
    """Bytes with a replacement sign for each that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                data[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(data[at : at + size])
            break
        else:
            out.append("�".encode())
            size = 1
        at += size
    return b"".join(out)


@functools.lru_cache(2)
def load(path: str) -> PieceModel:
    """One model for each file and worker."""
    return PieceModel(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array of token ids of every whole text (null: empty) as column ``ids``."""

    def make(column: pa.Array) -> list[pa.Array]:
        got = list(load(path).ids(_texts(column)))
        at = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))]

    return _append(df, text, [T.StructField(ids, IDS.dataType)], make)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of every array of ids."""

    def make(column: pa.Array) -> list[pa.Array]:
        own = load(path)
        rows = [[x for x in i or () if x is not None and 0 <= x < own.width] for i in column.to_pylist()]
        return [pa.array([own.decode_ids(i) for i in rows], pa.string())]

    return _append(df, ids, [T.StructField(decoded, T.StringType())], make)


def digest(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode, decode, and keep the number of ids and the hashes of ids (decimal, joined by commas) and decoded text."""

    def make(column: pa.Array) -> list[pa.Array]:
        rows = list(load(path).digests(_texts(column)))
        n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]

    return _append(df, text, DIGEST, make)
