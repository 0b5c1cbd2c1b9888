"""BPE encoding and decoding: speculate and verify.

For the words of a block of texts, greedy longest match proposes tokens; a vectorised check then looks every adjacent pair
of proposed tokens up in the table of compatible pairs (two tokens are compatible if exact merging of their joint symbols
gives the two back). A sequence whose adjacent pairs are all compatible is the exact encoding, so only the words with a
failing pair undergo exact merging.

Defined results: a null text is an empty one, with no tokens; equal rows give equal results; empty tables give empty ones;
very long texts are processed whole, in blocks of words; further columns are passed on by ``encode`` and ``decode``
unless they bear an output column's name, in which case the output replaces them.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pairs whose compatibility a worker remembers; when there are more, it starts anew.
KEPT_PAIRS = 4_000_000
#: Bytes of a word from which it is merged by itself, with a heap.
LONG = 128
#: The rank of a pair that is no merge.
NONE = np.int32(2**31 - 1)
#: Characters of text whose unknown words are encoded together.
BLOCK_CHARS = 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


@functools.cache
def ranges() -> dict[str, str]:
    """Ranges, as in a character class, of letters, numbers and white space by the standard library's Unicode tables.

    Signs that newer tables know and these don't count as unassigned, as the public library takes them.
    """
    found: dict[str, list[list[int]]] = {"L": [], "N": [], "s": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        kind = "s" if kind == "Z" or 9 <= c <= 13 or c == 0x85 else kind
        if kind in found:
            runs = found[kind]
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) for k, runs in found.items()}


def ragged(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a ragged array (row k: ``flat[at[k]:at[k+1]]``) one after another, and their bounds."""
    sizes = np.diff(at)[rows]
    to = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(to[-1]) + np.repeat(at[:-1][rows] - to[:-1], sizes)
    return flat[index], to


class WordBpe:
    """A tokenizer with word ends, read from the JSON file of a public vocabulary.

    The file's normaliser (NFC, runs of white space to one space, lower case), its pattern of word pieces and its added
    tokens, which are cut out of the raw text first, are followed. Base symbols are numbered: byte b is b within a word
    and 256 + b at its end.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.width = 1 + max(self.text)
        splits = [s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        signs = ranges()
        self.pieces = re.compile(splits[0].replace(r"\s", signs["s"]).replace(r"\p{L}", signs["L"]).replace(r"\p{N}", signs["N"]))
        self.space = re.compile(f"[{signs['s']}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        keys = np.array([self.vocab[x] * self.width + self.vocab[y] for x, y in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.joined = np.array([self.vocab["".join(m)] for m in merges], np.int32)
        sign = byte_symbols()
        self.base = np.array([self.vocab[c] for c in sign] + [self.vocab[c + end] for c in sign], np.int32)
        self._trie({c: b for b, c in enumerate(sign)}, end)
        size = np.array([len(self.text.get(i, "").encode()) + 1 for i in range(self.width)])
        self.spelt_at = np.concatenate([[0], np.cumsum(size)])
        self.spelt = np.frombuffer("".join([self.text.get(i, "") + " " for i in range(self.width)]).encode(), np.uint8)
        self.pairs = (np.zeros(0, np.int64), np.zeros(0, bool))

    def _trie(self, byte_of: dict[str, int], end: str) -> None:
        """Edges (node * 512 + base symbol) of the trie of all tokens, and each token's base symbols."""
        edges: dict[int, int] = {}
        token = [-1]
        self.symbols: dict[int, list[int]] = {}
        for t, i in self.vocab.items():
            last = t.endswith(end) and len(t) > len(end)
            own = [byte_of[c] for c in (t[: -len(end)] if last else t)]
            own[-1] += 256 * last
            self.symbols[i] = own
            node = 0
            for c in own:
                node = edges.setdefault(node * 512 + c, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edge.tolist()], np.int32)
        self.token = np.array(token, np.int32)

    # -- exact merging -------------------------------------------------------------------------------------------
    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE where it is no merge."""
        keys = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def merge(self, m: np.ndarray) -> np.ndarray:
        """Merge each row (tokens, then -1) exactly: the pair of the lowest rank first, the leftmost of equal ones."""
        m = m.copy()
        ranks = self._ranks(m[:, :-1], m[:, 1:])
        rows = np.arange(len(m))
        column = np.arange(m.shape[1])
        while len(rows):
            low = ranks[rows].argmin(1)
            best = ranks[rows, low]
            rows, low, best = rows[best < NONE], low[best < NONE], best[best < NONE]
            if not len(rows):
                break
            own = m[rows]
            own[np.arange(len(rows)), low] = self.joined[best]
            shift = column + (column > low[:, None])
            own = np.take_along_axis(np.pad(own, ((0, 0), (0, 1)), constant_values=-1), shift, 1)
            m[rows] = own
            new = np.take_along_axis(np.pad(ranks[rows], ((0, 0), (0, 1)), constant_values=NONE), shift[:, :-1], 1)
            k = np.arange(len(rows))
            new[k, np.minimum(low, new.shape[1] - 1)] = self._ranks(own[k, low], own[k, np.minimum(low + 1, m.shape[1] - 1)])
            new[k[low == m.shape[1] - 1], -1] = NONE
            has = low > 0
            new[k[has], low[has] - 1] = self._ranks(own[k[has], low[has] - 1], own[k[has], low[has]])
            ranks[rows] = new
        return m

    def merge_long(self, tokens: list[int]) -> list[int]:
        """The same for one long word: a heap of pairs over a linked list."""
        rank = dict(zip(self.keys.tolist(), self.rank.tolist(), strict=True)) if not hasattr(self, "_rank") else self._rank
        self._rank = rank
        n, w = len(tokens), self.width
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(tokens[i] * w + tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j < 0 or rank.get(tokens[i] * w + tokens[j]) != r:
                continue
            tokens[i], tokens[j] = int(self.joined[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := rank.get(tokens[x] * w + tokens[after[x]])) is not None:
                    heapq.heappush(heap, (r, x))
        return [t for t in tokens if t >= 0]

    # -- speculation and verification ------------------------------------------------------------------------------
    def greedy(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Longest match from the left for all rows at once, through the trie; every base symbol is a token."""
        out = np.full(symbols.shape, -1, np.int32)
        rows = np.arange(len(symbols))
        at, node, best, to, made = (np.zeros(len(rows), np.int32) for _ in range(5))
        while len(rows):
            keys = node.astype(np.int64) * 512 + symbols[rows, np.minimum(at, symbols.shape[1] - 1)]
            edge = np.minimum(np.searchsorted(self.edge, keys), len(self.edge) - 1)
            goes = (self.edge[edge] == keys) & (at < sizes[rows])
            node = np.where(goes, self.child[edge], 0)
            at = at + goes
            token = self.token[node]
            hit = goes & (token >= 0)
            best, to = np.where(hit, token, best), np.where(hit, at, to)
            stop = np.flatnonzero(~goes)
            out[rows[stop], made[stop]] = best[stop]
            made[stop] += 1
            at[stop] = to[stop]
            open_ = ~(~goes & (at >= sizes[rows]))
            rows, at, node, best, to, made = (x[open_] for x in (rows, at, node, best, to, made))
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether exact merging of two tokens' joint symbols gives the two back; the second may be missing (-1)."""
        a, b = pairs // self.width, pairs % self.width - 1
        own = [self.symbols[x] + (self.symbols[y] if y >= 0 else []) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        m = np.full((len(own), max([2, *map(len, own)])), -1, np.int32)
        for k, o in enumerate(own):
            m[k, : len(o)] = self.base[o]
        m = self.merge(m)
        return (m[:, 0] == a) & (m[:, 1] == b) & (m[:, 2:] < 0).all(1)

    def _rows(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each row of base symbols (then -1)."""
        tokens = self.greedy(symbols, sizes)
        single = tokens[:, 1] < 0
        keys = tokens[:, :-1].astype(np.int64) * self.width + tokens[:, 1:] + 1
        tested = (tokens[:, 1:] >= 0) | (single[:, None] & (np.arange(keys.shape[1]) == 0))
        seen = np.unique(keys[tested])
        known, good = self.pairs
        at = np.searchsorted(known, seen)
        new = seen[known[np.minimum(at, len(known) - 1)] != seen] if len(known) else seen
        if len(new):
            if len(known) > KEPT_PAIRS:
                known, good, new = known[:0], good[:0], seen
            known, good = np.concatenate([known, new]), np.concatenate([good, self.compatible(new)])
            order = np.argsort(known)
            self.pairs = known, good = known[order], good[order]
        bad = np.zeros(keys.shape, bool)
        bad[tested] = ~good[np.searchsorted(known, keys[tested])]
        failed = np.flatnonzero(bad.any(1))
        if len(failed):
            tokens[failed] = self.merge(np.where(symbols[failed] >= 0, self.base[symbols[failed]], -1))
        return tokens

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (not empty, without white space), one after another, and their bounds."""
        data = np.frombuffer("\n".join(words).encode() + b"\n", np.uint8)
        stop = np.flatnonzero(data == 10)
        start = np.concatenate([[0], stop[:-1] + 1])
        size = stop - start
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        least = 0
        for most in (4, 8, 12, 16, 24, 32, 64, LONG):
            own = np.flatnonzero((size > least) & (size <= most))
            least = most
            if not len(own):
                continue
            at = start[own][:, None] + np.arange(most)
            symbols = np.where(np.arange(most) < size[own][:, None], data[np.minimum(at, len(data) - 1)].astype(np.int32), -1)
            symbols[np.arange(len(own)), size[own] - 1] += 256
            tokens = self._rows(symbols, size[own])
            counts[own] = (tokens >= 0).sum(1)
            found.append((own, tokens))
        long = {}
        for w in np.flatnonzero(size > LONG).tolist():
            symbols = data[start[w] : stop[w]].astype(np.int32)
            symbols[-1] += 256
            long[w] = self.merge_long(self.base[symbols].tolist())
            counts[w] = len(long[w])
        to = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(to[-1], np.int32)
        for own, tokens in found:
            row, column = np.nonzero(tokens >= 0)
            flat[to[own][row] + column] = tokens[row, column]
        for w, tokens in long.items():
            flat[to[w] : to[w + 1]] = tokens
        return flat, to

    # -- texts -------------------------------------------------------------------------------------------------------
    def normalise(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case is taken sign by sign, without the rule of final sigma
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Runs without white space of the normalised text."""
        text = self.normalise(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() cuts there, the pattern's white space does not
            return [c for c in self.space.split(text) if c]
        return text.split()

    def parts(self, text: str) -> list[str | int]:
        """Chunks, and the ids of added tokens."""
        if self.cut is None or "<|" not in text or len(cut := self.cut.split(text)) == 1:
            return self.chunks(text)
        return [p for k, c in enumerate(cut) for p in ([self.added[c]] if k % 2 else self.chunks(c))]

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their bounds. Each different chunk and piece is encoded once."""
        number: dict[str | int, int] = {}
        put = number.setdefault
        uses: list[int] = []
        ends = [0]
        for t in texts:
            uses.extend([put(c, len(number)) for c in self.parts(t)])
            ends.append(len(uses))
        piece: dict[str | int, int] = {}
        put = piece.setdefault
        own: list[int] = []
        own_to = [0]
        find = self.pieces.findall
        for c in number:
            if isinstance(c, int) or c.isalpha():
                own.append(put(c, len(piece)))
            else:
                own.extend([put(p, len(piece)) for p in find(c)])
            own_to.append(len(own))
        words = [p for p in piece if isinstance(p, str)]
        flat, to = self.encode_words(words) if words else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        if len(words) < len(piece):  # each added token is a row of its own
            added = [p for p in piece if not isinstance(p, str)]
            flat, to = np.concatenate([flat, np.array(added, np.int32)]), np.concatenate([to, to[-1] + 1 + np.arange(len(added))])
            row = dict(zip([*words, *added], range(len(piece)), strict=True))
            places = [row[p] for p in piece]
            own = [places[i] for i in own]
        ids, at = ragged(flat, to, np.array(own, np.int64))
        ids, at = ragged(ids, at[np.array(own_to)], np.array(uses, np.int64))
        return ids, at[np.array(ends)]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, int]]:
        """For each text: ids as little-endian unsigned 32-bit integers, the decoded text in UTF-8, the number of ids."""
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK_CHARS):
                size += len(texts[end])
                end += 1
            ids, at = self.encode_block(texts[begin:end])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[a:b].astype("<u4").tobytes(), self.decode_ids(ids[a:b]), b - a
            begin = end

    def decode_ids(self, ids: np.ndarray) -> bytes:
        """The file names no decoder: tokens joined by a space."""
        return ragged(self.spelt, self.spelt_at, ids)[0].tobytes()[:-1]


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    """One tokenizer for each file and worker."""
    return WordBpe(path)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _append(df: DataFrame, column: str, fields: list[T.StructField], make) -> DataFrame:
    """``df`` without columns named as a new field, and the fields that ``make(pa.Array)`` yields."""
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = make(b.column(b.schema.names.index(column)))
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.names.index(f.name)) for f in kept] + made, [f.name for f in kept] + [f.name for f in fields]
            )

    return df.mapInArrow(run, T.StructType(kept + fields))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array of token ids of every whole text (null: empty) as column ``ids``."""

    def make(column: pa.Array) -> list[pa.Array]:
        got = [np.frombuffer(i, "<u4").astype(np.int32) for i, _, _ in load(path).encode_texts(_texts(column))]
        at = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))]

    return _append(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of every array of ids (null: empty; ids that the vocabulary lacks and nulls are left out)."""

    def make(column: pa.Array) -> list[pa.Array]:
        own = load(path)
        rows = [[x for x in i or () if x in own.text] for i in (r for r in column.to_pylist())]
        return [pa.array([own.decode_ids(np.array(i, np.int64)).decode() for i in rows], pa.string())]

    return _append(df, ids, [T.StructField(decoded, T.StringType())], make)


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DIGEST = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def digest(df: DataFrame, path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """Encode, decode, and keep the number of ids and the hashes of ids and decoded text; ids: and the ids."""

    def make(column: pa.Array) -> list[pa.Array]:
        n, a, d, kept = [], [], [], []
        for own, decoded, count in load(path).encode_texts(_texts(column)):
            n.append(count)
            a.append(hashlib.sha256(own).hexdigest())
            d.append(hashlib.sha256(decoded).hexdigest())
            kept.append(own if ids else b"")
        made = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
        if not ids:
            return made
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(kept), "<i4"))), *made]

    return _append(df, text, [IDS] * ids + DIGEST, make)


def encode_and_digest(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    return digest(df, path, text, ids=True)
