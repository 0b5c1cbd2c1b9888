"""Language-model scores with a probabilistic suffix tree over words, beside an add-one unigram model.

The tree's states are the contexts of one and of two words before a token (the start of a text is a word, too) that occur
LEAST times or more in the training texts and diverge: count times Kullback-Leibler divergence of the next-word
distribution from that of the longest retained suffix reaches GAIN. These are absolute numbers over the whole vocabulary,
so the tree grows with the corpus. A token is scored in the longest retained suffix of its context: a state's distribution
over all words is smoothed towards its suffix state's with the weight of NOVELTY counts for each different word that
follows the state (Witten and Bell), and the root is add-one smoothed.

Counts of words are exact, and those of grams are sums over all training texts by shortened hashes (see below), so scores don't
depend on how the rows are dealt out:

1. Texts are packed into chunks, which are staged. Words are counted; what is collected of them is the frequent ones only,
   of which there are at most 1 / FREQUENT, whatever the corpus.
2. Every chunk asks buckets for its different words, and for its different grams (the token and two words before it), with
   their counts in the chunk. A gram goes to the bucket of the word before the token, where that word's whole subtree is
   built, and the counts that make the gram's probability go back. A word of a share of HOT or more is no bucket: a gram after
   it goes to the bucket of both words before the token, the counts of pairs with the token to buckets of pairs, and its
   few sums are added up over all buckets; two-word contexts that end in such a word are tested against the root.
3. Every chunk takes its answers and scores its texts.

A gram's words are known by 28 (the nearest, within a bucket), 16 and 20 bits of their hashes, pairs by 48, words by 64
bits. Grams that are equal in these bits share their counts, so the score is that of a tree over such classes of words, not
over words. Counts of words, and so the base score, take no account of grams.

Defined results: a null or blank text has one token, the end; without training texts the scores are those of the smoothing
alone; repeated rows and ids, and null ids, are scored as rows of their own; whole texts are used; an empty table gives an
empty one; further columns are not passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm import spans
from evidentia.llm.staging import discard, stage
from evidentia.llm.toxicity import _find

#: Least count of a state's context, and least count times divergence (natural log).
LEAST = 2
GAIN = 6.0
#: Weight of the suffix state's distribution, in counts for each different word that follows a state.
NOVELTY = 1.0
#: Least shares of the training tokens of words whose probability is known everywhere, and of words that are no bucket.
FREQUENT = 1e-5
HOT = 1e-3
#: Bytes of text and documents of a chunk, about; words or grams of a bucket, about.
CHUNK = 6_000_000
CHUNK_DOCS = 65_535
BUCKET = 1_500_000
#: Stand for the end and the start of a text among hashes of words.
END = np.uint64(0x5EED0F7E11)
START = np.uint64(0x57A27)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
#: Kinds of what is asked: words, pairs after hot words, grams, grams after hot words.
WORD, PAIR, GRAM, HOT_GRAM = range(4)
#: Step of the coded log-probabilities of frequent words; the code of all others.
STEP, RARE = 20, 255


def tokens(block: spans.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts of a block, each text's end included, and the number of tokens of each text."""
    hashes = block.hashes()
    return np.insert(hashes, block.words_to, END), np.diff(block.words_to, prepend=0) + 1


def packed(docs: DataFrame) -> DataFrame:
    """Chunks (chunk, text, ends, ids, flags) of the rows (doc_id, text, train): texts are joined and compressed."""
    id_type = docs.schema["doc_id"].dataType
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(to_arrow_type(id_type)), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            data, ends = spans._raw(b.column(1))
            row = 0
            while row < len(ends):
                begin = int(ends[row - 1]) if row else 0
                last = min(max(row + 1, int(np.searchsorted(ends, begin + CHUNK, side="right"))), row + CHUNK_DOCS)
                text = pa.compress(data[begin : int(ends[last - 1])].tobytes(), "zstd", asbytes=True)
                values = [chunk, text, (ends[row:last] - begin).astype("<i8").tobytes(), b.column(0)[row:last].to_pylist(), b.column(2)[row:last].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["chunk", "text", "ends", "ids", "flags"])
                row, chunk = last, chunk + 1

    return docs.mapInArrow(run, f"chunk long, text binary, ends binary, ids array<{id_type.simpleString()}>, flags array<boolean>")


def read(text: bytes, ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a chunk, and the number of tokens of each text."""
    to = np.frombuffer(ends, "<i8")
    data = pa.decompress(text, int(to[-1]), "zstd")
    column = pa.LargeStringArray.from_buffers(len(to), pa.py_buffer(np.concatenate([[0], to]).astype("<i8")), data)
    found = [tokens(b) for b in spans.blocks(column)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights, len(unique)).astype(np.int64)


def count_words(chunks: DataFrame) -> DataFrame:
    """(word, n): the training tokens by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, ends, flags in zip(b.column(0), b.column(1), b.column(2), strict=True):
                token, size = read(text.as_buffer(), ends.as_buffer())
                word, n = np.unique(token[np.repeat(np.array(flags.as_py(), bool), size)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    return chunks.select("text", "ends", "flags").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Numbers of tokens and of different words, and the frequent words (sorted hashes) with their counts."""

    total: int
    kinds: int
    word: np.ndarray
    n: np.ndarray

    def __post_init__(self) -> None:
        rest = max(1, self.total - int(self.n.sum())) / max(1, self.kinds - len(self.word)) / max(1, self.total)
        codes = np.round(-STEP * np.log(np.maximum(self.n, 1) / max(1, self.total)))
        self.code = np.minimum(codes, RARE - 1).astype(np.uint8)
        self.log_p = -np.arange(256) / STEP
        self.log_p[RARE] = min(math.log(rest), 0.0)
        hot = self.n >= HOT * self.total
        word = np.where(self.word == END, START, self.word)[hot]  # as many starts as ends, and no end is a context
        order = np.argsort(word)
        self.hot, self.hot_n = word[order], self.n[hot][order]

    def codes(self, word: np.ndarray) -> np.ndarray:
        at = _find(self.word, word)
        return np.where(at >= 0, self.code[at] if len(self.code) else 0, RARE).astype(np.uint8)


@dataclass
class Asked:
    """Different things of one kind that a chunk asks for, in order of bucket: where each bucket begins, and which of them each place is."""

    key: np.ndarray
    cut: np.ndarray
    places: np.ndarray
    first: np.ndarray  # a place of each
    inverse: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, key: np.ndarray, route: np.ndarray, buckets: int) -> Asked:
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        bucket = ((route[first] & _LOW) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return cls(key[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), places, places[first[order]], rank[inverse])


def _fold(near: np.ndarray, far: np.ndarray, token: np.ndarray) -> np.ndarray:
    """28 bits of the nearest word, 16 of the one before it, 20 of the token."""
    return near >> np.uint64(36) << np.uint64(36) | (far >> np.uint64(16) & np.uint64(0xFFFF)) << np.uint64(20) | token & np.uint64(0xFFFFF)


@dataclass
class Contexts:
    """The tokens of a chunk, the two words before each, and the place of the nearer one among the hot words, or -1."""

    token: np.ndarray
    near: np.ndarray
    far: np.ndarray
    hot: np.ndarray

    @classmethod
    def of(cls, token: np.ndarray, size: np.ndarray, hot: np.ndarray) -> Contexts:
        at = np.cumsum(size) - size
        near, far = np.concatenate([[START], token[:-1]]), np.concatenate([[START, START], token[:-2]])[: len(token)]
        near[at] = far[at] = START
        far[at[size > 1] + 1] = START
        return cls(token, near, far, _find(hot, near).astype(np.int32))

    def asked(self, kind: int, buckets: int) -> Asked:
        """What a chunk asks for, of one kind."""
        if kind == WORD:
            return Asked.of(np.arange(len(self.token)), self.token, self.token, buckets)
        at = np.flatnonzero((self.hot < 0) == (kind == GRAM))
        near, far, token = self.near[at], self.far[at], self.token[at]
        if kind == PAIR:  # 16 bits of the hot word's place, 48 of the token; the place is read from the key again
            return Asked.of(at, self.hot[at].astype(np.uint64) << np.uint64(48) | token >> np.uint64(16), spans.mix(near * _ODD + token), buckets)
        if kind == GRAM:
            return Asked.of(at, _fold(near, far, token), near, buckets)
        both = spans.mix(near * _ODD + far)
        return Asked.of(at, _fold(both, np.zeros_like(both), token), both, buckets)


def squeezed(x: np.ndarray, ascending: bool = False) -> bytes:
    """A column of numbers by planes of bytes, compressed; ascending ones by their differences."""
    x = np.diff(x, prepend=x.dtype.type(0)) if ascending else x
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def loosened(data: pa.Buffer, dtype: str, ascending: bool = False) -> np.ndarray:
    n, wide = int.from_bytes(data[:8].to_pybytes(), "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * wide, "zstd"), np.uint8).reshape(wide, n)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=dtype) if ascending else x


def ask(chunks: DataFrame, vocabulary: Vocabulary, buckets: list[int]) -> DataFrame:
    """(kind, bucket, chunk, key, n, code): squeezed keys of each chunk with their counts in its training texts."""
    shared = chunks.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for chunk, text, ends, flags in zip(*b.columns, strict=True):
                token, size = read(text.as_buffer(), ends.as_buffer())
                use = np.repeat(np.array(flags.as_py(), bool), size)
                contexts = Contexts.of(token, size, own.hot)
                for kind in (WORD, PAIR, GRAM, HOT_GRAM):
                    a = contexts.asked(kind, buckets[kind])
                    n = np.bincount(a.inverse, use[a.places], len(a.key)).astype("<u4")
                    code = own.codes(token[a.first]) if kind != WORD else np.zeros(len(n), np.uint8)
                    has = np.flatnonzero(np.diff(a.cut)).tolist()
                    parts = [slice(a.cut[k], a.cut[k + 1]) for k in has]
                    made = [[squeezed(a.key[s], True) for s in parts], [squeezed(n[s]) for s in parts], [squeezed(code[s]) for s in parts]]
                    numbers = [pa.array([kind] * len(has), pa.int32()), pa.array(has, pa.int64()), pa.array([chunk.as_py()] * len(has), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*numbers, *(pa.array(m, pa.binary()) for m in made)], ["kind", "bucket", "chunk", "key", "n", "code"])

    return chunks.select("chunk", "text", "ends", "flags").mapInArrow(run, "kind int, bucket long, chunk long, key binary, n binary, code binary")


def _states(state: np.ndarray, count: np.ndarray, log_lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each next word (sorted by ``state``) the count of its state and how many different words follow it, 0 if the state isn't retained."""
    begin = np.flatnonzero(np.append(True, state[1:] != state[:-1]))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(state))))
    n = np.add.reduceat(count, begin)
    gain = np.add.reduceat(count * (np.log(np.maximum(count, 1) / np.maximum(n[of], 1)) - log_lower), begin)
    kept = (n >= LEAST) & (gain >= GAIN)
    follow = np.add.reduceat((count > 0).astype(np.int64), begin)
    return np.where(kept, n, 0)[of], np.where(kept, follow, 0)[of]


def smoothed(count: np.ndarray, n: np.ndarray, follow: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability of a next word in a state, from that in its suffix state; where the state isn't retained, the latter."""
    return np.where(follow > 0, (count + NOVELTY * follow * lower) / np.maximum(n + NOVELTY * follow, 1), lower)


def subtree(key: np.ndarray, count: np.ndarray, log_root: np.ndarray, nearest: bool) -> np.ndarray:
    """For each gram (sorted keys) its count, that of its state, and different words that follow it: in the nearest word's
    state (unless ``nearest``), then in that of both words; zeros for a state that isn't retained."""
    out = []
    log_lower = log_root
    if not nearest:
        pair = key >> np.uint64(36) << np.uint64(20) | key & np.uint64(0xFFFFF)
        pair, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        of_pair = np.bincount(inverse, count, len(pair)).astype(np.int64)
        n, follow = _states(pair >> np.uint64(20), of_pair, log_root[first])
        out = [np.where(follow > 0, of_pair, 0)[inverse], n[inverse], follow[inverse]]
        log_lower = np.log(smoothed(*out, np.exp(log_root)))
    n, follow = _states(key >> np.uint64(20), count, log_lower)
    return np.stack([*out, np.where(follow > 0, count, 0), n, follow])


TOLD = "chunk long, kind int, bucket long, answer binary, hot long, n long, kinds long, gain double"


def tell(questions: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The answers to a chunk's questions, in their order: counts, or the numbers of ``subtree``; and sums (hot, n, kinds, gain) of the contexts of hot words."""
    shared = questions.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f.split()[0] for f in TOLD.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def answer(rows: pa.Table) -> pa.Table:
        own = shared.value
        kind, bucket = rows["kind"][0].as_py(), rows["bucket"][0].as_py()
        held = {c: [loosened(x.as_buffer(), t, c == "key") for x in rows[c]] for c, t in (("key", "<u8"), ("n", "<u4"), ("code", "u1"))}
        to = np.cumsum([0, *map(len, held["key"])])
        held = {c: np.concatenate(x) for c, x in held.items()}
        key, first, inverse = np.unique(held["key"], return_index=True, return_inverse=True)
        count = np.bincount(inverse, held["n"], len(key)).astype(np.int64)
        log_root = own.log_p[held["code"][first]]
        del held
        more: list[list] = [[], [], [], []]
        if kind in (WORD, PAIR):
            values = count[None]
            if kind == PAIR:
                seen = np.flatnonzero(count > 0)
                hot = (key[seen] >> np.uint64(48)).astype(np.int64)
                gain = count[seen] * (np.log(count[seen] / own.hot_n[hot]) - log_root[seen])
                which = np.flatnonzero(kinds := np.bincount(hot, minlength=len(own.hot)))
                more = [which, np.bincount(hot, count[seen], len(own.hot))[which].astype(np.int64), kinds[which], np.bincount(hot, gain, len(own.hot))[which]]
        else:
            values = subtree(key, count, log_root, kind == HOT_GRAM)
        m, k = rows.num_rows, len(more[0])
        answers = [squeezed(np.ascontiguousarray(values[:, inverse[to[i] : to[i + 1]]]).reshape(-1)) for i in range(m)]
        columns = [[*rows["chunk"].to_pylist(), *[None] * k], [kind] * (m + k), [bucket] * (m + k), [*answers, *[None] * k], *([*[None] * m, *(x.tolist() if k else [])] for x in more)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return questions.groupBy("kind", "bucket").applyInArrow(answer, TOLD)


def score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = stage(packed(docs), "chunks")
    words = stage(count_words(chunks), "words")
    whole = words.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    total, kinds = whole["n"] or 0, whole["kinds"]
    often = words.filter(F.col("n") >= FREQUENT * total).orderBy("word").toArrow()  # at most 1 / FREQUENT
    hashes = often["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    vocabulary = Vocabulary(total, kinds, hashes[order], often["n"].to_numpy()[order])
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = [max(8, math.ceil(n_bytes / share / BUCKET)) for share in (60, 30, 9, 20)]
    told = stage(tell(ask(chunks, vocabulary, buckets), vocabulary), "answers")
    hot_sums = {r["hot"]: r for r in told.filter("hot is not null").groupBy("hot").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain")).collect()}
    hot_n, hot_follow = (np.zeros(len(vocabulary.hot), np.int64) for _ in range(2))
    for k, r in hot_sums.items():
        if r["n"] >= LEAST and r["gain"] >= GAIN:
            hot_n[k], hot_follow[k] = r["n"], r["kinds"]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.hot)
    id_type = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [part(left.slice(i, 1), right) for i in range(left.num_rows)]
        return pa.concat_tables(made) if made else part_of([], *[np.zeros(0)] * 5)

    def part_of(ids: list, flags: np.ndarray, size: np.ndarray, known: np.ndarray, base: np.ndarray, model: np.ndarray) -> pa.Table:
        columns = [pa.array(ids, id_arrow), pa.array(~flags.astype(bool)), pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), total, np.int64)), pa.array(base.astype(float)), pa.array(model.astype(float))]
        return pa.table(columns, [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def part(row: pa.Table, answers: pa.Table) -> pa.Table:
        token, size = read(row["text"][0].as_buffer(), row["ends"][0].as_buffer())
        contexts = Contexts.of(token, size, shared.value)
        kind, bucket = answers["kind"].to_numpy(), answers["bucket"].to_numpy()

        def got(k: int, columns: int) -> np.ndarray:
            rows = np.flatnonzero(kind == k)
            rows = rows[np.argsort(bucket[rows])]
            return np.concatenate([np.zeros((columns, 0), np.int64), *(loosened(answers["answer"][i].as_buffer(), "<i8").reshape(columns, -1) for i in rows.tolist())], 1)

        count = got(WORD, 1)[0][contexts.asked(WORD, buckets[WORD]).inverse]
        root = (count + 1) / (total + kinds + 1)
        p = root.copy()
        a = contexts.asked(PAIR, buckets[PAIR])
        hot = contexts.hot[a.places]
        p[a.places] = smoothed(got(PAIR, 1)[0][a.inverse], hot_n[hot], hot_follow[hot], p[a.places])
        a = contexts.asked(GRAM, buckets[GRAM])
        c, n, follow, c2, n2, follow2 = got(GRAM, 6)
        p[a.places] = smoothed(c2[a.inverse], n2[a.inverse], follow2[a.inverse], smoothed(c[a.inverse], n[a.inverse], follow[a.inverse], p[a.places]))
        del c, n, follow, c2, n2, follow2
        a = contexts.asked(HOT_GRAM, buckets[HOT_GRAM])
        p[a.places] = smoothed(*(x[a.inverse] for x in got(HOT_GRAM, 3)), p[a.places])
        begin = np.cumsum(size) - size
        known, base, model = (np.add.reduceat(x, begin) for x in ((count > 0).astype(np.int64), np.log10(root), np.log10(p)))
        return part_of(row["ids"][0].as_py(), np.array(row["flags"][0].as_py(), bool), size, known, base, model)

    out = f"{key} {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = told.filter("chunk is not null").select("chunk", "kind", "bucket", "answer")
    discard(words)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, out)
