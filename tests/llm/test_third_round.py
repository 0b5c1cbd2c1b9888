"""Ranked search, conversation repair and merge-type pieces against plain versions."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.llm import dialogue, pieces, ranked
from evidentia.llm.catalog import op11_ranked, op12_dialogue, op13_pieces, vocabulary

MODEL = "piece_bpe_32k.model"


# -- pieces ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))


SIGNS = ["a", "e", "th", "in", " ", "  ", "▁", "the ", "\n", "\t", "é", "é", "日", "①", "\0", "<s>", "<0x41>", "😀", "ﬁ", "2024", "...", "====", "    ", "​", "　", "ени", "tion", "://", "{}"]


def test_pieces_follow_the_library(library):
    own, rnd = pieces.load(vocabulary(MODEL)), random.Random(11)
    texts = ["", " ", "  a", *(" " * n + "the" for n in range(40)), *("x" + " " * n for n in range(40))]
    texts += ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    for t, ids in zip(texts, own.ids(texts), strict=True):
        assert ids.tolist() == library.encode(t), t
        assert own.decode_ids(ids.tolist()) == library.decode(ids.tolist())
    for _ in range(2000):
        ids = [rnd.randrange(32_000) if rnd.random() < 0.5 else rnd.randrange(300) for _ in range(rnd.randrange(1, 6))]
        assert own.decode_ids(ids) == library.decode(ids), ids


def test_long_parts_and_the_table_of_pairs(library, monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aeihnorstu") for _ in range(n)) for n in (63, 64, 65, 500, 20_000)] + ["é" * 40 + "日本" * 50, "①" * 5_000]
    own = pieces.PieceModel(vocabulary(MODEL))
    monkeypatch.setattr(pieces, "KEPT_PARTS", 1)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 10)
    for _ in range(2):
        assert [x.tolist() for x in own.ids(texts)] == [library.encode(t) for t in texts]


def test_pieces_query_against_the_library(spark, sf_dir, library):
    found = {r.doc_id: r for r in op13_pieces(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "")
        own = found[r.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_round_trip_and_edges(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 8), (3, "a  b\n" * 3, 9), (3, "a  b\n" * 3, 9)], "doc_id long, text string, n_tokens int")
    out = pieces.decode(pieces.encode(df, vocabulary(MODEL)), vocabulary(MODEL))
    assert sorted((r.doc_id, r.decoded) for r in out.collect()) == [(1, ""), (2, ""), (3, "a  b\n" * 3), (3, "a  b\n" * 3)]
    digests = pieces.digest(df, vocabulary(MODEL))
    assert digests.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == 4
    assert pieces.digest(df.limit(0), vocabulary(MODEL)).count() == 0
    odd = spark.createDataFrame([([5, None, -1, 40_000, 1318],), (None,)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(odd, vocabulary(MODEL)).collect()] == ["\x02 x", ""]


# -- ranked search -----------------------------------------------------------------------------------------------------
def plain_search(docs, items, top=10):
    terms = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in terms(text).items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(heapq.nsmallest(top, rows))]
    return sorted(out, key=str)


@pytest.mark.parametrize("places, postings, terms", [(8192, 10**6, 10**6), (16, 40, 30)])
def test_ranked_search_against_a_plain_version(spark, monkeypatch, places, postings, terms):
    monkeypatch.setattr(ranked, "PLACES", places)
    monkeypatch.setattr(ranked, "POSTINGS", postings)
    monkeypatch.setattr(ranked, "TERMS", terms)
    monkeypatch.setattr(ranked, "STRETCH", 50)
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["É", "É́x", "a1", "B2b", "日本"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "--", "\0"]) for _ in range(n))
    docs = [(rnd.randrange(-50, 10**12), text(rnd.randrange(0, 60))) for _ in range(300)]
    docs += [(5, docs[0][1]), (5, docs[0][1]), (4, docs[0][1]), (None, docs[0][1]), (None, None), (77, None), (78, ""), (79, " .,"), (80, text(3000)), (81, "x" * 500)]
    items = [(k, text(rnd.randrange(1, 12))) for k in range(12)] + [(3, docs[0][1]), (None, "w1"), (40, None), (41, "nowhere"), (42, ""), (43, docs[0][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, number int").repartition(5)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = ranked.search(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_search(docs, items)


def test_ranked_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs, items).count() == 0
    assert ranked.search(items.select(F.col("item_id").alias("doc_id"), "text"), items.limit(0)).count() == 0


def test_ranked_query_asks_every_item(spark, sf_dir):
    got = op11_ranked(spark, sf_dir)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_search(docs, items)


# -- conversations ---------------------------------------------------------------------------------------------------------
PATTERN = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """All edit sequences with up to two insertions before each row and at the end; the cheapest, ASCII-least."""
    seen, forms = set(), []
    for role, text in rows:
        shown = text.rstrip(WHITE)
        forms.append("x" if not shown or (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    found = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    def go(k, cost, edits, roles, lines):
        nonlocal found
        if found and cost > found[0]:
            return
        for more in inserts:
            c, e, r = cost + 5 * len(more), edits + "I" * len(more), roles + "".join(more)
            ls = lines + [{"u": "user:", "a": "assistant:"}[m] for m in more]
            if k == len(rows):
                if PATTERN.fullmatch(r) and (found is None or (c, e) < found[:2]):
                    found = (c, e, "\n".join(ls))
                continue
            role, text = rows[k]
            go(k + 1, c + 2, e + "D", r, ls)
            if forms[k] != "x":
                extra = 5 * (forms[k] == "t")
                go(k + 1, c + extra, e + "K", r + (role[:1] or "?"), [*ls, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(k + 1, c + 1 + extra, e + "R", r + new[0], [*ls, f"{new}:{text}"])
    go(0, 0, "", "", [])
    return found


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if h == 0:
            continue
        role = "user" if h == 4 else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows, edits=plain_edits):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [(r[2], r[3]) for r in own]
        blank = [not t.strip(WHITE) for _, t in pairs]
        duplicate = [not b and p in pairs[:k] for k, (p, b) in enumerate(zip(pairs, blank, strict=True))]
        cut = [not b and not d and t.rstrip(WHITE)[-1] not in ".!?" for b, d, (_, t) in zip(blank, duplicate, pairs, strict=True)]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, lines = edits(pairs)
        gap = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gap, sum(blank), sum(duplicate), sum(cut), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def results(df):
    rows = [tuple(r) for r in df.collect()]
    found = {r[0]: r[1:] for r in rows}
    assert len(found) == len(rows)
    return found


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def made_rows(seed, n_conversations, most):
    rnd, rows = random.Random(seed), []
    for c in range(n_conversations):
        for t in range(rnd.randrange(1, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "Sys", None])
            text = rnd.choice(["Yes.", "No!", "Well", "", " \n", "Why? ", None, "é.", "A" * 70 + rnd.choice("xy.")])
            rows.append((c if c else None, rnd.choice([t, t * 2, 3, None]) if rnd.random() < 0.3 else t, role, text))
    return rows


def test_repair_against_all_edits(spark):
    rows = made_rows(5, 60, 6)
    df = spark.createDataFrame(rows, CONVERSATIONS)
    want = plain_repair(rows)
    assert results(dialogue.repair_all(dialogue.damage(df), df)) == want


def plain_dynamic(pairs):
    """Row by row without a trie; ties by the whole strings."""
    seen, states = set(), {0: (0, "")}
    def inserts(states):
        for _ in range(3):
            for s, (c, e) in list(states.items()):
                to = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                states[to] = min(states.get(to, (math.inf, "")), (c + 5, e + "I"))
        return states
    states = inserts(states)
    for role, text in pairs:
        shown, nexts = text.rstrip(WHITE), {}
        must = not shown or (role, text) in seen
        seen.add((role, text))
        for s, (c, e) in states.items():
            options = [(s, c + 2, "D")]
            if not must:
                extra = 5 * (shown[-1] not in ".!?")
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                options += [(to, c + extra, "K")] if to else []
                options += [({0: 2, 1: 2, 2: 3, 3: 2}[s], c + 1 + extra, "R")]
            for to, cost, letter in options:
                nexts[to] = min(nexts.get(to, (math.inf, "")), (cost, e + letter))
        states = inserts(nexts)
    cost, audit = min(states[s] for s in (0, 3) if s in states)
    lines, state, k = [], 0, 0
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        if letter == "K":
            state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}[state, pairs[k][0][:1]]
        else:
            state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        name = pairs[k][0] if letter == "K" else {2: "user", 3: "assistant"}[state]
        lines.append(f"{name}:" + ("" if letter == "I" else pairs[k][1]))
        k += letter != "I"
    return cost, audit, "\n".join(lines)


@pytest.mark.parametrize("rows_of_a_piece, chars", [(256, 1 << 20), (4, 1 << 20), (1, 1 << 20), (100, 60)])
def test_long_conversations_in_pieces(spark, monkeypatch, rows_of_a_piece, chars):
    monkeypatch.setattr(dialogue, "ROWS", rows_of_a_piece)
    monkeypatch.setattr(dialogue, "CHARS", chars)
    rnd = random.Random(9)
    rows = made_rows(17, 30, 12)
    for t in range(400):
        rows.append((1_000, t, rnd.choice(["user", "assistant"]), f"{rnd.choice('abc')} {rnd.randrange(150)}{rnd.choice('.!x')}"))
        rows.append((1_001, None if t % 7 == 0 else t, ("user", "assistant")[t % 2], f"line {t}."))
        rows.append((1_002, t, "system", ""))
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    assert results(dialogue.repair_all(dialogue.damage(df), df)) == plain_repair(rows, plain_dynamic)


def test_repair_query_over_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_dialogue(spark, sf_dir)
    assert [c for c, _ in got.dtypes] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert results(got) == plain_repair(rows, plain_dynamic)


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert dialogue.repair_all(dialogue.damage(df), df).count() == 0
    one = spark.createDataFrame([(1, 2)], "conv_id long, cost long")
    assert [tuple(r) for r in dialogue.repair_all(df, one).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_layers_are_shared():
    trie = dialogue.Trie()
    for s in sorted(["uaua", "uauA", "uax", "uaua"]):
        trie.layer(s)
    assert trie.n == 6


# -- the index of nearest neighbours, and the entry ------------------------------------------------------------------------
def test_the_index_finds_nine_of_ten(spark, monkeypatch):
    """10,000 vectors, of which a query reads a share only."""
    import numpy as np

    from evidentia.llm import nearest

    monkeypatch.setattr(nearest, "LEAST", 0)
    x = np.random.default_rng(2).normal(size=(10_000, 16)).astype(np.float32)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got: dict[int, set[int]] = {}
    for r in nearest.search(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wide, found = x.astype(np.float64), 0
    for q in range(0, 10_000, 100):
        d = ((wide - wide[q]) ** 2).sum(1)
        d[q] = np.inf
        found += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert found >= 0.9 * 1_000, found


def test_entry_without_the_vocabularies():
    """A machine without the package of vocabularies has all queries; only those that encode stop when they run."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'knn_topk' in q and 'op3_bpe' in q and 'pipeline' in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
