"""Spans, toxicity, language, quality and language-model scores against plain versions, and at their edges."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import catalog, language, quality, spans, suffixlm, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x" * 100_000), (6, "a b c " * 20_000), (None, "été\n\nété"), (7, "\u0000 \U0001f600 ß")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def frame(spark, rows=EDGES, more="score string, kept string, ids string, n string"):
    return spark.createDataFrame([(*r, *["z"] * 4) for r in rows], f"doc_id long, text string, {more}")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_spans():
    texts = [" Hello\tWORLD  ab", None, "", "a", "x y z w", "p q r s t u p q r s t", "Ünï \n\n", "end"]
    for most in (1, 10, 1 << 20):
        for b in spans.blocks(pa.array(texts), most):
            for i, s in enumerate(spans.shingle_sets(b)):
                want = WORD.findall(lower(texts[b.first + i]))
                at = b.words_to[i - 1] if i else 0
                assert [b.word(k).decode() for k in range(at, b.words_to[i])] == want
                assert len(s) == len({tuple(want[k : k + 5]) for k in range(max(1, len(want) - 4))} if want else ())


def noise(rnd, n, syllables):
    return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(n))


def toxic_rows(n=400):
    rnd = random.Random(1)
    rows, marks = [], []
    for i in range(n):
        words = noise(rnd, 60, ["the", "er", "on", "an", "re"]).split()
        if i % 4 == 0:
            for k in rnd.sample(range(60), 3):
                words[k] = "vek" + rnd.choice(["on", "er", "and", "re"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(i % 4 == 0)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = toxic_rows()
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), catalog.remainder(5) == 0
    model = toxicity.fit(docs, labels(spark, [*marks, (0, 1, None), (None, 1, 1), (1, 0, 0), (1, 0, 0)]), keep=~held)
    got = {r.doc_id: r.score for r in toxicity.score(docs.filter(held), model).collect()}
    assert sum((s >= 0.5) == (d % 4 == 0) for d, s in got.items()) >= 0.97 * len(got) > 60
    edge = toxicity.score(frame(spark), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.score <= 1 for r in edge)
    assert len({r.score for r in edge if r.doc_id == 4}) == 1


def test_toxicity_without_labels(spark):
    docs = frame(spark)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels(spark, [(4, 1, 1)]))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def plain_backoff(seen, gram):
    after = collections.Counter(s[1:] for s in seen if len(s) > 1)
    own = {h: c for h, c in after.items() if h[:-1] == gram[:-1]}
    lower = plain_backoff(set(after), gram[1:]) if len(gram) > 1 else 1 / 256
    n = sum(own.values())
    return (max(own.get(gram, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(own) * lower) / n if n else lower


def test_toxicity_is_plain_kneser_ney():
    """Evidence of words, with strings for grams and counters for tables."""
    rnd = random.Random(13)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(1, 8))) for _ in range(60)]
    t, o = ([rnd.choice([0, 0, 1, 2, 5]) for _ in words] for _ in range(2))

    def of(word):
        signs = f" {word} "
        return [signs[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(signs))]

    counts = [collections.Counter(), collections.Counter()]
    for w, *ns in zip(words, t, o, strict=True):
        for c, n in zip(counts, ns, strict=True):
            c.update({g: n * k for g, k in collections.Counter(of(w)).items()})
    seen = {g for c in counts for g, n in c.items() if n}

    def p(c, g):
        own = {h: n for h, n in c.items() if h[:-1] == g[:-1] and n}
        n = sum(own.values())
        lower = plain_backoff(seen, g[1:])
        return (max(own.get(g, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(own) * lower) / n if n else lower

    gram, _, owner = toxicity.grams([w.encode() for w in words])
    gram, a, b = toxicity._sums(gram, np.array(t, float)[owner], np.array(o, float)[owner])
    model = toxicity.Model.fit(gram, a, b)
    for w in [*words[:20], "abcdx", "zz", "dcbadcba"]:
        want = sum(math.log(p(counts[0], g)) - math.log(p(counts[1], g)) for g in of(w))
        assert model.evidence([w.encode()])[0] == pytest.approx(want, abs=1e-9)


def test_shared_backoff_sums_to_one():
    words = [b"abc", b"abd", b"xbc"]
    gram, _, _ = toxicity.grams(words)
    seen = np.unique(gram)
    for context in np.unique(seen >> np.uint64(8)):
        every = (context << np.uint64(8)) | np.arange(1, 257, dtype=np.uint64) % np.uint64(256)
        assert abs(toxicity.backoff(seen, np.sort(every)).sum() - 1) < 0.01


def test_language(spark):
    rnd = random.Random(2)
    kinds = {"aa": ["the", "er", "ing"], "bb": ["que", "ión", "os"], "cc": ["sch", "ung", "ver"]}
    rows = [(i, noise(rnd, 40, kinds[k]), k) for i, k in enumerate(sorted(kinds) * 40)]
    docs = spark.createDataFrame([*rows, (900, "the er", None)], "doc_id long, text string, lang string")
    model = language.fit(docs, keep=catalog.remainder(3) != 1)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs.drop("lang"), model).collect()}
    assert all(got[i] == k for i, _, k in rows) and got[900] == "aa"
    edge = {(r.doc_id, r.lang_pred, r.score) for r in language.predict(frame(spark, [*EDGES, (8, "123 !"), (9, "\u00b2 \u00bd \u2167")]), model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (8, "und", 0.0), (9, "und", 0.0)} <= edge
    assert language.predict(frame(spark).limit(0), model).count() == 0
    empty = language.predict(frame(spark), language.fit(docs.limit(0)))
    assert {r.lang_pred for r in empty.collect()} == {"und"}


def test_suffix_automaton_matches_substrings():
    text = "abcbcabc"
    table = language.suffix_automaton([ord(c) - 96 for c in text], 4)
    for n in range(1, 6):
        for s in {tuple(np.random.default_rng(n * 31 + k).integers(1, 4, n)) for k in range(40)}:
            state = 0
            for c in s:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == ("".join(chr(96 + c) for c in s) in text)


def plain_phrases(own, learnt):
    n = 0
    while own:
        k = 1
        while k < len(own) and own[: k + 1] in learnt:
            k += 1
        n, own = n + 1, own[k:]
    return n


@pytest.mark.parametrize("piece", [1, 2, 7, 256])
def test_phrases_are_the_longest_matches_across_words(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    rnd = random.Random(11)
    learnt = {k: noise(rnd, 80, s).encode() for k, s in {"aa": ["ta", "re"], "bb": ["ta", "ko"]}.items()}
    model = language.Model.fit(learnt)
    texts = [noise(rnd, rnd.randint(0, 120), ["ta", "re", "ko", "x\u00e9"]) for _ in range(30)] + [None, "", "z" * 700, learnt["aa"].decode() * 3]
    got = model.rates(pa.array(texts))
    for t, rates in zip(texts, got, strict=True):
        data = (t or "").encode() + b" "
        want = [plain_phrases(data, learnt[k]) * np.log2(len(learnt[k]) + 1) / len(data) for k in ("aa", "bb")]
        assert rates == pytest.approx(want)


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    times = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def plain_margin(text, weights):
    """The weighted shares of a text's n-grams, one n-gram after another."""
    data = text.encode() + b" "
    odd, mask = [int(x) for x in quality._ODD], 2**64 - 1
    mixed = lambda x: int(spans.mix(np.array([x & mask], np.uint64))[0])
    words = [int(h) for b in spans.blocks(pa.array([text]), lower=False) for h in b.hashes()]
    kinds = [[] for _ in range(quality.KINDS)]
    for i, c in enumerate(data):
        two, three = (data[i - k] if i >= k else 0x20 for k in (1, 2))
        kinds[0].append((c + 1) * odd[0])
        kinds[1].append((c << 8 | two) * odd[1] + odd[2])
        kinds[2].append(mixed(c << 16 | two << 8 | three))
    for i, w in enumerate(words):
        kinds[3].append(w * odd[3])
        kinds[4].append(mixed(w + (words[i - 1] if i else 0) * odd[4]))
        kinds[5].append((sum((words[i - k] == w) << k for k in (1, 2, 3) if i >= k) + 1) * odd[5])
    return sum(sum(float(weights[k][(x & mask) >> 64 - quality.BITS]) for x in own) / max(1, len(own)) for k, own in enumerate(kinds))


def test_quality_margins_are_the_plain_ones(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 50)
    rnd = random.Random(12)
    weights = np.random.default_rng(1).normal(size=(quality.KINDS, 1 << quality.BITS)).astype(np.float32)
    texts = [noise(rnd, rnd.randint(0, 40), ["ta", "re", "\u00e9", "X#"]) for _ in range(20)] + ["a a b a", "", "\u00e9t\u00e9\n\nx"] * 2
    got = quality.Model(weights).margins(pa.array(texts))
    assert got == pytest.approx([plain_margin(t, weights) for t in texts], abs=1e-4)
    assert got[-3:].tolist() == pytest.approx(got[-6:-3].tolist())


def test_quality(spark):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        words = noise(rnd, 80, ["the", "er", "on", "an"]).split()
        rows.append((i, " ".join(w + ("%%" if i % 3 == 0 else "") for w in words)))
        marks.append((i, int(i % 3 != 0), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, labels(spark, [*marks, (5, None, 0)]))
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert sum(got[i].kept == (i % 3 != 0) for i in got) >= 0.97 * len(got)
    texts = [*EDGES, (8, "a b a b a b\nl\nl\n\n\nl\r\n"), (9, "#*$%&|<> é")]
    for r in quality.judge(frame(spark, texts), model, prefix="q_").collect():
        assert [r[f"q_{c}"] for c in quality.COUNTS] == plain_counts(r.text)
        assert r.q_base_failed == (r.q_n_words < 50 or 100 * r.q_n_repeat_words > 50 * r.q_n_words) and r.kept == "z"
        assert not (r.q_base_failed and r.q_kept)
    assert quality.judge(docs.limit(0), quality.fit(docs, labels(spark, []))).count() == 0


def test_language_model(spark):
    rnd = random.Random(4)
    kinds = [[f"{a}{k}" for k in range(30)] for a in "xyz"]
    rows = [(i, " ".join(rnd.choices(kinds[i % 3], k=rnd.randint(0, 90)))) for i in range(300)]
    rows += [*[e for e in EDGES if e[0] != 6], (5, "The THE the")]
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    got = suffixlm.score(docs, catalog.remainder(7) != 2).collect()
    words = {}
    count, n = collections.Counter(), 0
    for i, t in rows:
        if i is None:
            continue
        words.setdefault(i, []).append(own := [*WORD.findall(lower(t)), None])
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(own)
            n += len(own)
    base = lambda own: sum(math.log10((count[x] + 1) / (n + len(count) + 1)) for x in own)
    assert len(got) == sum(map(len, words.values()))
    for r in got:
        assert r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert any(r.n_tokens == len(o) and r.n_known == sum(count[x] > 0 for x in o) and abs(r.base_score - base(o)) < 1e-6 * len(o) for o in words[r.doc_id])
        assert r.score <= 0
    held = [r for r in got if r.held_out and r.doc_id > 9]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    got = suffixlm.score(docs, F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert suffixlm.score(docs.limit(0), F.lit(True)).count() == 0


def plain_scores(rows, least=suffixlm.LEAST):
    """Scores of the tokens of (tokens, training) by dictionaries over words, without hashes of grams or buckets."""
    count = collections.Counter(x for own, use in rows if use for x in own)
    n, kinds = sum(count.values()), len(count)
    often = {w: c for w, c in count.items() if c >= suffixlm.FREQUENT * n}
    rare = min(math.log(max(1, n - sum(often.values())) / max(1, kinds - len(often)) / n), 0)
    root_hat = lambda x: -min(round(-suffixlm.STEP * math.log(often[x] / n)), 254) / suffixlm.STEP if x in often else rare
    hot = {"<s>" if w is None else w for w, c in count.items() if c >= suffixlm.HOT * n}
    one, two = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for own, use in rows:
        for v, w, x in zip(["<s>", "<s>", *own], ["<s>", *own], own, strict=False):
            if use:
                one[w][x] += 1
                two[v, w][x] += 1

    def state(follow, lower):
        total = sum(follow.values())
        gain = sum(c * (math.log(c / total) - lower(x)) for x, c in follow.items())
        return (total, suffixlm.NOVELTY * len(follow)) if total >= least and gain >= suffixlm.GAIN else None

    ones = {w: state(f, root_hat) for w, f in one.items()}

    def smoothed(s, follow, x, lower):
        return lower if s is None else (follow[x] + s[1] * lower) / (s[0] + s[1])

    def lower_of(w):
        return root_hat if w in hot else lambda x: math.log(smoothed(ones[w], one[w], x, math.exp(root_hat(x))))

    twos = {(v, w): state(f, lower_of(w)) for (v, w), f in two.items()}
    for own, _ in rows:
        out = 0.0
        for v, w, x in zip(["<s>", "<s>", *own], ["<s>", *own], own, strict=False):
            p = smoothed(ones.get(w), one[w], x, (count[x] + 1) / (n + kinds + 1))
            out += math.log10(smoothed(twos.get((v, w)), two[v, w], x, p))
        yield out


@pytest.mark.parametrize("hot", [suffixlm.HOT, 0.02])
def test_language_model_is_the_plain_tree_however_rows_are_dealt(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixlm, "HOT", hot)
    monkeypatch.setattr(suffixlm, "CHUNK", 4_000)
    rnd = random.Random(5)
    likely = {w: rnd.choices(range(80), k=3) for w in range(80)}
    name, used = {}, set()  # words that the bits kept of their hashes tell apart
    for k in range(2_000):
        h = int(next(iter(spans.blocks(pa.array([f"w{k}"])))).hashes()[0])
        if used.isdisjoint(bits := {("x", h & 0xFFFFF), ("v", h >> 16 & 0xFFFF)}):
            used |= bits
            name[len(name)] = f"w{k}"
    rows = []
    for i in range(250):
        own, w = [], rnd.randrange(80)
        for _ in range(rnd.randint(0, 80)):
            own.append(name[w] if rnd.random() < 0.95 else name[80 + rnd.randrange(500)])
            w = rnd.choice(likely[w]) if rnd.random() < 0.8 else rnd.randrange(80)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, t) for i, t in rows[:20]]
    want = dict(zip((i for i, _ in rows), plain_scores([([*(t.split()), None], zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]), strict=True))
    for parts in (1, 2, 16):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.doc_id: r.score for r in suffixlm.score(docs, catalog.remainder(7) != 2).collect()}
        assert got.keys() == want.keys()
        off = {i: (got[i], want[i]) for i in want if abs(got[i] - want[i]) >= 1e-9 * max(1, -want[i])}
        assert not off
        first = got if parts == 1 else first
        assert all(abs(got[i] - first[i]) < 1e-9 * max(1, -first[i]) for i in got)


def test_states_grow_with_the_corpus():
    rng = np.random.default_rng(3)

    def states(n):
        key = np.sort(spans.mix(rng.integers(0, n // 4, n).astype(np.uint64)) >> np.uint64(20) << np.uint64(20) | rng.integers(0, 4, n).astype(np.uint64))
        key, count = np.unique(key, return_counts=True)
        follow = suffixlm.subtree(key, count, np.full(len(key), -9.0), True)[2]
        return len(np.unique(key[follow > 0] >> np.uint64(20)))

    assert states(80_000) > 8 * states(8_000) > 0
