"""Joins, shards, neighbours, urls and mixing against plain versions, and at their edges."""

import random
import re
import zlib

import numpy as np
import pytest

from evidentia.llm import catalog, components, jaccard, mixing, nearest, shards, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in ids}


def near_copies(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, passage = [], [rnd.choice(vocabulary) for _ in range(40)]
    for i in range(n):
        kind = rnd.random()
        if rows and kind < 0.5:  # a near copy of an earlier text, at and around the threshold
            words = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randint(0, 1 + len(words) // 25)):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        else:
            words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 5, 8, 20, 60, 200]))]
            if kind > 0.8:
                words = passage + words
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    rows = [*near_copies(seed), (500, None), (501, ""), (502, None), (503, "One two"), (504, "one TWO"), (505, "x y z " * 5000), (506, "X y z " * 5000)]
    docs = spark.createDataFrame([*rows, (None, "One two")], "doc_id long, text string").repartition(3)
    got = jaccard.link(docs.withColumnRenamed("text", "body"), text="body").collect()
    sets, want = brute(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id][0])
    kept = jaccard.one_of_each(docs.union(docs.filter("doc_id = 503"))).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({*want.values()})


@pytest.mark.parametrize("block", [7, 1_024])
def test_jaccard_loses_no_link(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    words = [f"v{k}" for k in range(120)]
    group = [(1000 + k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(0, 60, 2)]  # near copies of each other
    rows = [*near_copies(3), *group, (2000, group[0][1]), (501, ""), (502, None)]
    docs = spark.createDataFrame([*rows, (None, group[0][1])], "doc_id long, text string").repartition(3)
    sets = {i: shingles(t) for i, t in rows}
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    want = {(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])}
    component = brute(rows)[1]
    for r in jaccard.join(docs).collect():
        assert r.n_links == sum(r.doc_id in p for p in want)
        assert r.doc_id is None or (r.component_id, r.n_shingles) == (component[r.doc_id], len(sets[r.doc_id]))
    links, standing = jaccard.pairs(docs)
    links = [tuple(r) for r in links.select("a", "b").collect()]
    stands = dict(tuple(r) for r in standing.select("doc_id", "representative").collect())
    assert len(links) == len(set(links)) > 400
    assert set(links) == {p for p in want if stands[p[0]] != stands[p[1]] and set(p) <= set(stands.values())}
    assert set(stands) == {i for i in sets if sets[i]} and all(sets[i] == sets[r] for i, r in stands.items())


def test_jaccard_has_no_link_in_nothing(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_of_nothing(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 120))).astype(np.uint64) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(400, 500, 2).astype(np.uint64)])) for s in sets[:60]]

    def bits(s):
        return jaccard.bitmaps((s % np.uint64(256)) << np.uint64(20))  # few hashes, so that shingles share them

    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    sets, size = [sets[i] for i in order], size[order]
    tree = jaccard.Tree(np.stack([bits(s) for s in sets]), size)
    assert len(tree.levels) > 1
    found = set(zip(*(x.tolist() for x in jaccard.dual(tree, tree)), strict=True))
    for a in range(len(sets)):
        for b in range(len(sets)):
            if jaccard.linked(sets[a], sets[b]):
                assert (a, b) in found
    assert len(found) < len(sets) ** 2 / 2


def test_components(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    links = spark.createDataFrame([*pairs, (None, 4), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {x: find(x) for x in root if find(x) != x or any(find(y) == x and y != x for y in root)}


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(i % 50, "t" * (i % 7)) for i in range(500)], [(i, "same text") for i in range(400)], [(i, "é" * (i * 37 % 900)) for i in range(3000)]])
def test_shards(spark, rows):
    docs = spark.createDataFrame([*rows, (None, None)] if rows else [], "doc_id long, text string").withColumnRenamed("doc_id", "id")
    docs = docs.selectExpr("id", "text", "'q' as slot", "1 as other")
    got = shards.shard(docs, 4, key="id").collect()
    assert len(got) == (len(rows) + 1 if rows else 0)
    by = {}
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 1 and r.other == 1
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    for s in by.values():  # slots follow the order of keys: equal texts lie together
        texts = [r.text or "" for r in sorted(s, key=lambda r: r.slot)]
        assert sum(a != b for a, b in zip(texts, texts[1:], strict=False)) == max(0, len(set(texts)) - 1)
    if len(rows) > 300:
        total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(abs(sum(r["size"] for r in by.get(k, [])) - total / 4) <= 0.01 * total / 4 + 2 * most for k in range(4))


def test_shards_hold_the_documents(spark, sf_dir, monkeypatch):
    made, shard = [], shards.shard
    monkeypatch.setattr(shards, "shard", lambda *a, **k: made.append(shard(*a, **k)) or made[-1])
    got = {(r.shard, r.slot): r for r in catalog.op7_shards(spark, sf_dir).collect()}
    held = {(r.shard, r.slot): r for r in made[0].select("doc_id", "text", "shard", "slot").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(held) and len(got) == len(texts)
    for at, r in held.items():
        raw = (texts[r.doc_id] or "").encode()
        assert r.text == texts[r.doc_id] and (got[at].doc_id, got[at].text_crc32, got[at]["size"]) == (r.doc_id, zlib.crc32(raw), len(raw) + 1)


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0]  # a third of all vectors are one
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 15), (5004, [None] * 16), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = 0
    assert set(got) == set(range(0, 3000, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10].tolist()
        assert sorted(found) == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-9 for v, s in found.values())
        hit += len({v for v, _ in found.values()} & set(want))
    assert hit >= 0.9 * 10 * len(got)


def test_neighbours_of_few(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert nearest.search(vectors.limit(0), vectors).count() == 0


def plain_rule(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(host) :])[0]
    fit = [(len(h + p), h + p, v) for v, h, p in catalog.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls(spark):
    rnd = random.Random(8)
    hosts = ["a.example.com", "b.example.com", "example.com", "com", "xcom", "a.example.net", "W.ORG", "other.io"]
    given = [f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'es', 'fr'])}/{rnd.randrange(1000)}{rnd.choice(['', '/', '.html', '?a=/b#c', '#x'])}" for _ in range(800)]
    given += [None, "", "no scheme", "x://", "x://h", "a://B.com?x=1", "a://b.com#y", "a://b.com/en/://c.org/es/", "http://b.com/en/7\n", "http://com/en/" + "s/" * 50_000]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(given)] + [(0, given[0], "z")], "page_id long, url string, host string")
    got = urls.judge(pages, catalog.RULES).collect()
    assert len(got) == len(given) + 1
    for r in got:
        host, path, rule, verdict = plain_rule(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), catalog.RULES).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.io/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)] + [(900, "http://h.io/spam/zzz"), (901, "http://h.io/news/zzz"), (902, "http://k.io/spam/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "page_id long, blocked int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, [], labels).collect()}
    assert got[900] == "block" and got[901] == "allow" and got[902] == "allow"


@pytest.mark.parametrize("sections", [15, 16, 40])
def test_sections_are_judged_apart_at_any_fan_out(spark, sections):
    given = [f"http://h.com/en/{i}" for i in range(100)] + [f"http://h.com/s{k}/{i}" for k in range(sections) for i in range(10)]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = urls.judge(pages, [("block", "com", "/en/")]).collect()
    assert [r.verdict for r in got if r.path.startswith("/s")] == ["allow"] * 10 * sections
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(0, len(given), 2)], "page_id long, blocked int")
    for r in urls.judge(pages, [], labels).collect():
        assert r.verdict == ("block" if r.path.startswith("/en/") else "allow")


def test_unruled_urls_are_blocked_without_labels(spark):
    """A value among blocked values, and an odd section of a host that is blocked nearly whole; not a clean section beside a blocked one."""
    given = [f"http://h.com/en/x/a{i}" for i in range(60)] + [f"http://h.com/en/y{i}/b" for i in range(3)]
    given += [f"http://k.com/en/{i}" for i in range(200)] + [f"http://k.com/odd/{i}" for i in range(8)]
    given += [f"http://m.com/en/{i}" for i in range(50)] + [f"http://m.com/{s}/{i}" for s in ("fr", "de") for i in range(30)]
    rules = [("block", "h.com", "/en/x/a"), ("block", "k.com", "/en/"), ("block", "m.com", "/en/")]
    pages = spark.createDataFrame([*enumerate([*given, "http://h.com/en/x/b1", "http://n.com/en/1"])], "page_id long, url string")
    got = urls.judge(pages, rules).collect()
    own = {(r.host + r.path): (r.rule, r.verdict) for r in got}
    assert own["h.com/en/x/b1"] == (None, "block") and own["h.com/en/y1/b"] == (None, "block")
    assert all(own[f"k.com/odd/{i}"] == (None, "block") for i in range(8))
    assert all(own[f"m.com/{s}/{i}"] == (None, "allow") for s in ("fr", "de") for i in range(30)) and own["n.com/en/1"] == (None, "allow")


def test_urls_is_expressions_only(spark):
    pages = spark.createDataFrame([(i, f"http://h.com/en/{i}") for i in range(20)], "page_id long, url string")
    assert not re.search("Python|Pandas|Arrow", urls.judge(pages, catalog.RULES)._jdf.queryExecution().toString())


def test_templates_have_the_depth_of_their_paths(spark):
    rows = [(i, f"http://h.io/a/b/c/d/e/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "page_id long, blocked int")
    for r in urls.judge(pages, [], labels).collect():
        assert r.verdict == ("block" if r.page_id % 2 else "allow") and r.template.count("/") == 7


def mixture(spark):
    rnd = random.Random(9)
    rows, marks = [], []
    for i in range(300):
        words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(rnd.randint(60, 100))]
        kind = i % 10
        if kind == 0:
            words = [w + "###" for w in words]
        if kind in (1, 2):
            words[::9] = ["vile"] * len(words[::9])
        rows.append((i, " ".join(words)))
        marks.append((i, int(kind != 0), int(kind in (1, 2))))
    return rows, spark.createDataFrame([*marks, (None, 1, 1), (5, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


def test_mixing(spark):
    rows, labels = mixture(spark)
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (3, rows[3][1]), (None, "w " * 20_000)], "doc_id long, text string")
    got = mixing.mix(docs, labels, {"good": 0.7, "poor": 0.1, "toxic": 0.2}).collect()
    assert len(got) == len(rows) + 4
    total = {d: sum(r.n_tokens * r[f"p_{d}"] * r.rate for r in got) for d in mixing.DOMAINS}
    whole = sum(total.values())
    for d, w in {"good": 0.7, "poor": 0.1, "toxic": 0.2}.items():
        assert abs(total[d] / whole - w) < 0.02
    assert all(r.rate >= 0 and abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-9 and abs(r.copies - r.rate) < 1 for r in got)
    assert len({r.rate for r in got if r.doc_id == 3}) == 1
    own = {r.doc_id: r for r in got}
    assert own[10].p_poor > 0.9 and own[11].p_toxic > 0.9 and own[13].p_good > 0.9
    few = mixing.mix(docs, labels.limit(0)).collect()
    assert all(r.p_good == 1 for r in few)
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_posteriors_are_plain_naive_bayes(spark):
    rows, _ = mixture(spark)
    rows = [*rows, (900, "A#B a, a!  b"), (901, None)]
    domain = {i: "poor" if i % 10 == 0 else "toxic" if i % 10 in (1, 2) else "good" for i in range(0, 300, 2)}
    labelled = spark.createDataFrame(list(domain.items()), "doc_id long, domain string")
    telling = ["vile", "a"]

    def features(t):
        t = t or ""
        words = [w for w in re.split(r"[\s.,!|]+", t.lower()) if w]
        marks, capitals = sum(c in mixing._MARKS for c in t), sum("A" <= c <= "Z" for c in t)
        size = max(1, len(t))
        return [len(words), np.log1p(len(words)), len(set(words)) / max(1, len(words)), np.log1p(1000 * marks / size), np.log1p(1000 * capitals / size), np.log1p(len(set(words) & set(telling)))]

    x = {i: features(t) for i, t in rows}
    got, names = mixing.posteriors(mixing.features(spark.createDataFrame(rows, "doc_id long, text string"), telling), labelled)
    own = {d: np.array([x[i][1:] for i in domain if domain[i] == d]) for d in names}
    assert names == mixing.DOMAINS
    for r in got.collect():
        assert [r.tokens, *(r[c] for c in mixing.FEATURES)] == pytest.approx(x[r.doc_id])
        logs = []
        for d in names:
            mean, spread = own[d].mean(0), np.maximum(own[d].var(0), 0.02)
            fit = -((np.array(x[r.doc_id][1:]) - mean) ** 2 / (2 * spread) + 0.5 * np.log(spread)).sum() if r.tokens else 0.0
            logs.append(np.log(len(own[d]) / len(domain)) + fit)
        e = np.exp(np.array(logs) - max(logs))
        assert r.p == pytest.approx((e / e.sum()).tolist(), abs=1e-9)


def test_mixing_meets_targets_of_rare_domains(spark):
    rows = spark.createDataFrame([(999_900, [1.0, 0.0, 0.0]), (90, [0.0, 1.0, 0.0]), (10, [0.0, 0.0, 1.0])], "tokens long, p array<double>")
    total = 999_900 * 1.01 / 0.97
    got = mixing.rates(rows, [total * w for w in (0.97, 0.02, 0.01)]).collect()
    own = [sum(r.tokens * r.p[k] * r.rate for r in got) / total for k in range(3)]
    assert own == pytest.approx([0.97, 0.02, 0.01], abs=1.5e-4, rel=2e-3)
    soft = [(50 + k, [0.9998 - k * 1e-6, 1e-4, 1e-4 + k * 1e-6]) for k in range(100)] + [(3, [0.1, 0.8, 0.1]), (2, [0.0, 0.1, 0.9])]
    rows = spark.createDataFrame(soft, "tokens long, p array<double>")
    total = sum(t for t, _ in soft)
    got = mixing.rates(rows, [total * w for w in (0.97, 0.02, 0.01)]).collect()
    assert [sum(r.tokens * r.p[k] * r.rate for r in got) / total for k in range(3)] == pytest.approx([0.97, 0.02, 0.01], abs=1.5e-4, rel=2e-3)
    assert min(r.rate for r in got) >= 0


def test_mixing_reports_what_it_cannot_meet(spark):
    rows = spark.createDataFrame([(100, [0.5, 0.5])], "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.rates(rows, [90.0, 10.0]).collect()


def test_mixing_is_expressions_only(spark):
    rows, labels = mixture(spark)
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert catalog.op7_shards(spark, sf_dir).count() == n
    row = catalog.op7_shards(spark, sf_dir).first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(f"doc_id = {row.doc_id}").first().text
    assert row.text_crc32 == zlib.crc32(text.encode()) and row.law == "bytes"
