"""The queries of the operators over a whole table: columns, types, rows and remainders that are agreed on."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from evidentia.llm import catalog

TYPES = {
    "op1_urls": "page_id bigint, host string, path string, rule string, verdict string",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint, n_links bigint",
    "op5_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_suffixlm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_nearest": "query_id bigint, rank int, vec_id bigint, score double",
}
REMAINDERS = {"op2_toxicity": (5, 0), "op5_language": (3, 1), "op6_suffixlm": (7, 2)}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_contract(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    for column in TYPES[name].split(", "):
        field, kind = column.split()
        assert kinds[field] == kind
    rows = df.collect()
    source = {"op1_urls": "pages", "op10_nearest": "embeddings"}.get(name, "documents")
    key = {"pages": "page_id", "embeddings": "vec_id", "documents": "doc_id"}[source]
    given = spark.read.parquet(f"{sf_dir}/{source}.parquet").collect()
    if name == "op10_nearest":
        x = {r.vec_id: np.array(r.embedding, np.float64) for r in given}
        got = {}
        for r in rows:
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
            assert r.score == pytest.approx(np.linalg.norm(x[r.vec_id] - x[r.query_id]), abs=1e-12)
        assert set(got) == {i for i in x if i % 100 == 0} and all(sorted(g) == list(range(1, 11)) for g in got.values())
        hit = 0
        for q, found in got.items():
            near = sorted((np.linalg.norm(v - x[q]), i) for i, v in x.items() if i != q)[:10]
            hit += len({i for _, i in near} & {v for v, _ in found.values()})
        assert hit >= 0.9 * 10 * len(got)
        return
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in given)
    texts = {r[key]: r.text or "" for r in given} if source == "documents" else {}
    for r in rows:
        if name in REMAINDERS:
            of, value = REMAINDERS[name]
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == value)
        if name == "op1_urls":
            assert r.verdict in ("allow", "block")
        if name == "op2_toxicity":
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if name == "op5_language":
            assert 0 <= r.score <= 1
        if name == "op7_shards":
            raw = texts[r.doc_id].encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        if name == "op9_quality":
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    if name == "op3_bpe":
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        t.no_truncation()
        t.no_padding()
        for r in rows:
            ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    if name == "op4_jaccard":
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
        want = con.execute(catalog.oracle_sql()[name]).fetchall()
        assert sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "n_links")) for r in rows) == sorted(want)
    if name == "op7_shards":
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
