"""The encoder against the public library, sign by sign and on hard texts."""

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(library, texts):
    own = bpe.load(PATH)
    want = library.encode_batch(texts, add_special_tokens=False)
    for t, w, (ids, decoded, n) in zip(texts, want, own.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids, repr(t)
        assert n == len(w.ids)
        assert decoded.decode() == library.decode(w.ids, skip_special_tokens=False), repr(t)


def test_hard_texts(library):
    same(library, [
        "", " ", "a", "Hello, WORLD's don't we'll 'tis 12345 a1b2", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>", "<|endoftext|>",
        "café café ÉÈ İstanbul ΣΣΣ ẞß ﬁ", "\x1c\x1d a\x1fb \x85   x　y​z", "\U0001f600\U0001f468‍\U0001f469",
        "!!!??? $$$ --- a--b", "word" * 300, "z" * 700, "中文字符", "à́̂", "\u0000x\u0007",
        "x" * 50 + "<|endoftext|>" * 3, "I'LL I'Ll 'S'T'Re", "²½Ⅷ", "a ́b",
    ])


def test_every_sign(library):
    texts = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) not in ("Cn", "Cs") and (c < 0x3000 or c % 7 == 0):
            texts.append(f"a{chr(c)}B {chr(c)}")
    own = bpe.load(PATH)
    want = library.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w, (ids, _, _) in zip(texts, want, own.encode_texts(texts), strict=True) if np.frombuffer(ids, "<u4").tolist() != w.ids]
    assert not wrong, [hex(ord(t[1])) for t in wrong][:80]


def test_random_words(library):
    rnd = random.Random(5)
    vocab = [t.replace("</w>", "") for t in bpe.load(PATH).vocab if t.replace("</w>", "").isascii()]
    texts = [" ".join("".join(rnd.choices(vocab, k=rnd.randint(1, 5))) for _ in range(50)) for _ in range(300)]
    texts += ["".join(rnd.choices("abcdeinorst' 1.-", k=400)) for _ in range(200)]
    same(library, texts)


def test_frame(spark, library):
    rows = [(1, "Hello there", "z"), (1, "Hello there", "z"), (2, None, None), (3, "", "q"), (None, "été " * 5000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digest(df, PATH).collect()}
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) in got
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(back) == 5
    assert {r.decoded for r in back if r.doc_id == 1} == {library.decode(library.encode("Hello there", add_special_tokens=False).ids)}
    assert bpe.digest(df.limit(0), PATH).count() == 0
