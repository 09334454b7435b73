import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiweave.llm import bpe


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary_path())


def same(enc, reference, texts):
    ids, at = enc.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == (reference(t) if t else []), repr(t)[:200]


def test_cases(enc, reference):
    same(enc, reference, [None, "", " ", "a", "don't we'll 's 're I'd'", "''s", "x\n's", "  's", "a  b \n\n c\t", "日本's 12３४", "<|endoftext|>", "\x85　x  y", "🙂'll", "'", "'l", "'l l", "'r e"])


def test_long_texts(enc, reference):
    same(enc, reference, ["a" * 60_000, " " * 40_000 + "x", "ab" * 30_000, "xq'z" * 30_000, "word " * 300_000])


def test_random_mixtures(enc, reference):
    r = random.Random(7)
    letters = "ab'sredlvtm  \t\n12٣é日!?.\"’　\xa0​🙂\x85\x1c"
    same(enc, reference, ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(8000)])


def test_every_code_point(enc):
    t = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 50_000):
        texts = [f"x{chr(c)}1{chr(c)}'s {chr(c)} a" for c in points[lo : lo + 50_000]]
        ids, at = enc.encode_batch(texts)
        for i, want in enumerate(t.encode_batch(texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == want.ids, hex(points[lo + i])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(enc, reference, text):
    same(enc, reference, [text, text + "'s", " " + text])


def test_encode_offsets_and_decode(spark, reference):
    texts = [None, "", "Hé ho 🙂 don't", "x" * 5000, "Hé ho 🙂 don't", "a\r\n b"]
    df = spark.createDataFrame([(i, t, [1], "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, offsets string")
    rows = bpe.encode(df, "doc_id", "text", offsets=True).orderBy("doc_id").collect()
    pieces = {i: p for p, i in bpe.ranks(bpe.vocabulary_path()).items()}
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        assert r.ids == (reference(t) if t else [])
        ends = [*r.offsets[1:], len(raw)] if r.ids else []
        assert [raw[a:b] for a, b in zip(r.offsets, ends, strict=True)] == [pieces[i] for i in r.ids]
    back = bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id").orderBy("doc_id").collect()
    assert [r.text for r in back] == [t or "" for t in texts]
    assert [r.n_tokens for r in bpe.count_tokens(df, ["doc_id"], "text").orderBy("doc_id").collect()] == [len(r.ids) for r in rows]
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
