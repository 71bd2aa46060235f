import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from furrow.llm.bpe import Decoder, Encoder, bpe_decode, bpe_encode, encode_words
from furrow.llm.queries import op2_bpe_round_trip, op3_token_counts
from furrow.llm.token_counts import token_counts, whole_tokens
from furrow.llm.tokenizer_files import load_model

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>", "a<|startoftext|>b<|endoftext|> c", "it's We'LL  x's \n\n y  ", "a" * 700, "ab" * 2000, "日本語" * 60, "é́ΑΣ Σ ß İ", " ", "\t\n", "12345 x12"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_same_as_library(path):
    lib, model = Tokenizer.from_file(path), load_model(path)
    ids = Encoder(model).encode(ODD)
    ref = lib.encode_batch(ODD, add_special_tokens=False)
    assert ids == [r.ids for r in ref]
    assert [Decoder(model).decode(i) for i in ids] == [lib.decode(r.ids, skip_special_tokens=False) for r in ref]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_every_code_point(path):
    lib, encoder = Tokenizer.from_file(path), Encoder(load_model(path))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 100_000):
        texts = [f"a{chr(c)}1{chr(c)}{chr(c)}!{chr(c)} b" for c in points[lo : lo + 100_000]]
        assert encoder.encode(texts) == [r.ids for r in lib.encode_batch(texts, add_special_tokens=False)]


def test_texts_of_any_code_points():
    rng = random.Random(17)
    blocks = [(0x20, 0x7F), (0x80, 0x600), (0x1C80, 0x2100), (0xA640, 0xAC00), (0x10000, 0x12700), (0x16E00, 0x19200), (0x1D000, 0x1FA00), (0x300, 0x370)]
    texts = ["".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for path in (WORD, BYTE):
        assert Encoder(load_model(path)).encode(texts) == [r.ids for r in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",)), max_size=200))
def test_any_text(text):
    for path in (WORD, BYTE):
        assert Encoder(load_model(path)).encode([text])[0] == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_long_words_agree_with_short_method():
    model, rng = load_model(BYTE), random.Random(3)
    words = ["".join(rng.choice("theinor") for _ in range(n)) for n in (90, 96, 97, 150, 400)]
    lib = Tokenizer.from_file(BYTE)
    assert [list(i) for i in encode_words(words, model)] == [lib.encode(w, add_special_tokens=False).ids for w in words]


def test_whole_tokens_are_single():
    lib = Tokenizer.from_file(BYTE)
    whole = whole_tokens(load_model(BYTE))
    assert len(whole) > 40_000 and all(len(r.ids) == 1 for r in lib.encode_batch(whole[::50], add_special_tokens=False))


def test_null_empty_repeated_and_clashing(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat", "x"), (3, "the cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df, BYTE).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (3, 7, 2), (3, 7, 2)]
    enc = bpe_encode(df.withColumn("ids", df.text), WORD, decoded=True)
    assert sorted((r.doc_id, len(r.ids), r.decoded) for r in enc.collect())[:2] == [(1, 0, ""), (2, 0, "")]
    assert sorted(r.decoded for r in bpe_decode(enc, WORD).collect()) == ["", "", "the</w> cat</w>", "the</w> cat</w>"]
    assert token_counts(df.limit(0), BYTE).count() == 0 and bpe_encode(df.limit(0), WORD).count() == 0


def test_queries_against_library(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    for r in op2_bpe_round_trip(spark, small).collect():
        ids = word.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in op3_token_counts(spark, small).collect():
        n = len(byte.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)
