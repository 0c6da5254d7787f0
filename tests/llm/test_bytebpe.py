"""Against the tokenizer libraries, and round trips."""

import base64
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import bytebpe
from tests.llm.conftest import ODD_TEXTS

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'stremdvl  \n\t9a.!éA"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_ids_equal_the_library(texts):
    enc, codec = library(MULTI), bytebpe.codec(MULTI)
    got = ids(codec, texts)
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert [codec.decode(i) for i in got] == [t.encode() for t in texts]


def test_json_vocabulary_equals_tokenizers():
    t = Tokenizer.from_file(JSON)
    texts = [x or "" for x in ODD_TEXTS] + ["<|endoftext|> is text", "a <|endoftext|>  <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>y", "<|endoftext", "|endoftext|>"] * 2
    assert ids(bytebpe.codec(JSON), texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_scan_equals_stepping():
    rng = random.Random(1)
    of_symbol, product, values, _ = bytebpe._monoid()
    assert all(product[product[a, b], c] == product[a, product[b, c]] for a in range(len(product)) for b in range(len(product)) for c in range(len(product)))
    for n in (1, 2, 127, 128, 129, 5000, 20_000):
        symbols = np.array([rng.randrange(9) for _ in range(n)])
        state, want = bytebpe.START, []
        for s in symbols:
            state = bytebpe._step(state, int(s))[0]
            want.append(state)
        assert values[:, bytebpe.START].take(bytebpe._scan(of_symbol[symbols])).tolist() == want


def test_cache_is_bounded_and_offsets_decode():
    c = bytebpe.Codec(MULTI, cache_pieces=3, chunk_chars=10)
    texts = ["one two three four five six", "seven eight nine"]
    assert ids(c, texts) == ids(bytebpe.codec(MULTI), texts) and len(c._merged) <= 3
    raw = texts[0].encode()
    (tokens,) = ids(c, texts[:1])
    ends = c.ends(np.array(tokens, "<u4").tobytes()).tolist()
    assert [raw[a:b] for a, b in zip([0, *ends], ends)] == [c.token_bytes[i] for i in tokens]
    every = np.array(tokens, "<u4"), np.array(ends)
    assert all(c.decode_bytes(*every, a, b) == raw[a:b] for a in range(len(raw) + 1) for b in range(a, len(raw) + 1))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("'stremdvl  \n\t9a.!éA"), st.characters(exclude_categories=["Cs"])), min_size=10, max_size=80))
def test_parts_of_long_texts_equal_the_library(text):
    for size in (5, 9):
        assert ids(in_parts(size), [text]) == [library(MULTI).encode_ordinary(text)]


@functools.cache
def in_parts(size):
    return bytebpe.Codec(MULTI, chunk_chars=size)


def test_a_text_of_several_parts():
    rng = random.Random(4)
    text = "".join(rng.choice(["word ", "it's ", "  \n", "ünï", "12 ", "!? "]) for _ in range(600_000)) + "a" * 30_000
    assert ids(bytebpe.Codec(MULTI, chunk_chars=200_000), [text]) == [library(MULTI).encode_ordinary(text)]


def test_plain_merging_equals_the_library():
    ranks, enc = bytebpe.load_ranks(MULTI), library(MULTI)
    for piece in ("hello", " unbelievable", "zzzzzz", "¿qué", "a", "1234567", " Straßenbahn"):
        assert bytebpe.merge_piece(ranks, piece.encode()) == enc.encode_ordinary(piece)


def test_text_that_is_not_utf8(documents):
    from pyspark.sql import functions as F

    wrong = documents(["x"]).withColumn("text", F.unhex(F.lit("61FF62")).cast("string"))
    assert bytes(bytebpe.decode_documents(bytebpe.encode_documents(wrong, MULTI), MULTI).first().bytes).decode() == "a\ufffdb"


def test_query_digests(documents):
    enc = library(MULTI)
    docs = documents(ODD_TEXTS)
    for r in bytebpe.round_trip(docs, MULTI).collect():
        text = ODD_TEXTS[r.doc_id] or ""
        want = enc.encode_ordinary(text)
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    decoded = bytebpe.decode_documents(bytebpe.encode_documents(docs, MULTI), MULTI).collect()
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in decoded) == [(i, t or "") for i, t in enumerate(ODD_TEXTS)]
    part = bytebpe.decode_documents(bytebpe.encode_documents(docs, MULTI), MULTI, start=3, stop=9).collect()
    assert {r.doc_id: bytes(r.bytes) for r in part} == {i: (t or "").encode()[3:9] for i, t in enumerate(ODD_TEXTS)}
    assert bytebpe.round_trip(docs.where("false"), MULTI).count() == 0


@pytest.mark.parametrize("path", [MULTI, JSON])
def test_vocabulary_has_all_bytes(path):
    assert all(bytes([b]) in bytebpe.load_ranks(path) for b in range(256))
