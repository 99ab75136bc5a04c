import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from confab.llm import bpe, queries, token_count

from .helpers import docs

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [
    None, "", " ", "\n\n  \t", "a", "Hello world's  end ", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y  ", "naïve café — “quoted” … 東京 🙂🙃 ٣٤",
    "don't  we'll\r\n\r\n  tabs\tand spaces   ", "a" * 5000, "word " * 30000, "    " * 20000 + "x", "԰῿ text ԰ᾅ", "\x1c\x1d words\x85next\xa0nbsp", "1234567890" * 50,
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(JSON)


def test_counts_equal_the_library(spark, tok):
    df = docs(spark, ODD).withColumnRenamed("lang", "n_tokens")
    got = {r.doc_id: r for r in token_count.token_counts(df, JSON, PATTERN).collect()}
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)[:40]


def test_counts_over_the_table(spark, sf_dir, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, sf_dir).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_count_of_any_text(text):
    tok = token_count.tokenizer(JSON)
    lengths = token_count.Lengths(tok, {})
    assert token_count.count_text(text, lengths, regex.compile(PATTERN), token_count.specials_of(tok)) == len(tok.encode(text, add_special_tokens=False).ids)


def test_cache_is_bounded(tok):
    lengths = token_count.Lengths(tok, {"a": 1}, cache=3)
    assert [lengths[w] for w in ("b", "c", "d", "e", "f")] == [1] * 5
    assert len(lengths) <= 4 and lengths["a"] == 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1.'\n\t é"), max_size=80), st.integers(1, 12))
def test_cuts_are_safe(text, size):
    parts = bpe.pieces(text, size)
    assert "".join(parts) == text
    split = regex.compile(PATTERN)
    assert [t for p in parts for t in split.findall(p)] == split.findall(text)


def test_round_trip(spark, sf_dir):
    enc = bpe.encoding(RANKS, PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=enc._mergeable_ranks, special_tokens={})
    df = docs(spark, ODD)
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    rows = queries.op8_bpe_round_trip(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


LONG = ["x" + " " * 5000 + "y", " " * 5000, "\n" * 4999 + "a", "a " + "\t" * 6000, "a" + "\u3000" * 5000 + "b", "x" + " " * 20000 + "\n", "\x85" * 5000 + " b", "\x1c" * 5000 + " " * 5000 + "\x1cb", " " * 4096 + "a" + " " * 4097 + "'s"]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_long_white_space_equals_the_library(k):
    enc = bpe.encoding(RANKS, PATTERN)
    assert bpe.encode_text(enc, LONG[k]).tolist() == enc.encode_ordinary(LONG[k])


def test_very_long_white_space(spark):
    texts = [" " * 2_000_000, "\n" * 2_000_000 + "a", "b" + " \t" * 1_000_000 + "c", "a" * 500_000]
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, texts), RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    enc = bpe.encoding(RANKS, PATTERN)
    assert got[0].n_tokens == len(enc._encode_single_piece(" " * 2_000_000))


def test_empty_tables_and_repeated_rows(spark):
    none = docs(spark, []) if False else spark.createDataFrame([], "doc_id long, text string")
    assert token_count.token_counts(none, JSON, PATTERN).collect() == [] and bpe.round_trip(none, RANKS, PATTERN).collect() == []
    twice = docs(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    assert sorted(str(r.doc_id) for r in token_count.token_counts(twice, JSON, PATTERN).collect()) == ["1", "1", "None"]
    assert len(bpe.round_trip(twice, RANKS, PATTERN).collect()) == 3
