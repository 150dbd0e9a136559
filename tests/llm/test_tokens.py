"""Token counts and byte-level BPE against the libraries, exactly."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askloom.llm import byte_bpe, queries, token_counts
from tests.llm.conftest import NASTY

MODEL = queries.tokenizer_file("piece_bpe_32k.model")
RANKS = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
SP = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ENC = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={}
)
TEXT = st.text(st.one_of(st.sampled_from(" \n\t▁aebn'sßéñ1.!?日"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_lengths_add_up(text):
    assert token_counts.lengths([text], MODEL) == [len(SP.encode(text))]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_ids_are_the_library_s(text):
    (got,) = byte_bpe.encode_texts([text], byte_bpe.load(RANKS), public_tokenizers.PATTERN)
    assert np.frombuffer(got, "<u4").tolist() == ENC.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdeéß"), min_size=2, max_size=60))
def test_one_tree_and_many_trees_merge_alike(word):
    raw, ranks = word.encode(), byte_bpe.load(RANKS)
    one = byte_bpe.merge_one(raw, ranks)
    if len(raw) <= byte_bpe.TREE_WIDTH:
        (many,) = byte_bpe.merge_many([raw], byte_bpe.TREE_WIDTH, ranks)
        assert many.tolist() == one


def test_long_matches():
    ranks = byte_bpe.load(RANKS)
    for text in ("a" * 5000, "xy" * 3000, "日本" * 2000, " " * 4000 + "z"):
        (got,) = byte_bpe.encode_texts([text], ranks, public_tokenizers.PATTERN)
        assert np.frombuffer(got, "<u4").tolist() == ENC.encode_ordinary(text)


def test_known_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PARTS", 50)
    monkeypatch.setattr(byte_bpe, "KEPT_MATCHES", 50)
    texts = [f"word{k} other{k} third{k}" for k in range(200)]
    assert token_counts.lengths(texts, MODEL) == [len(SP.encode(t)) for t in texts]
    got = byte_bpe.encode_texts(texts, byte_bpe.load(RANKS), public_tokenizers.PATTERN)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ENC.encode_ordinary(t) for t in texts]


def test_balanced_batches():
    parts = ["a" * k for k in (5, 90, 200, 3, 4, 5)]
    assert [len(b) for b in token_counts.balanced(parts, 100)] == [2, 1, 3]


def test_queries(spark, sf_dir, documents):
    rows = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    counts = queries.op5_token_counts(spark, sf_dir).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts} == {
        (k, len(t.encode()), len(SP.encode(t)), len(SP.encode(t)) > 4096) for k, t in rows.items()
    }
    for r in queries.op9_byte_bpe(spark, sf_dir).collect():
        ids = ENC.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_nasty_documents(nasty, no_docs):
    counts = token_counts.count_tokens(nasty, MODEL)
    assert sorted((str(r[0]), r[1], r[2]) for r in counts.collect()) == sorted((str(k), len((t or "").encode()), len(SP.encode(t or ""))) for k, t in NASTY)
    both = byte_bpe.decode(byte_bpe.encode(nasty, RANKS, public_tokenizers.PATTERN), RANKS).withColumn("text", F.decode("decoded", "UTF-8"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in both.collect()) == sorted((str(k), t or "") for k, t in NASTY)
    assert token_counts.count_tokens(no_docs, MODEL).collect() == [] == byte_bpe.digests(no_docs, RANKS, public_tokenizers.PATTERN).collect()


def test_null_ids_decode_to_null(spark):
    encoded = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decode(encoded, RANKS).first()["decoded"] is None

