"""Piece encoding, cross-tokenizer alignment and fill-in-middle against the libraries and plain Python."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askloom.llm import byte_bpe, cross_tokenizer, fill_in_middle, piece_bpe, queries, token_counts
from tests.llm.conftest import NASTY
from tools.check import rows

MODEL = queries.tokenizer_file("piece_bpe_32k.model")
SIDE_A = queries.tokenizer_file("byte_bpe_50k.json")
SP = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
TEXT = st.text(st.one_of(st.sampled_from(" \n\r\t▁aebn'sßéñ1.!?日;"), st.characters(exclude_categories=["Cs"])), max_size=60)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


# Piece encoding -----------------------------------------------------------------------------------------------


def small_model(pieces, byte_fallback=True, kind=2, prefix=1, squeeze=0):
    """A model file of the given pieces, earlier ones of better score."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        if isinstance(value, float):
            return varint(number << 3 | 5) + np.float32(value).tobytes()
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    rows += [(p, -float(k), 1) for k, p in enumerate(pieces)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in rows)
    out += field(2, field(3, kind) + field(35, int(byte_fallback)))
    return out + field(3, field(1, b"identity") + field(3, prefix) + field(4, squeeze) + field(5, 1))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_are_the_library_s(text):
    model = piece_bpe.load(MODEL)
    (got,) = model.encode([text])
    assert ids(got) == SP.encode(text, add_bos=True, add_eos=True)
    assert model.decode(got) == SP.decode(ids(got))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab▁c", min_size=2, max_size=5), max_size=12, unique=True), st.text("abc d▁\n", max_size=40), st.booleans())
def test_any_vocabulary(pieces, text, byte_fallback):
    """Also vocabularies that merging alone would not give: unreachable pieces, scores in any order, pieces across blanks."""
    content = small_model([*pieces, "a", "b", "▁"], byte_fallback)
    library = sentencepiece.SentencePieceProcessor(model_proto=content)
    model = piece_bpe.Pieces(content)
    (got,) = model.encode([text])
    assert ids(got) == library.encode(text, add_bos=True, add_eos=True)
    assert model.decode(got) == library.decode(ids(got))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_any_ids_decode_like_the_library(some):
    assert piece_bpe.load(MODEL).decode(np.array(some, "<u4").tobytes()) == SP.decode(some)


def test_long_parts_and_failed_positions():
    model = piece_bpe.load(MODEL)
    for text in ("a" * 50_000, "日本語" * 20_000, "ab" * 9000, " " * 5000 + "z", "x" + " " * 5000, "thethethe" * 3000):
        (got,) = model.encode([text])
        assert ids(got) == SP.encode(text, add_bos=True, add_eos=True)


def test_other_models_are_refused():
    for content in (small_model(["a"], kind=1), small_model(["a"], squeeze=1), small_model(["a"], prefix=0)):
        with pytest.raises(ValueError):
            piece_bpe.Pieces(content)


def test_two_models_in_one_worker(spark):
    docs = spark.createDataFrame([(k, "abc abc ab") for k in range(4)], "doc_id long, text string").coalesce(1)
    other = small_model(["ab", "▁a", "abc", "a", "b", "c", "▁"])
    for content in (MODEL, other, MODEL):
        library = sentencepiece.SentencePieceProcessor(model_proto=content)
        for r in piece_bpe.encode(docs, content).collect():
            assert ids(r["ids"]) == library.encode("abc abc ab", add_bos=True, add_eos=True)


def test_counts_and_ranks_of_two_vocabularies_in_one_worker(spark):
    docs = spark.createDataFrame([(k, "information retrieval abc") for k in range(4)], "doc_id long, text string").coalesce(1)
    other = small_model(["ab", "▁a", "abc", "a", "b", "c", "▁"])
    for content in (MODEL, other, MODEL):
        n = len(sentencepiece.SentencePieceProcessor(model_proto=content).encode("information retrieval abc"))
        assert {r["n_tokens"] for r in token_counts.count_tokens(docs, content).collect()} == {n}
    large = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    small = b"\n".join(sorted(large.splitlines(), key=lambda x: int(x.split()[1]))[:300])
    counts = []
    for content in (small, large, small):
        ranks = byte_bpe.vocabulary(content)
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        expected = library.encode_ordinary("information retrieval abc")
        for r in byte_bpe.encode(docs, content, public_tokenizers.PATTERN).collect():
            assert ids(r["ids"]) == expected
        counts.append(len(expected))
    assert counts[0] > counts[1]


def test_known_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_PARTS", 50)
    monkeypatch.setattr(piece_bpe, "KEPT_PAIRS", 50)
    texts = [f"word{k} other{k}\nthird{k}" for k in range(200)]
    assert [ids(g) for g in piece_bpe.Pieces(MODEL).encode(texts, 500)] == SP.encode(texts, add_bos=True, add_eos=True)


def test_op11(spark, sf_dir, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    found = queries.op11_piece_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = SP.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(expected) and r["ids_sha256"] == sha(np.array(expected, "<u4").tobytes())
        assert r["decoded_sha256"] == sha(SP.decode(expected))


def test_piece_encoding_of_nasty_documents(nasty, no_docs):
    both = piece_bpe.decode(piece_bpe.encode(nasty, MODEL), MODEL).collect()
    expected = [(str(k), SP.encode(t or "", add_bos=True, add_eos=True)) for k, t in NASTY]
    assert sorted((str(r["doc_id"]), ids(r["ids"])) for r in both) == sorted(expected)
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in both) == sorted((k, SP.decode(e)) for k, e in expected)
    assert piece_bpe.digests(no_docs, MODEL).collect() == []


def test_null_ids_decode_to_null(spark):
    assert piece_bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), MODEL).first()["decoded"] is None


# Cross-tokenizer alignment ------------------------------------------------------------------------------------

A = tokenizers.Tokenizer.from_str(SIDE_A.decode())
A.encode_special_tokens = True


def expected_alignment(texts):
    """Whole texts by both libraries; groups from the sets of token ends, links from all overlapping ranges."""
    of = cross_tokenizer.byte_of_character()
    a_bytes = {k: bytes(of[c] for c in t) for t, k in json.loads(SIDE_A)["model"]["vocab"].items() if set(t) <= of.keys()}

    def b_bytes(k):
        p = SP.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if SP.is_byte(k) else p.replace("▁", " ").encode()

    def ranges(names, of_id):
        at, out = 0, []
        for k in names:
            out.append((at, at + len(of_id(k)), k))
            at += len(of_id(k))
        return out

    docs = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = (ranges(A.encode(" " + text, add_special_tokens=False).ids, a_bytes.__getitem__), ranges(SP.encode(text), b_bytes)) if text else ([], [])
        if b"".join(a_bytes[k] for *_, k in a) != raw or b"".join(b_bytes(k) for *_, k in b) != raw:
            docs.append(([], [], [], []))
            continue
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, links, begin, j0 = [], [], 0, 0
        for end in ends:
            sides = [[str(k) for s, e, k in side if begin <= s and e <= end] if len(a) < 3000 else None for side in (a, b)]
            groups.append(sides)
            begin = end
        for s, e, k in a:
            while j0 < len(b) and b[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][0] < e:
                links.append((k, b[j][2]))
                j += 1
        docs.append((a, b, groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups) if groups and groups[0][0] is not None else None
        digest = "" if not a else None if text is None else sha(text)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out, count


def same(found, expected):
    """Rows equal; a digest that the slow form doesn't state is not compared."""
    found, expected = sorted(found, key=str), sorted(expected, key=str)
    assert len(found) == len(expected)
    for f, e in zip(found, expected, strict=True):
        assert f[:-1] == e[:-1] and e[-1] in (None, f[-1])


@pytest.mark.parametrize("small", [False, True])
def test_op12(spark, sf_dir, documents, monkeypatch, small):
    if small:  # many runs, several levels of merging, several tasks for a radix
        monkeypatch.setattr(cross_tokenizer, "FAN_IN", 3)
        monkeypatch.setattr(cross_tokenizer, "RUNS_A_TASK", 2)
        documents = documents.repartition(13)
    given = [(r["doc_id"], r["text"]) for r in documents.collect()]
    expected, count = expected_alignment([t for _, t in given])
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = cross_tokenizer.align(documents, SIDE_A, MODEL) if small else queries.op12_cross_tokenizer(spark, sf_dir)
    same([tuple(r) for r in got.select(columns).collect()], [(k, *e) for (k, _), e in zip(given, expected, strict=True)])
    if small:
        best = {}
        for (a, _), n in count.items():
            best[a] = max(best.get(a, 0), n)
        pairs = cross_tokenizer.pair_counts(documents, SIDE_A, MODEL).collect()
        assert {tuple(r) for r in pairs} == {(a, b, n, n == best[a]) for (a, b), n in count.items()} and len(pairs) == len(count)


def test_alignment_of_nasty_documents(spark, nasty, no_docs):
    expected, _ = expected_alignment([t for _, t in NASTY])
    got = cross_tokenizer.align(nasty, SIDE_A, MODEL, keep_groups=True).collect()
    same([(str(r["doc_id"]), *r[1:8]) for r in got], [(str(k), *e) for (k, _), e in zip(NASTY, expected, strict=True)])
    assert all(r["groups_sha256"] == (sha(r["groups"]) if r["groups"] else "") for r in got)
    assert cross_tokenizer.align(no_docs, SIDE_A, MODEL).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cross_tokenizer.align(blank, SIDE_A, MODEL).collect()) == [1, 2]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\r\t\x1c\x85\xa0aebn'stl1.!?<|>"), st.characters(max_codepoint=0x24F)), max_size=60))
def test_quick_side_a_is_side_a(text):
    sides = cross_tokenizer.load(SIDE_A, MODEL)
    assert sides.quick is not None
    assert sides.a_ids([text, text + "日", ""]) == [A.encode(" " + t, add_special_tokens=False).ids for t in (text, text + "日", "")]


def test_quick_side_a_on_every_character():
    sides = cross_tokenizer.load(SIDE_A, MODEL)
    texts = [f"{x}{chr(c)}{y}{chr(c)}{chr(c)} {chr(c)}z" for c in range(0x250) for x in ("", "a", "1 ", ".") for y in ("b", "2", " ", "\n", "!")]
    assert sides.a_ids(texts) == [A.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_merge_of_runs():
    r = random.Random(5)
    runs = [{r.randrange(4) << 32 | r.randrange(30): r.randrange(1, 9) for _ in range(20)} for _ in range(7)]
    total = Counter()
    for run in runs:
        total.update(run)
    streams = [(np.array(sorted(x)), np.array([x[k] for k in sorted(x)])) for x in runs]
    keys, counts, best = cross_tokenizer.merged(streams)
    assert dict(zip(keys, counts, strict=True)) == total and keys == sorted(total)
    assert best == [max(n for k, n in total.items() if k >> 32 == key >> 32) for key in keys]


# Fill-in-middle -----------------------------------------------------------------------------------------------


def expected_rendering(key, text):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    h = [int(sha(f"7:{'' if key is None else key}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, n, "plain", None, None, text
    if h[3] % 100 < 50:
        return key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def rendered(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op13(spark, sf_dir, documents):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    relation = con.execute(fill_in_middle.ORACLE)
    columns = [d[0] for d in relation.description]
    got = queries.op13_fill_in_middle(spark, sf_dir)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, relation.fetchall())


def test_rendering_of_nasty_documents(spark, nasty, no_docs):
    more = [(20, "a<P>b\nc"), (21, "\n\n\n"), (22, "x\n" * 5000), (23, "y" * 20_000 + "\nend"), (24, "<\nP>\n<S\n>M>"), (25, "é\nü\n日本\nß" * 900)]
    docs = nasty.select("doc_id", "text", "n", "id", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "id", "key")}))
    got = fill_in_middle.transform(docs)
    assert rendered(got) == sorted((expected_rendering(k, t) for k, t in [*NASTY, *more]), key=str)
    back = got.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert rendered(back) == sorted(((k, t or "") for k, t in [*NASTY, *more]), key=str)
    assert fill_in_middle.transform(no_docs).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("a\né日 "), max_size=50), max_size=8), st.booleans())
def test_cuts_from_chunks(texts, collide):
    """Every cut of every text, with chunks of a few bytes; also when all chunks have one hash."""
    from unittest import mock

    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    hashes = (lambda data, ends: np.zeros(len(ends), np.uint64)) if collide else fill_in_middle.chunk_hashes
    with mock.patch.multiple(fill_in_middle, CHUNK_BITS=2, LONGEST=7, chunk_hashes=hashes):
        lines = fill_in_middle.Lines(data, offsets, fill_in_middle.Summaries(1000))
        for k, text in enumerate(texts):
            units = re.findall("[^\n]*\n|[^\n]+", text)
            assert lines.count[k] == len(units)
            for n in range(len(units) + 1):
                head = "".join(units[:n])
                assert lines.cut(k, n) == (len(head.encode()), len(head))


def test_shared_passages_share_chunks():
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh \n") for _ in range(6000))
    found = []
    for before in ("", "something else in front of it\n" * 7):
        raw = (before + passage).encode()
        ends = fill_in_middle.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        found.append({raw[a:b] for a, b in zip([0, *ends], ends)})
    assert len(found[0] & found[1]) >= len(found[0]) - 2 > 10
    summaries = fill_in_middle.Summaries()
    raw = passage.encode()
    for _ in range(2):
        fill_in_middle.Lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), summaries)
    assert summaries.hits == len(summaries.kept) == len(found[0])
