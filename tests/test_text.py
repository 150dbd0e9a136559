"""Text and URL expressions against hand-written pairs and their properties."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from askloom.functions import qa as Q
from askloom.functions import text as T
from askloom.functions import urls as U

PIECES = [
    "hello", "  ", "\n", "\r\n", "\r", "\t", " ", "​", "‏", "﻿", "نماز", "کے", "اَلجَوَابُ", "é", "Q:", "A:", "A word here",
    "&amp;", "&lt;b&gt;", " ", "　", "\x1c", "\x85", "Zürich,", "(word)", "long enough line of text", ".", "سوال", "END", "x",
]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def apply(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [list(r)[1:] for r in rows]


def test_normalize_literal(spark):
    assert apply(spark, ["  hello  \n\n  world  ​ ", None, ""], T.normalize_text(F.col("s"))) == [["hello\nworld"], [""], [""]]


NORMALIZED = [
    ("a\r\nb\rc", "a\nb\nc"),
    (" a \t b \n\n\n \n c ", "a b\nc"),
    ("x\xa0\xa0y", "x y"),
    ("\u200bz\ufeff\u200f", "z"),
    ("Tom &amp; Jerry &lt;b&gt; &#65;", "Tom & Jerry <b> A"),
    ("e\u0301", "\u00e9"),
    ("&nbsp;\n&nbsp;", ""),
    ("\u0646\u0645\u0627\u0632", "\u0646\u0645\u0627\u0632"),
]


def test_normalize_pairs(spark):
    assert [g[0] for g in apply(spark, [a for a, _ in NORMALIZED], T.normalize_text(F.col("s")))] == [b for _, b in NORMALIZED]


def test_normalize_properties(spark):
    """Nothing but blanks, entities and marks goes; lines keep their order and hold no outer blanks."""
    texts = [x.replace("&", "") for x in random_texts(300, 1)]
    for before, (after,) in zip(texts, apply(spark, texts, T.normalize_text(F.col("s"))), strict=True):
        letters = lambda x: [c for c in x if c.isascii() and c.isalnum() and c != "e"]
        assert letters(after) == letters(before)
        assert all(line and line == line.strip() and "  " not in line for line in after.split("\n")) or after == ""


def test_normalize_idempotent_without_entities(spark):
    texts = [t.replace("&", "") for t in random_texts(100, 2)]
    once = [g[0] for g in apply(spark, texts, T.normalize_text(F.col("s")))]
    assert [g[0] for g in apply(spark, once, T.normalize_text(F.col("s")))] == once


def test_dedupe_lines(spark):
    texts = random_texts(200, 3)
    got = [g[0] for g in apply(spark, texts, T.dedupe_lines(F.col("s")))]
    want = ["\n".join(dict.fromkeys(x for x in (y.strip() for y in t.split("\n")) if x)) for t in texts]
    assert got == want
    assert [g[0] for g in apply(spark, got, T.dedupe_lines(F.col("s")))] == got


def test_hash(spark):
    df = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b")], "q string, a string")
    h = [r[0] for r in df.select(T.content_hash(F.col("q"), F.col("a"))).collect()]
    assert h[0] == h[1] != h[2]


def test_keywords(spark):
    texts = random_texts(200, 4)

    def want(s):
        words = [w.strip(T.WORD_PUNCT) for w in s.split()]
        return list(dict.fromkeys(w for w in words if len(w) > 3 and w not in T.STOP_WORDS))[:3]

    assert [g[0] for g in apply(spark, texts, T.keywords(F.col("s")))] == [want(t) for t in texts]


CANONICAL = {
    "https://Example.COM/path/?x=1#frag": "https://example.com/path?x=1",
    "http://A.b/c;d/e;f;g": "http://a.b/c;d/e",
    "HTTP://A?": "http://a/",
    "foo/bar/": "foo/bar/",
    " http://a.com/x y/ ": "http://a.com/x y",
    "http://h/?": "http://h/",
    "ftp://H/x/": "ftp://h/x",
    "mailto:x@y": "mailto:x@y",
    "http://h/a?b=/c/#d": "http://h/a?b=/c/",
    "http://user@Host:80/p/": "http://user@host:80/p",
    "//x/y": "//x/y",
    "": "",
    "http://h#f": "http://h/",
    "http://h/a//b//": "http://h/a//b",
}


def test_canonical_url(spark):
    got = [g[0] for g in apply(spark, list(CANONICAL), U.canonical_url(F.col("s")))]
    assert dict(zip(CANONICAL, got, strict=True)) == CANONICAL
    assert [g[0] for g in apply(spark, got, U.canonical_url(F.col("s")))] == got


def test_percent_decode(spark):
    pairs = {"/a%20b": "/a b", "/100%zz": "/100%zz", "a+b%2Bc": "a+b+c", "%": "%", "%E2%82%AC": "\u20ac", "50%25": "50%"}
    assert [g[0] for g in apply(spark, list(pairs), U.percent_decode(F.col("s")))] == list(pairs.values())


def test_url_segments_drop_any_run_of_front_controllers(spark):
    urls = ["http://h" + "/index.php" * 25 + "/a/b", "http://h/a/index.php/b"]
    assert [g[0] for g in apply(spark, urls, U.url_segments(F.col("s")))] == [["a", "b"], ["a", "index.php", "b"]]


@pytest.mark.parametrize("base", ["http://h.org/a/b/c?x=1#f", "http://h.org", "https://h.org/a/"])
def test_resolve_href(spark, base):
    hrefs = ["d", "../d", "../../../d", "/x/./y", "?y=2", "//o.org/p", "mailto:x", "./", "..", "", "a/b/../c/", "/a/..", "http://z.org/q", "d?u=/../v"]
    got = [g[0] for g in apply(spark, hrefs, U.resolve_href(F.lit(base), F.col("s")))]
    assert got == [urljoin(base, h) for h in hrefs]


def test_url_helpers(spark):
    urls = ["https://www.q.org/index.php/home/ur/slug/12/", "https://q.org/home/ur/search/12", "https://q.org/home/en/s/1?x", "https://other.org/home/en/s/1"]
    got = apply(spark, urls, U.canonical_detail_url(F.col("s"), "q.org", ("search",)))
    assert [g[0] for g in got] == ["https://q.org/home/ur/slug/12", None, "https://q.org/home/en/s/1", None]
    variants = apply(spark, ["https://www.q.org/a", "https://x.org/a"], U.url_variants(F.col("s"), "q.org"))
    assert variants[0][0] == ["https://q.org/a", "https://q.org/index.php/a", "https://www.q.org/a", "https://www.q.org/index.php/a"]
    assert variants[1][0] == ["https://x.org/a", "https://x.org/index.php/a"]


MANY = "\n".join(f"question line number {k}" for k in range(30))


def test_split_lines(spark):
    pairs = {
        f"Q:\n{MANY}\nA:\nanswer text\nEND of it": (MANY, "answer text\nEND of it"),
        "Q: the question itself\nshort\nA: the whole answer": ("the question itself", "the whole answer"),
        "Q: short\nA\nok\nlong enough": ("", "long enough"),
        "no marks at all": ("", ""),
    }
    got = apply(spark, list(pairs), Q.split_qa_lines(F.col("s"), "Q", "A", ("END",)))
    assert [tuple(g[0]) for g in got] == list(pairs.values())
    (cut,) = apply(spark, [f"Q:\n{MANY}\nA:\nanswer text"], Q.split_qa_lines(F.col("s"), "Q", "A", ("END",), reach=9))[0]
    assert cut["question"].count("\n") == 8


def test_split_state(spark):
    text = "intro\nQ the question text\nmore of it\na word in the answer line\nrest of it END\ngone\nQ again, a long one"
    (got,) = apply(spark, [text], Q.split_qa_state(T.lines_of(F.col("s")), ("Q",), ("word",), ("A:",), ("END",)))[0]
    assert tuple(got) == ("Q the question text\nmore of it\nQ again, a long one", "a word in the answer line\nrest of it END")


def test_split_marker_keeps_whole_questions(spark):
    long_q = "why " * 2000
    pairs = {f"{long_q}A: because": (long_q.strip(), "A: because"), f"{long_q}\nbecause": (long_q.strip(), "because"), "one line": ("one line", "one line")}
    assert [tuple(g[0]) for g in apply(spark, list(pairs), Q.split_qa_marker(F.col("s"), "A:"))] == list(pairs.values())
    ((cut,),) = apply(spark, [f"{long_q}A: because"], Q.split_qa_marker(F.col("s"), "A:", width=1200))
    assert len(cut["question"]) <= 1200


def test_split_priority_and_earliest(spark):
    text = "a question of some length, then A: the answer END and what else there is to say about it"
    prio, early = apply(spark, [text], Q.split_qa_priority(F.col("s"), ("END", "A:")), Q.split_qa_earliest(F.col("s"), ("A:", "END")))[0]
    assert tuple(prio) == ("a question of some length, then A: the answer", "END and what else there is to say about it")
    assert tuple(early) == ("a question of some length, then", "A: the answer END and what else there is to say about it")
    assert tuple(apply(spark, ["short A: x"], Q.split_qa_earliest(F.col("s"), ("A:",)))[0][0]) == ("", "")


def test_splitters_lose_nothing(spark):
    """Before and after a marker there is everything but blanks."""
    texts = [x.replace("&", "") for x in random_texts(200, 5)]
    solid = lambda x: "".join(x.split())
    normal = [g[0] for g in apply(spark, texts, T.squash(F.col("s")))]
    for text, (marker, cut) in zip(normal, apply(spark, normal, Q.split_qa_priority(F.col("s"), ("END", "A:")), T.trim_signature(F.col("s"), ("END", "x"))), strict=True):
        assert solid(marker["question"] + marker["answer"]) == solid(text)
        assert solid(text).startswith(solid(cut["body"])) and cut["stopped"] == ("END" in text or "x" in text)


def test_blocked_page_reads_the_whole_page(spark):
    texts = ["x" * 9000 + " checking your browser", "fine", ""]
    assert [g[0] for g in apply(spark, texts, T.blocked_page(F.col("s"), ("checking your browser",)))] == [True, False, True]
    assert apply(spark, texts, T.blocked_page(F.col("s"), ("checking your browser",), head=5000))[0] == [False]


def test_tokens_fold_all_latin_accents(spark):
    assert apply(spark, ["\u1e0da\u02bf\u012bf ti\u1ebfng Z\u00fcrich"], T.tokens(F.col("s")))[0][0][-2:] == ["tieng", "zurich"]
