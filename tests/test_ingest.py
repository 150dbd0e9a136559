from pyspark.sql import functions as F

from askloom.operators import corpus, crawlset, ingest
from askloom.operators import search as S
from askloom.sources import files

RECORDS = [
    (1, "نماز کے اوقات", "تفصیلی جواب", "TestSource", "https://example.com/f/1", "عبادات"),
    (2, "زکوٰۃ کا حساب", "دوسرا جواب", "TestSource", "https://example.com/f/2", "مالیات"),
]


def records(spark):
    return spark.createDataFrame(RECORDS, "id long, question string, answer string, source string, url string, category string")


def test_upsert_first_wins_and_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "v", "c")], "seq long, url string, answer string")
    store = spark.createDataFrame([], "url string")
    got = {r.seq: r.status for r in ingest.upsert_by_url(batch, store).collect()}
    assert got == {1: "inserted", 2: "skipped", 3: "inserted"}
    stored = ingest.upsert_by_url(batch, store).filter(F.col("status") == "inserted")
    again = ingest.upsert_by_url(batch, stored.select("url"))
    assert {r.status for r in again.collect()} == {"skipped"}


def test_search_browse_and_statistics(spark):
    df = records(spark)
    first = corpus.with_total(corpus.page(df, [F.desc("id")], 1, 1), df).collect()
    assert [(r.id, r.total) for r in first] == [(2, 2)]
    assert [r.id for r in S.token_search(df, "نماز").collect()] == [1]
    assert S.search_filters(df, ["TestSource", "MissingSource"]).count() == 2
    assert S.get_by_id(df, 99999).count() == 0 and S.get_by_id(df, 1).count() == 1
    assert tuple(corpus.corpus_stats(df).first()) == (2, 1, 2)
    assert [tuple(r) for r in corpus.source_counts(df).collect()] == [("TestSource", 2)]
    assert [r.n for r in corpus.category_top(df, 1).collect()] == [1]


def test_miss_log_round_trip(spark):
    df = records(spark)
    queries = spark.createDataFrame([(1, " this-query-should-not-match-anything "), (2, "نماز"), (3, "وٰۃ")], "qid long, query string")
    hits = S.search_with_fallback(df, queries)
    assert {(r.qid, r.id, r.via) for r in hits.collect()} == {(2, 1, "token"), (3, 2, "literal")}
    log = S.search_miss_log(queries, hits, "2024-01-01 00:00:00")
    row = log.collect()
    assert [(r.qid, r["query"], r.results_count, r.resolved) for r in row] == [(1, "this-query-should-not-match-anything", 0, False)]
    misses = log.withColumn("id", F.lit(5).cast("long"))
    solved = S.miss_resolve(misses, spark.createDataFrame([(5,)], "id long"))
    assert [r.resolved for r in solved.collect()] == [True]


def test_noise_delete_keeps_null_rows(spark):
    df = spark.createDataFrame([(1, "s", "bad word"), (2, "s", None), (3, None, "bad"), (4, "t", "bad")], "id long, source string, question string")
    assert {r.id for r in ingest.noise_delete(df, "s", ["bad"]).collect()} == {2, 3, 4}
    assert tuple(ingest.noise_report(df, "s", ["bad"]).first()) == (1, 1, 1)


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1,)], "id long")
    out = ingest.conform_schema(df, {"id": ("string", "x"), "role": ("string", "user"), "seen": ("timestamp_ntz", None)})
    assert out.dtypes == [("id", "bigint"), ("role", "string"), ("seen", "timestamp_ntz")]
    gaps = ingest.verify_schema({"users": out}, {"users": ["role", "flag"], "gone": ["a", "b"]})
    assert {tuple(r) for r in gaps.collect()} == {("users", "flag"), ("gone", None)}


def test_text_folder_and_uploads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("First line asks something here\nجواب the answer follows in full", encoding="utf-8")
    (tmp_path / "sub" / "b.txt").write_text("too short", encoding="utf-8")
    got = files.scan_text_dir(spark, str(tmp_path), "Archive").collect()
    assert [(r.question, r.answer, r.url, r.category) for r in got] == [
        ("First line asks something here", "جواب the answer follows in full", "file://pdf/a.txt", "pdf")
    ]
    (tmp_path / "x.doc").write_bytes(b"hi")
    (tmp_path / "long.TXT").write_bytes("یہ ایک طویل جواب ہے جو پچاس حروف سے زیادہ ہونا چاہیے۔ ".encode() * 2 + b"\xff")
    (tmp_path / "c.pdf").write_text("latin only " * 10)
    gated = files.gate_upload_files(files.read_files(spark, str(tmp_path))).collect()
    reasons = {r.name: r.reason for r in gated}
    assert reasons["x.doc"] == "only pdf or txt files" and reasons["long.TXT"] is None
    assert reasons["b.txt"] == "text too short" and reasons["c.pdf"] == "text not readable"


def test_decode_bytes(spark):
    rows = [("سلام".encode("windows-1256"), "windows-1256"), ("é".encode("latin-1"), "ISO-8859-1"), (b"ok\xff", None), (b"x", "no-such")]
    df = spark.createDataFrame(rows, "b binary, cs string")
    assert [r[0] for r in df.select(files.decode_bytes(F.col("b"), F.col("cs"))).collect()] == ["سلام", "é", "ok�", "x"]


def test_stale_cutoff_by_brute_force(spark):
    import random

    rnd = random.Random(1)
    rows = [(p, i + 1, rnd.choice([0, 0, 0, 2])) for p in "abcde" for i in range(60)]
    df = spark.createDataFrame(rows, "path string, page long, new_urls long")
    last = None
    for n in (2, 3, 8):
        want = set()
        for p in "abcde":
            stale = 0
            for q, page, new in rows:
                if q != p:
                    continue
                want.add((p, page))
                stale = 0 if new else stale + 1
                if stale >= n:
                    break
        got = {(r.path, r.page) for r in crawlset.stale_cutoff(df, n).filter("visited").collect()}
        assert got == want
        assert last is None or last <= got  # a larger n never visits less
        last = got


def test_robots_groups_match_the_standard_library(spark):
    from urllib.robotparser import RobotFileParser

    bodies = {
        "a.org": "User-agent: *\nDisallow: /x\nAllow: /x/y\n",
        "b.org": "User-agent: loom\nUser-agent: other\nAllow: /x/y\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n",
        "c.org": "# nothing\nDisallow: /x\n",
        "d.org": "User-agent: *\nDisallow:\n\nUser-agent: LOOM\nDisallow: /q?z\n",
    }
    paths = ["/", "/x", "/x/y", "/x/y/z", "/q?z=1", "/q", ""]
    robots = spark.createDataFrame(list(bodies.items()), "host string, body string")
    urls = [f"https://{h}{p}" for h in [*bodies, "e.org"] for p in paths] + ["ftp://a.org/", "nothing"]
    got = crawlset.robots_filter(spark.createDataFrame([(u,) for u in urls], "url string"), crawlset.robots_rules(robots, "loom/1.0"))
    verdict = {r.url: r.allowed for r in got.collect()}
    for host, body in bodies.items():
        rp = RobotFileParser()
        rp.parse(body.splitlines())
        for p in paths:
            u = f"https://{host}{p}"
            assert verdict[u] == rp.can_fetch("loom/1.0", u), u
    assert all(verdict[f"https://e.org{p}"] for p in paths)
    assert not verdict["ftp://a.org/"] and not verdict["nothing"]


def test_links_as_a_browser_sees_them(spark):
    html = """<a href='/x?a=1&amp;b=2'>R&amp;D</a><!-- <a href="/hidden">no</a> --><a class=k href=/unq>bare</a><a href="/open">first
    <a title="a" HREF = "/second">second</a><a name="x">no link</a>"""
    page = spark.createDataFrame([(1, "http://h.org/p", html)], "page_id long, url string, html string")
    got = [(r["href"], r["text"], r["url"]) for r in crawlset.extract_links(page).orderBy("pos").collect()]
    assert got == [
        ("/x?a=1&b=2", "R&D", "http://h.org/x?a=1&b=2"),
        ("/unq", "bare", "http://h.org/unq"),
        ("/open", "first", "http://h.org/open"),
        ("/second", "second", "http://h.org/second"),
    ]


def test_documents_of_any_frame(spark):
    pages = [
        (1, "http://h.org/p", '<iframe src="/viewer.html?file=a%2Fb.pdf"></iframe><iframe src="/pdf?x=1"></iframe><iframe src="/PDF?file=a+b%20c.pdf"></iframe>'),
        (2, "http://h.org/p", '<iframe src="/ad"></iframe><iframe src="https://files.h.org/show?x=1&amp;file=%2Fd%2Fe"></iframe>'),
        (3, "http://h.org/p", "<p>none</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["doc_url"] for r in crawlset.embedded_doc_url(df).collect()}
    assert got == {1: "http://h.org/a/b.pdf", 2: "http://h.org/d/e", 3: None}


def test_page_fields_decode_and_ignore_attribute_order(spark):
    html = """<meta content="A &quot;long&quot; description" name='description'><meta content=2024-05-06T00:00 property=article:published_time><p>a &amp; b</p><p>short</p>"""
    row = spark.createDataFrame([(html, "x" * 5000)], "html string, long string").select(
        crawlset.meta_question(F.col("html")).alias("q"), crawlset.longest_paragraph(F.col("html")).alias("p"), crawlset.date_chain(F.col("html"), F.lit("http://h")).alias("d"),
        crawlset.meta_question(F.concat(F.lit("<title>"), F.col("long"), F.lit("</title>"))).alias("t"),
    ).first()
    assert tuple(row)[:3] == ('A "long" description', "a & b", "2024-05-06") and len(row["t"]) == 5000


def test_malformed_escapes_do_not_pass_robots(spark):
    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /private/\nDisallow: /a+b")], "host string, body string")
    urls = {"http://a.org/private/100%zz": False, "http://a.org/a+b/c": False, "http://a.org/a b": True, "http://a.org/public/50%": True}
    got = crawlset.robots_filter(spark.createDataFrame([(u,) for u in urls], "url string"), crawlset.robots_rules(robots, "loom/1.0"))
    assert {r["url"]: r["allowed"] for r in got.collect()} == urls
