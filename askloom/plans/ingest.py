"""Ingest queries: flagship, upsert, dead letters, publishing, gates, maintenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from askloom.functions import qa as Q
from askloom.functions import text as T
from askloom.functions import urls as U
from askloom.operators import charsets
from askloom.operators import ingest as I
from askloom.operators.keyed_store import KeyedStore
from askloom.plans import duck as D
from askloom.plans.bind import AS_OF
from askloom.plans.registry import query
from askloom.session import staged, staging_path
from askloom.sources import files

C = F.col
BLOCKERS = ("spam-farm", "cheap-pills")
# Split marker and repeated-URL key of the flagship: pages of one host and language share an address.
PAGE_KEY = "concat('HTTPS://', regexp_extract(url, '//([^/?#]*)', 1), '/', regexp_extract(url, '//[^/]*/([a-z]+)/', 1), '/#', CAST(page_id AS STRING))"


def staged_pages(t):
    """Parsed pages with their error, before the append."""
    return parse_pages(t.pages)


def parse_pages(raw):
    pages = raw.select("page_id", "html", F.expr(PAGE_KEY).alias("url"), U.host(C("url")).alias("source"))
    text = pages.select(
        "page_id", "source", U.canonical_url(C("url")).alias("url"), T.blocked_page(C("html"), BLOCKERS).alias("blocked"), T.html_to_text(C("html")).alias("body")
    )
    split = text.select("page_id", "source", "url", "blocked", Q.split_qa_marker(C("body"), "tion ").alias("s"))
    clean = split.select(
        "page_id", "source", "url", "blocked", T.dedupe_lines(C("s.question")).alias("question"), T.dedupe_lines(C("s.answer")).alias("answer")
    )
    gated = I.quality_gate(clean)
    error = F.when(C("blocked"), F.lit("fetch: challenge page")).when(C("reason").isNotNull(), F.concat(F.lit("parse: "), C("reason")))
    status = F.when(C("blocked"), F.lit("failed")).when(C("reason").isNotNull(), F.lit("parsed_none"))
    return gated.withColumns({"error": error, "status": status}).drop("reason", "blocked")


D_STAGED = rf"""
    k AS (SELECT page_id, html, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS source,
                 'https://' || lower(regexp_extract(url, '//([^/?#]*)', 1)) || '/' || regexp_extract(url, '//[^/]*/([a-z]+)/', 1) AS url FROM pages),
    b AS (SELECT *, contains(html, 'spam-farm') OR contains(html, 'cheap-pills') AS blocked, {D.page_text('html')} AS b FROM k),
    p AS (SELECT *, instr(b, 'tion ') AS p FROM b),
    s AS (SELECT *, {D.squash("CASE WHEN p > 0 THEN " + D.strip("substr(b, 1, p - 1)") + " ELSE split_part(b, chr(10), 1) END")} AS q0,
                 {D.squash("CASE WHEN p > 0 THEN substr(b, p) WHEN contains(b, chr(10)) THEN substr(b, instr(b, chr(10)) + 1) ELSE b END")} AS a0 FROM p),
    d AS (SELECT *, list_filter({D.lines('q0')}, lambda x, i: list_position({D.lines('q0')}, x) = i) AS ql,
                 list_filter({D.lines('a0')}, lambda x, i: list_position({D.lines('a0')}, x) = i) AS al FROM s),
    staged AS (SELECT page_id, source, url, question, answer,
                 CASE WHEN blocked THEN 'fetch: challenge page' WHEN reason IS NOT NULL THEN 'parse: ' || reason END AS error,
                 CASE WHEN blocked THEN 'failed' WHEN reason IS NOT NULL THEN 'parsed_none' END AS status
          FROM (SELECT *, CASE WHEN question = '' OR answer = '' THEN 'empty' WHEN len(question) < 20 THEN 'question too short'
                       WHEN len(answer) < 50 THEN 'answer too short' WHEN question = answer THEN 'question equals answer' END AS reason
                FROM (SELECT *, array_to_string(ql, chr(10)) AS question, array_to_string(al, chr(10)) AS answer FROM d)))"""


@query(
    "flagship",
    oracle=f"""
    WITH {D_STAGED},
    f AS (SELECT url, min(page_id) AS page_id FROM staged WHERE status IS NULL GROUP BY url),
    r AS (SELECT g.source, coalesce(g.status, CASE WHEN f.page_id IS NOT NULL THEN 'inserted' ELSE 'skipped' END) AS status
          FROM staged g LEFT JOIN f ON f.url = g.url AND f.page_id = g.page_id)
    SELECT source, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'skipped') AS skipped,
           count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'parsed_none') AS parsed_none FROM r GROUP BY source""",
)
def flagship(t):
    # Parsing is the costly part and three branches read its result, so it is written once.
    parsed = staged(staged_pages(t), "parsed").select("page_id", "source", "url", "status")
    good = parsed.filter(C("status").isNull()).drop("status")
    store = good.sparkSession.createDataFrame([], "url string")
    appended = I.upsert_by_url(good, store, "page_id")
    bad = parsed.filter(C("status").isNotNull())
    return I.ingest_stats(appended.unionByName(bad.select(*appended.columns)))


@query(
    "scan_pages",
    oracle="""SELECT page_id, url, CAST(len(html) AS BIGINT) AS n_chars, CASE WHEN html IS NULL OR html = '' THEN 'failed' ELSE 'read' END AS status FROM pages""",
)
def _(t):
    return files.scan_pages(t.spark, t.sf_dir).select("page_id", "url", F.length("html").cast("long").alias("n_chars"), "status")


@query(
    "upsert_by_url",
    "incoming stored",
    f"""
    WITH k AS (SELECT seq, source, {D.canonical('url')} AS url FROM incoming),
         f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM k)
    SELECT seq, source, url, CASE WHEN rn = 1 AND url NOT IN (SELECT url FROM stored) THEN 'inserted' ELSE 'skipped' END AS status FROM f""",
)
def upserted(t):
    batch = t.incoming.select("seq", "source", U.canonical_url(C("url")).alias("url"))
    return I.upsert_by_url(batch, t.stored)


D_UPSERTED = f"""
    k AS (SELECT seq, source, {D.canonical('url')} AS url FROM incoming),
    w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM k),
    ups AS (SELECT seq, source, url, CASE WHEN rn = 1 AND url NOT IN (SELECT url FROM stored) THEN 'inserted' ELSE 'skipped' END AS status FROM w)"""


@query("dead_letter", oracle=f"WITH {D_STAGED} SELECT url, source, error FROM staged WHERE status IS NOT NULL")
def _(t):
    # A filter on the status would be pushed into the parse and repeat it; the parsed table is written first.
    return I.dead_letter(staged(staged_pages(t), "parsed"))


@query("dry_run", "incoming stored", f"WITH {D_UPSERTED} SELECT status, count(*) AS n FROM ups GROUP BY status")
def _(t):
    return I.dry_run(upserted(t))


@query(
    "ingest_stats",
    "incoming stored",
    f"""WITH {D_UPSERTED} SELECT source, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'skipped') AS skipped,
        CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS parsed_none FROM ups GROUP BY source""",
)
def ingest_stats(t):
    return I.ingest_stats(upserted(t))


# Manual entries: documents with a status, an explicit name for some and an acting user.
MANUAL = """
    SELECT id, concat('  ', question) AS question, concat(answer, chr(10)) AS answer, concat(' ', category) AS category,
           CASE WHEN id % 4 = 0 THEN concat(' ', source, ' ') WHEN id % 4 = 1 THEN '  ' END AS source_name,
           CASE WHEN id % 2 = 0 THEN 'admin' ELSE 'reviewer' END AS claimed_role,
           CASE WHEN id % 3 = 0 THEN 'draft' ELSE 'published' END AS status, (id * 7) % 400 AS actor_id,
           CASE WHEN id % 5 = 0 THEN id % 12 END AS assigned_to,
           TIMESTAMP_NTZ '2024-01-01 00:00:00' + id * INTERVAL '1' MINUTE AS created_at
    FROM {records}"""
D_MANUAL = "manual AS (" + MANUAL.format(records="records").replace("TIMESTAMP_NTZ '", "TIMESTAMP '") + ")"


def manual(t):
    return t.spark.sql(MANUAL, records=t.records)


@query(
    "publish_record",
    "records",
    f"""WITH {D_MANUAL}
    SELECT {D.strip('question')} AS question, {D.strip('answer')} AS answer, source, 'manual://' || id AS url,
           nullif({D.strip('category')}, '') AS category, '2024-01-25' AS date
    FROM (SELECT *, substr(coalesce(nullif({D.strip('source_name')}, ''), 'Admin Entry'), 1, 255) AS source FROM manual WHERE status = 'published')
    UNION ALL SELECT question, answer, source, url, category, CAST(NULL AS VARCHAR) FROM records""",
)
def published(t):
    named = manual(t).withColumn("source", I.search_name(C("source_name")))
    corpus = t.records.drop("id").withColumn("date", F.lit(None).cast("string"))
    return I.with_published(corpus, I.publish_record(named, "manual", AS_OF))


@query(
    "publish_back_reference",
    "records",
    f"WITH {D_MANUAL} SELECT id, status, CASE WHEN status = 'published' THEN 'manual://' || id END AS record_url FROM manual",
)
def _(t):
    return I.back_reference(manual(t).select("id", "status"), published(t).select("url"), "manual")


@query(
    "manual_source_name",
    "records",
    f"""WITH {D_MANUAL}
    SELECT m.id, coalesce(nullif({D.strip('source_name')}, ''), CASE WHEN claimed_role = 'admin' THEN 'Admin' ELSE coalesce(r.s_name, 'Reviewer') END) AS stored_name,
           coalesce(substr(nullif({D.strip('source_name')}, ''), 1, 255), 'Admin Entry') AS search_name
    FROM manual m LEFT JOIN supplier r ON r.s_suppkey = m.actor_id""",
)
def _(t):
    rows = manual(t).join(t.reviewers.select(C("user_id").alias("actor_id"), "display_name"), "actor_id", "left")
    return rows.select(
        "id",
        I.stored_name(C("source_name"), C("claimed_role"), C("display_name")).alias("stored_name"),
        I.search_name(C("source_name")).alias("search_name"),
    )


@query(
    "role_gate",
    "records users reviewers",
    f"""WITH {D_MANUAL}
    SELECT m.id, m.actor_id, m.claimed_role, CASE WHEN u.id IS NULL THEN 'user not found' WHEN u.role <> m.claimed_role THEN 'forbidden'
           WHEN m.claimed_role = 'reviewer' AND r.id IS NULL THEN 'profile not found'
           WHEN m.claimed_role = 'reviewer' AND m.assigned_to <> r.id THEN 'not assigned' END AS reason
    FROM manual m LEFT JOIN users u ON u.id = m.actor_id LEFT JOIN reviewers r ON r.user_id = u.id""",
)
def _(t):
    return I.role_gate(manual(t), t.users, t.reviewers).select("id", "actor_id", "claimed_role", "reason")


@query(
    "manual_list",
    "records",
    f"""WITH {D_MANUAL} SELECT id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
        (SELECT count(*) FROM manual WHERE status = 'published') AS total
        FROM manual WHERE status = 'published' ORDER BY manual.created_at DESC, id DESC LIMIT 20 OFFSET 20""",
)
def _(t):
    from askloom.operators.corpus import with_total, page

    rows = manual(t).filter(C("status") == "published")
    top = page(rows, [F.desc("created_at"), F.desc("id")], 2, 20)
    out = with_total(top.select("id", "status", "created_at"), rows)
    return out.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "quality_gate",
    "records",
    """SELECT id, CASE WHEN q = '' OR a = '' THEN 'empty' WHEN len(q) < mq THEN 'question too short' WHEN len(a) < ma THEN 'answer too short'
              WHEN must AND q = a THEN 'question equals answer' END AS reason
       FROM (SELECT id, question AS q, CASE WHEN id % 9 = 0 THEN question ELSE answer END AS a, CASE WHEN source IN ('src1', 'src2') THEN 10 ELSE 20 END AS mq,
                    CASE WHEN source IN ('src1', 'src2') THEN 30 ELSE 50 END AS ma, source NOT IN ('src1', 'src2') AS must FROM records)""",
)
def _(t):
    lenient = C("source").isin("src1", "src2")
    rows = t.records.withColumn("answer", F.when(C("id") % 9 == 0, C("question")).otherwise(C("answer")))
    gated = I.quality_gate(rows, F.when(lenient, 10).otherwise(20), F.when(lenient, 30).otherwise(50), ~lenient)
    return gated.select("id", "reason")


NOISE = ("License", "tion", "Der")
D_NOISE = "source = 'src3' AND (contains(question, 'License') OR contains(question, 'tion') OR contains(question, 'Der'))"


@query("noise_rows", "records", f"SELECT id, question FROM records WHERE {D_NOISE}")
def _(t):
    return I.noise_rows(t.records, "src3", NOISE).select("id", "question")


@query("noise_delete", "records", f"SELECT id, source FROM records WHERE NOT coalesce({D_NOISE}, false)")
def _(t):
    return I.noise_delete(t.records, "src3", NOISE).select("id", "source")


@query(
    "noise_report",
    "records",
    f"SELECT count(*) FILTER ({D_NOISE}) AS matched, count(*) FILTER ({D_NOISE}) AS deleted, count(*) FILTER (source = 'src3' AND NOT ({D_NOISE})) AS remaining FROM records",
)
def _(t):
    return I.noise_report(t.records, "src3", NOISE)


@query(
    "conform_schema",
    "users questions",
    """SELECT q.id, q.user_id, q.status, q.payment_status, CAST(NULL AS BIGINT) AS payment_amount, 'normal' AS priority, 'ur' AS language FROM questions q""",
)
def _(t):
    target = {
        "payment_status": ("string", "unpaid"),
        "payment_amount": ("bigint", None),
        "priority": ("string", "normal"),
        "language": ("string", "ur"),
    }
    return I.conform_schema(t.questions.select("id", "user_id", "status", "payment_status"), target)


@query(
    "verify_schema",
    "users questions",
    """SELECT 'users' AS table_name, 'dashboard_access' AS column_name, (SELECT count(*) FROM users) AS affected_rows
       UNION ALL SELECT 'questions', 'payment_note', (SELECT count(*) FROM questions) UNION ALL SELECT 'reviewer_payments', NULL, 0""",
)
def _(t):
    expected = {
        "users": ("role", "dashboard_access"),
        "questions": ("reviewer_id", "assigned_at", "answered_at", "payment_note", "payment_status"),
        "reviewers": (),
        "reviewer_payments": ("month",),
    }
    tables = {"users": t.users, "questions": t.questions, "reviewers": t.reviewers}
    sizes = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, df in tables.items()]
    counts = sizes[0].unionByName(sizes[1]).unionByName(sizes[2])
    # How many rows the default of a missing column would fill.
    return I.verify_schema(tables, expected).join(counts, "table_name", "left").select("table_name", "column_name", F.coalesce("n", F.lit(0)).alias("affected_rows"))


# Files derived from the tables --------------------------------------------------------------------------------


# Documents in the shape of the binary file reader: the folder readers add nothing but the listing.
def as_files(t, suffix):
    name = F.concat(F.lit("file:/in/"), (C("doc_id") % 7).cast("string"), F.lit("/doc-"), C("doc_id").cast("string"), suffix)
    content = F.encode("text", "utf-8")
    return t.documents.select("doc_id", name.alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


@query(
    "scan_text_dir",
    oracle=f"""
    SELECT url, source, {D.squash("CASE WHEN p > 0 THEN " + D.strip("substr(b, 1, p - 1)") + " ELSE split_part(b, chr(10), 1) END")} AS question,
           {D.squash("CASE WHEN p > 0 THEN substr(b, p) WHEN contains(b, chr(10)) THEN substr(b, instr(b, chr(10)) + 1) ELSE b END")} AS answer
    FROM (SELECT 'file://pdf/doc-' || doc_id || '.txt' AS url, 'text archive' AS source, b, instr(b, 'tion ') AS p
          FROM (SELECT doc_id, nfc_normalize({D.squash('text')}) AS b FROM documents) WHERE len(b) >= 40)""",
)
def _(t):
    return files.text_records(as_files(t, F.lit(".txt")), "text archive", marker="tion ").select("url", "source", "question", "answer")


@query(
    "gate_upload_files",
    oracle=rf"""
    WITH f AS (SELECT doc_id, encode(text) AS raw, nfc_normalize(text) AS text, [' ', '.txt', '.TXT', '.pdf', '.doc'][doc_id % 4 + 2] AS suffix FROM documents),
         l AS (SELECT *, {D.lines(D.squash('text'))} AS ls FROM f),
         b AS (SELECT *, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10)) AS body FROM l)
    SELECT 'doc-' || doc_id || suffix AS name, CASE WHEN suffix = '.doc' THEN 'only pdf or txt files' WHEN octet_length(raw) > 20000 THEN 'file too large'
             WHEN suffix = '.pdf' AND len(regexp_extract_all(body, '[\x{{0600}}-\x{{06FF}}]')) < 50 THEN 'text not readable'
             WHEN len(body) < 50 THEN 'text too short' END AS reason,
           CASE WHEN suffix <> '.doc' AND octet_length(raw) <= 20000 THEN CAST(len(body) AS BIGINT) END AS n_chars
    FROM b""",
)
def _(t):
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".TXT", ".pdf", ".doc"))), (C("doc_id") % 4 + 1).cast("int"))
    gated = files.gate_upload_files(as_files(t, suffix), max_bytes=20_000)
    return gated.select("name", "reason", F.length("body").cast("long").alias("n_chars"))


@query(
    "sitemap_urls",
    oracle=f"""
    SELECT DISTINCT url FROM (SELECT {D.canonical("u")} AS url FROM (
        SELECT 'http://Maps.Example.org/2024/01/1' || page_id % 10 || '/p' || regexp_extract(html, 'href="/([A-Za-z]+)', 1) || '/#x' AS u FROM pages
        UNION ALL SELECT 'https://maps.example.org/?p=' || regexp_extract(url, '/([0-9]+)', 1) FROM pages WHERE regexp_matches(url, '/[0-9]+')))""",
)
def _(t):
    # Every page stands for an index document and for the map it names, which lists its first link; one map of each index does not exist.
    pid, number = C("page_id").cast("string"), F.regexp_extract("url", "/([0-9]+)", 1)
    slug = F.regexp_extract("html", 'href="/([A-Za-z]+)', 1)
    post = F.concat(F.lit("http://Maps.Example.org/2024/01/1"), (C("page_id") % 10).cast("string"), F.lit("/p"), slug, F.lit("/#x"))
    loc = lambda *parts: F.concat(F.lit("<url><loc> "), *parts, F.lit(" </loc></url>\n"))
    direct = F.when(number != "", loc(F.lit("https://maps.example.org/?p="), number)).otherwise(loc(F.lit("https://maps.example.org/about")))
    maps = t.pages.select(F.concat(F.lit("http://maps.example.org/m"), pid, F.lit(".xml")).alias("doc_url"), F.concat(F.lit("<urlset>"), loc(post), F.lit("</urlset>")).alias("body"))
    indexes = t.pages.select(
        F.concat(F.lit("http://maps.example.org/index"), pid).alias("doc_url"),
        F.concat(loc(F.lit("http://maps.example.org/m"), pid, F.lit(".xml")), loc(F.lit("http://maps.example.org/gone"), pid, F.lit(".XML")), direct).alias("body"),
    )
    return files.sitemap_urls(maps.unionByName(indexes), U.post_url, roots=F.contains(C("doc_url"), F.lit("/index")))


@query("decode_bytes", oracle="SELECT doc_id, text FROM documents")
def _(t):
    charset = F.when(C("doc_id") % 3 == 0, F.lit("utf-16be")).when(C("doc_id") % 3 == 1, F.lit("utf-8"))
    raw = F.when(C("doc_id") % 3 == 0, F.encode("text", "utf-16be")).otherwise(F.encode("text", "utf-8"))
    docs = t.documents.select("doc_id", raw.alias("content"), charset.alias("charset"))
    return docs.select("doc_id", files.decode_bytes(C("content"), C("charset")).alias("text"))


CHARSET_OF = [f"WHEN {k} THEN '{c}'" for k, c in enumerate(charsets.CHARSETS)]
CHARSET_OF = f"CASE doc_id % {len(charsets.CHARSETS)} {' '.join(CHARSET_OF)} END"


@F.pandas_udf(BinaryType())
def _encoded(text: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else x.encode(c, errors="replace") for x, c in zip(text, charset)], dtype=object)


@query(
    "detect_charset",
    oracle=f"""SELECT charset, count(*) AS n_texts, sum(CASE WHEN strlen(text) >= 200 THEN 1 ELSE 0 END) AS n_long, true AS found
       FROM (SELECT {CHARSET_OF} AS charset, text FROM documents) AS a GROUP BY charset""",
)
def _(t):
    """Texts in six charsets, told apart by their bytes; ``found`` if of 200 bytes and more at least 98 % are decoded right."""
    docs = t.documents.select("doc_id", "text", F.expr(CHARSET_OF).alias("charset"))
    detector = charsets.Detector(charsets.learn_pairs(docs))
    read = docs.withColumn("got", detector.decode_detected(_encoded("text", "charset")))
    long = F.octet_length("text") >= 200
    right = F.count_if(long & C("got").eqNullSafe(C("text"))) >= 0.98 * F.count_if(long)
    return read.groupBy("charset").agg(F.count("*").alias("n_texts"), F.count_if(long).alias("n_long"), right.alias("found"))


@query(
    "keyed_store",
    "incoming",
    """SELECT url, max(seq) AS seq, arg_max(source, seq) AS source, md5(arg_max(answer, seq)) AS answer_md5 FROM incoming
       WHERE url NOT IN (SELECT url FROM incoming JOIN labels ON doc_id = seq WHERE toxic = 1) GROUP BY url""",
)
def _(t):
    store = KeyedStore(t.spark, staging_path(t.spark, "keyed-store"), "url string, seq long, source string, answer string", "url", "seq", 16)
    early = F.coalesce(C("category"), F.lit("")) == ""
    store.upsert(t.incoming.filter(~early))
    store.upsert(t.incoming.filter(early))
    store.delete(t.incoming.join(t.labels.filter("toxic = 1"), C("doc_id") == C("seq")))
    return store.table().select("url", "seq", "source", F.md5("answer").alias("answer_md5"))
