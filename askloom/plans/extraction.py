"""Page extraction queries. Template pages are derived from the documents, so their contents are known."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import extraction as O
from askloom.plans import duck as D
from askloom.plans.registry import query
from askloom.sources.html_nodes import TEXT, html_nodes

C = F.col
S = O.Sel


def esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "html_elements",
    oracle=r"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)(?:\s[^>]*)?>', 1))) AS tag FROM pages) GROUP BY ALL""",
)
def _(t):
    nodes = html_nodes(t.pages).select("page_id", F.explode("nodes").alias("n"))
    return nodes.filter(C("n.tag") != TEXT).groupBy("page_id", C("n.tag").alias("tag")).agg(F.count("*").alias("n"))


@query("first_match_field", oracle=f"SELECT page_id, {D.squash(D.unescape("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS title FROM pages")
def _(t):
    rules = [O.Rule((S(tag=("h1",), cls=("entry",)),)), O.Rule((S(tag=("h1",)),)), O.Rule((S(tag=("title",)),))]
    return html_nodes(t.pages).select("page_id", O.first_match_field(C("nodes"), rules).alias("title"))


@query(
    "strip_noise",
    oracle=f"""SELECT page_id, {D.squash(D.unescape("regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<div class=.ad.>.*?</div>', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"))} AS body FROM pages""",
)
def _(t):
    noise = (S(tag=("head", "nav", "footer")), S(tag=("div",), cls=("ad",)))
    return html_nodes(t.pages).select("page_id", O.page_text(O.strip_noise(C("nodes"), noise)).alias("body"))


@query("clean_text", oracle=f"SELECT page_id, {D.page_text('html')} AS body FROM pages")
def _(t):
    return html_nodes(t.pages).select("page_id", O.clean_text(C("nodes")).alias("body"))


@query("readable_text")
def _(t):
    return html_nodes(t.pages).select("page_id", O.readable_text(C("nodes")).alias("body"))


# Template pages: the answer's lines become paragraphs.
A_PARAS = """concat('<p>', replace({a}, chr(10), '</p><p>'), '</p>')"""
ASK = "concat('Question about this matter: ', question)"
URL = "concat('https://q.example.org/2024/03/0', CAST(1 + id % 9 AS STRING), '/p', CAST(id AS STRING), '/')"


def template(t, html: str):
    return t.records.selectExpr("id AS page_id", f"{URL} AS url", f"{html} AS html")


BOLD = f"""concat('<html><head><title>x</title></head><body><nav><div class="breadcrumb"><a href="/">Home</a><a href="/c">', {esc("coalesce(category, '')")}, ' group</a></div></nav><div id="printthis"><div class="hidden-print">noise</div>',
    '<p class="UrduTextNafeesPara"><b class="text-danger">سوال:</b> ', {esc(ASK)}, '</p><p class="UrduTextNafeesPara"><b class="text-danger">جواب:</b>', replace({esc("answer")}, chr(10), '</p><p>'), '</p></div></body></html>')"""

D_CAND = f"""
    l AS (SELECT *, list_transform(string_split(answer, chr(10)), lambda l: {D.squash('l')}) AS ls FROM (SELECT id, source, category, nfc_normalize(question) AS question, nfc_normalize(answer) AS answer FROM records))"""


def d_dedupe(x: str) -> str:
    return f"array_to_string(list_filter({D.lines(x)}, lambda x, i: list_position({D.lines(x)}, x) = i), chr(10))"


@query(
    "split_qa_label",
    "records",
    f"""WITH {D_CAND}, a AS (SELECT id, category, {D.squash("'Question about this matter: ' || question")} AS q0,
            array_to_string(list_filter(list_transform(ls, lambda x, i: CASE WHEN i = 1 OR len(x) > 5 THEN x ELSE '' END), lambda x: x <> ''), chr(10) || chr(10)) AS a0 FROM l)
    SELECT id AS page_id, q0 AS question, a0 AS answer FROM a""",
)
def _(t):
    nodes = html_nodes(template(t, BOLD))
    return nodes.select("page_id", O.split_qa_label(C("nodes"), None).alias("s")).select("page_id", "s.question", "s.answer")


@query(
    "bold_labels",
    "records",
    f"""WITH {D_CAND}, a AS (SELECT id, category, {D.squash("'Question about this matter: ' || question")} AS q0,
            array_to_string(list_filter(list_transform(ls, lambda x, i: CASE WHEN i = 1 OR len(x) > 5 THEN x ELSE '' END), lambda x: x <> ''), chr(10) || chr(10)) AS a0 FROM l),
        f AS (SELECT id, category, {d_dedupe('q0')} AS question, {d_dedupe("CASE WHEN a0 <> '' THEN a0 ELSE 'سوال:' || chr(10) || q0 || chr(10) || 'جواب:' END")} AS answer FROM a)
    SELECT id AS page_id, question, answer, {D.squash("coalesce(category, '') || ' group'")} AS category,
           CASE WHEN answer = '' THEN 'empty' WHEN len(question) < 20 THEN 'question too short' WHEN len(answer) < 50 THEN 'answer too short' END AS reason FROM f""",
)
def _(t):
    return O.extract_records(template(t, BOLD), "bold_labels", "archive").select("page_id", "question", "answer", "category", "reason")


DIVS = f"""concat('<html><body><div class="sidebar">side<div class="question-text">wrong</div></div><div class="question-details"><div class="question-info"><span class="category"> ', {esc("coalesce(category, '')")}, ' </span>',
    CASE WHEN id % 2 = 0 THEN '<span class="date">3 May  2023</span>' ELSE '' END, '</div><div class="question-text">', {esc(ASK)}, '</div><div class="answer-text">', {esc("answer")}, '</div></div><a href="/questions/7">listed</a></body></html>')"""


@query(
    "labelled_divs",
    "records",
    f"""SELECT id AS page_id, question, answer, category, CASE WHEN id % 2 = 0 THEN '3 May 2023' ELSE '2024-03-0' || (1 + id % 9) END AS date,
           CASE WHEN answer = '' THEN 'empty' WHEN len(answer) < 50 THEN 'answer too short' WHEN question = answer THEN 'question equals answer' END AS reason
    FROM (SELECT id, {d_dedupe(D.squash("'Question about this matter: ' || nfc_normalize(question)"))} AS question, {d_dedupe(D.squash("nfc_normalize(answer)"))} AS answer, CASE WHEN coalesce(category, '') = '' THEN 'listed' ELSE category END AS category FROM records)""",
)
def _(t):
    return O.extract_records(template(t, DIVS), "labelled_divs", "archive").select("page_id", "question", "answer", "category", "date", "reason")


POSTS = f"""concat('<html><head><meta property="article:published_time" content="2024-02-0', CAST(1 + id % 9 AS STRING), 'T00:00:00"></head><body><h1 class="entry-title">Title</h1><div class="sidebar">الجواب wrong</div>',
    '<div class="entry-content"><div><p>سوال: ', {esc(ASK)}, '</p><p>الجواب</p><p>An answer of at least fifty characters follows here, as such: </p>', {A_PARAS.format(a=esc("answer"))}, '</div></div><div class="cat-links"><a href="/x">', {esc("coalesce(category, '')")}, '</a></div></body></html>')"""


@query(
    "marker_posts",
    "records",
    f"""SELECT id AS page_id, {d_dedupe(D.squash("'Question about this matter: ' || nfc_normalize(question)"))} AS question,
        {d_dedupe(D.squash("'الجواب' || chr(10) || 'An answer of at least fifty characters follows here, as such: ' || chr(10) || nfc_normalize(answer)"))} AS answer, nullif(category, '') AS category, '2024-02-0' || (1 + id % 9) AS date FROM records""",
)
def _(t):
    return O.extract_records(template(t, POSTS), "marker_posts", "archive").select("page_id", "question", "answer", "category", "date")


HEADS = f"""concat('<html><body><header>سوال head</header><article><div class="cate_sec">A >> ', {esc("coalesce(category, '')")}, ' سوال نمبر: 7</div><h2>سوال</h2><p>سوال: ', {esc(ASK)}, '</p><h2>جواب</h2><p>Fatwa : 12/34</p>', {A_PARAS.format(a=esc("answer"))},
    '<p>واللہ اعلم end</p><p>this must not be part of the answer</p></article></body></html>')"""


@query(
    "heading_walk",
    "records",
    f"""WITH {D_CAND}, a AS (SELECT id, category, {d_dedupe(D.squash("'Question about this matter: ' || question"))} AS q, array_to_string(list_filter(ls, lambda x: len(x) > 5), chr(10) || chr(10)) AS a0 FROM l),
        d AS (SELECT *, {d_dedupe('a0')} AS a FROM a)
    SELECT id AS page_id, CASE WHEN len(a0) >= 30 AND len(a) >= 30 THEN q ELSE '' END AS question, CASE WHEN len(a0) >= 30 AND len(a) >= 30 THEN a ELSE '' END AS answer,
           CASE WHEN len(a0) >= 30 AND len(a) >= 30 THEN 'A — ' || coalesce(category, '') END AS category FROM d""",
)
def _(t):
    return O.extract_records(template(t, HEADS), "heading_walk", "archive").select("page_id", "question", "answer", "category")


LINKED = f"""concat('<html><head><meta property="article:section" content="', CASE WHEN id % 2 = 0 THEN 'Section' ELSE '' END, '"></head><body><main><h1 class="text-lg font-bold">', {esc(ASK)}, '</h1><a href="/d/x">Other group</a><span>on 12-03-2023</span>',
    CASE WHEN id % 3 = 0 THEN concat('<iframe src="/viewer.html?file=https%3A%2F%2Ff.example.org%2F', CAST(id AS STRING), '.pdf"></iframe>')
         WHEN id % 3 = 1 THEN concat('<a href="https://f.example.org/', CAST(id AS STRING), '.pdf">doc</a>') ELSE '' END, '</main></body></html>')"""


@query(
    "linked_documents",
    "records",
    f"""SELECT id AS page_id, question, CASE WHEN id % 3 < 2 THEN answer END AS answer, CASE WHEN id % 2 = 0 THEN 'Section' ELSE 'Other group' END AS category, 'on 12-03-2023' AS date,
        CASE WHEN id % 3 = 2 OR answer = '' THEN 'empty' WHEN len(question) < 10 THEN 'question too short' WHEN len(answer) < 30 THEN 'answer too short'
             WHEN NOT (len(answer) >= 30 AND k >= 40 AND k / nullif(k + lat, 0) >= 0.1 AND lat <= k) THEN 'answer not readable' END AS reason
    FROM (SELECT *, len(regexp_extract_all(answer, '[A-Za-z]')) AS lat, len(regexp_extract_all(answer, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]')) AS k
          FROM (SELECT id, {d_dedupe(D.squash("'Question about this matter: ' || nfc_normalize(question)"))} AS question, {d_dedupe(D.squash("nfc_normalize(answer)"))} AS answer FROM records))""",
)
def _(t):
    docs = t.records.select(
        F.concat(F.lit("https://f.example.org/"), C("id").cast("string"), F.lit(".pdf")).alias("doc_url"), O.T.normalize_text(C("answer")).alias("body")
    )
    out = O.linked_records(template(t, LINKED), docs, "archive", r"[A-Za-z\x{00C0}-\x{024F}]", 0.1)
    return out.select("page_id", "question", "answer", "category", "date", "reason")
