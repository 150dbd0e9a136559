"""Scalar operators over document texts, page URLs and page titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import qa as Q
from askloom.functions import text as T
from askloom.functions import urls as U
from askloom.operators import ingest
from askloom.plans import duck as D
from askloom.plans.registry import query

STOP = ("the", "that", "this", "have", "with", "dans", "pour", "avec", "para", "como", "nicht", "eine")
C = F.col


@query("normalize_text", oracle=f"SELECT doc_id, nfc_normalize({D.squash('text')}) AS body FROM documents")
def _(t):
    return t.documents.select("doc_id", T.normalize_text(C("text")).alias("body"))


@query("canonical_url", oracle=f"SELECT page_id, {D.canonical('url')} AS url FROM pages")
def _(t):
    return t.pages.select("page_id", U.canonical_url(C("url")).alias("url"))


@query(
    "strip_query_keys",
    oracle="""
    SELECT page_id, CASE WHEN q = '' THEN url WHEN kept = '' THEN base ELSE base || '?' || kept END AS url
    FROM (SELECT *, array_to_string(list_filter(string_split(q, '&'),
                     lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('utm_source', 'ref')), '&') AS kept
          FROM (SELECT page_id, url, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q,
                       regexp_extract(url, '^[^?#]*') AS base FROM pages))""",
)
def _(t):
    return t.pages.select("page_id", U.strip_query_keys(C("url"), ["utm_source", "ref"]).alias("url"))


@query("content_hash", "records", "SELECT id, sha256(question || chr(10) || answer) AS content_hash FROM records")
def _(t):
    return t.records.select("id", T.content_hash(C("question"), C("answer")).alias("content_hash"))


@query(
    "dedupe_lines",
    oracle=f"""
    WITH s AS (SELECT doc_id, {D.lines('text')} AS ls FROM documents),
         l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
         f AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY ALL)
    SELECT s.doc_id, coalesce(string_agg(f.line, chr(10) ORDER BY f.pos), '') AS body
    FROM s LEFT JOIN f USING (doc_id) GROUP BY s.doc_id""",
)
def _(t):
    return t.documents.select("doc_id", T.dedupe_lines(C("text")).alias("body"))


@query("html_to_text", oracle=f"SELECT page_id, {D.page_text('html')} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", T.html_to_text(C("html")).alias("body"))


@query(
    "script_counts",
    oracle=r"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]')) AS BIGINT) AS script_chars,
           CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS latin_chars,
           CAST(len(regexp_extract_all(text, '[\x{00C0}-\x{024F}]')) AS BIGINT) AS accented_chars
    FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id",
        T.script_counts(C("text")).alias("n"),
        T.script_counts(C("text"), r"[\x{00C0}-\x{024F}]")["script_chars"].alias("accented_chars"),
    ).select("doc_id", "n.script_chars", "n.latin_chars", "accented_chars")


@query(
    "readable_script",
    oracle=rf"""
    SELECT doc_id, lang, (len(body) >= 30 AND native >= 40 AND native / nullif(native + latin, 0) >= 0.2 AND latin <= native) IS TRUE AS strict_ok,
           (len(body) >= 30 AND vowels >= 40 AND vowels / nullif(vowels + latin, 0) >= 0.3 AND latin <= vowels) IS TRUE AS vowel_ok
    FROM (SELECT doc_id, lang, {D.strip('text')} AS body, len(regexp_extract_all(text, '[A-Za-z]')) AS latin,
                 len(regexp_extract_all(text, '[\x{{00C0}}-\x{{024F}}]')) AS native,
                 len(regexp_extract_all(text, '[\x{{00C0}}-\x{{024F}}a-zA-Z]')) AS vowels FROM documents)""",
)
def _(t):
    return t.documents.select(
        "doc_id",
        "lang",
        T.readable_script(C("text"), r"[\x{00C0}-\x{024F}]", min_share=0.2).alias("strict_ok"),
        T.readable_script(C("text"), r"[\x{00C0}-\x{024F}a-zA-Z]", min_share=0.3).alias("vowel_ok"),
    )


@query(
    "blocked_page",
    oracle="""
    SELECT page_id, html = '' OR contains(html, 'track(0)') OR contains(html, 'spam-farm') AS blocked
    FROM pages""",
)
def _(t):
    return t.pages.select("page_id", T.blocked_page(C("html"), ("track(0)", "spam-farm")).alias("blocked"))


@query(
    "preview",
    "records",
    """SELECT id, substr(answer, 1, 200) || CASE WHEN len(answer) > 200 THEN '...' ELSE '' END AS preview,
              substr(question, 1, 150) AS clipped FROM records""",
)
def _(t):
    return t.records.select("id", T.preview(C("answer")).alias("preview"), F.substring("question", 1, 150).alias("clipped"))


@query("blank_to_null", "records", f"SELECT id, nullif({D.strip('category')}, '') AS category FROM records")
def _(t):
    return t.records.select("id", T.blank_to_null(C("category")).alias("category"))


@query(
    "like_escape",
    oracle=r"""
    SELECT page_id, contains(html, '%% ') AS has_percent, contains(lower(url), 'utm_source') AS has_key,
           contains(html, '\') AS has_backslash FROM pages""",
)
def _(t):
    return t.pages.select(
        "page_id",
        T.contains_literal(C("html"), "%% ").alias("has_percent"),
        T.contains_literal(C("url"), "UTM_source").alias("has_key"),
        T.contains_literal(C("html"), "\\").alias("has_backslash"),
    )


@query(
    "keywords",
    oracle=rf"""
    WITH s AS (SELECT doc_id, list_transform(regexp_split_to_array({D.strip('text')}, '{D.WS}+'),
                      lambda w: trim(w, '.,:;!?()[]{{}}"''')) AS ws FROM documents),
         w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM s),
         f AS (SELECT doc_id, w, min(pos) AS pos FROM w WHERE len(w) > 3 AND w NOT IN {STOP} GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM f)
    SELECT s.doc_id, coalesce(string_agg(r.w, ' ' ORDER BY k), '') AS keywords
    FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND k <= 3 GROUP BY s.doc_id""",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(T.keywords(C("text"), STOP), " ").alias("keywords"))


DATED = """concat(url, CASE WHEN page_id % 3 = 0 THEN concat('/2024/0', CAST(1 + page_id % 9 AS STRING), '/1', CAST(page_id % 10 AS STRING), '/x/')
                         WHEN page_id % 3 = 1 THEN concat('/1', CAST(page_id % 10 AS STRING), '-0', CAST(1 + page_id % 9 AS STRING), '-2023/') ELSE '' END)"""


@query(
    "date_from_url",
    oracle=f"""
    SELECT page_id, coalesce(nullif(regexp_extract({D.path('u')}, '/([0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}})/?$', 1), ''),
           nullif(concat_ws('-', regexp_extract(u, '/([0-9]{{4}})/([0-9]{{2}})/([0-9]{{2}})/', 1), regexp_extract(u, '/([0-9]{{4}})/([0-9]{{2}})/([0-9]{{2}})/', 2),
                  regexp_extract(u, '/([0-9]{{4}})/([0-9]{{2}})/([0-9]{{2}})/', 3)), '--')) AS date
    FROM (SELECT page_id, {DATED} AS u FROM pages)""",
)
def _(t):
    return t.pages.select("page_id", U.date_from_url(F.expr(DATED)).alias("date"))


@query(
    "find_date",
    oracle=r"""
    SELECT o_orderkey, regexp_extract(s, '([0-9]{2}[-/][0-9]{2}[-/][0-9]{4}|[0-9]{4}[-/][0-9]{2}[-/][0-9]{2})', 1) AS found
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'placed ' || strftime(o_orderdate, '%d/%m/%Y') || ' ok'
                 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' then ' || strftime(o_orderdate, '%d-%m-%Y') ELSE o_orderpriority END AS s FROM orders)""",
)
def _(t):
    s = (
        F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit("placed "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" ok")))
        .when(C("o_orderkey") % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" then "), F.date_format("o_orderdate", "dd-MM-yyyy")))
        .otherwise(C("o_orderpriority"))
    )
    return t.orders.select("o_orderkey", T.date_in_text(s).alias("found"))


FRONTED = "concat('https://q.example.org', CASE WHEN page_id % 3 = 0 THEN '/index.php/INDEX.php' WHEN page_id % 3 = 1 THEN '/index.php' ELSE '' END, regexp_extract(url, '//[^/]*(/[^?#]*)', 1))"
D_SEG = rf"list_filter(string_split(regexp_replace({D.path('u')}, '(?i)^(/index\.php)+/', '/'), '/'), lambda s: s <> '')"


@query(
    "url_segments",
    oracle=f"SELECT page_id, array_to_string({D_SEG}, '>') AS segments, CAST(len({D_SEG}) AS BIGINT) AS n FROM (SELECT page_id, {FRONTED} AS u FROM pages)",
)
def _(t):
    return (
        t.pages.select("page_id", U.url_segments(F.expr(FRONTED)).alias("s"))
        .select("page_id", F.array_join("s", ">").alias("segments"), F.size("s").cast("long").alias("n"))
    )


DETAIL = """concat(CASE WHEN page_id % 2 = 0 THEN 'https://www.Q.example.org' ELSE 'http://q.example.org' END,
                   CASE WHEN page_id % 5 = 0 THEN '/index.php/home' WHEN page_id % 5 = 1 THEN '/other' ELSE '/home' END,
                   regexp_extract(url, '//[^/]*(/[a-z]+/)', 1),
                   CASE WHEN page_id % 7 = 0 THEN 'search' ELSE 'slug' END, '/', regexp_extract(url, '/([0-9]+)', 1), '/?x=1')"""


@query(
    "canonical_detail_url",
    oracle=rf"""
    SELECT page_id, CASE WHEN regexp_replace({D.host('u')}, '^www\.', '') = 'q.example.org' AND len(seg) = 4 AND seg[1] = 'home'
           AND seg[2] IN ('en', 'fr') AND seg[3] NOT IN ('search', 'page') AND regexp_full_match(seg[4], '[0-9]+')
           THEN 'https://q.example.org/' || array_to_string(seg, '/') END AS url
    FROM (SELECT page_id, u, {D_SEG} AS seg FROM (SELECT page_id, {DETAIL} AS u FROM pages))""",
)
def _(t):
    return t.pages.select(
        "page_id",
        U.canonical_detail_url(F.expr(DETAIL), "q.example.org", ("search", "page"), langs=("en", "fr")).alias("url"),
    )


@query(
    "url_variants",
    oracle=rf"""
    WITH c AS (SELECT page_id, {D.canonical('url')} AS u FROM pages),
         h AS (SELECT page_id, split_part(u, '://', 1) || '://' || w || regexp_replace({D.host('u')}, '^www\.', '') AS origin,
                      regexp_extract(u, '^[^:]*://[^/?#]*(.*)', 1) AS rest FROM c, (VALUES (''), ('www.')) AS v(w))
    SELECT DISTINCT page_id, url FROM (SELECT page_id, origin || rest AS url FROM h
        UNION ALL SELECT page_id, CASE WHEN rest = '/' THEN origin || '/index.php' ELSE origin || '/index.php' || rest END FROM h)""",
)
def _(t):
    return t.pages.select("page_id", F.explode(U.url_variants(C("url"))).alias("url"))


@query(
    "resolve_href",
    oracle=rf"""
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages),
         h AS (SELECT page_id, url, unnest([href, ltrim(href, '/'), '?p=' || ltrim(href, '/'), '#' || ltrim(href, '/'), '//cdn.example.org' || href]) AS href FROM l)
    SELECT page_id, href, CASE WHEN href LIKE '//%' THEN regexp_extract(url, '^[a-z]+:') || href
           WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href
           WHEN href LIKE '?%' THEN regexp_extract(url, '^[^?#]*') || href
           WHEN href LIKE '#%' THEN regexp_extract(url, '^[^#]*') || href
           ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)[^/?#]*', 1) || href END AS url
    FROM h""",
)
def _(t):
    from askloom.operators.crawlset import extract_links

    href, bare = C("href"), F.ltrim(C("href"), F.lit("/"))
    forms = F.array(href, bare, F.concat(F.lit("?p="), bare), F.concat(F.lit("#"), bare), F.concat(F.lit("//cdn.example.org"), href))
    links = extract_links(t.pages).select("page_id", C("page_url").alias("base"), F.explode(forms).alias("href"))
    return links.select("page_id", "href", U.resolve_href(C("base"), C("href")).alias("url"))


@query(
    "strip_prefix_label",
    "records",
    f"""SELECT id, regexp_replace(regexp_replace('Frage : ' || question, '^{D.WS}*Frage{D.WS}*[:：۔]?{D.WS}*', ''), '^{D.WS}*The{D.WS}*[:：۔]?{D.WS}*', '') AS question
        FROM records""",
)
def _(t):
    labelled = F.concat(F.lit("Frage : "), C("question"))
    return t.records.select("id", T.strip_prefix_label(T.strip_prefix_label(labelled, "Frage"), "The").alias("question"))


@query(
    "trim_signature",
    oracle=f"""
    SELECT doc_id, {D.strip("CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE text END")} AS body, p > 0 AS stopped
    FROM (SELECT doc_id, text, CASE WHEN instr(text, 'License') > 0 THEN instr(text, 'License')
                 WHEN instr(text, 'wh the') > 0 THEN instr(text, 'wh the') ELSE 0 END AS p FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", T.trim_signature(C("text"), ("License", "wh the")).alias("s")).select("doc_id", "s.body", "s.stopped")


@query("record_number", oracle=r"""SELECT event_id, regexp_extract(props, 'k"?[:\s]+([0-9/]+)', 1) AS number FROM events""")
def _(t):
    return t.events.select("event_id", T.record_number(C("props"), 'k"?').alias("number"))


D_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(
    "title_trim",
    oracle=f"""
    SELECT page_id, {D.strip("split_part(" + D.strip("split_part(x, ' | ', 1)") + ", ' - ', 1)")} AS title,
           {D.strip("CASE WHEN contains(x, ' - ') THEN split_part(x, ' - ', 1) WHEN contains(x, ' | ') THEN split_part(x, ' | ', 1) ELSE split_part(x, ' :: ', 1) END")} AS first_cut
    FROM (SELECT page_id, title || CASE page_id % 4 WHEN 0 THEN ' | Site - Home' WHEN 1 THEN ' - Home' WHEN 2 THEN ' :: Site' ELSE '' END AS x FROM (SELECT page_id, {D.squash(D_TITLE)} AS title FROM pages))""",
)
def _(t):
    r = C("page_id") % 4
    suffix = F.when(r == 0, F.lit(" | Site - Home")).when(r == 1, F.lit(" - Home")).when(r == 2, F.lit(" :: Site")).otherwise(F.lit(""))
    titles = t.pages.select("page_id", F.concat(T.squash(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), suffix).alias("x"))
    return titles.select(
        "page_id", T.title_trim(C("x")).alias("title"), T.title_trim(C("x"), (" - ", " | ", " :: "), first_only=True).alias("first_cut")
    )


HOMES = "CASE WHEN page_id % 4 = 0 THEN concat(regexp_extract(url, '^[^?#]*//[^/]*'), '/Default.aspx') WHEN page_id % 4 = 1 THEN '/' ELSE url END"


@query(
    "homepage_url",
    oracle=f"SELECT page_id, u IN ('', '/', 'https://a.org', 'https://a.org/') OR lower(u) LIKE '%/default.aspx' OR lower(u) LIKE '%/index.aspx' OR lower(u) LIKE '%/home.aspx' AS is_home FROM (SELECT page_id, {HOMES} AS u FROM pages)",
)
def _(t):
    return t.pages.select("page_id", U.homepage_url(F.expr(HOMES.replace("//[^/]*')", "//[^/]*', 0)")), "https://a.org").alias("is_home"))


@query(
    "month_bounds",
    oracle=rf"""
    SELECT month, {D.ts("m")} AS month_start, {D.ts("m + INTERVAL 1 MONTH")} AS month_end, n
    FROM (SELECT month, CAST(count(*) AS BIGINT) AS n, CASE WHEN regexp_full_match(month, '[0-9]{{4}}-(0[1-9]|1[0-2])') THEN CAST(month || '-01' AS TIMESTAMP) END AS m
          FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN strftime(o_orderdate, '%Y/%m') ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders) GROUP BY month)""",
)
def _(t):
    month = F.when(C("o_orderkey") % 50 == 0, F.date_format("o_orderdate", "yyyy/MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    per_month = t.orders.groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    b = per_month.select("month", "n", T.month_bounds(C("month")).alias("b"))
    return b.select("month", F.date_format("b.month_start", fmt).alias("month_start"), F.date_format("b.month_end", fmt).alias("month_end"), "n")


@query(
    "category_join",
    "records",
    """SELECT id, CASE WHEN nullif(category, '') IS NOT NULL AND sub <> '' AND sub <> category THEN category || ' — ' || sub
                        ELSE coalesce(nullif(category, ''), nullif(sub, '')) END AS category
       FROM (SELECT *, CASE WHEN id % 3 = 0 THEN source WHEN id % 3 = 1 THEN '' ELSE category END AS sub FROM records)""",
)
def _(t):
    r = C("id") % 3
    sub = F.when(r == 0, C("source")).when(r == 1, F.lit("")).otherwise(C("category"))
    return t.records.select("id", T.category_join(C("category"), sub).alias("category"))


@query(
    "meaningful_category",
    "records",
    f"""SELECT id, coalesce(len({D.strip('c')}) >= 4 AND lower({D.strip('c')}) NOT IN ('home', 'index', 'main', 'صفحہ اول', 'خانہ'), false) AS ok
        FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'Home ' WHEN id % 3 = 1 THEN source ELSE category END AS c FROM records)""",
)
def _(t):
    r = C("id") % 3
    c = F.when(r == 0, F.lit("Home ")).when(r == 1, C("source")).otherwise(C("category"))
    return t.records.select("id", T.meaningful_category(c).alias("ok"))


@query(
    "domain_check",
    "subscriptions users",
    """SELECT s.id, concat_ws(';', CASE WHEN plan NOT IN ('free', 'monthly') THEN 'plan' END, CASE WHEN status NOT IN ('active', 'expired') THEN 'status' END,
              CASE WHEN expires_at IS NULL THEN 'expires_at' END, CASE WHEN len(CAST(user_id AS VARCHAR)) NOT BETWEEN 2 AND 3 THEN 'user_id' END) AS reason
       FROM subscriptions s""",
)
def _(t):
    rules = [
        ingest.Domain("plan", values=("free", "monthly")),
        ingest.Domain("status", values=("active", "expired")),
        ingest.Domain("expires_at", required=True),
        ingest.Domain("user_id", length=(2, 3)),
    ]
    return ingest.domain_check(t.subscriptions, rules).select("id", "reason")


# Splitters over whole document texts, with markers of the given languages ------------------------------------

Q_MARK, A_MARK = "the", "and"
PRIO = ("wherever", "que de", "the ", "und ")


@query(
    "split_qa_marker",
    oracle=f"""
    SELECT doc_id, {D.squash("CASE WHEN p > 0 THEN " + D.strip("substr(b, 1, p - 1)") + " ELSE split_part(b, chr(10), 1) END")} AS question,
           {D.squash("CASE WHEN p > 0 THEN substr(b, p) WHEN contains(b, chr(10)) THEN substr(b, instr(b, chr(10)) + 1) ELSE b END")} AS answer
    FROM (SELECT doc_id, b, instr(b, 'tion ') AS p FROM (SELECT doc_id, nfc_normalize({D.squash('text')}) AS b FROM documents))""",
)
def _(t):
    body = t.documents.select("doc_id", T.normalize_text(C("text")).alias("b"))
    return body.select("doc_id", Q.split_qa_marker(C("b"), "tion ").alias("s")).select("doc_id", "s.question", "s.answer")


@query(
    "split_qa_priority",
    oracle=f"""
    SELECT doc_id, {D.squash("substr(b, 1, p - 1)")} AS question, {D.squash("substr(b, p)")} AS answer
    FROM (SELECT doc_id, b, CASE {' '.join(f"WHEN contains(b, '{m}') THEN instr(b, '{m}')" for m in PRIO)} ELSE 501 END AS p
          FROM (SELECT doc_id, nfc_normalize({D.squash('text')}) AS b FROM documents))""",
)
def _(t):
    body = t.documents.select("doc_id", T.normalize_text(C("text")).alias("b"))
    return body.select("doc_id", Q.split_qa_priority(C("b"), PRIO).alias("s")).select("doc_id", "s.question", "s.answer")


@query(
    "split_qa_earliest",
    oracle=f"""
    SELECT doc_id, CASE WHEN ok THEN q ELSE '' END AS question, CASE WHEN ok THEN a ELSE '' END AS answer
    FROM (SELECT doc_id, q, a, coalesce(p < len(b) - 25 AND len(q) >= 10 AND len(a) >= 30, false) AS ok
          FROM (SELECT doc_id, b, p, {D.strip("substr(b, 1, p)")} AS q, {D.strip("substr(b, p + 1)")} AS a
                FROM (SELECT doc_id, b, list_min(list_filter([instr(b, 'que de') - 1, instr(b, 'the ') - 1, instr(b, 'und ') - 1, instr(b, '. De') - 1], lambda x: x > 20)) AS p
                      FROM (SELECT doc_id, nfc_normalize({D.squash('text')}) AS b FROM documents))))""",
)
def _(t):
    body = t.documents.select("doc_id", T.normalize_text(C("text")).alias("b"))
    marks = ("que de", "the ", "und ", ". De")
    return body.select("doc_id", Q.split_qa_earliest(C("b"), marks).alias("s")).select("doc_id", "s.question", "s.answer")


# Labels put around the first lines so that all branches of the line walk occur.
LABELLED = """concat(CASE WHEN doc_id % 4 = 0 THEN concat('Frage:', chr(10)) WHEN doc_id % 4 = 1 THEN 'Frage : ' WHEN doc_id % 4 = 2 THEN concat('Frage', chr(10)) ELSE '' END,
    split_part(text, chr(10), 1), chr(10), split_part(text, chr(10), 2), chr(10),
    CASE WHEN doc_id % 5 < 2 THEN concat('Antwort', chr(10)) WHEN doc_id % 5 = 2 THEN 'Antwort: ' WHEN doc_id % 5 = 3 THEN 'Antwort ' ELSE '' END, text)"""


@query(
    "split_qa_lines",
    oracle=rf"""
    WITH s AS (SELECT doc_id, {D.lines(LABELLED)} AS ls FROM documents),
         l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM s),
         f AS (SELECT *, regexp_full_match(line, 'Frage\s*[:：]?\s*') AS qa, regexp_matches(line, 'Frage\s*[:：]') AS ql,
                      regexp_full_match(line, 'Antwort\s*[:：]?\s*') AS aa, regexp_matches(line, 'Antwort\s*[:：]') AS al,
                      contains(line, 'License') OR contains(line, 'est la') AS foot FROM l),
         k AS (SELECT doc_id, min(CASE WHEN qa OR ql THEN pos END) AS qp, min(CASE WHEN aa OR al THEN pos END) AS ap FROM f GROUP BY doc_id),
         w AS (SELECT f.*, qp, ap, min(CASE WHEN pos > qp AND contains(line, 'Antwort') THEN pos END) OVER (PARTITION BY f.doc_id) AS qstop,
                      min(CASE WHEN pos > ap AND foot THEN pos END) OVER (PARTITION BY f.doc_id) AS astop FROM f JOIN k USING (doc_id))
    SELECT doc_id, CASE WHEN bool_or(pos = qp AND qa) THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (pos > qp AND pos < coalesce(qstop, 1000000000) AND len(line) > 10), '')
             ELSE coalesce(max(CASE WHEN pos = qp AND len({D.strip("regexp_extract(line, '^(?:.*?)Frage\\s*[:：](.*)$', 1)")}) > 10 THEN {D.strip("regexp_extract(line, '^(?:.*?)Frage\\s*[:：](.*)$', 1)")} END), '') END AS question,
           CASE WHEN bool_or(pos = ap AND aa) THEN coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (pos > ap AND (pos < coalesce(astop, 1000000000) AND len(line) > 5 OR pos = astop)), '')
             ELSE coalesce(max(CASE WHEN pos = ap AND len({D.strip("regexp_extract(line, '^(?:.*?)Antwort\\s*[:：](.*)$', 1)")}) > 10 THEN {D.strip("regexp_extract(line, '^(?:.*?)Antwort\\s*[:：](.*)$', 1)")} END), '') END AS answer
    FROM w GROUP BY doc_id""",
)
def _(t):
    s = Q.split_qa_lines(F.expr(LABELLED), "Frage", "Antwort", ("License", "est la"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.question", "s.answer")


@query(
    "split_qa_state",
    oracle=rf"""
    WITH s AS (SELECT doc_id, {D.lines("nfc_normalize(text)")} AS ls FROM documents),
         l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM s),
         f AS (SELECT *, starts_with(line, 'La') OR starts_with(line, 'The') OR starts_with(line, 'Der') AS isq,
                      contains(line, 'que la') OR contains(line, 'of the') OR starts_with(line, 'De') AS hasa,
                      contains(line, 'est') OR contains(line, 'and') AS ends FROM l),
         r AS (SELECT *, hasa AND NOT isq AS isa, sum(CASE WHEN isq OR hasa THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
         m AS (SELECT *, CASE WHEN run = 0 THEN '' WHEN bool_or(isq) OVER (PARTITION BY doc_id, run) THEN 'q' ELSE 'a' END AS mode,
                      coalesce(max(CASE WHEN ends AND (NOT isa OR len(line) > 20) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM r)
    SELECT s.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (mode = 'q' AND (NOT isq OR len(line) > 10)), '') AS question,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (mode = 'a' AND closed = 0 AND (NOT isa OR len(line) > 20)), '') AS answer
    FROM s LEFT JOIN m USING (doc_id) GROUP BY s.doc_id""",
)
def _(t):
    blocks = T.lines_of(T.unescape_nfc(C("text")))
    s = Q.split_qa_state(blocks, ("La", "The", "Der"), ("que la", "of the"), ("De",), ("est", "and"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.question", "s.answer")
