"""Link, crawl-set and page-field queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.functions import urls as U
from askloom.operators import crawlset as X
from askloom.operators.chains import chain_order
from askloom.plans import duck as D
from askloom.plans.ingest import D_STAGED, D_UPSERTED, staged_pages, upserted
from askloom.plans.registry import query
from askloom.session import staged

C = F.col


def links(t):
    return X.extract_links(t.pages)


@query("extract_links", oracle=f"WITH {D.LINKS} SELECT page_id, pos, href, text, url FROM links")
def _(t):
    return links(t).select("page_id", "pos", "href", "text", "url")


PATTERNS = {"vowels": r"/[AEIOUaeiou][a-z]+$", "short": r"/[a-z]{2,3}$", "accent": r"/[^/]*[éèêóñäü][^/]*$"}


@query(
    "detail_links",
    oracle=f"WITH {D.LINKS} SELECT page_id, pos, source, url FROM (" + " UNION ALL ".join(f"SELECT page_id, pos, '{s}' AS source, url FROM links WHERE regexp_matches(url, '{p}')" for s, p in PATTERNS.items()) + ")",
)
def _(t):
    return X.detail_links(links(t), PATTERNS).select("page_id", "pos", "source", "url")


@query(
    "raw_detail_links",
    oracle=rf"""
    WITH f AS (SELECT page_id, url, regexp_extract_all(html, '["''](/[A-Za-z]+)["'']', 1) AS hs FROM pages),
         h AS (SELECT page_id, url, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM f)
    SELECT page_id, pos, {D.canonical("regexp_extract(url, '^[a-z]+://[^/?#]+') || h")} AS url FROM h""",
)
def _(t):
    return X.raw_detail_links(t.pages, r"""["'](/[A-Za-z]+)["']""").select("page_id", F.col("pos").cast("long").alias("pos"), "url")


POST = """concat(regexp_extract(url, '^[a-z]+://[^/?#]+', 0), CASE WHEN page_id % 5 = 0 THEN concat('/2024/05/0', CAST(page_id % 9 AS STRING), '/s', CAST(page_id AS STRING), '/')
    WHEN page_id % 5 = 1 THEN concat('/?x=1&p=', CAST(page_id AS STRING)) WHEN page_id % 5 = 2 THEN '/?page_id=a1' WHEN page_id % 5 = 3 THEN '/2024/05/01/' ELSE '/?page_id=7' END)"""
D_POST = """(regexp_matches(regexp_extract(u, '//[^/?#]*([^?#]*)', 1), '^/[0-9]{4}/[0-9]{2}/[0-9]{2}/[^/]+/?$') OR regexp_matches(u, '[?&](p|page_id)=[0-9]+(&|$)'))"""


@query("post_url", oracle=f"SELECT page_id, u AS url, {D_POST} AS is_post FROM (SELECT page_id, {POST} AS u FROM pages)")
def _(t):
    return t.pages.select("page_id", F.expr(POST).alias("url")).withColumn("is_post", U.post_url(C("url")))


HINTS = ("the", "que")


@query(
    "next_page_links",
    oracle=f"WITH {D.LINKS} SELECT page_id, url, min(pos) AS pos FROM links WHERE contains(lower(text), 'the') OR contains(lower(text), 'que') OR regexp_matches(href, '(?i)[?&]page=[0-9]+') GROUP BY ALL",
)
def _(t):
    return X.next_page_links(links(t), HINTS)


@query("category_slugs", oracle=f"WITH {D.LINKS} SELECT DISTINCT regexp_extract(url, '//[^/]+/([^/?#]+)', 1) AS slug FROM links WHERE regexp_extract(url, '//[^/]+/([^/?#]+)', 1) NOT IN ('the', 'que', '')")
def _(t):
    return X.category_slugs(links(t), 0, 1, ("the", "que"))


@query(
    "menu_first_per_slug",
    oracle=f"WITH {D.LINKS} SELECT page_id, slug, min(pos) AS pos, arg_min(url, pos) AS url FROM (SELECT *, lower(substr(text, 1, 2)) AS slug FROM links) WHERE slug <> '' GROUP BY page_id, slug",
)
def _(t):
    return X.menu_first_per_slug(links(t), F.lower(F.substring("text", 1, 2)))


FRAMED = """concat(html, CASE WHEN page_id % 4 = 0 THEN concat('<iframe src="/viewer.html?x=1&file=http%3A%2F%2Ff.org%2F', CAST(page_id AS STRING), '.pdf&z=1"></iframe>')
    WHEN page_id % 4 = 1 THEN concat('<a class="d" href="/files/', CAST(page_id AS STRING), '.pdf">doc</a>')
    WHEN page_id % 4 = 2 THEN concat('<iframe src="/pdf?file=%2Fdocs%2F', CAST(page_id AS STRING), '"></iframe>') ELSE '' END)"""


@query(
    "embedded_doc_url",
    oracle="""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://f.org/' || page_id || '.pdf' WHEN 1 THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || '/files/' || page_id || '.pdf'
        WHEN 2 THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || '/docs/' || page_id END AS doc_url FROM pages""",
)
def _(t):
    return X.embedded_doc_url(t.pages.select("page_id", "url", F.expr(FRAMED).alias("html")))


DESCRIBED = """concat(CASE WHEN page_id % 6 = 3 THEN concat('<meta content="swapped &amp; long, page ', CAST(page_id AS STRING), '" name="description">') WHEN page_id % 3 = 0 THEN concat('<meta name="description" content=" page  ', CAST(page_id AS STRING), ' of the archive ">') WHEN page_id % 3 = 1 THEN '<meta name="description" content="short">' ELSE '' END, html)"""


@query(
    "meta_question",
    oracle=f"""SELECT page_id, CASE WHEN len(d) >= 12 THEN d WHEN len(t) >= 12 THEN t ELSE '' END AS question
    FROM (SELECT page_id, {D.squash(D.unescape("regexp_extract(h, 'description. *content=.([^>]*).>', 1) || regexp_extract(h, 'content=.([^>]*). name=.description', 1)"))} AS d, {D.squash(D.unescape("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS t
          FROM (SELECT page_id, {DESCRIBED} AS h FROM pages))""",
)
def _(t):
    return t.pages.select("page_id", X.meta_question(F.expr(DESCRIBED)).alias("question"))


@query(
    "longest_paragraph",
    oracle=rf"""
    WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS ps FROM pages),
         x AS (SELECT page_id, {D.fields(D.unescape('p'))} AS body, pos FROM (SELECT page_id, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM p)),
         r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY len(body) DESC, pos) AS k FROM x)
    SELECT p.page_id, coalesce(r.body, '') AS body FROM p LEFT JOIN r ON r.page_id = p.page_id AND r.k = 1""",
)
def _(t):
    return t.pages.select("page_id", X.longest_paragraph(C("html")).alias("body"))


TIMED = """concat(CASE WHEN page_id % 5 = 0 THEN '<meta property="article:published_time" content="2024-02-03T10:00:00+05:00">' WHEN page_id % 5 = 1 THEN '<time class="t" datetime="2023-11-09 08:00">x</time>'
    WHEN page_id % 5 = 2 THEN '<span class="date"> 7 March  2022 </span>' WHEN page_id % 5 = 3 THEN '<time datetime="2023">' ELSE '' END, html)"""


@query(
    "date_chain",
    oracle="""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '2023-11-09' WHEN 2 THEN '7 March 2022' WHEN 3 THEN '2021-04-05' END AS date FROM pages""",
)
def _(t):
    url = F.when(C("page_id") % 5 == 3, F.lit("https://a.org/2021/04/05/x/")).otherwise(C("url"))
    return t.pages.select("page_id", X.date_chain(F.expr(TIMED), url).alias("date"))


@query(
    "listing_category_label",
    oracle=f"""
    WITH {D.LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS k FROM links)
    SELECT r.url, r.page_id, {D.squash("regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS label FROM r JOIN pages p USING (page_id) WHERE k = 1""",
)
def _(t):
    titles = t.pages.select("page_id", T.title_trim(T.squash(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), (" :: ",), True).alias("label"))
    return X.listing_category_label(links(t), titles)


@query(
    "source_union",
    "records",
    """SELECT id, source, question FROM records WHERE source = 'src5' UNION ALL SELECT id, source, question FROM records WHERE category = 'de'
       UNION ALL SELECT id, source, question FROM records WHERE len(answer) > 1000""",
)
def _(t):
    r = t.records
    registry = {"five": r.filter(C("source") == "src5"), "german": r.filter(C("category") == "de"), "long": r.filter(F.length("answer") > 1000)}
    return X.source_union(["Five", " german", "long"], registry).select("id", "source", "question")


@query("frontier_first_seen", oracle=f"WITH {D.LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS k FROM links) SELECT url, page_id, pos FROM r WHERE k = 1")
def _(t):
    return X.frontier_first_seen(links(t))


@query(
    "frontier_new",
    oracle=f"""WITH {D.LINKS} SELECT DISTINCT url FROM links WHERE url NOT IN (SELECT {D.canonical('url')} FROM pages)
        AND url NOT IN (SELECT url FROM links WHERE page_url LIKE 'http://%')""",
)
def _(t):
    # Stored are the pages themselves, seen are the links of the pages without encryption.
    plain = X.extract_links(t.pages.filter(F.startswith("url", F.lit("http://"))))
    seen = t.pages.select(U.canonical_url(C("url")).alias("url")).unionByName(plain.select("url"))
    return X.frontier_new(X.frontier_first_seen(links(t)).select("url"), seen)


LISTING = """SELECT concat('/path/', CAST(doc_id % 5 AS STRING)) AS path, CAST(floor(doc_id / 5) AS BIGINT) + 1 AS page,
    CASE WHEN first_id = doc_id AND lang = 'de' THEN 1 ELSE 0 END AS new_urls
    FROM (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY split_part(text, chr(10), 1)) AS first_id FROM {documents}) AS d"""


def _stale_sql(n: int) -> str:
    return f"""
    WITH l AS ({LISTING.format(documents='documents')}),
         r AS (SELECT *, sum(new_urls) OVER (PARTITION BY path ORDER BY page) AS run FROM l),
         e AS (SELECT *, count(*) FILTER (new_urls = 0) OVER (PARTITION BY path, run ORDER BY page) AS streak FROM r),
         c AS (SELECT path, min(page) AS cutoff FROM e WHERE streak >= {n} GROUP BY path)
    SELECT l.path, l.page, CAST(new_urls AS BIGINT) AS new_urls, coalesce(page <= cutoff, true) AS visited FROM l LEFT JOIN c USING (path)"""


@query("stale_cutoff", oracle=_stale_sql(8))
def _(t):
    first = t.documents.groupBy(F.split_part("text", F.lit("\n"), F.lit(1)).alias("q")).agg(F.min(F.struct("doc_id", "lang")).alias("m"))
    news = first.filter(C("m.lang") == "de").select(C("m.doc_id").alias("doc_id"), F.lit(1).cast("long").alias("new_urls"))
    pages = t.documents.select("doc_id").join(news, "doc_id", "left")
    listing = pages.select(
        F.concat(F.lit("/path/"), (C("doc_id") % 5).cast("string")).alias("path"),
        (F.floor(C("doc_id") / 5) + 1).alias("page"),
        F.coalesce("new_urls", F.lit(0).cast("long")).alias("new_urls"),
    )
    return X.stale_cutoff(listing, 8).select("path", "page", "new_urls", "visited")


@query("limit_per_source", "incoming", "SELECT seq, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM incoming) WHERE rn <= 7")
def _(t):
    return X.limit_per_source(t.incoming.select("seq", "source"), 7)


ROBOTS = """SELECT host, CASE WHEN length(host) % 3 = 0 THEN concat('# rules', chr(10), 'User-agent: *', chr(10), 'Allow: /en/1', chr(10), 'Disallow: /en/ # all', chr(10), 'Crawl-delay: 2')
    WHEN length(host) % 3 = 1 THEN concat('User-Agent: other', chr(13), chr(10), 'User-agent: looms', chr(13), chr(10), 'Disallow: /', chr(13), chr(10), chr(13), chr(10), 'User-agent: LOOM', chr(13), chr(10),
        'Disallow: /fr', chr(13), chr(10), 'Disallow: /de/%35', chr(13), chr(10), chr(13), chr(10), 'User-agent: *', chr(13), chr(10), 'Disallow: /') ELSE 'User-agent: *' END AS body
    FROM (SELECT DISTINCT lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host FROM {pages}) AS h WHERE length(host) % 7 <> 0"""


@query(
    "robots_filter",
    oracle="""
    WITH u AS (SELECT page_id, CASE WHEN page_id % 50 = 3 THEN 'ftp' || substr(url, 5) ELSE url END AS url FROM pages),
         h AS (SELECT *, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, regexp_extract(url, '//[^/?#]*([^#]*)', 1) AS p FROM u)
    SELECT page_id, host, url NOT LIKE 'ftp%' AND CASE WHEN len(host) % 7 = 0 THEN true
        WHEN len(host) % 3 = 0 THEN p LIKE '/en/1%' OR p NOT LIKE '/en/%' WHEN len(host) % 3 = 1 THEN p NOT LIKE '/fr%' AND p NOT LIKE '/de/5%' ELSE true END AS allowed FROM h""",
)
def _(t):
    robots = t.spark.sql(ROBOTS, pages=t.pages)
    url = F.when(C("page_id") % 50 == 3, F.concat(F.lit("ftp"), F.expr("substr(url, 5)"))).otherwise(C("url"))
    urls = t.pages.select("page_id", url.alias("url"))
    return X.robots_filter(urls, X.robots_rules(robots, "loom/1.0 (+https://example.org)")).select("page_id", "host", "allowed")


@query(
    "discovery_summary",
    oracle=f"""
    SELECT count(*) AS discovered, count(*) FILTER ({D_POST}) AS kept, count(*) FILTER (NOT {D_POST}) AS filtered,
           count(*) FILTER ({D_POST} AND regexp_matches(regexp_extract(u, '//[^/?#]*([^?#]*)', 1), '/[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}/s[0-9]+')) AS strict
    FROM (SELECT DISTINCT {POST} AS u FROM pages)""",
)
def _(t):
    return X.discovery_summary(t.pages.select(F.expr(POST).alias("url")), U.post_url(C("url")), "/[0-9]{4}/[0-9]{2}/[0-9]{2}/s[0-9]+")


D_RUNS = f"""WITH {D_UPSERTED}, s AS (SELECT seq // 100 AS run, source, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status = 'skipped') AS skipped FROM ups GROUP BY ALL)"""


def run_stats(t):
    runs = upserted(t).withColumn("run", F.floor(C("seq") / 100))
    return runs.groupBy("run", "source").agg(F.count_if(C("status") == "inserted").alias("inserted"), F.count_if(C("status") == "skipped").alias("skipped"))


@query(
    "run_progress",
    "incoming stored",
    D_RUNS + " SELECT run, source, CAST(sum(inserted) OVER w AS BIGINT) AS inserted, CAST(sum(skipped) OVER w AS BIGINT) AS skipped FROM s WINDOW w AS (PARTITION BY run ORDER BY source ROWS UNBOUNDED PRECEDING)",
)
def _(t):
    return X.run_progress(run_stats(t), "run", "source", ["inserted", "skipped"])


@query(
    "run_history",
    "incoming stored",
    D_RUNS
    + """ SELECT run, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(skipped) AS BIGINT) AS skipped,
          strftime(TIMESTAMP '2024-01-01' + (run * 7 % 31) * INTERVAL 1 DAY, '%Y-%m-%d') AS finished_at FROM s GROUP BY run ORDER BY finished_at DESC, run DESC LIMIT 10""",
)
def _(t):
    day = F.timestamp_add("DAY", (C("run") * 7 % 31).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    runs = run_stats(t).groupBy("run").agg(F.sum("inserted").alias("inserted"), F.sum("skipped").alias("skipped")).withColumn("finished_at", day)
    return X.run_history(runs).withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd"))


@query("exact_dup_groups", "records", "SELECT sha256(question || chr(10) || answer) AS content_hash, count(*) AS n, min(id) AS first_id FROM records GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return X.exact_dup_groups(t.records.select("id", T.content_hash(C("question"), C("answer")).alias("content_hash")))


@query("error_summary", oracle=f"WITH {D_STAGED} SELECT source, split_part(error, ':', 1) AS kind, count(*) AS n FROM staged WHERE status IS NOT NULL GROUP BY ALL")
def _(t):
    return X.error_summary(staged(staged_pages(t), "parsed").filter(C("status").isNotNull()))


@query("host_frequency", oracle="SELECT lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def _(t):
    return X.host_frequency(t.pages)


@query(
    "polite_schedule",
    "requests",
    """WITH RECURSIVE r AS MATERIALIZED (SELECT seq, lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host, ready_ms, 1500 + ('0x' || substr(md5(url), 1, 8))::UBIGINT::BIGINT % 751 AS gap,
            row_number() OVER (PARTITION BY lower(regexp_extract(url, '//([^/?#]*)', 1)) ORDER BY seq) AS n FROM requests),
        s AS (SELECT seq, host, n, greatest(ready_ms, 0) AS at_ms FROM r WHERE n = 1
              UNION ALL SELECT r.seq, r.host, r.n, greatest(r.ready_ms, s.at_ms + r.gap) FROM s JOIN r ON r.host = s.host AND r.n = s.n + 1)
    SELECT seq, host, at_ms FROM s""",
)
def _(t):
    return X.polite_schedule(t.requests)


@query(
    "page_chains",
    "next_links",
    """WITH RECURSIVE l AS (SELECT page_id, min(following_id) AS following_id FROM next_links WHERE following_id <> page_id GROUP BY page_id),
        i AS MATERIALIZED (SELECT following_id AS page_id, min(page_id) AS before FROM l GROUP BY following_id),
        n AS (SELECT page_id FROM next_links UNION SELECT following_id FROM next_links WHERE following_id IS NOT NULL),
        w AS (SELECT page_id AS head, page_id, 1 AS rank, false AS back FROM n
              UNION ALL SELECT w.head, f.page_id, w.rank + 1, f.page_id = w.head FROM w JOIN i f ON f.before = w.page_id WHERE NOT w.back),
        -- Heads: nodes that nothing leads to, and the least node of a circle, which its own walk comes back to.
        c AS (SELECT head FROM w GROUP BY head HAVING bool_or(back) AND min(page_id) = head),
        h AS (SELECT page_id AS head FROM n WHERE page_id NOT IN (SELECT page_id FROM i) UNION SELECT head FROM c)
    SELECT w.page_id AS node, w.head, CAST(w.rank AS BIGINT) AS rank FROM w JOIN h USING (head) WHERE NOT w.back""",
)
def _(t):
    return chain_order(t.next_links.select(C("page_id").alias("node"), C("following_id").alias("to")))[0]
