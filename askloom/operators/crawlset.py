"""Links and crawl sets: extraction, detail patterns, frontier, stop rules, robots rules, run statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions import urls as U
from askloom.functions.text import let, normalize_text, squash, strip, unescape, unescape_nfc
from askloom.session import is_small

# An anchor with a quoted or bare href, up to its end tag, the next anchor or the end of the page.
_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_ANCHOR = rf"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*{_VALUE}[^>]*>(.*?)(?=</a\s*>|<a\s|\z)"""
_COMMENT = r"(?s)<!--.*?-->"
# Texts that mark a pagination link.
NEXT_HINTS = ("اگلا", "next", ">>", "›", "»")
PAGE_KEY = r"(?i)[?&]page=[0-9]+"
# Hosts whose frames show documents.
DOCUMENT_HOSTS = ("//files.",)


def extract_links(pages: DataFrame) -> DataFrame:
    """``page_id, page_url, pos, href, text, url`` of every anchor, in document order.

    Only the extracted fields leave the scan; the page text itself is never shuffled.
    """
    shown = F.regexp_replace("html", _COMMENT, "")
    group = [F.regexp_extract_all("shown", F.lit(_ANCHOR), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3, 4)]
    found = pages.select("page_id", F.col("url").alias("page_url"), shown.alias("shown"))
    links = found.select("page_id", "page_url", F.posexplode(F.arrays_zip(*group)).alias("pos", "a"))
    links = links.select(
        "page_id",
        "page_url",
        F.col("pos").cast("long").alias("pos"),
        unescape(F.concat("a.g1", "a.g2", "a.g3")).alias("href"),
        normalize_text(F.regexp_replace("a.g4", r"(?s)<[^>]*>", "")).alias("text"),
    )
    return links.withColumn("url", U.canonical_url(U.resolve_href(F.col("page_url"), F.col("href"))))


def detail_links(links: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Links that match a source's detail pattern, one row per (link, source). Patterns are a fixed short list."""
    hits = F.array(*[F.when(F.col("url").rlike(p), F.lit(s)) for s, p in patterns.items()])
    return links.withColumn("source", F.explode(F.array_compact(hits)))


def raw_detail_links(pages: DataFrame, pattern: str) -> DataFrame:
    """Detail URLs found anywhere in the page source, also outside anchors."""
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    hits = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "href"))
    return hits.withColumn("url", U.canonical_url(U.resolve_href(F.col("page_url"), F.col("href"))))


def next_page_links(links: DataFrame, hints: Sequence[str] = NEXT_HINTS) -> DataFrame:
    """Pagination links, each URL once per page at its first position."""
    text, href = F.lower("text"), F.col("href")
    hinted = reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in hints])
    kept = links.filter((hinted | href.rlike(PAGE_KEY)) & (strip(href) != "") & ~F.startswith(strip(href), F.lit("#")))
    return kept.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def category_slugs(links: DataFrame, detail_at: int, min_segments: int, stop: Sequence[str] = ()) -> DataFrame:
    """Distinct slugs at a path position of links that are long enough."""
    seg = links.select(U.url_segments(F.col("url")).alias("seg"))
    slugs = seg.filter(F.size("seg") >= min_segments).select(F.get("seg", F.lit(detail_at)).alias("slug"))
    return slugs.filter(~F.col("slug").isin(*stop) if stop else F.lit(True)).distinct()


def menu_first_per_slug(links: DataFrame, slug: Column) -> DataFrame:
    """First link of each slug on a page."""
    keyed = links.withColumn("slug", slug).filter(F.coalesce(F.col("slug"), F.lit("")) != "")
    first = keyed.groupBy("page_id", "slug").agg(F.min(F.struct("pos", "url")).alias("m"))
    return first.select("page_id", "slug", "m.pos", "m.url")


def embedded_doc_url(pages: DataFrame) -> DataFrame:
    """Linked document of a page: viewer parameter, else a ``.pdf`` link, else the parameter of another frame."""
    shown = F.regexp_replace("html", _COMMENT, "")
    sources = F.regexp_extract_all("shown", F.lit(r"""(?is)<iframe\s[^>]*?src\s*=\s*["']([^"'>]*)["']"""), F.lit(1))
    link = F.regexp_extract("shown", r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"'>]*\.pdf[^"'>]*)["']""", 1)
    # Frame addresses and the link are decoded together; a line break stands in none of them.
    decoded = F.split(unescape(F.array_join(F.concat(F.array(link), sources), "\n")), "\n")
    found = pages.select("page_id", "url", shown.alias("shown")).select("page_id", "url", decoded.alias("decoded"))
    return found.select("page_id", document_of(F.col("url"), F.get("decoded", F.lit(0)), F.slice("decoded", 2, F.size("decoded"))).alias("doc_url"))


def document_of(url: Column, link: Column, frames: Column, hosts: Sequence[str] = DOCUMENT_HOSTS) -> Column:
    """Address of a page's document: the first viewer frame's parameter if absolute, else the link, else the first parameter of a document frame."""

    def file_param(src: Column) -> Column:
        return F.nullif(U.percent_decode(F.regexp_extract(src, r"[?&]file=([^&]+)", 1)), F.lit(""))

    viewer = file_param(F.get(F.filter(frames, lambda s: F.contains(s, F.lit("viewer.html"))), F.lit(0)))
    of_document = lambda s: F.contains(F.lower(s), F.lit("pdf")) | reduce(lambda a, b: a | b, [F.contains(s, F.lit(h)) for h in hosts])
    params = F.filter(F.transform(F.filter(frames, of_document), file_param), lambda p: p.isNotNull())
    absolute = lambda href: U.resolve_href(url, F.nullif(href, F.lit("")))
    return F.coalesce(let(viewer, lambda u: F.when(F.startswith(u, F.lit("http")), u)), absolute(link), absolute(F.get(params, F.lit(0))))


def meta_content(html: Column, key: str, value: str) -> Column:
    """Content of the first ``meta`` tag whose ``key`` attribute is ``value``, whatever the order of its attributes; else an empty string."""
    tag = rf"""(?is)<meta\s(?=[^>]*?\b{key}\s*=\s*["']?{value}["'\s/>])[^>]*?\bcontent\s*=\s*{_VALUE}"""
    return F.concat(*[F.regexp_extract(html, tag, k) for k in (1, 2, 3)])


def meta_question(html: Column, longest_title: int | None = None) -> Column:
    """Meta description of at least 12 characters, else a title of as many (and of ``longest_title`` at most, if given), else an empty string."""
    desc = normalize_text(meta_content(html, "name", "description"))
    title = normalize_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    long_enough = lambda x: (F.length(x) >= 12) & (F.lit(True) if longest_title is None else F.length(x) <= longest_title)
    usable = let(desc, lambda d: F.when(F.length(d) >= 12, d))
    return F.coalesce(usable, let(title, lambda x: F.when(long_enough(x), x)), F.lit(""))


def longest_paragraph(html: Column) -> Column:
    """Longest paragraph text; the first one wins a tie."""
    paras = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    # Decoded in one go; U+0001 can't come from an entity.
    joined = unescape_nfc(F.array_join(F.transform(paras, lambda p: F.regexp_replace(p, r"(?s)<[^>]*>|\x01", "")), "\x01"))
    texts = F.transform(F.split(joined, "\x01"), squash)
    return F.aggregate(texts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))


def date_chain(html: Column, url: Column, width: int = 10) -> Column:
    """Published-time meta tag, else a ``time`` element, else a dated span, else the URL's date."""
    meta = meta_content(html, "property", "article:published_time")
    time = F.regexp_extract(html, r"""(?is)<time\s(?:[^>]*?\s)?datetime\s*=\s*["']?([^"'>]*)""", 1)
    span = F.regexp_extract(html, r"""(?is)<span\s(?:[^>]*?\s)?class\s*=\s*["']?(?:[^"'>]*\s)?date(?:\s[^"'>]*)?["']?(?:\s[^>]*)?>(.*?)</span>""", 1)

    def long_enough(c: Column) -> Column:
        return let(c, lambda x: F.when(F.length(x) >= 10, F.substring(x, 1, width)))

    return F.coalesce(long_enough(meta), long_enough(time), F.nullif(normalize_text(span), F.lit("")), U.date_from_url(url))


def listing_category_label(links: DataFrame, titles: DataFrame) -> DataFrame:
    """Each URL with the label of the first listing that links it."""
    first = links.groupBy("url").agg(F.min(F.struct("page_id", "pos")).alias("m"))
    keyed = first.select("url", F.col("m.page_id").alias("page_id"))
    return keyed.join(titles.select("page_id", "label"), "page_id", "left").select("url", "page_id", "label")


def source_union(names: Sequence[str], registry: dict[str, DataFrame]) -> DataFrame:
    unknown = [n for n in names if n.strip().lower() not in registry]
    if unknown:
        raise ValueError(f"unknown source {unknown[0]!r}; known: {', '.join(sorted(registry))}")
    return reduce(DataFrame.unionByName, [registry[n.strip().lower()] for n in names])


# Crawl sets ---------------------------------------------------------------------------------------------------


def frontier_first_seen(links: DataFrame, order: Sequence[str] = ("page_id", "pos")) -> DataFrame:
    """Distinct URLs with the first place they were seen."""
    first = links.groupBy("url").agg(F.min(F.struct(*order)).alias("m"))
    return first.select("url", *[F.col(f"m.{c}").alias(c) for c in order])


def frontier_new(urls: DataFrame, seen: DataFrame) -> DataFrame:
    return urls.join(seen.select("url"), "url", "left_anti")


def stale_cutoff(listings: DataFrame, n: int) -> DataFrame:
    """Listing pages with ``visited``: false behind ``n`` consecutive pages without new URLs on their path.

    ``listings`` is ``path, page, new_urls`` with pages numbered 1, 2, … per path. A page ends the walk when none
    of the last ``n`` pages had news, that is when no page with news covers it. Everything is keyed by
    ``(path, page)``, so a long path is no single task.
    """
    news = listings.filter(F.col("new_urls") > 0)
    covered = news.select("path", F.explode(F.sequence(F.col("page"), F.col("page") + (n - 1))).alias("page"))
    ends = listings.filter(F.col("page") >= n).select("path", "page").join(covered, ["path", "page"], "left_anti")
    cutoff = ends.groupBy("path").agg(F.min("page").alias("cutoff"))
    return listings.join(cutoff, "path", "left").withColumn(
        "visited", F.coalesce(F.col("page") <= F.col("cutoff"), F.lit(True))
    )


def limit_per_source(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """First ``n`` rows per source; the row limit is applied before the shuffle as well."""
    w = W.partitionBy("source").orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """``host, rules`` for one agent from robots texts ``host, body``.

    The rules of a host stay one array in file order, because the first matching prefix decides. A text is parsed
    inside its row: groups end at blank lines or where a user-agent line follows a rule.
    """
    line = lambda x: strip(F.regexp_replace(x, r"#.*\z", ""))
    field = lambda x: F.lower(strip(F.split_part(x, F.lit(":"), F.lit(1))))
    value = lambda x: strip(F.regexp_extract(x, r"(?s)\A[^:]*:(.*)\z", 1))
    rules_type = "array<struct<allow:boolean,prefix:string>>"
    no_rules = F.array().cast(rules_type)
    groups_type = "array<struct<agents:array<string>,rules:array<struct<allow:boolean,prefix:string>>>>"
    start = F.struct(
        F.array().cast("array<string>").alias("agents"), no_rules.alias("rules"), F.array().cast(groups_type).alias("done")
    )

    def step(s: Column, x: Column) -> Column:
        f, v = field(x), U.percent_decode(value(x))
        is_agent, is_rule = f == "user-agent", f.isin("allow", "disallow")
        full = F.size(s["rules"]) > 0
        close = (x == "") | (is_agent & full)
        kept = F.when(close & full, F.array_append(s["done"], F.struct(s["agents"], s["rules"]))).otherwise(s["done"])
        base_agents = F.when(close, F.array().cast("array<string>")).otherwise(s["agents"])
        # An empty Disallow allows everything.
        rule = F.struct(((f == "allow") | (v == "")).alias("allow"), F.coalesce(v, value(x)).alias("prefix"))
        known = F.size(s["agents"]) > 0
        return F.struct(
            F.when(is_agent, F.array_append(base_agents, F.lower(value(x)))).otherwise(base_agents).alias("agents"),
            F.when(close, no_rules).when(is_rule & known, F.array_append(s["rules"], rule)).otherwise(s["rules"]).alias("rules"),
            kept.alias("done"),
        )

    lines = F.concat(F.transform(F.split("body", r"\r\n|\r|\n"), line), F.array(F.lit("")))
    name = agent.split("/")[0].lower()
    parsed = robots.select("host", F.aggregate(lines, start, step, lambda s: s["done"]).alias("groups"))
    own = F.filter("groups", lambda g: F.exists(g["agents"], lambda a: (a != "*") & F.contains(F.lit(name), a)))
    any_agent = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    return parsed.select("host", F.coalesce(F.get(own, F.lit(0)), F.get(any_agent, F.lit(0)))["rules"].alias("rules"))


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs with ``allowed``. Hosts without rules are allowed; other schemes or no host are not.

    Rules are one row per host; they are broadcast only when small, otherwise the join shuffles on the host and
    adaptive skew handling splits a dominant host.
    """
    side = F.broadcast(rules) if is_small(rules) else rules
    keyed = urls.withColumn("host", U.host(F.col("url")))
    q = U.query(F.col("url"))
    target = U.percent_decode(F.concat(U.path(F.col("url")), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))))
    keyed = keyed.withColumn("_target", F.when(target == "", F.lit("/")).otherwise(target))
    hit = F.filter("rules", lambda r: (r["prefix"] == "*") | F.startswith(F.col("_target"), r["prefix"]))
    verdict = F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True))
    web = U.scheme(F.col("url")).isin("http", "https") & (F.col("host") != "")
    return keyed.join(side, "host", "left").withColumn("allowed", web & verdict).drop("rules", "_target")


def discovery_summary(urls: DataFrame, keep: Column, strict: str) -> DataFrame:
    """Counts over distinct URLs: discovered, kept, filtered out, and kept ones that match the strict path pattern."""
    flags = urls.select("url").distinct().select(keep.alias("keep"), U.path(F.col("url")).rlike(strict).alias("strict"))
    return flags.agg(
        F.count("*").alias("discovered"),
        F.count_if("keep").alias("kept"),
        F.count_if(~F.col("keep")).alias("filtered"),
        F.count_if(F.col("keep") & F.col("strict")).alias("strict"),
    )


def run_progress(stats: DataFrame, run: str, order: str, measures: Sequence[str]) -> DataFrame:
    """Running totals over the sources of a run. The input has one row per run and source."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return stats.select(run, order, *[F.sum(m).over(w).alias(m) for m in measures])


def run_history(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("finished_at"), F.desc("run")).limit(n)


def exact_dup_groups(df: DataFrame, key: str = "content_hash") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter(F.col("n") > 1)


def error_summary(errors: DataFrame) -> DataFrame:
    kind = F.split_part("error", F.lit(":"), F.lit(1)).alias("kind")
    return errors.groupBy("source", kind).agg(F.count("*").alias("n"))


def host_frequency(urls: DataFrame) -> DataFrame:
    return urls.groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def polite_schedule(requests: DataFrame, delay_ms: int = 1500, jitter_ms: int = 750, seed: str = "", width: int = 1_000_000) -> DataFrame:
    """``seq, host, at_ms``: the earliest time of every request ``seq, url, ready_ms`` so that requests of a host keep their distance.

    Requests of a host are made in the order of ``seq`` (unique), each when it is ready and at least ``delay_ms`` and a drawn part of
    ``jitter_ms`` after the one before; the draw depends on ``seed`` and the URL. Hosts don't wait for each other; URLs without a
    host wait for each other like those of one host. A NULL ``ready_ms`` is 0.

    With gaps g and their running sum G, a request is made at G + the greatest of (ready - G) up to it. Sums and greatest values of blocks
    of ``width`` consecutive numbers are carried to the blocks behind, so a host that has most requests is split.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("url", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = requests.select(
        "seq",
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.coalesce("ready_ms", F.lit(0)).cast("long").alias("ready"),
        (F.lit(delay_ms) + F.pmod(draw, F.lit(jitter_ms + 1))).alias("gap"),
        F.floor(F.col("seq") / width).alias("block"),
    )
    inside = W.partitionBy("host", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.withColumn("sum", F.sum("gap").over(inside)).withColumn("most", F.max(F.col("ready") - F.col("sum")).over(inside))
    ends = rows.groupBy("host", "block").agg(F.sum("gap").alias("sum"))
    # A block's greatest (ready - G) is taken relative to its own start, then moved by the sum of the blocks before it.
    ends = ends.join(local.groupBy("host", "block").agg(F.max("most").alias("most")), ["host", "block"])
    before = W.partitionBy("host").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    ends = ends.withColumn("carried", F.max(F.col("most") - F.col("base")).over(before)).select("host", "block", "base", "carried")
    at = F.col("sum") + F.greatest("most", F.col("carried") + F.col("base"))  # greatest skips the NULL of a first block
    return local.join(ends, ["host", "block"]).select("seq", "host", at.alias("at_ms"))
