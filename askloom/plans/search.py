"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import fulltext as X
from askloom.operators import search as S
from askloom.plans import duck as D
from askloom.plans.bind import AS_OF
from askloom.plans.registry import query
from askloom.session import staging_path

C = F.col
FMT = "yyyy-MM-dd HH:mm:ss"


def d_tokens(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\p{{L}}\p{{N}}\p{{Co}}]+'))"


D_HITS = f"""
    doc AS (SELECT id, question, answer, {d_tokens("question || ' ' || answer || ' ' || coalesce(category, '')")} AS toks FROM records),
    qry AS (SELECT qid, query, {d_tokens('query')} AS qtoks FROM searches),
    tok AS (SELECT qid, id FROM qry JOIN doc ON len(qtoks) > 0 AND list_has_all(toks, qtoks)),
    lit AS (SELECT qid, id FROM qry JOIN doc ON contains(lower(question), lower(trim(query))) OR contains(lower(answer), lower(trim(query)))
            WHERE trim(query) <> '' AND qid NOT IN (SELECT qid FROM tok)),
    hits AS (SELECT qid, id, 'token' AS via FROM tok UNION ALL SELECT qid, id, 'literal' FROM lit)"""


@query("substring_search", "records", "SELECT id, source FROM records WHERE contains(lower(question), 'que de') OR contains(lower(answer), 'que de')")
def _(t):
    return S.substring_search(t.records, " QUE de ").select("id", "source")


@query("token_search", "records", f"SELECT id FROM records WHERE list_has_all({d_tokens("question || ' ' || answer || ' ' || coalesce(category, '')")}, ['es', 'la'])")
def _(t):
    return S.token_search(t.records, "Là, ÉS").select("id")


@query("search_filters", "records", "SELECT id, source, category FROM records WHERE source IN ('src1', 'src7', 'missing') AND category = 'en'")
def _(t):
    return S.search_filters(t.records, [" src1", "src7", "", "missing"], " en ").select("id", "source", "category")


@query("get_by_id", "records", "SELECT id, question, answer FROM records WHERE id = 42")
def _(t):
    return S.get_by_id(t.records, 42).select("id", "question", "answer")


@query("search_with_fallback", "records searches", f"WITH {D_HITS} SELECT qid, id, via FROM hits")
def _(t):
    return S.search_with_fallback(t.records, t.searches)


@query(
    "batch_search",
    "records searches",
    f"""WITH {D_HITS}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id DESC) AS rank, count(*) OVER (PARTITION BY qid) AS total FROM hits)
    SELECT qid, rank, id, total FROM r WHERE rank <= 10""",
)
def _(t):
    return S.batch_search(S.search_with_fallback(t.records, t.searches), 1, 10)


def d_all_tokens(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def _index(t, merged: bool = False) -> X.Index:
    """An index of the records in four batches, one replaced in part, then with deletions, then with some batches merged."""
    index = X.Index(t.spark, staging_path(t.spark, "index"))
    first = [index.append(t.records.filter(C("id") % 4 == k)) for k in range(4)]
    spanish = t.records.filter(C("category") == "es")
    index.append(spanish.withColumns({"question": C("answer"), "answer": C("question")}))
    index.delete(t.labels.filter(C("quality") == 0).select(C("doc_id").alias("id")))
    if merged:
        index.merge(first[1:])
        index.vacuum()
    return index


@query(
    "index_postings",
    "kept_records",
    f"""WITH k AS (SELECT id, unnest({d_tokens("question || ' ' || answer || ' ' || coalesce(category, '')")}) AS key FROM kept_records
                   UNION ALL SELECT id, 'source=' || source FROM kept_records UNION ALL SELECT id, 'category=' || category FROM kept_records WHERE category IS NOT NULL)
    SELECT key, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, min(id) AS first_id, max(id) AS last_id FROM k GROUP BY key""",
)
def _(t):
    """Every key with its records, from the stored postings of all batches."""
    index = _index(t, merged=True)
    vocabulary = index.table("vocabulary").select(C("key").alias("qid"), F.lit(0).alias("term"), "key").distinct()
    hits = X.block_hits(index, vocabulary).select(C("qid").alias("key"), F.explode(X._places("bits")).alias("place"), F.shiftleft("block", X.BLOCK_BITS).alias("base"))
    ids = hits.select("key", (C("base") + C("place")).alias("id"))
    return ids.groupBy("key").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


D_INDEXED = f"""
    doc AS (SELECT id, source, category, {d_tokens("question || ' ' || answer || ' ' || coalesce(category, '')")} AS toks FROM kept_records),
    qry AS (SELECT qid, {d_tokens('query')} AS qtoks FROM searches)"""
D_PAGE = """r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id DESC) AS rank, count(*) OVER (PARTITION BY qid) AS total FROM hits)"""


@query(
    "index_search",
    "kept_records searches",
    f"""WITH {D_INDEXED}, hits AS (SELECT qid, id FROM qry JOIN doc ON len(qtoks) > 0 AND list_has_all(toks, qtoks)), {D_PAGE}
    SELECT qid, rank, id, CAST(total AS BIGINT) AS total FROM r WHERE rank BETWEEN 11 AND 20""",
)
def _(t):
    return X.search(_index(t), t.searches, 2, 10)


@query(
    "index_filtered_search",
    "kept_records searches",
    f"""WITH {D_INDEXED}, hits AS (SELECT qid, id FROM qry JOIN doc ON len(qtoks) > 0 AND list_has_all(toks, qtoks) AND source IN ('src1', 'src2', 'src3', 'src7') AND category = 'en'), {D_PAGE}
    SELECT qid, rank, id, CAST(total AS BIGINT) AS total FROM r WHERE rank <= 10""",
)
def _(t):
    return X.search(_index(t, merged=True), t.searches, 1, 10, ["src1", " src2", "src3", "src7", "missing"], "en ")


def d_matches(column: str) -> str:
    """Whether the tokens ``column`` hold the words ``ws``, as a phrase or all of them."""
    line, phrase = f"' ' || array_to_string({column}, ' ') || ' '", "' ' || array_to_string(ws, ' ') || (CASE WHEN prefix THEN '' ELSE ' ' END)"
    last = f"CASE WHEN prefix THEN len(list_filter({column}, lambda x: starts_with(x, ws[-1]))) > 0 ELSE list_contains({column}, ws[-1]) END"
    return f"CASE WHEN phrase THEN contains({line}, {phrase}) ELSE list_has_all({column}, ws[:-2]) AND {last} END"


@query(
    "index_match",
    "kept_records phrases",
    f"""WITH doc AS (SELECT id, {d_all_tokens('question')} AS q, {d_all_tokens('answer')} AS a, {d_all_tokens('category')} AS c FROM kept_records),
        qry AS (SELECT qid, {d_all_tokens('query')} AS ws, phrase, prefix, field FROM phrases)
    SELECT qid, id FROM qry JOIN doc ON len(ws) > 0 AND CASE WHEN field = 'question' THEN {d_matches('q')} WHEN field = 'answer' THEN {d_matches('a')}
        WHEN phrase THEN ({d_matches('q')}) OR ({d_matches('a')}) OR ({d_matches('c')}) ELSE {d_matches('list_concat(q, a, c)')} END""",
)
def _(t):
    asked = t.phrases.select("qid", F.array("query").alias("words"), "phrase", "prefix", "field")
    return X.match(_index(t), asked)


@query(
    "snippet",
    "records",
    rf"""
    WITH w AS (SELECT id, list_filter(regexp_split_to_array({D.strip('question')}, '{D.WS}+'), lambda x: x <> '') AS ws FROM records
               WHERE list_has_all({d_tokens("question || ' ' || answer || ' ' || coalesce(category, '')")}, ['the', 'and'])),
         h AS (SELECT id, ws, list_transform(ws, lambda x: list_has_any(regexp_extract_all(strip_accents(lower(x)), '[\p{{L}}\p{{N}}\p{{Co}}]+'), ['the', 'and'])) AS hs FROM w),
         p AS (SELECT *, greatest(coalesce(list_position(hs, true), 0), 1) AS f FROM h),
         s AS (SELECT *, greatest(least(f - 5, len(ws) - 9), 1) AS a FROM p)
    SELECT id, (CASE WHEN a > 1 THEN '...' ELSE '' END) || array_to_string(list_transform(range(a, least(a + 10, len(ws) + 1)),
             lambda i: CASE WHEN hs[i] THEN '<b>' || ws[i] || '</b>' ELSE ws[i] END), ' ') || (CASE WHEN a + 9 < len(ws) THEN '...' ELSE '' END) AS snippet
    FROM s ORDER BY id DESC LIMIT 50""",
)
def _(t):
    top = S.token_search(t.records, "the AND").orderBy(F.desc("id")).limit(50)
    return top.select("id", S.snippet(C("question"), "the AND").alias("snippet"))


@query(
    "search_miss_log",
    "records searches",
    f"""WITH {D_HITS} SELECT qid, trim(query) AS query, CAST(0 AS BIGINT) AS results_count, 'src1,src2' AS source_filter, CAST(NULL AS VARCHAR) AS category_filter,
        '{AS_OF}' AS searched_at, false AS resolved FROM qry WHERE trim(query) <> '' AND qid NOT IN (SELECT qid FROM hits)""",
)
def _(t):
    log = S.search_miss_log(t.searches, S.search_with_fallback(t.records, t.searches), AS_OF, ["src2 ", "src1"], " ")
    return log.withColumn("searched_at", F.date_format("searched_at", FMT))


@query(
    "miss_list",
    "misses",
    f"""SELECT id, query, {D.ts('searched_at')} AS searched_at, (SELECT count(*) FROM misses WHERE NOT resolved) AS total
        FROM misses WHERE NOT resolved ORDER BY misses.searched_at DESC, id DESC LIMIT 20""",
)
def _(t):
    out = S.miss_list(t.misses, False, 1, 20)
    return out.select("id", "query", F.date_format("searched_at", FMT).alias("searched_at"), "total")


@query("miss_stats", "misses", "SELECT query, count(*) AS n FROM misses GROUP BY query ORDER BY n DESC, query LIMIT 10")
def _(t):
    return S.miss_top(t.misses)


@query("miss_totals", "misses", "SELECT count(*) AS total, count(*) FILTER (NOT resolved) AS unresolved FROM misses")
def _(t):
    return S.miss_totals(t.misses)


@query("miss_resolve", "misses", "SELECT id, resolved OR id IN (SELECT event_id FROM events WHERE value > 50) AS resolved FROM misses")
def _(t):
    return S.miss_resolve(t.misses, t.events.filter(C("value") > 50).select(C("event_id").alias("id"))).select("id", "resolved")
