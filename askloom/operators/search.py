"""Search over the corpus: literal, by token, with fallback, in batches; snippets; the log of missed searches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.session import is_small, staged


def substring_search(df: DataFrame, q: str) -> DataFrame:
    q = q.strip()
    return df.filter(T.contains_literal(F.col("question"), q) | T.contains_literal(F.col("answer"), q))


def record_tokens() -> Column:
    """Distinct tokens of question, answer and category."""
    return F.array_distinct(F.concat(*[T.tokens(F.col(c)) for c in ("question", "answer", "category")]))


def token_search(df: DataFrame, q: str) -> DataFrame:
    """Records that hold every token of the query. One query needs no index: the test stays inside the scan."""
    wanted = F.array_distinct(T.tokens(F.lit(q)))

    def holds_all(have: Column) -> Column:
        return (F.size(wanted) > 0) & F.forall(wanted, lambda w: F.array_contains(have, w))

    return df.filter(T.let(record_tokens(), holds_all))


def search_filters(df: DataFrame, sources: Sequence[str] | None = None, category: str | None = None) -> DataFrame:
    names = [s.strip() for s in sources or [] if s and s.strip()]
    if names:
        df = df.filter(F.col("source").isin(*names))
    if category and category.strip():
        df = df.filter(F.col("category") == category.strip())
    return df


def get_by_id(df: DataFrame, record_id: int) -> DataFrame:
    return df.filter(F.col("id") == record_id)


def _side(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table whose size estimate is small; larger ones keep the shuffle join."""
    return F.broadcast(df) if is_small(df) else df


# Indexes are narrow tables ``id, key``; callers keep as tables those that they read several times.
BROADCAST_PAIRS = 100_000


def token_index(df: DataFrame) -> DataFrame:
    """Distinct tokens per record."""
    return df.select("id", F.explode(record_tokens()).alias("key"))


def chunk_index(df: DataFrame) -> DataFrame:
    """Distinct white-space separated chunks of question and answer per record, ASCII case folded."""
    chunks = F.array_distinct(F.split(F.concat_ws("\n", "question", "answer"), f"{T.WS}+"))
    folded = F.transform(chunks, lambda x: F.when(x.rlike("[A-Z]"), T.fold_ascii(x)).otherwise(x))
    return df.select("id", F.explode(F.filter(F.array_distinct(folded), lambda x: x != "")).alias("key"))


def _grams(c: Column, sizes: Sequence[int]) -> Column:
    """Distinct character n-grams. The look-ahead walks the text once; positions by substring would be quadratic."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


def anchor_pairs(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``qid, id`` of entries that hold the rarest key of a query ``qid, qkeys``, and the postings of all query keys.

    What holds all keys holds the rarest one, so the pairs are a superset of the hits. Meeting on that key only keeps
    very common keys, which may sit in a third of all entries, out of the join unless a query has nothing else. A
    query with a key that occurs nowhere has no pairs. Frequencies are map-side combined counts. The index is read
    once; what is kept are the postings of the queries' own keys, and the anchors, whose true size decides the join.
    """
    asked = queries.select("qid", F.explode("qkeys").alias("key"))
    wanted = asked.select("key").distinct()
    postings = staged(index.join(_side(wanted), "key", "left_semi").select("id", "key"), "postings")
    freq = postings.groupBy("key").agg(F.count("*").alias("df"))
    best = (
        asked.join(freq, "key", "left")
        .groupBy("qid")
        .agg(F.min(F.struct("df", "key")).alias("m"), F.count_if(F.col("df").isNull()).alias("absent"))
    )
    anchors = staged(best.filter(F.col("absent") == 0).select("qid", F.col("m.key").alias("key")), "anchors")
    return postings.join(_side(anchors), "key").select("qid", "id"), postings


def token_hits(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id`` of every record that holds all tokens of a query.

    Pairs from the rarest token are checked against the postings on ``(id, key)``; that key spreads evenly.
    """
    qs = queries.select("qid", F.array_distinct(T.tokens(F.col("query"))).alias("qkeys")).filter(F.size("qkeys") > 0)
    pairs, postings = anchor_pairs(index, qs)
    single = qs.filter(F.size("qkeys") == 1).select("qid")
    several = qs.filter(F.size("qkeys") > 1)
    needed = pairs.join(_side(several), "qid").select("qid", "id", F.size("qkeys").alias("n"), F.explode("qkeys").alias("key"))
    found = needed.join(postings, ["id", "key"], "left_semi")
    full = found.groupBy("qid", "id", "n").agg(F.count("*").alias("k")).filter(F.col("k") == F.col("n"))
    return pairs.join(_side(single), "qid", "left_semi").unionByName(full.select("qid", "id"))


def chunks_containing(index: DataFrame, needles: DataFrame) -> DataFrame:
    """``needle, key`` of the chunks that contain a needle free of white space.

    Works on the vocabulary, which is far smaller than the text: needle and chunk meet on the needle's rarest
    gram of up to three characters, and ``contains`` decides.
    """
    vocabulary = index.select("key").distinct()
    gram_index = vocabulary.select(F.col("key").alias("id"), F.explode(_grams(F.col("key"), (1, 2, 3))).alias("key"))
    by_length = F.when(F.length("needle") >= 3, _grams(F.col("needle"), (3,))).otherwise(F.array("needle"))
    pairs, _ = anchor_pairs(gram_index, needles.select(F.col("needle").alias("qid"), by_length.alias("qkeys")))
    routes = pairs.filter(F.contains("id", "qid")).select(F.col("qid").alias("needle"), F.col("id").alias("key"))
    return staged(routes, "routes")


def substring_hits(df: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id`` of every record whose question or answer contains the query literally.

    The longest piece of the query between blanks must lie inside one chunk of the record. For a query of one
    piece that is the whole condition; for others the record's text is looked up and tested.
    """
    folded = queries.select("qid", T.fold_ascii(T.strip(F.col("query"))).alias("literal")).filter(F.col("literal") != "")
    pieces = F.split("literal", f"{T.WS}+")
    longest = F.aggregate(pieces, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    asked = folded.select("qid", "literal", longest.alias("needle"), (F.size(pieces) > 1).alias("open"))
    chunks = chunks_containing(index, asked.select("needle").distinct())
    routes = staged(asked.join(_side(chunks), "needle").select("qid", "literal", "open", "key"), "query-routes")
    pairs = index.join(_side(routes), "key").select("qid", "id", "literal", "open").distinct()
    inside = [F.contains(T.fold_ascii(F.col(c)), "literal") for c in ("question", "answer")]
    pairs = staged(pairs, "query-pairs")
    doubtful = pairs.filter("open")
    # A few pairs travel to the texts; many meet them by id.
    side = F.broadcast(doubtful) if doubtful.count() <= BROADCAST_PAIRS else doubtful
    tested = df.select("id", "question", "answer").join(side, "id").filter(inside[0] | inside[1])
    return pairs.filter(~F.col("open")).select("qid", "id").unionByName(tested.select("qid", "id"))


def search_with_fallback(df: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, via``: token hits, and literal hits for the queries that have none."""
    # The token index is read once, so only the postings of the asked tokens are written; chunks are only made for queries that need them.
    by_token = staged(token_hits(token_index(df), queries), "token-hits")
    rest = staged(queries.join(by_token.select("qid").distinct(), "qid", "left_anti"), "queries-left")
    found = by_token.withColumn("via", F.lit("token"))
    if rest.isEmpty():
        return found
    literal = substring_hits(df, staged(chunk_index(df), "chunks"), rest).withColumn("via", F.lit("literal"))
    return found.unionByName(literal)


def batch_search(hits: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """Page of ids (newest first) and total per query.

    The rank is limited on the map side and the total is an aggregate of its own, so a query that hits a third of
    the corpus never gathers its hits in one task.
    """
    w = W.partitionBy("qid").orderBy(F.desc("id"))
    top = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= page * size)
    totals = hits.groupBy("qid").agg(F.count("*").alias("total"))
    return top.filter(F.col("rank") > (page - 1) * size).join(totals, "qid").select("qid", "rank", "id", "total")


def snippet(c: Column, q: str | Column, n: int = 10, mark: tuple[str, str] = ("<b>", "</b>"), more: str = "...") -> Column:
    """``n`` words around the first hit, hits marked; without a hit the first ``n`` words. For the rows of one page."""
    wanted = F.array_distinct(T.tokens(F.lit(q) if isinstance(q, str) else q))

    def is_hit(w: Column) -> Column:
        return F.arrays_overlap(T.tokens(w), wanted)

    def cut(words: Column) -> Column:
        first = F.greatest(F.array_position(F.transform(words, is_hit), True).cast("int"), F.lit(1))
        start = F.greatest(F.least(first - n // 2, F.size(words) - n + 1), F.lit(1))

        def render(at: Column) -> Column:
            window = F.transform(
                F.slice(words, at, F.lit(n)), lambda w: F.when(is_hit(w), F.concat(F.lit(mark[0]), w, F.lit(mark[1]))).otherwise(w)
            )
            head = F.when(at > 1, F.lit(more)).otherwise(F.lit(""))
            tail = F.when(at + n - 1 < F.size(words), F.lit(more)).otherwise(F.lit(""))
            return F.concat(head, F.array_join(window, " "), tail)

        return T.let(start, render)

    words = F.filter(F.split(T.strip(c), f"{T.WS}+"), lambda w: w != "")
    return T.let(words, cut)


# Missed searches ----------------------------------------------------------------------------------------------


def search_miss_log(
    queries: DataFrame, hits: DataFrame, as_of: str, sources: Sequence[str] | None = None, category: str | None = None, width: int | None = None
) -> DataFrame:
    """One row per query without any hit."""
    asked = queries.select("qid", T.cut(T.strip(F.col("query")), width).alias("query")).filter(F.col("query") != "")
    missed = asked.join(hits.select("qid").distinct(), "qid", "left_anti")
    names = ",".join(sorted(s.strip() for s in sources or [] if s and s.strip())) or None
    return missed.select(
        "qid",
        "query",
        F.lit(0).cast("long").alias("results_count"),
        F.lit(names).cast("string").alias("source_filter"),
        F.lit(category.strip() if category and category.strip() else None).cast("string").alias("category_filter"),
        F.lit(as_of).cast("timestamp_ntz").alias("searched_at"),
        F.lit(False).alias("resolved"),
    )


def miss_list(df: DataFrame, resolved: bool | None = None, number: int = 1, size: int = 20) -> DataFrame:
    from askloom.operators.corpus import page, with_total

    rows = df if resolved is None else df.filter(F.col("resolved") == resolved)
    return with_total(page(rows, [F.desc("searched_at"), F.desc("id")], number, size), rows)


def miss_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("unresolved"))


def miss_top(df: DataFrame, n: int = 10) -> DataFrame:
    return df.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)


def miss_resolve(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with ``resolved`` set for the given ids."""
    marked = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return df.join(marked, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("hit", F.lit(False))).drop("hit")
