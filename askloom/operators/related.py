"""Related records: by category, filled up by keyword; the cache of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.operators.search import _side, chunk_index, chunks_containing
from askloom.session import staged

# Sizes, scores and validity of the related list.
CATEGORY_SAMPLE, KEYWORD_STEP, MAX_LIMIT = 10, 5, 10
CATEGORY_SCORE, KEYWORD_SCORE = 0.8, 0.5
CACHE_DAYS = 7


def _card() -> Column:
    """What a related entry shows of a record; carried along so that no join back to the corpus is needed."""
    return F.struct("id", F.substring(F.coalesce("question", F.lit("")), 1, 150).alias("question"), "category", "source")


def related_by_category(df: DataFrame, seed: int | None = 0, n: int = CATEGORY_SAMPLE, group: int = 100_000) -> DataFrame:
    """``id, found``: up to ``n`` other records of the same category as an array of entries.

    Records of a category stand in a ring, in seeded hash order (id order with ``seed=None``); each gets the ``n`` that follow
    it, so every record is recommended as often as any other. A category of more than ``group`` records is cut into
    ranges of equal width along that order, which bounds what one task orders and changes no result: the last ``n`` records of a range go on
    with the first ones of the ranges behind it, and the last range with the first.
    """
    order = F.col("id") if seed is None else F.xxhash64(F.lit(seed), F.col("id"))
    named = df.filter(F.coalesce("category", F.lit("")) != "").select("id", "category", _card().alias("card"), order.alias("place"))
    place = F.col("place").cast("double")
    sizes = named.groupBy(F.col("category").alias("c")).agg(F.ceil(F.count("*") / group).alias("ranges"), F.min(place).alias("low"), F.max(place).alias("high"))
    share = F.when(F.col("high") > F.col("low"), (place - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    range_ = F.least(F.floor(share * F.col("ranges")), F.col("ranges") - 1)
    cut = named.join(sizes, F.col("category") == F.col("c")).withColumn("range", range_).drop("c", "low", "high")
    w = W.partitionBy("category", "range").orderBy("place", "id")
    after = cut.withColumns({"rn": F.row_number().over(w), "found": F.collect_list("card").over(w.rowsBetween(1, n))})
    full = after.filter(F.size("found") == n).select("id", "found")
    heads = after.filter(F.col("rn") <= n).groupBy("category", "range", "ranges").agg(F.array_sort(F.collect_list(F.struct("rn", "card"))).alias("heads"))
    heads = heads.select("category", "range", "ranges", F.transform("heads", lambda h: h["card"]).alias("heads"))
    # Behind the last range stand the first ones again. No range is empty, so n ranges hold n records.
    first = heads.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy("range"))).filter(F.col("k") <= n)
    ring = heads.unionByName(first.drop("k").withColumn("range", F.col("range") + F.col("ranges")))
    behind = F.flatten(F.collect_list("heads").over(W.partitionBy("category").orderBy("range").rowsBetween(1, n)))
    behind = ring.withColumn("behind", behind).filter(F.col("range") < F.col("ranges"))
    behind = behind.select(F.col("category").alias("c"), F.col("range").alias("r"), F.slice("behind", 1, 2 * n + 1).alias("behind"))
    ends = after.filter(F.size("found") < n).join(behind, (F.col("category") == F.col("c")) & (F.col("range") == F.col("r")))
    # A small category comes back to the record itself.
    others = F.filter(F.array_distinct(F.concat("found", "behind")), lambda x: x["id"] != F.col("id"))
    ends = ends.select("id", F.slice(others, 1, n).alias("found"))
    alone = df.filter(F.coalesce("category", F.lit("")) == "").select("id", F.array().cast(full.schema["found"].dataType).alias("found"))
    return full.unionByName(ends).unionByName(alone)


def keyword_matches(df: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """``keyword, cards``: the first ``n`` records by id whose question or answer contains the keyword.

    Keywords hold no white space, so a text contains one exactly when one of its chunks does. The vocabulary maps
    keywords to chunks and the index maps chunks to records. Ranking by ``dense_rank`` lets a record that holds the
    keyword in several chunks count once. The index is reduced to the first ``n`` records of each chunk before it meets the
    vocabulary, so a chunk that most records hold costs ``n`` rows.
    """
    index = staged(chunk_index(df), "chunks")
    routes = chunks_containing(index, words.select(F.col("keyword").alias("needle")))
    # No chunk needs more than its first n records, however many hold it.
    top = index.withColumn("rn", F.dense_rank().over(W.partitionBy("key").orderBy("id"))).filter(F.col("rn") <= n).drop("rn")
    hits = top.join(_side(routes), "key").select(F.col("needle").alias("keyword"), "id")
    w = W.partitionBy("keyword").orderBy("id")
    first = hits.withColumn("rn", F.dense_rank().over(w)).filter(F.col("rn") <= n).select("keyword", "id").distinct()
    shown = first.join(df.select("id", _card().alias("card")), "id")
    return shown.groupBy("keyword").agg(F.array_sort(F.collect_list("card")).alias("cards"))


def related_records(df: DataFrame, limit: int = 5, seed: int | None = 0, stop=T.STOP_WORDS) -> DataFrame:
    """``id, rank, related_id, score, question, category, source``: category hits first, then keyword hits.

    Keywords are tried in order while fewer than ``limit`` records are found; each adds at most five new
    ones. At that point a record excludes itself and at most ``limit - 1`` found ones, so the first
    ``limit + 5`` records of each keyword hold everything that can be needed.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError("limit must be between 1 and 10")
    by_category = related_by_category(df, seed)
    kws = T.keywords(F.coalesce("question", F.lit("")), stop)
    # A record whose category has enough others needs no keywords. Ids that repeat or are NULL leave a ring short, so such categories ask.
    named = df.filter(F.coalesce("category", F.lit("")) != "")
    rings = named.groupBy(F.col("category").alias("c")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    filled = rings.filter((F.col("n") == F.col("ids")) & (F.col("n") > limit)).select("c")
    short = df.select("id", "category").join(filled, F.col("category") == F.col("c"), "left_anti").select("id")
    asked = staged(df.join(short, "id", "left_semi").select("id", F.transform(kws, T.fold_ascii).alias("kws")), "keywords")
    words = asked.select(F.explode("kws").alias("keyword")).distinct()
    matches = keyword_matches(df, words, limit + KEYWORD_STEP)
    per_word = asked.select("id", F.posexplode("kws").alias("pos", "keyword")).join(matches, "keyword")
    by_keyword = per_word.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "cards"))).alias("steps"))
    both = by_category.join(by_keyword, "id", "left")
    entry_type = "array<struct<card:struct<id:bigint,question:string,category:string,source:string>,score:double>>"

    def entries(cards: Column, score: float) -> Column:
        return F.transform(cards, lambda c: F.struct(c.alias("card"), F.lit(score).alias("score")))

    def fill(found: Column, step: Column) -> Column:
        fresh = F.filter(
            step["cards"],
            lambda c: (c["id"] != F.col("id")) & ~F.exists(found, lambda f: f["card"]["id"] == c["id"]),
        )
        more = entries(F.slice(fresh, 1, KEYWORD_STEP), KEYWORD_SCORE)
        return F.when(F.size(found) < limit, F.concat(found, more)).otherwise(found)

    steps = F.coalesce("steps", F.array().cast(both.schema["steps"].dataType))
    found = F.aggregate(steps, entries(F.col("found"), CATEGORY_SCORE).cast(entry_type), fill)
    return related_top(both.select("id", found.alias("found")), limit)


def related_top(found: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` entries by score; entries of one score keep their order. Category hits come first already."""
    out = found.select("id", F.posexplode(F.slice("found", 1, limit)).alias("pos", "e"))
    return out.select(
        "id",
        (F.col("pos") + 1).alias("rank"),
        F.col("e.card.id").alias("related_id"),
        F.col("e.score").alias("score"),
        F.col("e.card.question").alias("question"),
        F.col("e.card.category").alias("category"),
        F.col("e.card.source").alias("source"),
    )


def related_cache_write(related: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return related.select(
        F.col("id").alias("record_id"),
        "related_id",
        "score",
        now.alias("created_at"),
        (now + F.expr(f"INTERVAL '{CACHE_DAYS}' DAY")).alias("cached_until"),
    )


def related_cache_read(cache: DataFrame, df: DataFrame, as_of: str, limit: int = 5) -> DataFrame:
    """Valid cache rows of each record, best score first, with the entry's text; rows of deleted records drop out.

    The limit applies before the join, as a deleted target still takes its place in the cached list.
    """
    valid = cache.filter(F.col("cached_until") > F.lit(as_of).cast("timestamp_ntz"))
    w = W.partitionBy("record_id").orderBy(F.desc("score"), "related_id")
    top = valid.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    cards = df.select(F.col("id").alias("related_id"), F.substring("question", 1, 150).alias("question"), "category", "source")
    return top.select("record_id", "rank", "related_id", "score").join(cards, "related_id")
