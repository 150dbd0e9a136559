"""Caches of derived texts, prompt rows and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.operators.blocked import day

# Cache validity and history sizes.
CACHE_DAYS = 30
HISTORY = 10
RECENT = 10


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _valid(cache: DataFrame, as_of: str) -> DataFrame:
    return cache.filter(F.col("cached_until") > _ts(as_of))


def cache_lookup(cache: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    """Valid cache rows of the requested (record, language) pairs."""
    return requests.join(_valid(cache, as_of), ["record_id", "language"])


def cache_work_list(requests: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Requested pairs without a valid row: what has to be made."""
    keys = ["record_id", "language"]
    return requests.select(*keys).distinct().join(_valid(cache, as_of).select(*keys), keys, "left_anti")


def cache_upsert(cache: DataFrame, rows: DataFrame, as_of: str, days: int = CACHE_DAYS) -> DataFrame:
    """One row per (record, language): new rows replace stored ones, the newest stored row wins otherwise."""
    now = _ts(as_of)
    new = rows.withColumns({"created_at": now, "cached_until": now + F.expr(f"INTERVAL '{days}' DAY")})
    columns = [c for c in cache.columns if c not in ("record_id", "language", "created_at", "id")]
    both = cache.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))
    newest = both.groupBy("record_id", "language").agg(F.max(F.struct("fresh", "created_at", "id", *columns)).alias("m"))
    return newest.select("record_id", "language", "m.*").drop("fresh")


def translation_parse(c: Column) -> Column:
    """``question, answer, ok`` of a JSON text; malformed text or two empty fields are a failure."""
    parsed = F.from_json(c, "question string, answer string")
    q, a = (F.coalesce(T.strip(F.get_json_object(c, f"$.{k}")), F.lit("")) for k in ("question", "answer"))
    usable = (parsed.isNotNull()) & ((q != "") | (a != ""))
    return F.struct(q.alias("question"), a.alias("answer"), F.coalesce(usable, F.lit(False)).alias("ok"))


# Prompt templates are parameters; these are neutral defaults of our own.
TEMPLATES = {
    "translate": "Translate question and answer into {language}. Reply with a JSON object of the keys question and answer.\nQuestion: {question}\nAnswer: {answer}",
    "summary": "Summarise the answer in simple {language}, in at most four sentences.\nQuestion: {question}\nAnswer: {answer}",
    "chat": "Reply in {language} and only from this record.\nQuestion: {question}\nAnswer: {answer}",
}


def prompt_rows(df: DataFrame, template: str, languages: dict[str, str]) -> DataFrame:
    """``id, language, prompt`` for every record and language. The calls themselves are made elsewhere."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("language"), F.lit(v).alias("name")) for k, v in languages.items()]))
    rows = df.select("id", "question", "answer", named.alias("l"))
    pieces: list[Column] = []
    fields = {"language": F.col("l.name"), "question": F.coalesce("question", F.lit("")), "answer": F.coalesce("answer", F.lit(""))}
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        pieces.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        pieces.append(fields[name])
    return rows.select("id", "l.language", F.concat(*pieces).alias("prompt"))


def chat_context(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """Last ``n`` messages per session in time order. The rank is limited before the shuffle as well."""
    w = W.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("turn"))
    last = messages.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    entry = F.struct("created_at", "turn", "role", "content")
    return last.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("history"))


def with_new_message(context: DataFrame, new: DataFrame) -> DataFrame:
    """Role and content list for the next reply: history plus the new user message of each session."""
    history = F.transform(F.coalesce("history", F.array().cast(context.schema["history"].dataType)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    own = F.array(F.struct(F.lit("user").alias("role"), F.col("message").alias("content")))
    return new.join(context, "session_id", "left").select("session_id", F.concat(history, own).alias("messages"))


def chat_transcript(messages: DataFrame) -> DataFrame:
    """All messages in session and time order, as rows with their position.

    Rows rather than one array per session: a session may be of any length. The global sort is a range
    shuffle on (session, time, turn), which also splits one very long session over several tasks.
    """
    return messages.orderBy("session_id", "created_at", "turn").select("session_id", "turn", "role", "content", "created_at")


def recent_sessions(sessions: DataFrame, messages: DataFrame, n: int = RECENT, first: int = HISTORY) -> DataFrame:
    """The newest ``n`` active sessions of every user, each with its first ``first`` messages."""
    newest = W.partitionBy("user_id").orderBy(F.desc("last_message_at"), F.desc("session_id"))
    top = sessions.filter("is_active").withColumn("session_rank", F.row_number().over(newest)).filter(F.col("session_rank") <= n)
    opening = W.partitionBy("session_id").orderBy("created_at", "turn")
    # Only messages of the listed sessions are ranked.
    asked = messages.select("session_id", "created_at", "turn", "role", "content").join(top.select("session_id"), "session_id", "left_semi")
    head = asked.withColumn("rn", F.row_number().over(opening))
    heads = head.filter(F.col("rn") <= first).groupBy("session_id")
    listed = heads.agg(F.array_sort(F.collect_list(F.struct("created_at", "turn", "role", "content"))).alias("messages"))
    return top.select("user_id", "session_rank", "session_id", "record_id").join(listed, "session_id", "left")


def session_upsert(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Sessions with first and last message time and message count.

    Stored sessions stay, also without new messages (count 0), with their owner, record and creation time.
    """
    per = messages.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.min("record_id").alias("record_id"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_message_at"),
        F.count("*").alias("n_messages"),
    )
    if sessions is None:
        return per
    kept = ("user_id", "record_id", "created_at", "last_message_at")
    old = sessions.select("session_id", *[F.col(c).alias(f"old_{c}") for c in kept])
    joined = per.join(old, "session_id", "full")
    return joined.select(
        "session_id",
        *[F.coalesce(f"old_{c}", c).alias(c) for c in ("user_id", "record_id", "created_at")],
        F.greatest("last_message_at", "old_last_message_at").alias("last_message_at"),
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
    )


def session_owner_check(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages that name an unknown session, or a session of another user or record, with ``reason``."""
    owners = sessions.select("session_id", F.col("user_id").alias("owner"), F.col("record_id").alias("topic"))
    joined = messages.join(owners, "session_id", "left")
    reason = F.when(F.col("owner").isNull(), F.lit("session not found")).when(
        (F.col("owner") != F.col("user_id")) | (F.col("topic") != F.col("record_id")), F.lit("session does not match")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("owner", "topic")


def event_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", block=day) -> DataFrame:
    """``key, started_at, last_at, n``: runs of events of a key whose neighbours are at most ``gap`` apart.

    Events without a key or time are left out; NULL is no key. Runs are made per (key, day), and only these, one row each,
    are joined along the key, so that a key with most of the events is split by its days.
    """
    width = F.expr(f"INTERVAL {gap}")

    def runs(df: DataFrame, keys: list[str]) -> DataFrame:
        order = W.partitionBy(*keys).orderBy("started_at", "last_at")
        starts = (F.col("started_at") > F.lag("last_at").over(order) + width).cast("int")
        numbered = df.withColumn("_run", F.sum(F.coalesce(starts, F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        totals = F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n")
        return numbered.groupBy(*keys, "_run").agg(*totals).drop("_run")

    timed = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    # Equal times are counted before they are ordered.
    points = timed.groupBy(key, block(ts).alias("_block"), F.col(ts).alias("started_at")).agg(F.count("*").alias("n"))
    parts = runs(points.withColumn("last_at", F.col("started_at")), [key, "_block"])
    return runs(parts.drop("_block"), [key]).select(key, "started_at", "last_at", "n")
