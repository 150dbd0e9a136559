"""Cache, prompt and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import conversation as O
from askloom.plans import duck as D
from askloom.plans.bind import AS_OF
from askloom.plans.registry import query
from askloom.plans.workflow import text_ts

C = F.col
REQ = "SELECT doc_id - doc_id % 2 AS record_id, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS language FROM {documents}"
D_REQ = "req AS (SELECT DISTINCT * FROM (" + REQ.format(documents="documents") + "))"


def requests(t):
    return t.spark.sql(REQ, documents=t.documents).distinct()


@query("cache_lookup", "cache", f"WITH {D_REQ} SELECT c.id, record_id, language, content FROM req JOIN cache c USING (record_id, language) WHERE cached_until > TIMESTAMP '{AS_OF}'")
def _(t):
    return O.cache_lookup(t.cache, requests(t), AS_OF).select("id", "record_id", "language", "content")


@query("cache_work_list", "cache", f"WITH {D_REQ} SELECT record_id, language FROM req r WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.record_id = r.record_id AND c.language = r.language AND cached_until > TIMESTAMP '{AS_OF}')")
def _(t):
    return O.cache_work_list(requests(t), t.cache, AS_OF)


@query(
    "cache_upsert",
    "cache",
    f"""WITH {D_REQ}, n AS (SELECT -1 AS id, record_id, language, 'made' AS content, TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '2024-02-24' AS cached_until, 1 AS fresh FROM req WHERE language = 'en'),
        b AS (SELECT id, record_id, language, content, created_at, cached_until, 0 AS fresh FROM cache UNION ALL SELECT * FROM n)
    SELECT record_id, language, id, content, {D.ts('created_at')} AS created_at, {D.ts('cached_until')} AS cached_until FROM b QUALIFY row_number() OVER (PARTITION BY record_id, language ORDER BY fresh DESC, created_at DESC, id DESC) = 1""",
)
def _(t):
    made = requests(t).filter(C("language") == "en").select("record_id", "language", F.lit(-1).cast("long").alias("id"), F.lit("made").alias("content"))
    return text_ts(O.cache_upsert(t.cache, made, AS_OF), "created_at", "cached_until")


@query(
    "translation_parse",
    "cache",
    f"""SELECT id, coalesce({D.strip("json_extract_string(j, '$.question')")}, '') AS question, coalesce({D.strip("json_extract_string(j, '$.answer')")}, '') AS answer,
        coalesce(json_extract_string(j, '$.question') <> '' OR json_extract_string(j, '$.answer') <> '', false) AS ok FROM (SELECT id, try_cast(content AS JSON) AS j FROM cache)""",
)
def _(t):
    return t.cache.select("id", O.translation_parse(C("content")).alias("p")).select("id", "p.question", "p.answer", "p.ok")


LANGS = {"en": "English", "ar": "Arabic"}


@query(
    "prompt_rows",
    "records",
    """SELECT id, l.code AS language, 'Summarise the answer in simple ' || l.name || ', in at most four sentences.' || chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || answer AS prompt
       FROM records, (VALUES ('en', 'English'), ('ar', 'Arabic')) AS l(code, name)""",
)
def _(t):
    return O.prompt_rows(t.records, O.TEMPLATES["summary"], LANGS)


@query(
    "chat_context",
    "messages",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, turn DESC) AS rn FROM messages)
    SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY created_at, turn) || chr(10) || 'user: and then?' AS messages FROM r WHERE rn <= 10 GROUP BY session_id""",
)
def _(t):
    new = t.sessions.select("session_id", F.lit("and then?").alias("message"))
    out = O.with_new_message(O.chat_context(t.messages), new)
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return out.select("session_id", F.array_join(line, "\n").alias("messages"))


@query("chat_transcript", "messages", f"SELECT session_id, turn, role, content, {D.ts('created_at')} AS created_at FROM messages ORDER BY session_id, created_at, turn")
def _(t):
    return text_ts(O.chat_transcript(t.messages), "created_at")


@query(
    "recent_sessions",
    "sessions",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC, session_id DESC) AS k FROM sessions WHERE is_active),
       m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn) AS rn FROM messages)
    SELECT s.user_id, CAST(s.k AS INT) AS session_rank, s.session_id, s.record_id, string_agg(m.role || ': ' || m.content, chr(10) ORDER BY m.created_at, m.turn) AS messages
    FROM s LEFT JOIN m ON m.session_id = s.session_id AND rn <= 10 WHERE k <= 10 GROUP BY ALL""",
)
def _(t):
    out = O.recent_sessions(t.sessions, t.messages)
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return out.withColumn("messages", F.array_join(line, "\n"))


@query(
    "session_upsert",
    "sessions",
    f"""SELECT coalesce(m.session_id, s.session_id) AS session_id, coalesce(min(s.user_id), min(m.user_id)) AS user_id, coalesce(min(s.record_id), min(m.record_id)) AS record_id,
        {D.ts("coalesce(min(s.created_at), min(m.created_at))")} AS created_at, {D.ts("greatest(max(m.created_at), max(s.last_message_at))")} AS last_message_at, count(m.session_id) AS n_messages
        FROM messages m FULL JOIN (SELECT session_id + k AS session_id, user_id, record_id, created_at - INTERVAL 1 DAY AS created_at, last_message_at FROM sessions, (VALUES (0), (1000000000)) v(k) WHERE is_active) s
        ON s.session_id = m.session_id GROUP BY 1""",
)
def _(t):
    old = t.sessions.filter("is_active").withColumn("created_at", C("created_at") - F.expr("INTERVAL '1' DAY"))
    # As many stored sessions again have no new messages.
    idle = old.withColumn("session_id", C("session_id") + 1000000000)
    return text_ts(O.session_upsert(t.messages, old.unionByName(idle)), "created_at", "last_message_at")


@query(
    "session_owner_check",
    "sessions",
    """SELECT m.session_id, m.turn, CASE WHEN s.session_id IS NULL THEN 'session not found' ELSE 'session does not match' END AS reason
       FROM (SELECT session_id, turn, CASE WHEN turn % 5 = 1 THEN user_id + 1 ELSE user_id END AS user_id, CASE WHEN turn % 7 = 2 THEN record_id + 1 ELSE record_id END AS record_id FROM messages) m
       LEFT JOIN (SELECT * FROM sessions WHERE is_active) s ON s.session_id = m.session_id WHERE s.session_id IS NULL OR s.user_id <> m.user_id OR s.record_id <> m.record_id""",
)
def _(t):
    claimed = t.messages.withColumns(
        {
            "user_id": F.when(C("turn") % 5 == 1, C("user_id") + 1).otherwise(C("user_id")),
            "record_id": F.when(C("turn") % 7 == 2, C("record_id") + 1).otherwise(C("record_id")),
        }
    )
    return O.session_owner_check(claimed, t.sessions.filter("is_active")).select("session_id", "turn", "reason")


D_RUNS = """pts AS (SELECT user_id, ts, ts > lag(ts) OVER u + INTERVAL 30 MINUTE AS cut, max(ts) OVER () AS newest FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
    nmb AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM pts),
    runs AS (SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS n, max(newest) AS newest FROM nmb GROUP BY user_id, run)"""


@query(
    "event_sessions",
    oracle=f"WITH {D_RUNS} SELECT user_id, epoch_us(started) AS started_us, epoch_us(last) AS last_us, n FROM runs",
)
def _(t):
    timed = t.events.withColumn("ts", C("ts").cast("timestamp"))
    out = O.event_sessions(timed, "user_id", "ts")
    return out.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_at").alias("last_us"), "n")
