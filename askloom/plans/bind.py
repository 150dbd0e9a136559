"""Inputs of the operators, derived from the given tables.

Each derived table is one SELECT that both engines understand. Spark gets it through ``spark.sql`` with the
DataFrames passed by name, DuckDB as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from askloom.session import spread

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TEXTS = ("documents", "pages")  # parsing these is CPU-bound

AS_OF = "2024-01-25 00:00:00"  # evaluation time for tables derived from events and documents
AS_OF_ORDERS = "2001-07-15 00:00:00"  # evaluation time for tables derived from orders

DERIVED: dict[str, str] = {
    # Question/answer records: the first line asks, the rest answers.
    "records": """
        SELECT doc_id AS id,
               split_part(text, chr(10), 1) AS question,
               substr(text, length(split_part(text, chr(10), 1)) + 2) AS answer,
               source,
               concat('https://Lib.Example.ORG/r/', CAST(doc_id AS STRING), '/') AS url,
               CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE lang END AS category
        FROM {documents}""",
    # Crawled records whose address repeats when the question repeats.
    "incoming": """
        SELECT id AS seq, question, answer, source, category,
               concat('HTTPS://Lib.Example.ORG/q/', md5(question), '/#', CAST(id AS STRING)) AS url
        FROM {records}""",
    # What an earlier run has stored: the questions of one source group.
    "stored": """
        SELECT min(id) AS id, concat('https://lib.example.org/q/', md5(question)) AS url
        FROM {records} WHERE source IN ('src1', 'src2', 'src3', 'src4') GROUP BY question""",
    "questions": """
        SELECT q.*,
               CASE WHEN reviewer_id IS NOT NULL THEN submitted_at + INTERVAL '1' DAY END AS assigned_at,
               CASE WHEN status IN ('answered', 'published') AND id % 11 <> 0
                    THEN submitted_at + (id % 40 - 2) * INTERVAL '1' DAY END AS answered_at
        FROM (SELECT o_orderkey AS id, o_custkey AS user_id,
                     CASE WHEN o_orderkey % 7 = 0 THEN NULL
                          ELSE o_custkey % (SELECT count(*) FROM {supplier}) END AS reviewer_id,
                     CASE WHEN o_orderstatus = 'F' THEN 'answered' WHEN o_orderstatus = 'O' THEN 'pending'
                          WHEN o_orderkey % 3 = 0 THEN 'published' WHEN o_orderkey % 3 = 1 THEN 'reviewing'
                          ELSE 'rejected' END AS status,
                     CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'paid' ELSE 'unpaid' END AS payment_status,
                     CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN CAST(15 AS DOUBLE) END AS payment_amount,
                     o_orderdate AS updated_at,
                     o_orderdate AS submitted_at
              FROM {orders}) AS q""",
    "reviewers": """
        SELECT s_suppkey AS id, s_suppkey AS user_id, s_name AS display_name,
               CAST(15 + s_suppkey % 5 AS DOUBLE) AS rate, s_suppkey % 3 <> 0 AS is_available,
               CAST(s_suppkey % 9 AS BIGINT) AS total_answered, CAST(s_acctbal AS DOUBLE) AS total_earned,
               TIMESTAMP_NTZ '2000-01-01 00:00:00' + s_suppkey * INTERVAL '1' DAY AS joined_at
        FROM {supplier}""",
    "users": """
        SELECT c_custkey AS id, lower(concat(c_name, '@example.org')) AS email, c_name AS name,
               CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'google'
                    WHEN c_mktsegment = 'FURNITURE' THEN 'apple' ELSE 'guest' END AS provider,
               CASE WHEN c_nationkey = 0 THEN 'admin'
                    WHEN c_custkey < (SELECT count(*) FROM {supplier}) THEN 'reviewer' ELSE 'user' END AS role,
               TIMESTAMP_NTZ '2023-01-01 00:00:00' + (c_custkey % 300) * INTERVAL '1' DAY AS created_at
        FROM {customer}""",
    "subscriptions": """
        SELECT event_id AS id, user_id,
               CASE WHEN event_id % 3 = 0 THEN 'yearly' ELSE 'monthly' END AS plan,
               CASE WHEN event_id % 4 = 3 THEN 'cancelled' ELSE 'active' END AS status,
               ts AS created_at,
               CASE WHEN event_id % 17 <> 0 THEN ts + (event_id % 20) * INTERVAL '1' DAY END AS expires_at
        FROM {events} WHERE event_type = 'signup'""",
    "trials": """
        SELECT event_id AS id, user_id, CAST(event_id % 4 AS BIGINT) AS used_count, CAST(3 AS BIGINT) AS max_count
        FROM {events} WHERE event_type = 'signup' AND value > 20""",
    "uses": """
        SELECT event_id AS id, user_id, ts AS used_at FROM {events} WHERE event_type = 'click'""",
    "donations": """
        SELECT event_id AS id, user_id, value AS amount,
               CASE WHEN event_id % 4 = 0 THEN 'USD' ELSE 'PKR' END AS currency,
               CASE WHEN event_id % 3 = 0 THEN 'success' WHEN event_id % 3 = 1 THEN 'pending' ELSE 'failed' END AS status,
               event_id % 5 = 0 AS week_granted, ts AS donated_at
        FROM {events} WHERE event_type = 'purchase'""",
    "misses": """
        SELECT event_id AS id, regexp_extract(props, '([0-9]+)', 1) AS query, event_id % 3 = 0 AS resolved,
               ts AS searched_at
        FROM {events} WHERE event_type = 'error'""",
    # Search requests: the start of a benchmark item, a part of a word, a reversed text, in turn.
    "searches": """
        SELECT item_id AS qid,
               CASE WHEN item_id % 3 = 0 THEN concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2))
                    WHEN item_id % 3 = 1 THEN substr(split_part(text, ' ', 2), 2)
                    ELSE reverse(split_part(text, ' ', 3)) END AS query
        FROM {benchmark}""",
    # Searches by words: three words of a benchmark item, some as a phrase, some with the last one cut, some for one field.
    "phrases": """
        SELECT item_id AS qid,
               concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3), ' ',
                      CASE WHEN item_id % 2 = 1 THEN substr(split_part(text, ' ', 4), 1, 2) ELSE split_part(text, ' ', 4) END) AS query,
               item_id % 3 <> 2 AS phrase, item_id % 2 = 1 AS prefix,
               CASE WHEN item_id % 5 = 0 THEN 'question' WHEN item_id % 5 = 1 THEN 'answer' END AS field
        FROM {benchmark}""",
    # Records after some were deleted and others replaced.
    "kept_records": """
        SELECT id, CASE WHEN category = 'es' THEN answer ELSE question END AS question,
               CASE WHEN category = 'es' THEN question ELSE answer END AS answer, source, category
        FROM {records} WHERE id NOT IN (SELECT doc_id FROM {labels} WHERE quality = 0)""",
    "messages": """
        SELECT conv_id AS session_id, turn, role, text AS content, conv_id % 150 AS user_id, conv_id AS record_id,
               TIMESTAMP_NTZ '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS created_at
        FROM {conversations}""",
    "sessions": """
        SELECT session_id, min(user_id) AS user_id, min(record_id) AS record_id, min(created_at) AS created_at,
               max(created_at) AS last_message_at, session_id % 4 <> 0 AS is_active
        FROM {messages} GROUP BY session_id""",
    # Cached derived texts per record and language, some already stale.
    "cache": """
        SELECT doc_id AS id, doc_id - doc_id % 2 AS record_id, lang AS language,
               CASE WHEN doc_id % 5 = 0 THEN concat('{{"question": "', source)
                    WHEN doc_id % 7 = 0 THEN '{{"question": "", "answer": ""}}'
                    ELSE concat('{{"question": "', source, '", "answer": "', lang, '"}}') END AS content,
               TIMESTAMP_NTZ '2024-01-10 00:00:00' + doc_id * INTERVAL '1' SECOND AS created_at,
               TIMESTAMP_NTZ '2024-01-20 00:00:00' + (doc_id % 10) * INTERVAL '1' DAY AS cached_until
        FROM {documents}""",
    # Requests for the crawled pages, in bursts.
    "requests": """
        SELECT page_id AS seq, url, CAST(page_id - page_id % 40 AS BIGINT) * 300 AS ready_ms FROM {pages}""",
    # Links from a listing page to the next one of its site and language; some are missing, the last page of some leads back to the first.
    "next_links": """
        SELECT page_id AS page_id, CASE WHEN page_id % 11 = 3 THEN NULL WHEN following IS NULL AND page_id % 2 = 0 THEN first_id ELSE following END AS following_id
        FROM (SELECT page_id, lead(page_id) OVER (PARTITION BY split_part(split_part(url, '/', 3), '.', 3), split_part(url, '/', 4) ORDER BY page_id) AS following,
                     min(page_id) OVER (PARTITION BY split_part(split_part(url, '/', 3), '.', 3), split_part(url, '/', 4)) AS first_id FROM {pages}) AS p""",
    "listings": """
        SELECT page_id AS seq, regexp_extract(lower(url), '//([^/?#]*)', 1) AS path, url, html FROM {pages}""",
}


def _deps(sql: str) -> list[str]:
    return [d for d in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)]


class Tables:
    """Given and derived tables by attribute, each a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            df = spread(df) if name in TEXTS else df
        elif name in DERIVED:
            sql = DERIVED[name]
            df = self.spark.sql(sql, **{d: getattr(self, d) for d in dict.fromkeys(_deps(sql))})
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df


def _order(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n in DERIVED and n not in seen:
            _order(_deps(DERIVED[n]), seen)
            seen.append(n)
    return seen


def with_tables(names: list[str], body: str) -> str:
    """``body`` for DuckDB with the derived tables it needs in front."""
    ctes = []
    for n in _order(names, []):
        sql = DERIVED[n].format(**{d: d for d in _deps(DERIVED[n])})
        ctes.append(f"{n} AS ({sql})".replace("TIMESTAMP_NTZ '", "TIMESTAMP '"))
    body, head = body.strip(), "WITH "
    if body.upper().startswith("WITH RECURSIVE "):
        body, head = "WITH " + body[15:], "WITH RECURSIVE "
    if not ctes:
        return head + body[5:] if head != "WITH " else body
    joint = ",\n" if body.upper().startswith("WITH ") else "\n"
    return head + ",\n".join(ctes) + joint + (body[5:] if joint == ",\n" else body)
