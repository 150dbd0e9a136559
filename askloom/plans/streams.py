"""Streaming queries, run over the files that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from askloom.functions import urls as U
from askloom.operators import accounts as A
from askloom.operators import ingest as I
from askloom.plans.accounts import D_LATEST
from askloom.plans.conversation import D_RUNS
from askloom.plans.ingest import parse_pages
from askloom.plans.registry import REGISTRY, query
from askloom.session import checkpoint_root
from askloom.streaming import streams as O

C = F.col


def _folder(t, label: str) -> str:
    return f"{checkpoint_root(t.spark)}/{label}-{uuid.uuid4().hex}"


@query("ingest_stream", oracle=REGISTRY["flagship"].oracle)
def _(t):
    store = _folder(t, "ingest-stream")
    pages = O.read_table_stream(t.spark, t.sf_dir, "pages.parquet")
    O.ingest_stream(pages, parse_pages, store).start().awaitTermination()
    ledger = t.spark.read.schema("url string, source string, status string").parquet(f"{store}/ledger")
    return I.ingest_stats(ledger)


@query(
    "ingest_recent",
    oracle="SELECT DISTINCT lower(regexp_extract(url, '//([^/?#]*)', 1)) AS host FROM pages",
)
def _(t):
    pages = O.read_table_stream(t.spark, t.sf_dir, "pages.parquet")
    # All pages of a host arrive within the delay, so the host stands for a repeated URL.
    timed = pages.select(U.host(C("url")).alias("host"), F.timestamp_seconds(1704067200 + C("page_id") % 3600).alias("seen_at"))
    return O.run_to_table(O.ingest_recent(timed, "seen_at", "1 day", "host"), _folder(t, "recent")).select("host")


@query(
    "miss_stream",
    "misses",
    """SELECT strftime(day, '%Y-%m-%d') AS day, query, count(*) AS n FROM (SELECT date_trunc('day', searched_at) AS day, query, max(searched_at) OVER () AS newest FROM misses)
       WHERE day + INTERVAL 1 DAY <= newest - INTERVAL 1 DAY GROUP BY ALL""",
)
def _(t):
    events = O.read_table_stream(t.spark, t.sf_dir, "events.parquet").filter(C("event_type") == "error")
    misses = events.select(C("ts").cast("timestamp").alias("searched_at"), F.regexp_extract("props", "([0-9]+)", 1).alias("query"))
    out = O.run_to_table(O.miss_stream(misses), _folder(t, "miss-stream"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "query", "n")


@query(
    "trial_stream",
    "uses subscriptions",
    f"""WITH {D_LATEST}, a AS (SELECT u.id, u.user_id, u.used_at, coalesce(l.status = 'active' AND l.expires_at > u.used_at, false) AS paid FROM uses u LEFT JOIN latest l ON l.user_id = u.user_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, paid ORDER BY used_at, id) AS k FROM a)
    SELECT id, user_id, CASE WHEN paid THEN 'subscribed' WHEN k <= 3 THEN 'used' ELSE 'exhausted' END AS outcome FROM r""",
)
def _(t):
    events = O.read_table_stream(t.spark, t.sf_dir, "events.parquet").filter(C("event_type") == "click")
    newest = A.latest_subscription(t.subscriptions).select("user_id", "status", "expires_at")
    uses = events.select(C("event_id").alias("id"), "user_id", C("ts").alias("used_at")).join(newest, "user_id", "left")
    paid = A.subscription_valid(C("status"), C("expires_at"), C("used_at"))
    stream = O.trial_stream(uses.select("id", "user_id", C("used_at").cast("timestamp").alias("used_at"), paid.alias("paid")))
    return O.run_to_table(stream, _folder(t, "trial-stream")).select("id", "user_id", "outcome")


@query(
    "session_stream",
    oracle=f"""WITH {D_RUNS} SELECT user_id, epoch_us(started) AS started_us, epoch_us(last + INTERVAL 30 MINUTE) AS closed_us, n
       FROM runs WHERE last + INTERVAL 30 MINUTE <= newest - INTERVAL 1 HOUR""",
)
def _(t):
    events = O.read_table_stream(t.spark, t.sf_dir, "events.parquet").withColumn("ts", C("ts").cast("timestamp"))
    out = O.run_to_table(O.session_stream(events, "user_id", "ts"), _folder(t, "session-stream"))
    return out.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("closed_at").alias("closed_us"), "n")
