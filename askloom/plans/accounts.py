"""User, subscription, trial and donation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import accounts as O
from askloom.plans import duck as D
from askloom.plans.bind import AS_OF
from askloom.plans.registry import query
from askloom.plans.workflow import text_ts

C = F.col
FMT = "yyyy-MM-dd HH:mm:ss"
D_NOW = f"TIMESTAMP '{AS_OF}'"
D_LATEST = "latest AS (SELECT * FROM subscriptions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1)"
D_TRIAL = "trial AS (SELECT user_id, used_count, max_count FROM trials QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) = 1)"


@query("latest_subscription", "subscriptions", f"WITH {D_LATEST} SELECT user_id, id, plan, status, {D.ts('created_at')} AS created_at, {D.ts('expires_at')} AS expires_at FROM latest")
def _(t):
    return text_ts(O.latest_subscription(t.subscriptions), "created_at", "expires_at")


@query("subscription_valid", "subscriptions", f"SELECT id, coalesce(status = 'active' AND expires_at > {D_NOW}, false) AS is_valid FROM subscriptions")
def _(t):
    return t.subscriptions.select("id", O.subscription_valid(C("status"), C("expires_at"), F.lit(AS_OF).cast("timestamp_ntz")).alias("is_valid"))


@query("trial_row", "trials", f"WITH {D_TRIAL} SELECT * FROM trial")
def _(t):
    return O.trial_row(t.trials)


D_STATUS = f"""{D_LATEST}, {D_TRIAL}, st AS (SELECT u.id, u.provider, u.created_at, l.plan, l.status AS subscription_status, coalesce(l.status = 'active' AND l.expires_at > {D_NOW}, false) AS can_save,
    greatest(coalesce(max_count, 3) - coalesce(used_count, 0), 0) AS trials_remaining FROM users u LEFT JOIN latest l ON l.user_id = u.id LEFT JOIN trial t ON t.user_id = u.id)"""
STATUS_COLS = ["id", "plan", "subscription_status", "can_save", "trials_remaining", "can_use_ai"]


@query("user_status", "users subscriptions trials", f"WITH {D_STATUS} SELECT id, plan, subscription_status, can_save, trials_remaining, can_save OR trials_remaining > 0 AS can_use_ai FROM st")
def _(t):
    return O.user_status(t.users, t.subscriptions, t.trials, AS_OF).select(*STATUS_COLS)


@query(
    "user_list_status",
    "users subscriptions trials",
    f"""WITH {D_STATUS} SELECT id, plan, subscription_status, can_save, trials_remaining, can_save OR trials_remaining > 0 AS can_use_ai,
        (SELECT count(*) FROM users WHERE provider = 'google') AS total FROM st WHERE provider = 'google' ORDER BY created_at DESC, id DESC LIMIT 25""",
)
def _(t):
    out = O.user_list_status(t.users, t.subscriptions, t.trials, AS_OF, "google", 1, 25)
    return out.select(*STATUS_COLS, "total")


LINKS = """SELECT DISTINCT user_id AS guest_id, user_id - user_id % 4 AS user_id FROM {events} WHERE event_type = 'click' AND value > 60"""
D_LINKS = "lnk AS (" + LINKS.format(events="events") + ")"


def merged(t):
    return O.guest_merge(t.spark.sql(LINKS, events=t.events), t.trials, t.users.withColumn("is_active", F.lit(True)))


@query(
    "guest_merge",
    "trials",
    f"""WITH {D_TRIAL}, {D_LINKS}, g AS (SELECT l.user_id, max(coalesce(used_count, 0)) AS gu FROM lnk l LEFT JOIN trial t ON t.user_id = l.guest_id WHERE l.guest_id <> l.user_id GROUP BY 1)
    SELECT coalesce(t.user_id, g.user_id) AS user_id, greatest(coalesce(used_count, 0), coalesce(gu, 0)) AS used_count, coalesce(max_count, 3) AS max_count FROM trial t FULL JOIN g ON g.user_id = t.user_id""",
)
def _(t):
    return merged(t)[0]


@query("guest_merge_users", "users", f"WITH {D_LINKS} SELECT id, id NOT IN (SELECT guest_id FROM lnk WHERE guest_id <> user_id) AS is_active FROM users")
def _(t):
    return merged(t)[1].select("id", "is_active")


@query(
    "trial_replay",
    "uses subscriptions trials",
    f"""WITH {D_TRIAL}, a AS (SELECT u.id, u.user_id, u.used_at, coalesce(s.status = 'active' AND s.expires_at > u.used_at, false) AS paid
            FROM uses u ASOF LEFT JOIN subscriptions s ON s.user_id = u.user_id AND u.used_at >= s.created_at),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, paid ORDER BY used_at, id) AS k FROM a)
    SELECT id, r.user_id, CASE WHEN paid THEN 'subscribed' WHEN k <= coalesce(max_count, 3) - coalesce(used_count, 0) THEN 'used' ELSE 'exhausted' END AS outcome
    FROM r LEFT JOIN trial t ON t.user_id = r.user_id""",
)
def _(t):
    return O.trial_replay(t.uses, t.subscriptions, t.trials).select("id", "user_id", "outcome")


SIGNINS = """SELECT event_id AS id, ts, CASE WHEN event_id % 3 = 0 THEN 'guest' WHEN event_id % 3 = 1 THEN 'email' ELSE 'apple' END AS provider, concat(' g', CAST(user_id AS STRING)) AS guest_id,
    concat('uid-', CAST(user_id AS STRING), ' ') AS provider_uid, concat('Customer#', lpad(CAST(user_id AS STRING), 9, '0'), '@Example.org') AS email FROM {events} WHERE event_type IN ('signup', 'view')"""
D_SIGNINS = "sgn AS (" + SIGNINS.format(events="events") + ")"


@query(
    "identity_upsert",
    "users",
    f"""WITH {D_SIGNINS}, k AS (SELECT ts, CASE provider WHEN 'guest' THEN 'guest:' || trim(guest_id) WHEN 'email' THEN 'email:' || lower(trim(email)) ELSE provider || ':' || trim(provider_uid) END AS key FROM sgn),
        s AS (SELECT key, min(ts) AS a, max(ts) AS b FROM k GROUP BY key), u AS (SELECT 'email:' || email AS key, created_at FROM users)
    SELECT coalesce(u.key, s.key) AS key, {D.ts('coalesce(created_at, a)')} AS created_at, {D.ts('coalesce(greatest(b, created_at), b, created_at)')} AS last_seen_at, u.key IS NULL AS is_new FROM u FULL JOIN s ON s.key = u.key""",
)
def _(t):
    signins = t.spark.sql(SIGNINS, events=t.events)
    events = signins.select("ts", O.identity_key(C("provider"), C("guest_id"), C("provider_uid"), C("email")).alias("key"))
    users = t.users.select(F.concat(F.lit("email:"), "email").alias("key"), "created_at", C("created_at").alias("last_seen_at"))
    return text_ts(O.identity_upsert(events, users), "created_at", "last_seen_at")


@query(
    "subscription_append",
    "subscriptions users",
    """SELECT id, user_id, plan, status FROM subscriptions UNION ALL
       SELECT event_id, user_id, plan, 'active' FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 1000000000 ELSE user_id END AS user_id, CASE WHEN event_id % 5 = 0 THEN 'weekly' ELSE 'monthly' END AS plan FROM events WHERE event_type = 'purchase')
       WHERE plan = 'monthly' AND user_id IN (SELECT id FROM users)""",
)
def _(t):
    return O.subscription_append(subscription_rows(t), t.users, t.subscriptions).select("id", "user_id", "plan", "status")


def subscription_rows(t):
    bought = t.events.filter(C("event_type") == "purchase")
    return bought.select(
        C("event_id").alias("id"),
        F.when(C("event_id") % 9 == 0, F.lit(1000000000)).otherwise(C("user_id")).alias("user_id"),
        F.when(C("event_id") % 5 == 0, F.lit("weekly")).otherwise(F.lit("monthly")).alias("plan"),
        F.lit("active").alias("status"),
        C("ts").alias("created_at"),
        C("ts").alias("expires_at"),
    )


@query(
    "subscription_rejects",
    "users",
    """SELECT event_id AS id, CASE WHEN plan <> 'monthly' THEN 'domain' ELSE 'user not found' END AS reason
       FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 1000000000 ELSE user_id END AS user_id, CASE WHEN event_id % 5 = 0 THEN 'weekly' ELSE 'monthly' END AS plan FROM events WHERE event_type = 'purchase')
       WHERE plan <> 'monthly' OR user_id NOT IN (SELECT id FROM users)""",
)
def _(t):
    out = O.subscription_requests(subscription_rows(t), t.users).filter(C("reason") != "")
    return out.select("id", F.when(C("reason") == "user not found", C("reason")).otherwise("domain").alias("reason"))


@query(
    "donation_validate",
    "donations users",
    """SELECT d.id, CASE WHEN currency = 'PKR' AND amount < 50 OR currency = 'USD' AND amount < 0.5 THEN 'below minimum' WHEN u.id IS NULL THEN 'user not found' END AS reason
       FROM (SELECT *, CASE WHEN id % 10 = 0 THEN user_id + 1000000000 ELSE user_id END AS uid FROM donations) d LEFT JOIN users u ON u.id = d.uid""",
)
def _(t):
    rows = t.donations.withColumn("user_id", F.when(C("id") % 10 == 0, C("user_id") + 1000000000).otherwise(C("user_id")))
    return O.donation_validate(rows, t.users).select("id", "reason")


@query(
    "donation_history",
    "donations",
    f"""SELECT id, amount, currency, status, {D.ts('donated_at')} AS donated_at, (SELECT CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS DOUBLE) FROM donations WHERE user_id = 3 AND currency = 'PKR' AND status = 'success') AS total_donated_pkr
        FROM donations WHERE user_id = 3""",
)
def _(t):
    return text_ts(O.donation_history(t.donations, 3).select("id", "amount", "currency", "status", "donated_at", "total_donated_pkr"), "donated_at")


@query(
    "donation_totals",
    "donations",
    "SELECT user_id, count(*) AS n, CAST(coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (currency = 'PKR' AND status = 'success'), 0) AS DOUBLE) AS total_donated_pkr FROM donations GROUP BY user_id",
)
def _(t):
    return O.donation_totals(t.donations)


@query(
    "donation_stats",
    "donations",
    """SELECT count(*) AS total_donations, CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (currency = 'PKR' AND status = 'success') AS DOUBLE) AS total_amount_pkr,
       count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (week_granted) AS weeks_granted FROM donations""",
)
def _(t):
    return O.donation_stats(t.donations)


@query(
    "donation_list",
    "donations",
    f"SELECT id, amount, {D.ts('donated_at')} AS donated_at, (SELECT count(*) FROM donations WHERE status = 'pending') AS total FROM donations WHERE status = 'pending' ORDER BY donations.donated_at DESC, id DESC LIMIT 20 OFFSET 20",
)
def _(t):
    return text_ts(O.donation_list(t.donations, "pending", 2, 20).select("id", "amount", "donated_at", "total"), "donated_at")


# Verify events: views act on the donation with the next smaller multiple of three.
VERIFY = """SELECT event_id AS seq, event_id - event_id % 3 + 1 AS donation_id, CASE WHEN event_id % 4 = 0 THEN user_id ELSE owner END AS user_id, ts AS verified_at
    FROM {events} AS e LEFT JOIN (SELECT id, user_id AS owner FROM {donations}) AS d ON d.id = event_id - event_id % 3 + 1 WHERE event_type IN ('view', 'click')"""


@query(
    "donation_verify",
    "donations",
    f"""WITH v AS ({VERIFY.format(events='events', donations='donations')}),
        o AS (SELECT v.seq, v.donation_id, CASE WHEN d.id IS NULL THEN 'not found' WHEN d.user_id <> v.user_id THEN 'not owner' WHEN d.status = 'success' THEN 'already' END AS base FROM v LEFT JOIN donations d ON d.id = v.donation_id)
    SELECT seq, donation_id, coalesce(base, CASE WHEN row_number() OVER (PARTITION BY donation_id, base ORDER BY seq) = 1 THEN 'success' ELSE 'already' END) AS outcome FROM o""",
)
def _(t):
    events = t.spark.sql(VERIFY, events=t.events, donations=t.donations)
    return O.donation_verify(events, t.donations).select("seq", "donation_id", "outcome")


@query(
    "grant_week",
    "donations subscriptions",
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT d.id, d.user_id, d.donated_at AS v, s.created_at AS c, coalesce(s.status = 'active' AND s.expires_at > d.donated_at, false) AS ok
            FROM (SELECT * FROM donations WHERE status <> 'failed' AND NOT week_granted) d ASOF LEFT JOIN subscriptions s ON s.user_id = d.user_id AND d.donated_at >= s.created_at),
        g AS (SELECT user_id, min(v) AS v FROM e WHERE NOT ok GROUP BY user_id
              UNION ALL SELECT g.user_id, min(e.v) FROM g JOIN e ON e.user_id = g.user_id AND e.v > g.v
                  AND CASE WHEN coalesce(e.c > g.v, false) THEN NOT e.ok ELSE e.v >= g.v + INTERVAL 7 DAY END GROUP BY g.user_id)
    SELECT e.id, g.user_id, {D.ts('g.v')} AS started_at, {D.ts('g.v + INTERVAL 7 DAY')} AS expires_at, 'free_ai_week' AS plan FROM g JOIN e ON e.user_id = g.user_id AND e.v = g.v""",
)
def _(t):
    verified = t.donations.filter(C("status") != "failed").select("id", "user_id", C("donated_at").alias("verified_at"), "week_granted")
    return text_ts(O.grant_week(verified, t.subscriptions), "started_at", "expires_at")
