"""Question workflow, reviewer and payment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import workflow as O
from askloom.plans import duck as D
from askloom.plans.bind import AS_OF, AS_OF_ORDERS
from askloom.plans.registry import query

C = F.col
FMT = "yyyy-MM-dd HH:mm:ss"
MONTH = "2001-06"
ANS = "status IN ('answered', 'published')"


def text_ts(df, *cols):
    return df.withColumns({c: F.date_format(c, FMT) for c in cols})


@query(
    "question_intake",
    oracle=f"""SELECT doc_id AS id, {D.strip('t')} AS question_text, coalesce(nullif({D.strip('l')}, ''), 'ur') AS language, 'pending' AS status, 'normal' AS priority,
        '{AS_OF}' AS submitted_at, CASE WHEN len(t) < 20 THEN 'too short' WHEN len(t) > 2000 THEN 'too long' END AS reason
        FROM (SELECT doc_id, ' ' || text AS t, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE lang END AS l FROM documents)""",
)
def _(t):
    rows = t.documents.select(
        C("doc_id").alias("id"),
        F.concat(F.lit(" "), "text").alias("question_text"),
        F.when(C("doc_id") % 3 == 0, F.lit("  ")).otherwise(C("lang")).alias("language"),
    )
    return text_ts(O.question_intake(rows, AS_OF), "submitted_at")


@query(
    "question_list",
    "questions",
    f"""SELECT id, status, {D.ts('submitted_at')} AS submitted_at, (SELECT count(*) FROM questions WHERE status = 'reviewing') AS total
        FROM questions WHERE status = 'reviewing' ORDER BY questions.submitted_at DESC, id DESC LIMIT 20 OFFSET 20""",
)
def _(t):
    return text_ts(O.question_list(t.questions, " reviewing ", 2, 20).select("id", "status", "submitted_at", "total"), "submitted_at")


@query(
    "reviewer_questions",
    "questions",
    f"""SELECT id, status, {D.ts('submitted_at')} AS submitted_at, (SELECT count(*) FROM questions WHERE reviewer_id = 7 AND status = 'answered') AS total
        FROM questions WHERE reviewer_id = 7 AND status = 'answered' ORDER BY questions.submitted_at DESC, id DESC LIMIT 20""",
)
def _(t):
    return text_ts(O.reviewer_questions(t.questions, 7, "answered").select("id", "status", "submitted_at", "total"), "submitted_at")


# Change events: lineitem rows of an order act on the question of that order.
CHANGES = """SELECT l_orderkey AS id, l_shipdate AS ts, l_linenumber AS seq,
    CASE WHEN l_linenumber % 4 = 0 THEN 'assign' WHEN l_linenumber % 4 = 1 THEN 'status' WHEN l_linenumber % 4 = 2 THEN 'answer' ELSE 'reject' END AS kind,
    CASE WHEN l_linenumber % 4 = 1 THEN 'published' END AS status, CASE WHEN l_linenumber % 4 = 0 THEN l_suppkey END AS reviewer_id FROM {lineitem}"""
D_CHANGES = "chg AS (" + CHANGES.format(lineitem="lineitem") + ")"


@query(
    "apply_status_events",
    "questions",
    f"""WITH {D_CHANGES}, x AS (SELECT DISTINCT * FROM chg),
        s AS (SELECT id, ts, CASE kind WHEN 'assign' THEN 'reviewing' WHEN 'answer' THEN 'answered' WHEN 'reject' THEN 'rejected' ELSE status END AS status
              FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC) = 1),
        a AS (SELECT id, ts, reviewer_id FROM x WHERE kind = 'assign' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, seq DESC, reviewer_id DESC) = 1)
        SELECT q.id, coalesce(s.status, q.status) AS status, coalesce(a.reviewer_id, q.reviewer_id) AS reviewer_id,
               {D.ts('coalesce(a.ts, q.assigned_at)')} AS assigned_at, {D.ts('coalesce(s.ts, q.submitted_at)')} AS updated_at
        FROM questions q LEFT JOIN s USING (id) LEFT JOIN a USING (id)""",
)
def _(t):
    events = t.spark.sql(CHANGES, lineitem=t.lineitem)
    out = O.apply_status_events(t.questions.withColumn("updated_at", C("submitted_at")), events)
    return text_ts(out.select("id", "status", "reviewer_id", "assigned_at", "updated_at"), "assigned_at", "updated_at")


@query(
    "finalize_answer",
    oracle=f"""
    WITH s AS (SELECT doc_id, {D.lines("nfc_normalize(" + D.squash('text') + ")")} AS ls FROM documents),
         b AS (SELECT doc_id, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), chr(10)) AS body FROM s)
    SELECT doc_id, body, CAST(len(body) AS BIGINT) AS extracted_length, substr(body, 1, 200) || CASE WHEN len(body) > 200 THEN '...' ELSE '' END AS preview,
           CASE WHEN len(body) < 50 THEN 'text too short' END AS reason FROM b""",
)
def _(t):
    return O.finalize_answer(t.documents.select("doc_id", C("text").alias("answer_text"))).drop("answer_text")


SUBMITTED = """SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS question_id,
    CASE WHEN l_linenumber % 2 = 0 THEN o_custkey % (SELECT count(*) FROM {supplier}) ELSE l_suppkey + CASE WHEN l_linenumber = 5 THEN 1000000000 ELSE 0 END END AS reviewer_id
    FROM {lineitem} AS l JOIN {orders} AS o ON o_orderkey = l_orderkey"""
D_SUBMITTED = "sub AS (" + SUBMITTED.format(lineitem="lineitem", orders="orders", supplier="supplier") + ")"
D_JUDGED = f"""{D_SUBMITTED}, judged AS (SELECT s.seq, s.question_id, s.reviewer_id, r.rate, CASE WHEN r.id IS NULL THEN 'profile not found' WHEN q.id IS NULL THEN 'question not found'
    WHEN q.reviewer_id IS DISTINCT FROM s.reviewer_id THEN 'forbidden' END AS reason
    FROM sub s LEFT JOIN questions q ON q.id = s.question_id LEFT JOIN reviewers r ON r.id = s.reviewer_id)"""


def submitted(t):
    answers = t.spark.sql(SUBMITTED, lineitem=t.lineitem, orders=t.orders, supplier=t.supplier)
    return O.answer_submit(answers, t.questions, t.reviewers)


@query(
    "answer_submit",
    "questions reviewers",
    f"WITH {D_JUDGED} SELECT seq, question_id, reviewer_id, reason, CASE WHEN reason IS NULL THEN rate END AS payment_amount, CASE WHEN reason IS NULL THEN 'unpaid' END AS payment_status FROM judged",
)
def _(t):
    return submitted(t)


@query(
    "answer_counts",
    "questions reviewers",
    f"""WITH {D_JUDGED} SELECT r.id, r.total_answered + count(j.seq) AS total_answered FROM reviewers r LEFT JOIN judged j ON j.reviewer_id = r.id AND j.reason IS NULL GROUP BY r.id, r.total_answered""",
)
def _(t):
    return O.answer_counts(submitted(t), t.reviewers).select("id", "total_answered")


D_STATS = f"""
    SELECT r.id AS reviewer_id, r.display_name, count(*) FILTER ({ANS} AND answered_at >= TIMESTAMP '2001-07-01' AND answered_at < TIMESTAMP '{AS_OF_ORDERS}') AS this_month_questions,
           count(*) FILTER ({ANS} AND answered_at >= TIMESTAMP '2001-07-01' AND answered_at < TIMESTAMP '{AS_OF_ORDERS}') * r.rate AS this_month_earned,
           count(*) FILTER (q.id IS NOT NULL AND NOT {ANS}) AS pending_questions, count(*) FILTER ({ANS}) AS answered_questions,
           round(avg(CASE WHEN {ANS} AND answered_at >= assigned_at THEN epoch(answered_at - assigned_at) / 3600.0 END), 6) AS avg_response_time_hours
    FROM reviewers r LEFT JOIN questions q ON q.reviewer_id = r.id GROUP BY r.id, r.display_name, r.rate"""


@query("reviewer_stats", "questions reviewers", D_STATS)
def _(t):
    out = O.reviewer_stats(t.questions, t.reviewers, AS_OF_ORDERS)
    return out.withColumn("avg_response_time_hours", F.round("avg_response_time_hours", 6))


@query(
    "reviewer_list",
    "reviewers users",
    f"""SELECT r.id, r.display_name, {D.ts('r.joined_at')} AS joined_at, u.email AS user_email, u.role AS user_role FROM reviewers r JOIN users u ON u.id = r.user_id WHERE r.is_available ORDER BY r.joined_at DESC, r.id DESC""",
)
def _(t):
    out = O.reviewer_list(t.reviewers, t.users, True)
    return text_ts(out.select("id", "display_name", "joined_at", C("user.email").alias("user_email"), C("user.role").alias("user_role")), "joined_at")


# Existing payments: one row per reviewer and month that has paid questions.
def payments(t):
    """Payment rows with an id derived from the key, so that no global numbering is needed."""
    paid = t.questions.filter(C("reviewer_id").isNotNull() & (C("payment_status") == "paid") & C("answered_at").isNotNull())
    g = paid.groupBy("reviewer_id", F.date_format("answered_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.max("answered_at").alias("last_at"))
    settled = (C("reviewer_id") + C("n")) % 3 == 0
    return g.select(
        (C("reviewer_id") * 1000000 + F.regexp_replace("month", "-", "").cast("long")).alias("id"),
        "reviewer_id",
        "month",
        C("n").alias("questions_answered"),
        (C("n") * F.lit(15.5)).alias("total_amount"),
        F.when(settled, F.lit("paid")).otherwise(F.lit("pending")).alias("status"),
        C("last_at").alias("created_at"),
        F.when(settled, C("last_at")).alias("paid_at"),
        F.lit(None).cast("string").alias("payment_ref"),
    )


D_PAYMENTS = """payments AS (SELECT reviewer_id * 1000000 + CAST(replace(month, '-', '') AS BIGINT) AS id, reviewer_id, month, n AS questions_answered, CAST(n * 15.5 AS DOUBLE) AS total_amount,
    CASE WHEN (reviewer_id + n) % 3 = 0 THEN 'paid' ELSE 'pending' END AS status, last_at AS created_at
    FROM (SELECT reviewer_id, strftime(answered_at, '%Y-%m') AS month, count(*) AS n, max(answered_at) AS last_at FROM questions
          WHERE reviewer_id IS NOT NULL AND payment_status = 'paid' AND answered_at IS NOT NULL GROUP BY ALL))"""
D_DUE = f"due AS (SELECT reviewer_id, strftime(answered_at, '%Y-%m') AS month, count(*) AS n FROM questions WHERE {ANS} AND payment_status = 'unpaid' AND answered_at IS NOT NULL AND reviewer_id IS NOT NULL GROUP BY ALL)"


@query(
    "monthly_payment",
    "questions reviewers",
    f"""WITH {D_PAYMENTS}, {D_DUE}
    SELECT r.id AS reviewer_id, r.user_id, '{MONTH}' AS month, coalesce(d.n, 0) AS questions_answered, r.rate AS per_question_rate, coalesce(d.n, 0) * r.rate AS total_amount,
           CASE WHEN p.status = 'paid' THEN 'paid' ELSE 'pending' END AS status, {D.ts(f"coalesce(p.created_at, TIMESTAMP '{AS_OF_ORDERS}')")} AS created_at
    FROM reviewers r LEFT JOIN due d ON d.reviewer_id = r.id AND d.month = '{MONTH}' LEFT JOIN payments p ON p.reviewer_id = r.id AND p.month = '{MONTH}'""",
)
def _(t):
    return text_ts(O.monthly_payment(t.questions, t.reviewers, payments(t), AS_OF_ORDERS, MONTH), "created_at")


@query(
    "monthly_payment_all",
    "questions reviewers",
    f"""WITH {D_PAYMENTS}, {D_DUE}
    SELECT coalesce(d.reviewer_id, p.reviewer_id) AS reviewer_id, r.user_id, coalesce(d.month, p.month) AS month, coalesce(d.n, 0) AS questions_answered, r.rate AS per_question_rate,
           coalesce(d.n, 0) * r.rate AS total_amount, CASE WHEN p.status = 'paid' THEN 'paid' ELSE 'pending' END AS status, {D.ts(f"coalesce(p.created_at, TIMESTAMP '{AS_OF_ORDERS}')")} AS created_at
    FROM due d FULL JOIN payments p ON p.reviewer_id = d.reviewer_id AND p.month = d.month JOIN reviewers r ON r.id = coalesce(d.reviewer_id, p.reviewer_id)""",
)
def _(t):
    return text_ts(O.monthly_payment(t.questions, t.reviewers, payments(t), AS_OF_ORDERS), "created_at")


D_MARKS = "marks AS (SELECT id FROM payments WHERE month >= '2000-01' AND total_amount > 16)"


def marked(t):
    p = payments(t)
    marks = p.filter((C("month") >= "2000-01") & (C("total_amount") > 16)).select("id", F.lit(" bank ").alias("payment_ref"))
    return O.mark_paid(p, t.questions, t.reviewers, marks, AS_OF_ORDERS)


@query(
    "mark_paid",
    "questions reviewers",
    f"""WITH {D_PAYMENTS}, {D_MARKS} SELECT p.id, reviewer_id, month, CASE WHEN m.id IS NOT NULL THEN 'paid' ELSE status END AS status,
        CASE WHEN status = 'paid' THEN {D.ts('created_at')} WHEN m.id IS NOT NULL THEN '{AS_OF_ORDERS}' END AS paid_at, CASE WHEN status <> 'paid' AND m.id IS NOT NULL THEN 'bank' END AS payment_ref
        FROM payments p LEFT JOIN marks m ON m.id = p.id""",
)
def _(t):
    return text_ts(marked(t)[0].select("id", "reviewer_id", "month", "status", "paid_at", "payment_ref"), "paid_at")


@query(
    "mark_paid_questions",
    "questions reviewers",
    f"""WITH {D_PAYMENTS}, {D_MARKS}, f AS (SELECT DISTINCT reviewer_id, month FROM payments JOIN marks USING (id) WHERE status <> 'paid')
    SELECT q.id, CASE WHEN hit THEN 'paid' ELSE payment_status END AS payment_status, CASE WHEN hit THEN rate ELSE payment_amount END AS payment_amount,
        CASE WHEN hit THEN '{AS_OF_ORDERS}' ELSE {D.ts('updated_at')} END AS updated_at
    FROM (SELECT q.*, r.rate, f.month IS NOT NULL AND {ANS} AND payment_status = 'unpaid' AS hit FROM questions q LEFT JOIN reviewers r ON r.id = q.reviewer_id
          LEFT JOIN f ON f.reviewer_id = q.reviewer_id AND f.month = strftime(q.answered_at, '%Y-%m')) q""",
)
def _(t):
    return text_ts(marked(t)[1].select("id", "payment_status", "payment_amount", "updated_at"), "updated_at")


@query(
    "mark_paid_reviewers",
    "questions reviewers",
    f"""WITH {D_PAYMENTS}, {D_MARKS}, f AS (SELECT reviewer_id, sum(total_amount) AS added FROM payments JOIN marks USING (id) WHERE status <> 'paid' GROUP BY 1)
    SELECT id, round(total_earned + coalesce(added, 0), 2) AS total_earned FROM reviewers LEFT JOIN f ON f.reviewer_id = id""",
)
def _(t):
    return marked(t)[2].select("id", "total_earned")


@query(
    "payment_list",
    "questions",
    f"""WITH {D_PAYMENTS} SELECT id, reviewer_id, total_amount, (SELECT count(*) FROM payments WHERE month = '2000-05' AND status = 'pending') AS total FROM payments
        WHERE month = '2000-05' AND status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 20""",
)
def _(t):
    return O.payment_list(payments(t), month="2000-05 ", status="pending").select("id", "reviewer_id", "total_amount", "total")


@query(
    "earnings",
    "questions reviewers",
    f"""WITH {D_PAYMENTS}, s AS ({D_STATS}), h AS (SELECT reviewer_id, string_agg(month || ':' || status, ',' ORDER BY created_at DESC, id DESC) AS history FROM payments GROUP BY 1)
    SELECT s.reviewer_id, this_month_questions, this_month_earned, r.total_earned, h.history FROM s JOIN reviewers r ON r.id = s.reviewer_id LEFT JOIN h ON h.reviewer_id = s.reviewer_id""",
)
def _(t):
    out = O.earnings(t.questions, t.reviewers, payments(t), AS_OF_ORDERS)
    line = F.transform("payment_history", lambda p: F.concat(p["month"], F.lit(":"), p["status"]))
    return out.select("reviewer_id", "this_month_questions", "this_month_earned", "total_earned", F.array_join(line, ",").alias("history"))


@query(
    "profile_patch",
    "reviewers",
    f"""SELECT id, CASE WHEN id % 4 = 0 THEN 'New ' || id ELSE display_name END AS display_name, CASE WHEN id % 4 < 2 THEN 20.0 ELSE rate END AS rate,
        CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'law' ELSE 'general' END AS specialization FROM reviewers""",
)
def _(t):
    r = C("id") % 4
    patches = t.reviewers.filter(r < 2).select(
        "id",
        F.when(r == 0, F.concat(F.lit(" New "), C("id").cast("string"))).alias("display_name"),
        F.lit(20.0).alias("rate"),
        F.when(r == 0, F.lit("  ")).otherwise(F.lit(" law ")).alias("specialization"),
    )
    current = t.reviewers.withColumn("specialization", F.lit("general"))
    return O.profile_patch(current, patches).select("id", "display_name", "rate", "specialization")


REQUESTS = """SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN user_id + 1000000000 ELSE user_id * 3 END AS user_id FROM {events} WHERE event_type = 'view'"""
D_REQUESTS = "req AS (" + REQUESTS.format(events="events") + ")"
D_CREATED = f"""{D_REQUESTS}, made AS (SELECT seq, q.user_id, CASE WHEN u.id IS NULL THEN 'user not found' WHEN r.id IS NOT NULL OR row_number() OVER (PARTITION BY q.user_id ORDER BY seq) > 1 THEN 'profile exists' END AS reason
    FROM req q LEFT JOIN users u ON u.id = q.user_id LEFT JOIN reviewers r ON r.user_id = q.user_id)"""


def created(t):
    return O.reviewer_create(t.spark.sql(REQUESTS, events=t.events), t.users, t.reviewers)


@query("reviewer_create", "users reviewers", f"WITH {D_CREATED} SELECT seq, user_id, reason FROM made")
def _(t):
    return created(t).select("seq", "user_id", "reason")


@query("reviewer_promote", "users reviewers", f"WITH {D_CREATED} SELECT id, CASE WHEN id IN (SELECT user_id FROM made WHERE reason IS NULL) THEN 'reviewer' ELSE role END AS role FROM users")
def _(t):
    return O.promote(t.users, created(t)).select("id", "role")
