"""Question workflow, reviewer statistics and monthly payments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from askloom.functions import text as T
from askloom.operators.corpus import page, with_total
from askloom.session import is_small

# Statuses that count as answered, and text limits.
ANSWERED = ("answered", "published")
MIN_QUESTION, MAX_QUESTION, MIN_ANSWER = 20, 2000, 50


def _ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _answered() -> Column:
    return F.col("status").isin(*ANSWERED)


def question_intake(rows: DataFrame, as_of: str) -> DataFrame:
    """Submitted questions in stored form, with ``reason`` for those whose length is out of range.

    The limits apply to the text as submitted; it is stored trimmed.
    """
    n = F.length("question_text")
    reason = F.when(F.coalesce(n, F.lit(0)) < MIN_QUESTION, F.lit("too short")).when(n > MAX_QUESTION, F.lit("too long"))
    return rows.select(
        "id",
        T.strip(F.col("question_text")).alias("question_text"),
        F.coalesce(F.nullif(T.strip(F.col("language")), F.lit("")), F.lit("ur")).alias("language"),
        F.lit("pending").alias("status"),
        F.lit("normal").alias("priority"),
        _ts(as_of).alias("submitted_at"),
        reason.alias("reason"),
    )


def question_list(df: DataFrame, status: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    rows = df.filter(F.col("status") == status.strip()) if status and status.strip() else df
    return with_total(page(rows, [F.desc("submitted_at"), F.desc("id")], number, size), rows)


def reviewer_questions(df: DataFrame, reviewer: int, status: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    return question_list(df.filter(F.col("reviewer_id") == reviewer), status, number, size)


def apply_status_events(questions: DataFrame, events: DataFrame) -> DataFrame:
    """Questions after a batch of changes ``id, ts, seq, kind, status, reviewer_id``.

    The last change of a question sets its status; the last assignment sets the reviewer. Both come from one
    map-side combined aggregate, so a question with very many changes is no bottleneck. An answer by an
    administrator does not set ``answered_at``.
    """
    order = F.struct("ts", "seq")
    status = (
        F.when(F.col("kind") == "assign", F.lit("reviewing"))
        .when(F.col("kind") == "answer", F.lit("answered"))
        .when(F.col("kind") == "reject", F.lit("rejected"))
        .otherwise(F.col("status"))
    )
    assigned = F.when(F.col("kind") == "assign", F.struct("ts", "seq", "reviewer_id"))
    last = events.groupBy("id").agg(
        F.max(F.struct("ts", "seq", status.alias("status"))).alias("last"), F.max(assigned).alias("assigned")
    )
    joined = questions.join(last, "id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("last.status", "status"),
            "updated_at": F.coalesce("last.ts", "updated_at"),
            "reviewer_id": F.coalesce("assigned.reviewer_id", "reviewer_id"),
            "assigned_at": F.coalesce("assigned.ts", "assigned_at"),
        }
    ).drop("last", "assigned")


def finalize_answer(df: DataFrame, column: str = "answer_text") -> DataFrame:
    """Cleaned answer with its length, preview and ``reason``."""
    cleaned = df.withColumn("body", T.dedupe_lines(T.normalize_text(F.col(column))))
    return cleaned.withColumns(
        {
            "extracted_length": F.length("body").cast("long"),
            "preview": T.preview(F.col("body")),
            "reason": F.when(F.length("body") < MIN_ANSWER, F.lit("text too short")),
        }
    )


def answer_submit(answers: DataFrame, questions: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Answers with ``reason`` NULL when they come from the assigned reviewer, and the amount they earn."""
    asked = questions.select(F.col("id").alias("question_id"), F.struct(F.col("reviewer_id").alias("to")).alias("asked"))
    rates = reviewers.select(F.col("id").alias("reviewer_id"), "rate")
    joined = answers.join(asked, "question_id", "left").join(_side(rates), "reviewer_id", "left")
    reason = (
        F.when(F.col("rate").isNull(), F.lit("profile not found"))
        .when(F.col("asked").isNull(), F.lit("question not found"))
        .when(~F.col("asked.to").eqNullSafe(F.col("reviewer_id")), F.lit("forbidden"))
    )
    ok = F.col("reason").isNull()
    return joined.withColumn("reason", reason).withColumns(
        {"payment_amount": F.when(ok, F.col("rate")), "payment_status": F.when(ok, F.lit("unpaid"))}
    ).drop("asked", "rate")


def answer_counts(submitted: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Reviewers with their answered total raised by the accepted answers."""
    added = submitted.filter(F.col("reason").isNull()).groupBy(F.col("reviewer_id").alias("id")).agg(F.count("*").alias("added"))
    out = reviewers.join(added, "id", "left")
    return out.withColumn("total_answered", F.col("total_answered") + F.coalesce("added", F.lit(0))).drop("added")


def reviewer_stats(questions: DataFrame, reviewers: DataFrame, as_of: str) -> DataFrame:
    """Workload figures per reviewer in one pass over the questions; idle reviewers appear with zeros.

    Everything that is neither answered nor published counts as pending, rejected questions included. The mean
    uses only answers at or after their assignment.
    """
    now = _ts(as_of)
    this_month = _answered() & (F.col("answered_at") >= F.date_trunc("month", now).cast("timestamp_ntz")) & (F.col("answered_at") < now)
    hours = F.timestamp_diff("SECOND", F.col("assigned_at"), F.col("answered_at")) / 3600.0
    timely = _answered() & (F.col("answered_at") >= F.col("assigned_at"))
    per = (
        questions.filter(F.col("reviewer_id").isNotNull())
        .groupBy(F.col("reviewer_id").alias("id"))
        .agg(
            F.count_if(this_month).alias("this_month_questions"),
            F.count_if(_answered()).alias("answered_questions"),
            F.count_if(~_answered()).alias("pending_questions"),
            F.avg(F.when(timely, hours)).alias("avg_response_time_hours"),
        )
    )
    joined = reviewers.select("id", "display_name", "rate").join(per, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        F.col("id").alias("reviewer_id"),
        "display_name",
        zero("this_month_questions").alias("this_month_questions"),
        (zero("this_month_questions") * F.col("rate")).alias("this_month_earned"),
        zero("pending_questions").alias("pending_questions"),
        zero("answered_questions").alias("answered_questions"),
        "avg_response_time_hours",
    )


def reviewer_list(reviewers: DataFrame, users: DataFrame, available: bool | None = None) -> DataFrame:
    """Reviewers with their user, newest first."""
    rows = reviewers if available is None else reviewers.filter(F.col("is_available") == available)
    people = users.select(F.col("id").alias("user_id"), F.struct("id", "email", "name", "provider", "role").alias("user"))
    return rows.join(people, "user_id").orderBy(F.desc("joined_at"), F.desc("id"))


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def monthly_payment(questions: DataFrame, reviewers: DataFrame, payments: DataFrame, as_of: str, month: str | None = None) -> DataFrame:
    """Payment rows of one month (or of all months) for every reviewer, merged with the existing rows.

    Existing rows ``reviewer_id, month, status`` keep ``paid``; all others become ``pending``. For one month every
    reviewer gets a row, also with nothing to pay; its bounds are literals, so they reach the scan.
    """
    due = questions.filter(_answered() & (F.col("payment_status") == "unpaid") & F.col("answered_at").isNotNull())
    if month is not None:
        start = F.lit(month + "-01").cast("timestamp_ntz")
        due = due.filter((F.col("answered_at") >= start) & (F.col("answered_at") < F.add_months(start, 1).cast("timestamp_ntz")))
        payments = payments.filter(F.col("month") == month)
    counted = due.groupBy("reviewer_id", _month("answered_at").alias("month")).agg(F.count("*").alias("n"))
    if month is not None:
        every = reviewers.select(F.col("id").alias("reviewer_id"), F.lit(month).alias("month"))
        counted = every.join(counted.drop("month"), "reviewer_id", "left")
    old = payments.select("reviewer_id", "month", F.col("status").alias("old_status"), F.col("created_at").alias("old_created_at"))
    merged = counted.join(old, ["reviewer_id", "month"], "full")
    rates = reviewers.select(F.col("id").alias("reviewer_id"), "user_id", "rate")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return merged.join(_side(rates), "reviewer_id").select(
        "reviewer_id",
        "user_id",
        "month",
        n.alias("questions_answered"),
        F.col("rate").alias("per_question_rate"),
        (n * F.col("rate")).alias("total_amount"),
        F.when(F.col("old_status") == "paid", F.lit("paid")).otherwise(F.lit("pending")).alias("status"),
        F.coalesce("old_created_at", _ts(as_of)).alias("created_at"),
    )


def mark_paid(
    payments: DataFrame, questions: DataFrame, reviewers: DataFrame, marks: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payments, questions and reviewers after the payments in ``marks`` (``id, payment_ref``) are paid.

    A payment that is paid already adds nothing to the reviewer's total, so a repeated run changes nothing. Questions that
    this run does not settle keep their amount and time of change.
    """
    picked = payments.join(marks.select("id", F.col("payment_ref").alias("new_ref")).dropDuplicates(["id"]), "id")
    fresh = picked.filter(F.col("status") != "paid").select("id", "new_ref", "reviewer_id", "month", "total_amount")
    paid = payments.join(fresh.select("id", "new_ref", F.lit(True).alias("hit")), "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    paid = paid.withColumns(
        {
            "status": F.when(hit, F.lit("paid")).otherwise(F.col("status")),
            "paid_at": F.when(hit, _ts(as_of)).otherwise(F.col("paid_at")),
            "payment_ref": F.when(hit, F.nullif(T.strip(F.col("new_ref")), F.lit(""))).otherwise(F.col("payment_ref")),
        }
    ).drop("hit", "new_ref")
    rates = reviewers.select(F.col("id").alias("reviewer_id"), "rate")
    months = fresh.select("reviewer_id", "month").distinct().join(_side(rates), "reviewer_id")
    keyed = questions.withColumn("month", _month("answered_at"))
    settled = keyed.join(_side(months), ["reviewer_id", "month"], "left")
    due = _answered() & (F.col("payment_status") == "unpaid") & F.col("rate").isNotNull()
    settled = settled.withColumns(
        {
            "payment_amount": F.when(due, F.col("rate")).otherwise(F.col("payment_amount") if "payment_amount" in questions.columns else F.lit(None)),
            "updated_at": F.when(due, _ts(as_of)).otherwise(F.col("updated_at") if "updated_at" in questions.columns else F.lit(None)),
            "payment_status": F.when(due, F.lit("paid")).otherwise(F.col("payment_status")),
        }
    ).drop("month", "rate")
    added = fresh.groupBy(F.col("reviewer_id").alias("id")).agg(F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("added"))
    earned = reviewers.join(added, "id", "left").withColumn(
        "total_earned", F.round(F.col("total_earned") + F.coalesce(F.col("added").cast("double"), F.lit(0.0)), 2)
    )
    return paid, settled, earned.drop("added")


def payment_list(
    df: DataFrame, reviewer: int | None = None, month: str | None = None, status: str | None = None, number: int = 1, size: int = 20
) -> DataFrame:
    rows = df
    if reviewer is not None:
        rows = rows.filter(F.col("reviewer_id") == reviewer)
    if month and month.strip():
        rows = rows.filter(F.col("month") == month.strip())
    if status and status.strip():
        rows = rows.filter(F.col("status") == status.strip())
    return with_total(page(rows, [F.desc("created_at"), F.desc("id")], number, size), rows)


def earnings(questions: DataFrame, reviewers: DataFrame, payments: DataFrame, as_of: str) -> DataFrame:
    """Month figures, total and payment history per reviewer. The history has one entry per month."""
    stats = reviewer_stats(questions, reviewers, as_of).select("reviewer_id", "this_month_questions", "this_month_earned")
    entry = F.struct("created_at", "id", "month", "total_amount", "status")
    history = payments.groupBy("reviewer_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("payment_history"))
    totals = reviewers.select(F.col("id").alias("reviewer_id"), F.coalesce("total_earned", F.lit(0.0)).alias("total_earned"))
    return stats.join(totals, "reviewer_id").join(history, "reviewer_id", "left")


def profile_patch(reviewers: DataFrame, patches: DataFrame, blank_is_null: Sequence[str] = ("specialization", "bio")) -> DataFrame:
    """Non-NULL patch fields replace the stored ones; a blank optional text becomes NULL. One patch per profile."""
    fields = [c for c in patches.columns if c != "id"]
    p = patches.select("id", *[F.col(c).alias(f"new_{c}") for c in fields])
    out = reviewers.join(p, "id", "left")
    types = dict(patches.dtypes)
    changed = {}
    for c in fields:
        new = F.col(f"new_{c}")
        value = T.strip(new) if types[c] == "string" else new
        if c in blank_is_null:
            value = F.nullif(value, F.lit(""))
        changed[c] = F.when(new.isNotNull(), value).otherwise(F.col(c))
    return out.withColumns(changed).drop(*[f"new_{c}" for c in fields])


def reviewer_create(rows: DataFrame, users: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Requested profiles with ``reason``: NULL when the user exists and has no profile yet.

    Of several requests for one user the first by ``seq`` wins, as the others then find a profile.
    """
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("known"))
    taken = reviewers.select("user_id", F.lit(True).alias("taken")).distinct()
    first = rows.groupBy("user_id").agg(F.min("seq").alias("first_seq"))
    joined = rows.join(first.join(known, "user_id", "left").join(taken, "user_id", "left"), "user_id")
    reason = F.when(F.col("known").isNull(), F.lit("user not found")).when(
        F.col("taken").isNotNull() | (F.col("seq") != F.col("first_seq")), F.lit("profile exists")
    )
    return joined.withColumn("reason", reason).drop("known", "taken", "first_seq")


def promote(users: DataFrame, created: DataFrame, role: str = "reviewer") -> DataFrame:
    """Users with the reviewer role where a profile was created."""
    new = created.filter(F.col("reason").isNull()).select(F.col("user_id").alias("id"), F.lit(True).alias("new"))
    out = users.join(new, "id", "left")
    return out.withColumn("role", F.when(F.col("new"), F.lit(role)).otherwise(F.col("role"))).drop("new")
