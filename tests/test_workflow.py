from pyspark.sql import functions as F

from askloom.operators import conversation, workflow

TEXT = "نماز کے بعد دعا کے آداب کیا ہیں؟ براہ کرم تفصیل سے رہنمائی فرمائیں۔"
Q_SCHEMA = "id long, status string, reviewer_id long, assigned_at timestamp_ntz, updated_at timestamp_ntz"


def test_question_life_cycle(spark):
    rows = spark.createDataFrame([(1, f" {TEXT} ", " "), (2, "short", "ur")], "id long, question_text string, language string")
    taken = {r.id: r for r in workflow.question_intake(rows, "2024-01-01 00:00:00").collect()}
    assert taken[1].reason is None and taken[1].question_text == TEXT and taken[1].language == "ur"
    assert (taken[1].status, taken[1].priority) == ("pending", "normal") and taken[2].reason == "too short"
    state = spark.createDataFrame([(1, "pending", None, None, None)], Q_SCHEMA)
    steps = [("status", "reviewing", None), ("assign", None, 9), ("answer", None, None), ("reject", None, None)]
    seen = []
    for k in range(1, len(steps) + 1):
        events = [(1, f"2024-01-0{i + 1} 00:00:00", i, kind, st, rev) for i, (kind, st, rev) in enumerate(steps[:k])]
        changes = spark.createDataFrame(events, "id long, t string, seq int, kind string, status string, reviewer_id long")
        changes = changes.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
        row = workflow.apply_status_events(state, changes).first()
        seen.append((row.status, row.reviewer_id))
    assert seen == [("reviewing", None), ("reviewing", 9), ("answered", 9), ("rejected", 9)]


def test_mark_paid_twice_changes_nothing(spark):
    reviewers = spark.createDataFrame([(1, 1, 10.0, 5.0)], "id long, user_id long, rate double, total_earned double")
    questions = spark.sql(
        "SELECT 7L AS id, 1L AS reviewer_id, 'answered' AS status, 'unpaid' AS payment_status, TIMESTAMP_NTZ '2024-03-31 23:59:59' AS answered_at"
    )
    empty = spark.createDataFrame([], "reviewer_id long, month string, status string, created_at timestamp_ntz")
    due = workflow.monthly_payment(questions, reviewers, empty, "2024-04-01 00:00:00", "2024-03")
    assert [(r.questions_answered, r.total_amount, r.status) for r in due.collect()] == [(1, 10.0, "pending")]
    payments = due.withColumns({"id": F.lit(3).cast("long"), "paid_at": F.lit(None).cast("timestamp_ntz"), "payment_ref": F.lit(None).cast("string")})
    marks = spark.createDataFrame([(3, " r ")], "id long, payment_ref string")
    paid, settled, earned = workflow.mark_paid(payments, questions, reviewers, marks, "2024-04-02 00:00:00")
    assert [(r.status, r.payment_ref) for r in paid.collect()] == [("paid", "r")]
    assert [(r.payment_status, r.payment_amount) for r in settled.collect()] == [("paid", 10.0)]
    assert [r.total_earned for r in earned.collect()] == [15.0]
    _, _, again = workflow.mark_paid(paid, settled.drop("payment_amount"), earned, marks, "2024-04-03 00:00:00")
    assert [r.total_earned for r in again.collect()] == [15.0]


def test_translation_parse(spark):
    rows = ['{"question": " q ", "answer": "a"}', '{"question": "", "answer": ""}', "{broken", '{"answer": 3}', None]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = [tuple(r.p) for r in df.select(conversation.translation_parse(F.col("s")).alias("p")).collect()]
    assert got == [("q", "a", True), ("", "", False), ("", "", False), ("", "3", True), ("", "", False)]
