from pyspark.sql import functions as F

from askloom.streaming import streams


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_over_batches_and_restart(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    schema = "page_id long, url string, source string, status string"

    def run():
        stream = streams.read_table_stream(spark, source, "*.parquet", files_per_batch=1)
        streams.ingest_stream(stream, lambda df: df, store).start().awaitTermination()

    write(spark, [(1, "u", "s", None), (2, "u", "s", None), (3, "v", "s", "failed")], schema, source)
    run()
    write(spark, [(4, "u", "s", None), (5, "w", "t", None)], schema, source)
    run()
    run()
    ledger = spark.read.parquet(f"{store}/ledger").groupBy("url", "status").count().collect()
    assert {(r.url, r.status, r["count"]) for r in ledger} == {("u", "inserted", 1), ("u", "skipped", 2), ("v", "failed", 1), ("w", "inserted", 1)}
    assert sorted(r.url for r in spark.read.parquet(f"{store}/records").collect()) == ["u", "w"]


def test_a_table_of_several_files_is_a_stream_as_one_file_is(spark, tmp_path):
    import uuid

    from askloom.plans import registry

    rows = [(k, f"https://www.Site{k % 3}.org/en/p/{k}", f"<p>Ques tion is this one, number {k}</p>") for k in range(12)]
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/other{uuid.uuid4().hex}.parquet")
    hosts = registry.queries()["ingest_recent"](spark, str(tmp_path)).collect()
    assert len(hosts) == len({r.host for r in hosts}) == 3
    by_status = registry.queries()["ingest_stream"](spark, str(tmp_path))
    assert sorted(map(tuple, by_status.collect())) == sorted(map(tuple, registry.queries()["flagship"](spark, str(tmp_path)).collect()))


def test_trial_state_survives_batches(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "id long, user_id long, used_at timestamp, paid boolean"

    def run():
        stream = streams.read_table_stream(spark, source, "*.parquet", files_per_batch=1)
        return streams.run_to_table(streams.trial_stream(stream), out)

    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1, h)
    write(spark, [(1, 7, t(3), False), (2, 7, t(1), False), (3, 7, t(2), True), (4, 8, t(1), False)], schema, source)
    run()
    write(spark, [(5, 7, t(5), False), (6, 7, t(4), False), (7, 8, t(9), True)], schema, source)
    got = {r.id: r.outcome for r in run().collect()}
    assert got == {1: "used", 2: "used", 3: "subscribed", 4: "used", 6: "used", 5: "exhausted", 7: "subscribed"}


def test_late_misses_are_dropped(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d, 12)
    for rows in ([(day(1), "a"), (day(1), "a"), (day(9), "b")], [(day(1), "late"), (day(12), "c")]):
        write(spark, rows, "searched_at timestamp, query string", source)
        stream = streams.read_table_stream(spark, source, "*.parquet", files_per_batch=1)
        table = streams.run_to_table(streams.miss_stream(stream), out)
    got = {(r["query"], r.n) for r in table.select("query", F.col("n")).collect()}
    assert got == {("a", 2), ("b", 1)}


SESSION_EVENTS = "user_id long, ts timestamp"


def at(minute, day=1):
    import datetime as dt

    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minute)


def brute_sessions(rows, gap=30):
    import datetime as dt

    out = []
    for user in {u for u, _ in rows if u is not None}:
        run = []
        for t in sorted(t for u, t in rows if u == user and t is not None):
            if run and t - run[-1] > dt.timedelta(minutes=gap):
                out.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        if run:
            out.append((user, run[0], run[-1], len(run)))
    return sorted(out)


def test_sessions_over_midnight_ties_and_a_hot_user(spark):
    import random

    from askloom.operators import conversation

    rnd = random.Random(3)
    rows = [(1, at(1430)), (1, at(1440)), (1, at(1470)), (1, at(1501)), (None, at(5)), (2, None), (3, at(0)), (3, at(0))]
    rows += [(9, at(rnd.randrange(0, 9000, 13))) for _ in range(400)]
    events = spark.createDataFrame(rows, SESSION_EVENTS).withColumn("started_at", F.lit("x"))
    got = conversation.event_sessions(events, "user_id", "ts").collect()
    assert sorted(tuple(r) for r in got) == brute_sessions(rows)
    assert conversation.event_sessions(events.limit(0), "user_id", "ts").count() == 0


def test_session_stream_closes_once_and_drops_late_rows(spark, tmp_path):
    import datetime as dt

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [
        [(1, at(0)), (1, at(30)), (2, at(10)), (None, at(0))],
        [(1, at(20)), (2, at(50)), (3, at(300))],  # one in the middle of a session that is open; time passes to minute 240
        [(1, at(5)), (2, at(235, day=2))],  # the first is late: its session is out
        [(4, at(0, day=9))],
    ]
    for rows in batches:
        write(spark, rows, SESSION_EVENTS, source)
        stream = streams.read_table_stream(spark, source, "*.parquet", files_per_batch=1)
        table = streams.run_to_table(streams.session_stream(stream, "user_id", "ts"), out)
    got = sorted((r.user_id, r.started_at, r.closed_at - dt.timedelta(minutes=30), r.n) for r in table.collect())
    on_time = [r for b in batches for r in b if r != (1, at(5))]
    assert got == [s for s in brute_sessions(on_time) if s[0] != 4]
