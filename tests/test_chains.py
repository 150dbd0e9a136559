"""Pointer doubling, week grants and fetch times against step-by-step Python."""

import random

from pyspark.sql import functions as F

from askloom.operators import accounts, chains
from askloom.operators import crawlset as X


def walked(links):
    to = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            to[a] = min(b, to.get(a, b))
    before = {}
    for a, b in to.items():
        before[b] = min(a, before.get(b, a))
    after = {a: b for b, a in before.items()}
    nodes = {x for link in links for x in link if x is not None}
    out, left = {}, set(nodes)
    for head in [*sorted(n for n in nodes if n not in before), *sorted(nodes)]:
        node, rank = head, 1
        while node in left:
            out[node] = (head, rank)
            left.discard(node)
            node, rank = after.get(node), rank + 1
    return out


def test_chain_order(spark):
    rnd = random.Random(7)
    links = [(k, k + 1) for k in range(0, 300) if k % 50 != 49] + [(1000 + k, 1000 + (k + 1) % 37) for k in range(37)]
    links += [(rnd.randint(2000, 2060), rnd.randint(2000, 2060)) for _ in range(90)] + [(5000, None), (None, 5001), (5002, 5002), (None, None), (1, 2), (5003, 5004), (5004, 5003)]
    df = spark.createDataFrame(links, "node long, to long").withColumns({c: F.lit("x") for c in ("head", "rank", "before", "steps")})
    order, _ = chains.chain_order(df)
    assert {r["node"]: (r["head"], r["rank"]) for r in order.collect()} == walked(links) and order.count() == len(walked(links))
    assert chains.chain_order(df.limit(0))[0].collect() == []


def test_a_long_chain_takes_few_rounds(spark):
    order, rounds = chains.chain_order(spark.range(9999).select(F.concat(F.lit("p"), F.lpad("id", 6, "0")).alias("node"), F.concat(F.lit("p"), F.lpad(F.col("id") + 1, 6, "0")).alias("to")))
    assert rounds < 20 and order.filter("head = 'p000000' AND rank = cast(substr(node, 2) AS int) + 1").count() == 10_000


def test_400_weeks_take_few_rounds(spark):
    donations = spark.range(2800).selectExpr("id", "1L AS user_id", "timestamp_ntz'2010-01-01 00:00:00' + make_dt_interval(cast(id AS int)) AS verified_at", "false AS week_granted")
    subs = spark.createDataFrame([], "id long, user_id long, status string, created_at timestamp_ntz, expires_at timestamp_ntz")
    granted, rounds = accounts._granted(donations, subs)
    assert sorted(r["id"] for r in granted.collect()) == list(range(0, 2800, 7)) and rounds <= 10


def test_fetch_times(spark):
    import hashlib

    rnd = random.Random(11)
    hosts = ["HTTP://One.example/a", "http://one.example/b?x", "https://two.example", "no scheme", None]
    rows = [(k * 3, rnd.choice([*hosts, "http://one.example/"]) if k % 9 else hosts[-1], rnd.choice([None, 0, rnd.randint(0, 900_000)])) for k in range(400)]
    want, last = {}, {}
    for seq, url, ready in rows:
        host = url.split("/")[2].lower() if url and "://" in url else ""
        gap = 1500 + int(hashlib.md5(("s" + (url or "")).encode()).hexdigest()[:8], 16) % 751
        last[host] = max(ready or 0, last[host] + gap) if host in last else ready or 0
        want[seq] = (host, last[host])
    df = spark.createDataFrame(rows, "seq long, url string, ready_ms long").withColumns({c: F.lit("x") for c in ("host", "gap", "block", "sum")})
    for width in (1, 7, 1_000_000):  # every request a block of its own, some, all in one
        got = X.polite_schedule(df, seed="s", width=width).collect()
        assert {r["seq"]: (r["host"], r["at_ms"]) for r in got} == want and len(got) == len(rows)
    assert X.polite_schedule(df.limit(0)).collect() == []


def test_one_host_is_split(spark):
    rows = spark.range(80_000).select(F.col("id").alias("seq"), F.lit("http://one.example/").alias("url"), F.lit(0).alias("ready_ms"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X.polite_schedule(rows, width=10_000)
        largest = plan.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert largest < 60_000
