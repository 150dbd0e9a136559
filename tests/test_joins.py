"""Skew-safe joins and ranks against brute force on small random data."""

import datetime as dt
import random

from pyspark.sql import functions as F

from askloom.operators import accounts, blocked, related
from askloom.operators import search as S

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_blocked_rank(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("aaab"), at(rnd.randint(0, 200))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = {r.id: r["rank"] for r in blocked.blocked_rank(df, ["k"], ["ts", "id"], blocked.day("ts")).collect()}
    for key in "ab":
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_asof_join(spark):
    rnd = random.Random(3)
    left = [(i, rnd.randint(0, 3), at(rnd.randint(0, 300))) for i in range(200)]
    right = [(1000 + i, rnd.randint(0, 3), at(rnd.randint(0, 300)), f"v{i}") for i in range(40)]
    ldf = spark.createDataFrame(left, "id long, u long, ts timestamp_ntz")
    rdf = spark.createDataFrame(right, "id long, u long, made timestamp_ntz, v string")
    got = {r.id: r.latest["v"] if r.latest else None for r in blocked.asof_join(ldf, rdf, "u", "ts", "made", ["v"]).collect()}
    for i, u, ts in left:
        best = max(((m, rid, v) for rid, ru, m, v in right if ru == u and m <= ts), default=None)
        assert got[i] == (best[2] if best else None)


def test_grant_week(spark):
    rnd = random.Random(4)
    donations = [(i, rnd.randint(0, 4), at(rnd.randint(0, 24 * 60)), rnd.random() < 0.1) for i in range(250)]
    subs = [(i, rnd.randint(0, 4), rnd.choice(["active", "cancelled"]), at(rnd.randint(0, 24 * 60)), rnd.randint(0, 240)) for i in range(12)]
    subs = [(i, u, s, c, c + dt.timedelta(hours=h)) for i, u, s, c, h in subs]
    ddf = spark.createDataFrame(donations, "id long, user_id long, verified_at timestamp_ntz, week_granted boolean")
    sdf = spark.createDataFrame(subs, "id long, user_id long, status string, created_at timestamp_ntz, expires_at timestamp_ntz")
    got = {r.id for r in accounts.grant_week(ddf, sdf).collect()}
    want = set()
    for user in range(5):
        grants = []
        for i, u, v, done in sorted(donations, key=lambda r: (r[2], r[0])):
            if u != user or done:
                continue
            known = [(c, 0, sid, s == "active" and e > v) for sid, su, s, c, e in subs if su == u and c <= v]
            known += [(g, 1, 0, g + dt.timedelta(days=7) > v) for g in grants]
            newest = max(known, default=None)
            if newest is None or not newest[3]:
                grants.append(v)
                want.add(i)
    assert got == want


def test_trial_replay(spark):
    rnd = random.Random(5)
    uses = [(i, rnd.choice([0, 0, 0, 1, 2]), at(rnd.randint(0, 400))) for i in range(150)]
    subs = [(1, 0, "active", at(50), at(120)), (2, 0, "cancelled", at(110), at(400)), (3, 1, "active", at(10), None)]
    trials = [(7, 0, 1, 4), (9, 1, 3, 3), (8, 1, 0, 3)]
    got = accounts.trial_replay(
        spark.createDataFrame(uses, "id long, user_id long, used_at timestamp_ntz"),
        spark.createDataFrame(subs, "id long, user_id long, status string, created_at timestamp_ntz, expires_at timestamp_ntz"),
        spark.createDataFrame(trials, "id long, user_id long, used_count long, max_count long"),
    )
    verdict = {r.id: r.outcome for r in got.collect()}
    left = {0: 3, 1: 0, 2: 3}
    for i, u, ts in sorted(uses, key=lambda r: (r[2], r[0])):
        newest = max(((c, sid, s, e) for sid, su, s, c, e in subs if su == u and c <= ts), default=None)
        if newest and newest[2] == "active" and newest[3] and newest[3] > ts:
            want = "subscribed"
        else:
            want = "used" if left[u] > 0 else "exhausted"
            left[u] -= want == "used"
        assert verdict[i] == want


WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "the", "of", "Étude", "etude", "xy", "ab-cd", "نماز", "100%_x"]


def corpus(spark, n=60, seed=6):
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    rows = [(i, text(4), text(8), "s", rnd.choice(["c1", "c2", "", None, f"u{i}"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, question string, answer string, source string, category string")


def test_token_and_literal_hits(spark):
    rows, df = corpus(spark)
    queries = [(1, "alpha beta"), (2, "ETUDE"), (3, "the of alpha"), (4, "nothing"), (5, "  "), (6, "lph"), (7, "a gam"), (8, "x"), (9, "%_"), (10, "ماز"), (11, "of the")]
    qdf = spark.createDataFrame(queries, "qid long, query string")
    tokens = {(r.qid, r.id) for r in S.token_hits(S.token_index(df), qdf).collect()}
    literal = {(r.qid, r.id) for r in S.substring_hits(df, S.chunk_index(df), qdf).collect()}
    import re
    import unicodedata

    def toks(s):
        flat = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
        return set(re.findall(r"[^\W_]+", flat))

    want_t = {(q, r[0]) for q, s in queries for r in rows if toks(s) and toks(s) <= toks(f"{r[1]} {r[2]} {r[4] or ''}")}
    want_l = {(q, r[0]) for q, s in queries for r in rows if s.strip() and any(s.strip().lower() in x.lower() for x in (r[1], r[2]))}
    assert tokens == want_t
    assert literal == want_l
    page = {(r.qid, r["rank"]): (r.id, r.total) for r in S.batch_search(S.token_hits(S.token_index(df), qdf), 2, 5).collect()}
    for q, _ in queries:
        ids = sorted((i for k, i in want_t if k == q), reverse=True)
        assert [page.get((q, 6 + k)) for k in range(len(ids[5:10]))] == [(i, len(ids)) for i in ids[5:10]]


def test_related_by_brute_force(spark):
    rows, df = corpus(spark, 50, 8)
    for limit in (3, 7):
        got = {}
        for r in related.related_records(df, limit, seed=None, stop=("beta",)).collect():
            got.setdefault(r.id, {})[r["rank"]] = (r.related_id, r.score)
        for i, q, _, _, cat in rows:
            ring = sorted(j for j, _, _, _, c in rows if cat and c == cat)
            at = ring.index(i) if cat else 0
            found = [(j, 0.8) for j in (ring[at + 1 :] + ring[:at])[:10]]
            kws = list(dict.fromkeys(w for w in q.split() if len(w) > 3 and w != "beta"))[:3]
            for kw in kws:
                if len(found) >= limit:
                    break
                have = {j for j, _ in found} | {i}
                found += [(j, 0.5) for j, qq, a, _, _ in rows if j not in have and (kw.lower() in qq.lower() or kw.lower() in a.lower())][:5]
            assert [got.get(i, {}).get(k + 1) for k in range(len(found[:limit]))] == found[:limit]
            assert len(got.get(i, {})) == len(found[:limit])


def test_snippet(spark):
    df = spark.createDataFrame([("one two three four five six seven eight nine ten eleven Alpha, twelve",), ("no hit here",)], "s string")
    got = [r[0] for r in df.select(S.snippet(F.col("s"), "alpha")).collect()]
    assert got == ["...four five six seven eight nine ten eleven <b>Alpha,</b> twelve", "no hit here"]


def test_category_rings_do_not_depend_on_their_ranges(spark):
    rnd = random.Random(12)
    rows = [(i * i % 1009 - 300, f"q{i}", rnd.choice(["big", "big", "big", "mid", ""]) if i > 12 else ("one" if i == 0 else "few"), "s") for i in range(200)]
    df = spark.createDataFrame(list({r[0]: r for r in rows}.values()), "id long, question string, category string, source string")
    for seed in (None, 3):
        found = [{r["id"]: [x["id"] for x in r["found"]] for r in related.related_by_category(df, seed, 10, group).collect()} for group in (1, 7, 50, 10**9)]
        assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == df.count()
    ring = sorted(r["id"] for r in df.collect() if r["category"] == "big")
    at = {i: k for k, i in enumerate(ring)}
    by_id = {r["id"]: [x["id"] for x in r["found"]] for r in related.related_by_category(df, None, 10, 7).collect()}
    assert all(by_id[i] == [ring[(at[i] + d) % len(ring)] for d in range(1, 11)] for i in ring)


def test_keywords_are_asked_only_where_the_category_gives_too_few(spark, monkeypatch):
    rows = [(k, f"word{k} shared", "text", "s", "big" if k < 20 else "tiny" if k < 23 else "twice" if k < 33 else None) for k in range(36)]
    rows += [r for r in rows if r[4] == "twice"]
    df = spark.createDataFrame(rows, "id long, question string, answer string, source string, category string")
    kept, staged = {}, related.staged

    def counted(table, label):
        out = staged(table, label)
        kept[label] = {r[0] for r in out.select(out.columns[0]).collect()}
        return out

    monkeypatch.setattr(related, "staged", counted)
    got = related.related_records(df, 5, seed=None).collect()
    assert kept["keywords"] == set(range(20, 36))
    assert {r.score for r in got if r.id < 20} == {0.8} and {r.score for r in got if r.id in (20, 34)} >= {0.5}
