"""Related-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import related as R
from askloom.plans import duck as D
from askloom.plans.bind import AS_OF
from askloom.plans.registry import query
from askloom.plans.scalars import STOP

C = F.col
FMT = "yyyy-MM-dd HH:mm:ss"
# The ten records that follow in a category's ring of ids.
D_RING = """ring AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id) AS rn, count(*) OVER (PARTITION BY category) AS n FROM records WHERE category <> ''),
    cat AS (SELECT a.id, b.id AS rid, (b.rn - a.rn + a.n) % a.n AS seq FROM ring a JOIN ring b ON a.category = b.category AND a.id <> b.id WHERE (b.rn - a.rn + a.n) % a.n <= 10)"""


@query(
    "related_by_category",
    "records",
    f"""WITH {D_RING} SELECT id, rid AS related_id, CAST(seq AS INT) AS rank FROM cat""",
)
def _(t):
    found = R.related_by_category(t.records, seed=None)
    out = found.select("id", F.posexplode("found").alias("pos", "c"))
    return out.select("id", C("c.id").alias("related_id"), (C("pos") + 1).alias("rank"))


@query(
    "related_by_category_sampled",
    "records",
    # Any seeded order: a record of a category gets ten others of it, or all if fewer, and is given as often itself.
    """WITH r AS (SELECT id, count(*) OVER (PARTITION BY category) - 1 AS others FROM records WHERE category <> '')
       SELECT id, least(others, 10) AS n_found, least(others, 10) AS n_given, 0 AS n_foreign FROM r""",
)
def _(t):
    found = R.related_by_category(t.records, seed=7).select("id", F.explode("found").alias("c"))
    pairs = found.select("id", C("c.id").alias("related_id"), C("c.category").alias("theirs")).join(t.records.select("id", "category"), "id")
    foreign = (C("theirs") != C("category")) | (C("related_id") == C("id"))
    out = pairs.groupBy("id").agg(F.countDistinct("related_id").alias("n_found"), F.count_if(foreign).alias("n_foreign"))
    given = pairs.groupBy(C("related_id").alias("id")).agg(F.count("*").alias("n_given"))
    named = t.records.filter(C("category") != "").select("id").join(out, "id", "left").join(given, "id", "left")
    return named.select("id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_found", "n_given")], F.coalesce("n_foreign", F.lit(0).cast("long")).cast("int").alias("n_foreign"))


D_RELATED = rf"""
    kw0 AS (SELECT id, list_transform(regexp_split_to_array({D.strip('question')}, '{D.WS}+'), lambda w: trim(w, '.,:;!?()[]{{}}"''')) AS ws FROM records),
    kw1 AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM kw0),
    kw2 AS (SELECT id, w, min(pos) AS pos FROM kw1 WHERE len(w) > 3 AND w NOT IN {STOP} GROUP BY ALL),
    kw AS (SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM kw2 QUALIFY k <= 3),
    mat AS MATERIALIZED (SELECT w, r.id AS rid FROM (SELECT DISTINCT w FROM kw) d JOIN (SELECT id, translate(question, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS question, translate(answer, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS answer FROM records) r
           ON contains(r.question, d.w) OR contains(r.answer, d.w)),
    {D_RING},
    f0 AS (SELECT id, rid, 0.8 AS score, seq FROM cat),
    n0 AS (SELECT r.id, count(f0.rid) AS n FROM records r LEFT JOIN f0 ON f0.id = r.id GROUP BY r.id),
    f1 AS MATERIALIZED (SELECT kw.id, mat.rid, 0.5 AS score, 100 + row_number() OVER (PARTITION BY kw.id ORDER BY mat.rid) AS seq FROM kw JOIN n0 ON n0.id = kw.id AND n0.n < 5
           JOIN mat ON mat.w = kw.w AND mat.rid <> kw.id WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM f0 WHERE f0.id = kw.id AND f0.rid = mat.rid) QUALIFY row_number() OVER (PARTITION BY kw.id ORDER BY mat.rid) <= 5),
    g1 AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1),
    n1 AS (SELECT r.id, count(g1.rid) AS n FROM records r LEFT JOIN g1 ON g1.id = r.id GROUP BY r.id),
    f2 AS MATERIALIZED (SELECT kw.id, mat.rid, 0.5 AS score, 200 + row_number() OVER (PARTITION BY kw.id ORDER BY mat.rid) AS seq FROM kw JOIN n1 ON n1.id = kw.id AND n1.n < 5
           JOIN mat ON mat.w = kw.w AND mat.rid <> kw.id WHERE k = 2 AND NOT EXISTS (SELECT 1 FROM g1 WHERE g1.id = kw.id AND g1.rid = mat.rid) QUALIFY row_number() OVER (PARTITION BY kw.id ORDER BY mat.rid) <= 5),
    g2 AS (SELECT * FROM g1 UNION ALL SELECT * FROM f2),
    n2 AS (SELECT r.id, count(g2.rid) AS n FROM records r LEFT JOIN g2 ON g2.id = r.id GROUP BY r.id),
    f3 AS MATERIALIZED (SELECT kw.id, mat.rid, 0.5 AS score, 300 + row_number() OVER (PARTITION BY kw.id ORDER BY mat.rid) AS seq FROM kw JOIN n2 ON n2.id = kw.id AND n2.n < 5
           JOIN mat ON mat.w = kw.w AND mat.rid <> kw.id WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM g2 WHERE g2.id = kw.id AND g2.rid = mat.rid) QUALIFY row_number() OVER (PARTITION BY kw.id ORDER BY mat.rid) <= 5),
    g3 AS (SELECT * FROM g2 UNION ALL SELECT * FROM f3),
    rel AS (SELECT id, rid AS related_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS rank FROM g3 QUALIFY rank <= 5)"""


@query(
    "related_by_keyword",
    "records",
    f"""WITH {D_RELATED} SELECT id, related_id, CAST(rank AS INT) AS rank, score FROM rel WHERE score < 0.8""",
)
def _(t):
    return R.related_records(t.records, 5, seed=None, stop=STOP).filter(C("score") < 0.8).select("id", "related_id", "rank", "score")


@query(
    "related_top",
    "records",
    f"""WITH {D_RELATED} SELECT rel.id, related_id, CAST(rank AS INT) AS rank, score, substr(r.question, 1, 150) AS question, r.category, r.source FROM rel JOIN records r ON r.id = related_id""",
)
def _(t):
    return R.related_records(t.records, 5, seed=None, stop=STOP)


# Cached pairs: each document points at documents around it; the last ones point past the end of the corpus.
CACHE = """SELECT doc_id AS record_id, doc_id + k * 3 AS related_id, CASE WHEN k % 2 = 0 THEN 0.8 ELSE 0.5 END AS score,
    TIMESTAMP_NTZ '2024-01-20 00:00:00' + (doc_id % 7 + k) * INTERVAL '1' DAY AS cached_until
    FROM {documents} AS d JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(k) ON true"""
D_CACHE = CACHE.format(documents="documents").replace("TIMESTAMP_NTZ '", "TIMESTAMP '")


@query(
    "related_cache_read",
    "records",
    f"""WITH c AS ({D_CACHE}), v AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, related_id) AS rank FROM c WHERE cached_until > TIMESTAMP '{AS_OF}')
    SELECT v.record_id, CAST(v.rank AS INT) AS rank, v.related_id, CAST(v.score AS DOUBLE) AS score, substr(r.question, 1, 150) AS question, r.category, r.source FROM v JOIN records r ON r.id = v.related_id WHERE v.rank <= 5""",
)
def _(t):
    k = F.explode(F.sequence(F.lit(1), F.lit(7)))
    pairs = t.documents.select("doc_id", k.alias("k"))
    cache = pairs.select(
        C("doc_id").alias("record_id"),
        (C("doc_id") + C("k") * 3).alias("related_id"),
        F.when(C("k") % 2 == 0, F.lit(0.8)).otherwise(F.lit(0.5)).alias("score"),
        F.timestamp_add("DAY", (C("doc_id") % 7 + C("k")).cast("int"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).alias("cached_until"),
    )
    return R.related_cache_read(cache, t.records, AS_OF)


@query(
    "related_cache_write",
    "records",
    f"""WITH {D_RELATED} SELECT id AS record_id, related_id, score, '{AS_OF}' AS created_at, '2024-02-01 00:00:00' AS cached_until FROM rel""",
)
def _(t):
    out = R.related_cache_write(R.related_records(t.records, 5, seed=None, stop=STOP), AS_OF)
    return out.withColumns({c: F.date_format(c, FMT) for c in ("created_at", "cached_until")})
