"""Corpus statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askloom.operators import corpus as O
from askloom.plans.registry import query
from askloom.session import staging_path


@query(
    "browse_page",
    "records",
    "SELECT id, source, category, (SELECT count(*) FROM records) AS total FROM records ORDER BY id DESC LIMIT 20 OFFSET 40",
)
def _(t):
    top = O.page(t.records.select("id", "source", "category"), [F.desc("id")], 3, 20)
    return O.with_total(top, t.records)


@query(
    "corpus_stats",
    "records",
    "SELECT count(*) AS total_records, count(DISTINCT source) AS total_sources, count(DISTINCT nullif(category, '')) AS total_categories FROM records",
)
def _(t):
    return O.corpus_stats(t.records)


@query("source_counts", "records", "SELECT source, count(*) AS n FROM records GROUP BY source ORDER BY n DESC, source")
def _(t):
    return O.source_counts(t.records)


@query("category_top", "records", "SELECT category, count(*) AS n FROM records WHERE category <> '' GROUP BY category ORDER BY n DESC, category LIMIT 3")
def _(t):
    return O.category_top(t.records, 3)


@query("category_list", "records", "SELECT DISTINCT category FROM records WHERE category <> '' ORDER BY category")
def _(t):
    return O.category_list(t.records)


@query(
    "merged_stats",
    "incoming",
    """SELECT source, category, n, true AS estimate_holds FROM (
         SELECT source, CAST(NULL AS VARCHAR) AS category, count(*) AS n FROM incoming GROUP BY source
         UNION ALL SELECT NULL, nullif(category, ''), count(*) FROM incoming WHERE category <> '' GROUP BY category
         UNION ALL SELECT NULL, NULL, count(*) FROM incoming) AS a""",
)
def _(t):
    store = O.StatsStore(t.spark, staging_path(t.spark, "stats"))
    early = F.coalesce(F.col("category"), F.lit("")) == ""
    store.add("early", t.incoming.filter(early))
    store.add("late", t.incoming.filter(~early))
    store.add("early", t.incoming.filter(early))  # a batch that is repeated counts once
    state = store.state(["early", "late"])
    null = F.lit(None).cast("string")

    def part(stats, exact, *by):
        keys = [F.col(c) if c in by else null.alias(c) for c in ("source", "category")]
        counted = exact.groupBy(*by).agg(F.countDistinct("url").alias("exact"))
        both = stats.join(counted, list(by)) if by else stats.withColumn("exact", counted.scalar())
        near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")
        return both.select(*keys, "n", near.alias("estimate_holds"))

    named = F.col("category").isNotNull() & (F.col("category") != "")
    by_source = part(O.stats_of(state, "source"), t.incoming, "source")
    by_category = part(O.stats_of(state, "category").filter(named), t.incoming.filter(named), "category")
    return by_source.unionByName(by_category).unionByName(part(O.stats_of(state), t.incoming))
