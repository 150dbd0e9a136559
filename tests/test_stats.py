"""Merged statistics of batches against plain counts."""

from pyspark.sql import functions as F

from askloom.operators import corpus as O
from askloom.session import staging_path


def test_states_of_batches_merge_to_the_whole(spark):
    rows = spark.range(30_000).select(
        F.concat(F.lit("u"), F.col("id") % 21_000).alias("url"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.when(F.col("id") % 7 == 0, F.lit("")).when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.lit("c")).alias("category"),
    )
    store = O.StatsStore(spark, staging_path(spark, "stats"))
    names = [f"b{k}" for k in range(3)]
    for k, name in enumerate(names):
        store.add(name, rows.filter(F.crc32("url") % 3 == k))
    store.add("b1", rows.filter(F.crc32("url") % 3 == 1))  # repeated
    state = store.state(names)
    total = O.stats_of(state).first()
    assert total["n"] == 30_000 and abs(total["n_distinct"] - 21_000) <= 0.05 * 21_000
    exact = {tuple(r) for r in rows.groupBy("source").count().collect()}
    assert {(r["source"], r["n"]) for r in O.stats_of(state, "source").collect()} == exact
    # Blank categories count as none, as in the other statistics.
    assert {r["category"] for r in O.stats_of(state, "category").collect()} == {None, "c"}


def test_nulls_and_nothing(spark):
    store = O.StatsStore(spark, staging_path(spark, "stats"))
    assert tuple(O.stats_of(store.state([])).first()) == (0, 0)
    store.add("a", spark.createDataFrame([(None, None, None), (None, None, "x")], "url string, source string, category string"))
    assert tuple(O.stats_of(store.state(["a"])).first()) == (2, 0)
