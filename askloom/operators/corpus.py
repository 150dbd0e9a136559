"""Corpus statistics and pages of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_PAGE = 100  # fixed value: largest page of a listing
SKETCH_BITS = 14


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a sorted result. Executes as a top-k over partitions, not as a global sort."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and size between 1 and {MAX_PAGE}")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(top: DataFrame, rows: DataFrame) -> DataFrame:
    """Page rows with the total of the unpaged result, as a scalar subquery over the unpaged rows."""
    return top.withColumn("total", rows.agg(F.count("*")).scalar())


def _category() -> Column:
    return F.nullif(F.col("category"), F.lit(""))


def corpus_stats(df: DataFrame) -> DataFrame:
    """Totals of the corpus.

    Both distinct counts start from one aggregate per (source, category); that table is small whatever the
    corpus holds, and a source with a third of all rows is combined before it is shuffled.
    """
    cells = df.groupBy("source", _category().alias("category")).agg(F.count("*").alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_records"),
        F.countDistinct("source").alias("total_sources"),
        F.countDistinct("category").alias("total_categories"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def category_top(df: DataFrame, n: int = 20) -> DataFrame:
    named = df.filter(_category().isNotNull())
    return named.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


def category_list(df: DataFrame) -> DataFrame:
    return df.filter(_category().isNotNull()).select("category").distinct().orderBy("category")


def stats_state(records: DataFrame, ident: str = "url") -> DataFrame:
    """What statistics need to know of one batch: rows and a sketch of the distinct ``ident`` for every (source, category).

    States of batches are merged by ``merged_state``; a batch is read once and a repeated batch replaces its own state.
    """
    cells = records.groupBy("source", _category().alias("category"))
    return cells.agg(F.count("*").alias("n"), F.hll_sketch_agg(ident, SKETCH_BITS).alias("sketch"))


def merged_state(states: DataFrame) -> DataFrame:
    """One state of the rows of several batches; exact counts add up, sketches unite."""
    return states.groupBy("source", "category").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def stats_of(state: DataFrame, *by: str) -> DataFrame:
    """``n`` (exact) and ``n_distinct`` (estimate, standard error 0.8 %) of all rows, or for each of ``by`` (source, category)."""
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")
    distinct = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0).cast("long")).alias("n_distinct")
    return state.groupBy(*by).agg(n, distinct)


class StatsStore:
    """States of batches in the folder ``root``, which all executors must share; statistics read these and no record."""

    SCHEMA = "source string, category string, n long, sketch binary, batch string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, batch: str, records: DataFrame, ident: str = "url") -> None:
        """Adds the state of a batch, or replaces it if the batch is repeated."""
        stats_state(records, ident).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def state(self, batches: Sequence[str]) -> DataFrame:
        """The merged state of ``batches``."""
        if not batches:
            return merged_state(self.spark.createDataFrame([], self.SCHEMA))
        paths = [f"{self.root}/batch={b}" for b in batches]
        return merged_state(self.spark.read.option("basePath", self.root).schema(self.SCHEMA).parquet(*paths))
