"""Connected components of a graph given as edges, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.tables import staged


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Every edge (u, v) hung to the least neighbour of u. Minima come from a written table, so joins on a hub can be split."""
    out = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = staged(out.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).withColumnRenamed("u", "w"), "least")
    hung = out.join(least, F.col("u") == F.col("w"))
    if both_ways:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, label: the least node of its component, for every node of an edge. Edges with NULL or equal ends are ignored.

    Each step is written and read again; the number of steps grows with the logarithm of the longest path. Nothing is gathered but two
    numbers a step, by which a step that changed nothing is seen.
    """
    now = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    now = staged(now.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    before = None
    while True:
        now = staged(_stars(_stars(now, True).where("u <> v"), False).where("u <> v"), "edges")
        mark = now.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x")).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
