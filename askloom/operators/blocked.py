"""Ordered work on keys of any size: ranks and as-of joins by (key, block).

A plain window over a key sorts all of the key's rows in one task. Here the order column is cut into blocks
(a day by default); rows are handled per (key, block) and only one summary row per block is carried along the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def day(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")


def blocked_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "rank") -> DataFrame:
    """``row_number`` per key. ``block`` must not decrease along ``order``."""
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_block"])
    return ranked.withColumn(name, F.col("_rn") + F.col("_before")).drop("_block", "_rn", "_before")


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: Sequence[str], tie: str = "id", block=day
) -> DataFrame:
    """``left`` with the newest ``right`` row of its key at or before ``left_ts`` as struct ``latest`` (or NULL).

    Newest means greatest ``(right_ts, tie)``. ``latest`` holds ``right_ts``, ``tie`` and ``values``.
    """
    state = F.struct(F.col(right_ts).alias("ts"), F.col(tie).alias("tie"), *values)
    states = right.select(key, block(right_ts).alias("_block"), F.col(right_ts).alias("_at"), state.alias("_state"))
    # What each block starts with: the newest state of all earlier blocks of the key.
    marks = left.select(key, block(left_ts).alias("_block")).withColumn("_last", F.lit(None).cast(states.schema["_state"].dataType))
    ends = states.select(key, "_block", F.col("_state").alias("_last")).unionByName(marks)
    per_block = ends.groupBy(key, "_block").agg(F.max("_last").alias("_last"))
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = per_block.select(key, "_block", F.max("_last").over(earlier).alias("_carried"))
    payload = F.struct(*left.columns)
    mixed = (
        left.select(key, block(left_ts).alias("_block"), F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), payload.alias("_row"))
        .withColumn("_state", F.lit(None).cast(states.schema["_state"].dataType))
        .unionByName(
            states.select(key, "_block", "_at", F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_row"), "_state")
        )
    )
    upto = W.partitionBy(key, "_block").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = mixed.withColumn("_seen", F.max("_state").over(upto)).filter(F.col("_side") == 1)
    joined = seen.join(carried, [key, "_block"], "left")
    return joined.select("_row.*", F.coalesce("_seen", "_carried").alias("latest"))
