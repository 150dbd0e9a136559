"""Streaming forms: ingest of arriving pages, counts of missed searches, sessions by event time, trial use per user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from askloom.operators.accounts import MAX_TRIALS
from askloom.operators.ingest import upsert_by_url
from askloom.session import staged


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the parquet files ``name`` below ``folder``; where ``name`` is itself a folder of files, over those."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(path):
        folder, name = f"{folder}/{name}", "*"
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def ingest_stream(pages: DataFrame, parse: Callable[[DataFrame], DataFrame], store: str, order_by: str = "page_id"):
    """Append arriving pages once per URL and keep a ledger of every row's status.

    The memory of known URLs is the store itself, met by an anti-join per batch, not streaming state that grows for
    ever. A batch writes below its own batch number and replaces it when it is repeated after a failure, and it
    reads only earlier batches, so the result is the same however often a batch runs.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = staged(parse(batch), f"batch-{batch_id}")
        known = spark.createDataFrame([], "url string")
        if batch_id > 0:
            earlier = spark.read.option("basePath", f"{store}/records").schema("url string, batch bigint").parquet(f"{store}/records")
            known = earlier.filter(F.col("batch") < batch_id).select("url")
        good = parsed.filter(F.col("status").isNull()).drop("status")
        done = staged(upsert_by_url(good, known, order_by), f"done-{batch_id}")
        done.filter(F.col("status") == "inserted").write.mode("overwrite").parquet(f"{store}/records/batch={batch_id}")
        ledger = done.select("url", "source", "status").unionByName(
            parsed.filter(F.col("status").isNotNull()).select("url", "source", "status")
        )
        ledger.write.mode("overwrite").parquet(f"{store}/ledger/batch={batch_id}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True)


def ingest_recent(pages: DataFrame, event_time: str, delay: str = "1 day", key: str = "url") -> DataFrame:
    """Event-time variant: drops a repeated URL that arrives within the watermark delay, with bounded state."""
    return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def miss_stream(misses: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Missed searches per query and tumbling window; rows later than the watermark are dropped."""
    timed = misses.withWatermark("searched_at", delay)
    counted = timed.groupBy(F.window("searched_at", width), "query").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "query", "n")


def session_stream(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """``key, started_at, closed_at, n`` of sessions of events at most ``gap`` apart, each once, when the watermark has passed its idle time.

    ``closed_at`` is the last event's time and ``gap``. State holds the open sessions only. Events later than the watermark are dropped;
    such a one would have opened a session of its own or changed one that is already out. Events without a key or time are left out.
    """
    timed = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    runs = timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n")


def trial_stream(uses: DataFrame, max_count: int = MAX_TRIALS) -> DataFrame:
    """Uses ``id, user_id, used_at, paid`` with ``outcome``; the state of a user is the number of uses counted.

    Within a batch the earliest uses count. The group is read chunk by chunk and only the few uses that may
    still count are held, so the size of a user's batch does not matter.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        left = max(0, max_count - used)
        held: pd.DataFrame | None = None
        for chunk in chunks:
            paid = chunk[chunk["paid"]]
            yield paid[["id", "user_id", "used_at"]].assign(outcome="subscribed")
            open_rows = chunk[~chunk["paid"]] if held is None else pd.concat([held, chunk[~chunk["paid"]]])
            ordered = open_rows.sort_values(["used_at", "id"])
            held = ordered.iloc[:left]
            yield ordered.iloc[left:][["id", "user_id", "used_at"]].assign(outcome="exhausted")
        if held is not None:
            yield held[["id", "user_id", "used_at"]].assign(outcome="used")
            state.update((used + len(held),))

    return uses.groupBy("user_id").applyInPandasWithState(
        step, "id bigint, user_id bigint, used_at timestamp, outcome string", "used int", "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is available into a parquet table and return the table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")
