"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Defaults only: a cluster's own settings win because they are already in the session.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs about a millisecond per column operation while a plan is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = 8, app: str = "askloom") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ASKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_root: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session that has none
    gets a temporary folder; on any other master a missing setting is an error, because a folder of one
    machine would be lost with that machine.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="askloom-")
    return _local_root


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table below the checkpoint folder and read back.

    Used where a result feeds several branches and is expensive to compute: readers of the table prune
    columns, and a lost executor costs a re-read instead of a recomputation.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_staged_paths: list[str] = []


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path for an intermediate table, which an enclosing ``scope`` will delete."""
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    _staged_paths.append(path)
    return path


@contextmanager
def scope(spark: SparkSession):
    """Deletes, on leaving, the intermediate tables written inside. Results must be written or collected by then."""
    begin = len(_staged_paths)
    try:
        yield
    finally:
        for path in _staged_paths[begin:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _staged_paths[begin:]


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]):
    """Settings of the session that hold for the queries run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a query are deleted as soon as it has ended, so that steps don't add up on disk."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster on which it is not installed, as ``--py-files`` would."""
    folder = tempfile.mkdtemp(prefix="askloom-")
    root = os.path.dirname(os.path.abspath(__file__))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/askloom", "zip", os.path.dirname(root), os.path.basename(root)))


def is_small(df, limit_bytes: int = 64 << 20) -> bool:
    """True when the optimizer's size estimate of ``df`` is at most ``limit_bytes``.

    The estimate comes from file sizes. It bounds scans and filters of uncompressed columns; compressed files and
    ``explode`` can be many times larger, so use it for narrow tables written as they are and not for generated rows.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit_bytes


def spread(df: DataFrame, per_core: int = 16 << 20) -> DataFrame:
    """``df`` over all cores when the scan is too small to fill them.

    A small file is one scan task however many cores there are, which leaves text parsing single-threaded. Large
    inputs have splits enough and are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if is_small(df, cores * per_core) else df
