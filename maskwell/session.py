"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "maskwell", **extra: str) -> SparkSession:
    """A session with this package's defaults; master and sizing come from the caller."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the cluster's checkpoint directory.

    Only a local session (a test on one machine) can do without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="maskwell-")
    return f"{root.rstrip('/')}/maskwell-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate results, wherever Spark keeps its files."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def replace(spark: SparkSession, path: str, new: str) -> None:
    """Put the folder ``new`` in the place of ``path``, on the same file system."""
    context = spark.sparkContext
    place, source = (context._jvm.org.apache.hadoop.fs.Path(x) for x in (path, new))
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(source):
        raise FileNotFoundError(new)
    files.delete(place, True)
    if not files.rename(source, place):
        raise OSError(f"{new} could not be moved to {path}")


def pin(df: DataFrame) -> DataFrame:
    """Write a small, several times used result to the checkpoint directory."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows of a task that ``spread`` aims at.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of few splits one partition per core, and more if it has many rows.

    Regex work is heavy per byte, so a small table in one or two splits would keep most
    cores idle, and short rows by the million would make a few tasks that grow with the
    table. A table with enough splits for its rows is returned as it is: tables of long
    texts are not shuffled for this. The rows are counted, so ``df`` is best a plain table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // SPREAD_ROWS))
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


#: What a Python function gets of a task's rows at once. Every function in a plan has its own
#: worker in each running task, and holds a batch and its result.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to a few megabytes; a smaller limit of its own stays."""
    key, most = BATCH_BYTES
    now = spark.conf.get(key).lower()
    size = int(now.rstrip("bkmg")) << {"k": 10, "m": 20, "g": 30}.get(now.rstrip("b")[-1:], 0)
    if size > most:
        spark.conf.set(key, str(most))
