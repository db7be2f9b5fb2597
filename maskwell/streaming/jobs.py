"""Streaming forms of the scan, the failed-login watch and the session report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from maskwell.functions.rules import TIMEOUT_MINUTES, login_tier
from maskwell.operators.audit import username_in
from maskwell.plans.sanitize import check_and_scan, sanitize

LATENESS = "10 minutes"


def read_stream(
    spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet"
) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    )


def scan_stream(files: DataFrame, as_of: Column, partitions: int | None = None) -> DataFrame:
    """Check and scan each arriving file; no state is kept.

    ``partitions`` spreads each batch over that many tasks. Set it where files arrive in few
    large pieces; with many files per batch leave it out, and nothing is shuffled.
    """
    if partitions:
        files = files.repartition(partitions)
    return check_and_scan(files, as_of).drop("content", "route")


def sanitize_stream(files: DataFrame, out: str, as_of: Column) -> StreamingQuery:
    """The upload job over arriving files, all its tables exactly once.

    Each batch is a run of its own, named by the batch's number. A batch that Spark repeats
    after a failure replaces what its first try left in any of the tables.
    """
    return (
        files.writeStream.foreachBatch(lambda batch, number: sanitize_batch(batch, number, out, as_of))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def sanitize_batch(batch: DataFrame, number: int, out: str, as_of: Column) -> None:
    sanitize(batch, out, f"batch-{number:09d}", as_of)


def failed_login_windows(audit: DataFrame, width: str = "1 hour") -> DataFrame:
    """Failed attempts per user name and window, with the alert tier.

    A window is given out once the watermark has passed its end; later rows are dropped.
    """
    return _login_rows(
        audit.filter(F.col("action") == "failed_login")
        .withWatermark("timestamp", LATENESS)
        .groupBy(
            F.window("timestamp", width).alias("w"),
            username_in(F.col("details")).alias("username"),
        )
        .agg(F.count(F.lit(1)).alias("attempts"))
    )


def _login_rows(counted: DataFrame) -> DataFrame:
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "username",
        "attempts",
        login_tier(F.col("attempts")).alias("tier"),
    )


def session_stream(audit: DataFrame) -> DataFrame:
    """Sessions per user, closed by more than 30 idle minutes."""
    return _session_rows(
        audit.filter(F.col("user_id").isNotNull())
        .withWatermark("timestamp", LATENESS)
        .groupBy(
            F.session_window("timestamp", f"{TIMEOUT_MINUTES} minutes").alias("w"), "user_id"
        )
        .agg(F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last_active"))
    )


def _session_rows(counted: DataFrame) -> DataFrame:
    return counted.select(
        "user_id", F.col("w.start").alias("session_start"), "last_active", "events"
    )


# --- what a stream still holds ---------------------------------------------------------------


def open_state(spark: SparkSession, out: str) -> DataFrame:
    """Keys and values of the windows that the stream below ``out`` has not given out yet."""
    return spark.read.format("statestore").load(f"{out}/checkpoint")


def open_login_windows(spark: SparkSession, out: str) -> DataFrame:
    """The rows of ``failed_login_windows`` whose windows are still open."""
    state = open_state(spark, out)
    window, username = (F.col(f"key.`{name}`") for name in state.schema["key"].dataType.names)
    held = state.select(
        window.alias("w"), username.alias("username"), F.col("value.count").alias("attempts")
    )
    return _login_rows(held)


def open_sessions(spark: SparkSession, out: str) -> DataFrame:
    """The rows of ``session_stream`` whose sessions are still open."""
    held = open_state(spark, out).select(
        F.col("value.session_window").alias("w"),
        F.col("value.user_id").alias("user_id"),
        F.col("value.max").alias("last_active"),
        F.col("value.count").alias("events"),
    )
    return _session_rows(held)


def close(spark: SparkSession, result: DataFrame, rest: DataFrame, out: str) -> DataFrame:
    """All rows of a finished stream: those given out, and those that were still open.

    The closing rows lie beside the stream's own and are written anew each time, so closing
    can be repeated, and the stream can go on later.
    """
    rest.write.mode("overwrite").parquet(f"{out}/closing")
    done = [spark.read.schema(result.schema).parquet(f"{out}/{part}") for part in ("data", "closing")]
    return done[0].unionByName(done[1])


def drain(result: DataFrame, out: str) -> StreamingQuery:
    """Process all that has arrived into a Parquet folder, then stop."""
    return (
        result.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/data")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
