"""Writers. Every one is a plain Spark write; a run's output replaces itself on a rerun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.operators.scan import explode_detections


def write_run(df: DataFrame, table: str, run_id: str, *partitions: str) -> None:
    """Write one run's rows under the table folder; a second run with the id replaces them.

    Rows that go to value folders are first brought together by value. The rebalance splits
    a frequent value over several tasks and joins rare ones, so files get a fair size.
    """
    if partitions:
        df = df.hint("rebalance", *partitions)
    # Whatever an earlier run left goes, also in folders that this one does not write.
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(f"{table}/run_id={run_id}")


def detection_rows(scanned: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows for the detections table; method and confidence have their defaults."""
    return explode_detections(scanned, key).fillna(
        {"detection_method": "regex", "confidence": 1.0}
    )


def event_rows(
    df: DataFrame,
    action: str,
    at: Column,
    user_id: Column,
    file_id: Column | None = None,
    details: Column | None = None,
    ip_address: Column | None = None,
    identity: Column | None = None,
) -> DataFrame:
    """Audit rows, one per input row. Missing details become an empty object.

    ``identity`` tells apart rows that are alike in all else; left out, it is the row's place
    in ``df``, so that two equal events are two rows with ids of their own.
    """
    identity = F.monotonically_increasing_id() if identity is None else identity
    text = F.lit(None).cast("string")
    file_id = text if file_id is None else file_id.cast("string")
    user_id = user_id.cast("string")
    details = F.coalesce(text if details is None else details, F.lit("{}"))
    ip_address = text if ip_address is None else ip_address
    log_id = F.sha2(
        F.to_json(
            F.struct(
                F.lit(action).alias("action"),
                user_id.alias("user_id"),
                file_id.alias("file_id"),
                details.alias("details"),
                at.cast("string").alias("at"),
                identity.cast("string").alias("identity"),
            ),
            {"ignoreNullFields": "false"},
        ),
        256,
    )
    return df.select(
        log_id.alias("log_id"),
        user_id.alias("user_id"),
        F.lit(action).alias("action"),
        file_id.alias("file_id"),
        details.alias("details"),
        ip_address.alias("ip_address"),
        at.alias("timestamp"),
    )


def failed_login_rows(attempts: DataFrame, at: Column, username: str = "username") -> DataFrame:
    """Audit rows of failed logins: no user, the tried name inside the details."""
    return event_rows(
        attempts,
        "failed_login",
        at,
        F.lit(None).cast("string"),
        details=F.to_json(F.struct(F.col(username).alias("username"))),
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """One text per line, as many files as partitions."""
    lines.select("value").write.mode("overwrite").text(path)


def write_export(export: DataFrame, path: str) -> None:
    """Exported texts, one folder per file type."""
    static = export.write.mode("overwrite").option("partitionOverwriteMode", "static")
    static.partitionBy("file_type").parquet(path)
