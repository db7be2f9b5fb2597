"""Current state of an append-only log, and deletes as anti-joins."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.operators.ranking import left_join


def current_rows(log: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The row of each key with the highest version; of equal versions, the one of one hash.

    The highest version is a number a key, so it is a hash aggregate that is reduced before
    the shuffle, however many versions a key has; the rows that hold it are then picked by a
    hash join. Nothing is sorted. Rows that are equal in all columns all stay.
    """
    plain = [f.name for f in log.schema if "map" not in f.dataType.simpleString()]
    # Version and hash in one number: an aggregate over structs would sort.
    tie = F.xxhash64(*plain).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    rank = F.col(version).cast("decimal(17,0)") * F.lit(Decimal(1 << 64)) + tie
    ranked = log.withColumn("_rank", rank.cast("decimal(38,0)"))
    top = ranked.groupBy(key).agg(F.max("_rank").alias("_rank"))
    return ranked.join(top.hint("shuffle_hash"), [key, "_rank"], "left_semi").select(*log.columns)


def started(files: DataFrame) -> DataFrame:
    """First log entry of new files."""
    return files.withColumns(
        {
            "status": F.lit("processing"),
            "sanitized_key": F.lit(None).cast("string"),
            "pii_count": F.lit(None).cast("bigint"),
            "pii_summary": F.lit(None).cast("map<string,bigint>"),
            "version": F.lit(1),
        }
    )


def finished(files: DataFrame, status: str = "done") -> DataFrame:
    """Log entry that follows the scan of a file."""
    return files.withColumns({"status": F.lit(status), "version": F.lit(2)})


def without(df: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows whose key is not among the deleted ones; rows without a key stay."""
    return left_join(df, gone.select(key).distinct(), key, "left_anti")


def cascade_delete(
    files: DataFrame, detections: DataFrame, audit: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, detections and audit rows that remain once the files in ``gone`` are deleted."""
    return without(files, gone), without(detections, gone), without(audit, gone)
