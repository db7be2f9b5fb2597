"""Users, files, log and word tables derived from the generic test tables.

They give the metadata reports something to run on. All values follow from row keys, so
any other engine can derive the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.operators import scan as scanning
from maskwell.session import spread
from maskwell.sources.readers import read_table

FILE_TYPES = ("pdf", "docx", "sql", "csv", "txt", "json", "png")
ACTIONS = {"click": "view", "purchase": "download", "error": "failed_login"}


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return moment(AS_OF)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id")


def users(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal").select(
        key.alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("user"), key, F.lit("@example.com")).alias("email"),
        F.when(key % 20 == 0, "admin").otherwise("standard").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        (moment("2023-01-01 00:00:00") + F.make_dt_interval(hours=key.cast("int"))).alias(
            "created_at"
        ),
    )


def _file_columns() -> dict[str, Column]:
    key = F.col("doc_id")
    kind = F.element_at(
        F.array(*[F.lit(t) for t in FILE_TYPES]), (key % len(FILE_TYPES) + 1).cast("int")
    )
    name = F.concat_ws("_", "source", key.cast("string"))
    hours = ((key * 7) % 1440).cast("int")
    done = key % 10 != 3
    filename = F.concat(name, F.lit("."), kind)
    return {
        "file_id": key,
        "original_filename": filename,
        "file_type": kind,
        "uploaded_by": key % 150,
        "status": F.when(done, "done").otherwise("processing"),
        "original_key": F.concat(F.lit("originals/"), key, F.lit("/"), filename),
        "sanitized_key": F.when(
            done, F.concat(F.lit("sanitized/"), key, F.lit("/sanitized_"), filename)
        ),
        "upload_time": moment("2023-12-02 00:00:00") + F.make_dt_interval(hours=hours),
    }


def file_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The files without anything that needs a scan of their text."""
    docs = read_table(spark, sf, "documents", "doc_id", "source")
    return docs.select(*[c.alias(n) for n, c in _file_columns().items()])


def scanned_files(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """The files with detections, masked text, count and summary; ``only`` these file_ids.

    ``only`` comes from a limit, so its ids can go to all tasks.
    """
    docs = read_table(spark, sf, "documents", "doc_id", "source", "text")
    if only is None:
        docs = spread(docs, "doc_id")
    else:
        docs = docs.join(F.broadcast(only.select(F.col("file_id").alias("doc_id"))), "doc_id", "left_semi")
    scanned = scanning.scan(docs)
    return scanned.select(
        *[c.alias(n) for n, c in _file_columns().items()],
        "detections",
        "masked_text",
        F.size("detections").cast("bigint").alias("pii_count"),
        scanning.summarize(F.col("detections")).alias("pii_summary"),
    )


def files(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    return scanned_files(spark, sf, only).drop("detections", "masked_text")


def files_log(spark: SparkSession, sf: str) -> DataFrame:
    """Version 1 of every file, and version 2 of the finished ones."""
    versions = F.when(F.col("status") == "done", F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    later = F.col("version") == 2
    return (
        files(spark, sf)
        .withColumn("version", F.explode(versions))
        .withColumns(
            {
                "status": F.when(later, "done").otherwise("processing"),
                **{c: F.when(later, F.col(c)) for c in ("sanitized_key", "pii_count", "pii_summary")},
            }
        )
    )


def audit(spark: SparkSession, sf: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id")
    events = read_table(
        spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props"
    )
    action = F.when(kind == "view", F.when(key % 5 == 0, "logout").otherwise("login")).when(
        kind == "signup", F.when(key % 4 == 1, "text_scan").otherwise("upload")
    )
    for source, name in ACTIONS.items():
        action = action.when(kind == source, name)
    failed = kind == "error"
    on_file = kind.isin("click", "purchase") | ((kind == "signup") & (key % 4 != 1))
    return events.select(
        key.alias("log_id"),
        F.when(~failed, F.col("user_id")).alias("user_id"),
        action.alias("action"),
        F.when(on_file, F.get_json_object("props", "$.k").cast("bigint")).alias("file_id"),
        F.when(
            failed, F.concat(F.lit('{"username":"user'), F.col("user_id"), F.lit('"}'))
        )
        .otherwise(F.col("props"))
        .alias("details"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("ts").alias("timestamp"),
    )


def words_of(texts: DataFrame, key: str) -> DataFrame:
    """A word table for texts: one line per text line, fixed-width boxes."""
    line_starts = texts.select(
        F.col(key).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_num", "line")
    )
    words = line_starts.select(
        "doc_id", "line_num", F.posexplode(F.split("line", " ")).alias("word_ord", "text")
    )
    return words.select(
        "doc_id",
        F.lit(1).alias("block_num"),
        F.lit(1).alias("par_num"),
        "line_num",
        "word_ord",
        "text",
        (F.col("word_ord") * 40).alias("left"),
        (F.col("line_num") * 20).alias("top"),
        (F.length("text") * 8).alias("width"),
        F.lit(16).alias("height"),
    )
