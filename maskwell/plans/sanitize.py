"""The upload job: check, scan, mask and record a batch of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.csv_text import cells_of, text_of
from maskwell.functions.keys import csv_line, original_key, route, sanitized_key
from maskwell.functions.text import decode_utf8
from maskwell.operators.lifecycle import current_rows, finished, started, without
from maskwell.operators.scan import no_detections, scan, scan_array, summarize
from maskwell.operators.threat_scan import blocked_details, security_scan
from maskwell.operators.words import line_detections, redaction_boxes
from maskwell.session import pin, remove, replace, spread, stage
from maskwell.sources.readers import read_csv_cells
from maskwell.sources.writers import detection_rows, event_rows, write_run

TABLES = ("files_log", "pii_detections", "audit_logs", "sanitized", "quarantine", "originals")


def check_and_scan(files: DataFrame, as_of: Column) -> DataFrame:
    """Add ``security``, ``detections`` and ``masked_text``; blocked files are not scanned.

    Needs ``content`` and ``filename``; ``units``, an array of texts, holds the pages or runs
    of files that were taken apart before. The kind of file, by its name, tells what is
    scanned by itself: the whole text, each CSV cell, each page or each run. All of a file's
    units are one array that is masked in place and put together again, so every kind goes
    through the same plan, the input is read once and nothing is shuffled. An image has no
    text of its own.
    """
    if "units" not in files.columns:
        files = files.withColumn("units", F.lit(None).cast("array<string>"))
    kind = F.when(F.col("security.safe"), route(F.col("filename")))
    text = decode_utf8(F.col("content"))
    checked = security_scan(files, as_of).withColumn("route", kind)
    csv = cells_of(F.when(F.col("route") == "cell", text))
    given = checked.withColumn("_csv", csv).withColumn(
        "units",
        F.when(F.col("route") == "cell", F.col("_csv.cells"))
        .when(F.col("route").isin("page", "run"), F.col("units"))
        .when(F.col("route") == "text", F.array(text)),
    )
    done = scan_array(given, "units")
    is_csv = F.col("route") == "cell"
    csv_again = text_of(F.when(is_csv, F.col("units")), F.when(is_csv, F.col("_csv.widths")))
    masked = (
        F.when(is_csv, csv_again)
        .when(F.col("route") == "page", joined_units(F.col("units"), "page"))
        .when(F.col("route") == "run", joined_units(F.col("units"), "run"))
        .otherwise(F.get("units", F.lit(0)))
    )
    return done.withColumn("masked_text", masked).drop("_csv", "units")


def joined_units(units: Column, kind: str) -> Column:
    """The text of a file from its pages or runs; a missing one counts as empty."""
    full = F.transform(units, lambda u: F.coalesce(u, F.lit("")))
    return F.array_join(full, {"page": "\n\n", "run": ""}[kind])


def word_findings(words: DataFrame) -> DataFrame:
    """file_id and the detections in the recognised words of its image, line by line."""
    found = line_detections(words.withColumnRenamed("file_id", "doc_id"))
    place = ("block_num", "par_num", "line_num", "ord")
    fields = ("pii_type", "original_value", "masked_value", "detection_method", "confidence")
    rows = F.array_sort(F.collect_list(F.struct(*place, F.struct(*fields).alias("d"))))
    return found.groupBy(F.col("doc_id").alias("file_id")).agg(rows["d"].alias("found"))


def sanitize(
    files: DataFrame, out: str, run_id: str, as_of: Column, words: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Run the job on ``files`` and return the tables it wrote.

    ``files`` has file_id, filename, file_type, uploaded_by, upload_time and content, and may
    have ``units`` (see ``check_and_scan``). ``words`` are the recognised words of images:
    file_id, their place, text and box; what is found in them joins the other findings, and
    the boxes to black out are written as ``boxes``. The scan is written once, below ``out``,
    and the tables are cut from what was written: no pattern runs twice, and a lost executor
    costs no rescan. All output of a run lies under its run id, so repeating a failed run
    replaces what it left behind. The scan's own folder goes at the end.
    """
    spark = files.sparkSession
    staged_at = f"{out}/staged"
    write_run(check_and_scan(files, as_of), staged_at, run_id)
    staged = spark.read.parquet(f"{staged_at}/run_id={run_id}")
    if words is not None:
        images = staged.filter("route = 'image'").drop("detections")
        found = F.coalesce("found", no_detections()).alias("detections")
        images = images.join(stage(word_findings(words)), "file_id", "left").select("*", found).drop("found")
        others = staged.filter("route IS NULL OR route <> 'image'")
        staged = others.unionByName(images)
        shown = images.select(F.col("file_id").alias("doc_id"))
        boxes = redaction_boxes(
            words.withColumnRenamed("file_id", "doc_id").join(shown, "doc_id", "left_semi")
        )
        write_run(boxes.withColumnRenamed("doc_id", "file_id"), f"{out}/boxes", run_id)

    safe = staged.filter("security.safe")
    blocked = staged.filter("NOT security.safe")
    name = F.col("filename")
    rows = safe.select(
        "file_id",
        name.alias("original_filename"),
        "file_type",
        "uploaded_by",
        original_key(F.col("file_id").cast("string"), name).alias("original_key"),
        sanitized_key(F.col("file_id").cast("string"), name).alias("sanitized_key"),
        F.size("detections").cast("bigint").alias("pii_count"),
        summarize(F.col("detections")).alias("pii_summary"),
        "upload_time",
    )
    second = finished(rows)
    log = started(rows).select(second.columns).unionByName(second)

    uploaded = event_rows(
        safe,
        "upload",
        F.col("upload_time"),
        F.col("uploaded_by"),
        F.col("file_id"),
        F.to_json(
            F.struct(name.alias("filename"), F.size("detections").alias("pii_count"))
        ),
        identity=F.col("file_id"),
    )
    refused = event_rows(
        blocked,
        "blocked_upload",
        F.col("upload_time"),
        F.col("uploaded_by"),
        details=blocked_details(F.col("security")),
        identity=F.col("file_id"),
    )
    write_run(log, f"{out}/files_log", run_id)
    write_run(detection_rows(safe), f"{out}/pii_detections", run_id, "pii_type")
    write_run(uploaded.unionByName(refused), f"{out}/audit_logs", run_id)
    write_run(safe.select("file_id", "file_type", "masked_text"), f"{out}/sanitized", run_id)
    write_run(blocked.select("file_id", "filename", "security"), f"{out}/quarantine", run_id)
    originals = safe.select(
        "file_id",
        original_key(F.col("file_id").cast("string"), name).alias("original_key"),
        F.col("security.hashes.sha256").alias("sha256"),
        "content",
    )
    write_run(originals, f"{out}/originals", run_id)
    remove(spark, f"{staged_at}/run_id={run_id}")
    return open_tables(spark, out)


def open_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of all runs, with the current row of each file as ``files``."""
    tables = {
        t: spark.read.option("basePath", f"{out}/{t}").parquet(f"{out}/{t}") for t in TABLES
    }
    tables["files"] = current_rows(tables["files_log"], "file_id")
    return tables


def delete_files(spark: SparkSession, out: str, gone: DataFrame) -> list[str]:
    """Take the files in ``gone`` (file_id) out of all tables, in place; the runs touched.

    Only the run folders that hold a deleted file are written anew, all others keep their
    files as they are. The log tells which runs those are. What stays of a folder is written
    once, beside the tables, and that folder then takes its place, so a delete that failed
    while it wrote can be repeated.
    The delete events themselves are appended afterwards by the caller and stay.
    """
    ids = pin(gone.select("file_id").distinct())

    def runs_of(table: str) -> list[str]:
        rows = _read(spark, f"{out}/{table}").select("run_id", "file_id")
        return [r.run_id for r in rows.join(ids, "file_id", "left_semi").select("run_id").distinct().collect()]

    runs = sorted({*runs_of("files_log"), *runs_of("quarantine")})
    for run in runs:
        for table in TABLES:
            rows = _read(spark, f"{out}/{table}").filter(F.col("run_id") == run).drop("run_id")
            if rows.join(ids, "file_id", "left_semi").isEmpty():
                continue
            by = ["pii_type"] if table == "pii_detections" else []
            write_run(without(rows, ids), f"{out}/kept/{table}", run, *by)
            replace(spark, f"{out}/{table}/run_id={run}", f"{out}/kept/{table}/run_id={run}")
    remove(spark, f"{out}/kept")
    return runs


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


def delete_events(gone: DataFrame, at: Column, user_id: Column) -> DataFrame:
    details = F.to_json(F.struct(F.col("original_filename").alias("filename")))
    return event_rows(
        gone, "delete", at, user_id, F.col("file_id"), details, identity=F.col("file_id")
    )


def sanitize_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV records with each cell masked by itself: keys, cells, line, detections.

    The records are written first and then dealt over tasks by their number: a file's splits
    are few for the work that its records need.
    """
    records = spread(stage(read_csv_cells(spark, path)), "path", "block", "row_ord")
    return scan_array(records, "cells").select(
        "path", "block", "row_ord", "cells", csv_line(F.col("cells")).alias("line"), "detections"
    )


def sanitize_units(units: DataFrame) -> DataFrame:
    """Scan text units (pages, styled runs) one by one; a value cut in two is not found.

    Blank units hold nothing to find and are kept as they are.
    """
    return scan(units)


def join_units(scanned: DataFrame, kind: str = "page") -> DataFrame:
    """Put the masked units of each document, rows of a table, back together in order.

    Units that are an array in their document's row need no gathering: ``scan_array``.
    """
    parts = F.array_sort(F.collect_list(F.struct("unit_id", "masked_text")))
    return (
        scanned.groupBy("doc_id")
        .agg(parts.alias("parts"), F.sum(F.size("detections")).alias("pii_count"))
        .select(
            "doc_id", joined_units(F.col("parts.masked_text"), kind).alias("masked_text"), "pii_count"
        )
    )
