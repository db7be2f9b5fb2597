"""Reads, filters and reports over the ``files`` and ``users`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions import rules
from maskwell.functions.threats import THREAT_TYPES


# --- reads -----------------------------------------------------------------------------


def active_user(users: DataFrame, username: str) -> DataFrame:
    return users.filter((F.col("username") == username) & F.col("is_active")).limit(1)


def all_users(users: DataFrame) -> DataFrame:
    """All users, newest first, without any credential column."""
    return users.select(
        "user_id", "username", "email", "role", "created_at", "is_active"
    ).orderBy(F.desc("created_at"), "user_id")


def file_by_id(files: DataFrame, file_id) -> DataFrame:
    return files.filter(F.col("file_id") == file_id)


def detections_of(detections: DataFrame, file_id) -> DataFrame:
    return detections.filter(F.col("file_id") == file_id).orderBy("pii_type", "ord")


def detections_table(detections: DataFrame, with_original: bool) -> DataFrame:
    """Detections under their display names; the original values only where allowed."""
    columns = {"pii_type": "Type", "original_value": "Original", "masked_value": "Masked As",
               "detection_method": "Method"}
    if not with_original:
        del columns["original_value"]
    return detections.select(*[F.col(c).alias(name) for c, name in columns.items()])


def with_uploader(
    files: DataFrame, users: DataFrame, missing: str | None = None
) -> DataFrame:
    """Add ``uploader``. Files of an unknown user keep ``missing`` there.

    No broadcast is forced: Spark does that itself while the user table is small, and
    adaptive execution splits the partitions of an uploader with very many files.
    """
    names = users.select(
        F.col("user_id").alias("uploaded_by"), F.col("username").alias("uploader")
    )
    joined = files.join(names, "uploaded_by", "left")
    return joined if missing is None else joined.fillna({"uploader": missing})


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("upload_time"), "file_id")


def visible_to(files: DataFrame, user_id, is_admin: bool) -> DataFrame:
    """Admins see every file, others their own."""
    return files if is_admin else files.filter(F.col("uploaded_by") == user_id)


def with_status(files: DataFrame, status: str) -> DataFrame:
    return files.filter(F.col("status") == status)


def search(
    files: DataFrame,
    name: str = "",
    file_type: str | None = None,
    band: str | None = None,
    date_range: str | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Files that pass every filter that is set."""
    if name:
        files = files.filter(
            F.contains(F.lower("original_filename"), F.lower(F.lit(name)))
        )
    if file_type:
        files = files.filter(F.lower("file_type") == file_type)
    if date_range:
        files = files.filter(rules.since(F.col("upload_time"), date_range, as_of))
    if band:  # last, as the count may still have to be computed
        files = files.filter(rules.in_band(F.col("pii_count"), band))
    return files


def uploads_per_range(files: DataFrame, as_of: Column) -> DataFrame:
    """Uploads in each of the date ranges, all counted in one pass."""
    counts = [
        F.struct(
            F.lit(name).alias("date_range"),
            F.count_if(rules.since(F.col("upload_time"), name, as_of)).alias("n"),
        )
        for name in rules.DATE_RANGES
    ]
    return files.agg(F.array(*counts).alias("ranges")).select(F.inline("ranges"))


def options(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Sorted distinct values of a column, without null."""
    return df.select(column.alias(name)).dropna().distinct().orderBy(name)


def shown_of_total(files: DataFrame, passes: Column) -> DataFrame:
    return files.agg(
        F.count_if(passes).cast("bigint").alias("shown"), F.count(F.lit(1)).alias("total")
    )


# --- reports ---------------------------------------------------------------------------


def _overview() -> list[Column]:
    done = F.col("status") == "done"
    return [
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(done).cast("bigint").alias("sanitized"),
        F.sum(F.when(done, F.coalesce("pii_count", F.lit(0))).otherwise(0))
        .cast("bigint")
        .alias("pii_items"),
        F.count_if(F.col("status") == "processing").cast("bigint").alias("processing"),
    ]


def overview(files: DataFrame) -> DataFrame:
    return files.agg(*_overview()).fillna(0, ["pii_items"])


def overview_by_user(files: DataFrame) -> DataFrame:
    return files.groupBy("uploaded_by").agg(*_overview())


def totals_by_type(files: DataFrame, with_threats: bool = False) -> DataFrame:
    """Detections per type over the finished files."""
    entries = with_status(files, "done").select(
        F.explode_outer("pii_summary").alias("pii_type", "n")
    ).filter("pii_type IS NOT NULL")
    if not with_threats:
        entries = entries.filter(~rules.is_threat(F.col("pii_type")))
    return (
        entries.groupBy("pii_type")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("pii_count"))
        .orderBy(F.desc("pii_count"), "pii_type")
    )


def heatmap(files: DataFrame, file_types: Sequence[str]) -> DataFrame:
    """Detections per type (rows) and upper-cased file type (columns); 0 where none."""
    entries = (
        with_status(files, "done")
        .select(
            F.upper("file_type").alias("ft"),
            F.explode_outer("pii_summary").alias("pii_type", "n"),
        )
        .filter(F.col("pii_type").isNotNull() & ~rules.is_threat(F.col("pii_type")))
    )
    return (
        entries.groupBy("pii_type")
        .pivot("ft", list(file_types))
        .agg(F.sum(F.coalesce("n", F.lit(0))))
        .fillna(0)
    )


def _total_of(summary: Column) -> Column:
    kept = F.map_filter(summary, lambda k, v: ~k.isin(*THREAT_TYPES))
    total = F.aggregate(
        F.map_values(kept), F.lit(0).cast("bigint"), lambda a, n: a + F.coalesce(n, F.lit(0))
    )
    return F.coalesce(total, F.lit(0))


def file_type_share(files: DataFrame) -> DataFrame:
    """Total per file type, its percent of the largest total, and whether it is the riskiest.

    Among file types with the same total the first by name is the riskiest.
    """
    totals = (
        with_status(files, "done")
        .groupBy(F.upper("file_type").alias("file_type"))
        .agg(F.sum(_total_of(F.col("pii_summary"))).alias("total"))
    )
    # A row a file type by now, so all of them are one sorted array.
    order = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("below"), "file_type")))
    top = F.get("types", F.lit(0))
    return (
        totals.agg(order.alias("types"))
        .select(top.alias("top"), F.posexplode("types").alias("place", "t"))
        .select(
            "t.file_type",
            (-F.col("t.below")).alias("total"),
            rules.share_percent(-F.col("t.below"), -F.col("top.below")).alias("share_pct"),
            (F.col("place") == 0).alias("riskiest"),
            "place",
        )
        .orderBy("place")
        .drop("place")
    )


def upload_timeline(files: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Uploads per day over the last ``days`` days; days without any are there with 0."""
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    first, last = F.to_date(cutoff), F.to_date(as_of)
    per_day = (
        files.filter((F.col("upload_time") >= cutoff) & (F.to_date("upload_time") <= last))
        .groupBy(F.to_date("upload_time").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    calendar = files.sparkSession.range(1).select(
        F.explode(F.sequence(first, last)).alias("day")
    )
    return (
        calendar.join(per_day, "day", "left")
        .select(
            F.date_format("day", "yyyy-MM-dd").alias("day"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("uploads"),
        )
        .orderBy("day")
    )


def with_risk(files: DataFrame) -> DataFrame:
    """Add ``risk``, ``has_threat`` and ``threats`` from the summary."""
    summary = F.col("pii_summary")
    return files.withColumns(
        {
            "risk": rules.risk_level(summary),
            "has_threat": rules.has_threat(summary),
            "threats": rules.threats_in(summary),
        }
    )


def recent(files: DataFrame, n: int = 8) -> DataFrame:
    return with_risk(newest_first(files).limit(n))


def user_files_table(files: DataFrame, user_id) -> DataFrame:
    """One user's files under their display names."""
    own = newest_first(visible_to(files, user_id, False))
    return own.select(
        F.col("original_filename").alias("Filename"),
        F.col("file_type").alias("Type"),
        F.col("pii_count").alias("PII Count"),
        F.col("status").alias("Status"),
        F.date_format("upload_time", "yyyy-MM-dd HH:mm").alias("Uploaded At"),
    )


def export_filtered(files: DataFrame, sanitized: DataFrame) -> DataFrame:
    """Sanitized texts of the given files under their export names.

    Files without a sanitized key or text are skipped.
    """
    return (
        files.filter(F.col("sanitized_key").isNotNull())
        .join(sanitized.select("file_id", "masked_text"), "file_id")
        .filter(F.col("masked_text").isNotNull())
        .select(
            "file_id",
            "file_type",
            F.concat(F.lit("sanitized_"), "original_filename").alias("export_name"),
            "masked_text",
        )
    )
