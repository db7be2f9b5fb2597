"""Exact dedup against a persistent digest index.

The index has one row per distinct text: its SHA-256 and the row that stays. It is a
Parquet table bucketed and sorted by digest, so new digests meet it in a sort-merge
anti-join that does not shuffle the index. New digests are appended.

Null texts count as empty. Rows with the same text and the same id are one group of
repeated rows; one of them stays. An empty table gives an empty index and no rows. Only the
id and the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import partitions, stage, whole
from maskwell.session import shared_folder

#: A digest held by more than one row in so many is joined by broadcast: there are at most
#: so many digests of that kind, however large the table is.
HOT_ONE_IN = 1000


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (tells repeated rows apart) and the 32-byte digest of the text."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(whole(F.col(text)), 256)).alias("digest"),
    )


class DigestIndex:
    """The index in ``folder``; opening it again finds what was added before."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = f"digest_index_{hashlib.md5(folder.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT,"
            f" keep_row BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest)"
            f" INTO {buckets} BUCKETS LOCATION '{folder}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` that the index lacks, each with its largest id.

        Repeating a batch adds nothing, so a failed job can simply be run again.
        """
        top = F.max(F.struct("doc_id", "row")).alias("top")
        winners = batch.groupBy("digest").agg(top)
        new = winners.join(self.rows().hint("merge"), "digest", "left_anti").select(
            "digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row")
        )
        new = stage(new)  # the table is not appended to while it is read
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """Add keep_id, keep_row and group_size (over ``rows``) to every row."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        groups = stage(sizes.join(self.rows().hint("merge"), "digest"))
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        is_hot = F.col("group_size") * HOT_ONE_IN > total
        hot = F.broadcast(groups.filter(is_hot))
        few = rows.join(hot.select("digest"), "digest", "left_anti")
        return rows.join(hot, "digest").unionByName(few.join(groups.filter(~is_hot), "digest"))


def deduplicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. The index keeps the first it meets, so
    the upper half of the ids goes in before the lower half. Without a folder the index is a
    new one in the shared folder, with as many buckets as shuffles have partitions.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, folder or shared_folder(spark), buckets or partitions(spark))
    rows = stage(digests(docs, doc_id, text))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        middle = (low + high) // 2
        index.add(rows.filter(F.col("doc_id") > middle))
        index.add(rows.filter((F.col("doc_id") <= middle) | F.col("doc_id").isNull()))
    else:
        index.add(rows)
    return index.resolve(rows).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
