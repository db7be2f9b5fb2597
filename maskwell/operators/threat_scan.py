"""Hostile-content scan of files: digests, findings, and the gate that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.functions.keys import extension
from maskwell.functions.text import computed_once, decode_utf8
from maskwell.functions.threats import malicious_content


def hashes(content: Column) -> Column:
    return F.struct(
        F.md5(content).alias("md5"),
        F.sha1(content).alias("sha1"),
        F.sha2(content, 256).alias("sha256"),
    )


def security_scan(
    df: DataFrame, as_of: Column, content: str = "content", filename: str = "filename"
) -> DataFrame:
    """Add ``security``: verdict, size, digests, findings and scan time of each file."""
    body, name = F.col(content), F.col(filename)
    found = malicious_content(decode_utf8(body), extension(name))
    return computed_once(df, "_found", found).withColumn(
        "security",
        F.struct(
            F.col("_found.safe").alias("safe"),
            name.alias("filename"),
            F.octet_length(body).cast("bigint").alias("file_size"),
            hashes(body).alias("hashes"),
            F.col("_found").alias("malicious_content"),
            as_of.alias("scanned_at"),
        ),
    ).drop("_found")


def split_by_verdict(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(safe files, blocked files) of a frame with a ``security`` column."""
    return scanned.filter("security.safe"), scanned.filter("NOT security.safe")


def blocked_details(security: Column) -> Column:
    """Details text of the event written for a blocked file."""
    return F.to_json(
        F.struct(
            security["filename"].alias("filename"),
            security["malicious_content"]["threats"].alias("threats"),
            security["hashes"]["sha256"].alias("sha256"),
        )
    )
