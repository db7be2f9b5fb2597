"""Latest-first slices that stay whole and balanced whatever the key distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def latest_per_key(
    df: DataFrame, key: str, n: int, order: list[Column], spread_by: str, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of each key, with their ``rank`` from 1.

    Rows are first cut to ``n`` per (key, salt), so that a key holding a large part of the
    table is handled by many tasks and the last step sees at most ``salts * n`` rows of it.
    A row among the first ``n`` of its key is also among the first ``n`` of its salt, so
    nothing is lost.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    by_salt = Window.partitionBy(key, "_salt").orderBy(*order)
    by_key = Window.partitionBy(key).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(by_salt))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
        .withColumn("rank", F.row_number().over(by_key))
        .filter(F.col("rank") <= n)
    )


def null_salted(df: DataFrame, key: str, name: str = "_salt") -> DataFrame:
    """Add a column that spreads the rows without a key, to be joined on beside it.

    It is 0 where there is a key, so that the other side joins with a 0. Rows without a key
    match nothing; with their salts they are dealt over all tasks, not to a single one.
    """
    plain = [f.name for f in df.schema if "map" not in f.dataType.simpleString()]
    spread = F.when(F.col(key).isNotNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*plain))
    return df.withColumn(name, spread)


def left_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Left or left anti join on a key that may be null in many rows."""
    # A literal 0 would be taken out of the join's keys again.
    keyed = table.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1).cast("bigint")))
    return null_salted(rows, key).join(keyed, [key, "_salt"], how).drop("_salt")


def look_up(rows: DataFrame, table: DataFrame, key: str, *columns: str) -> DataFrame:
    """Left-join columns of a large keyed table to rows whose number has a known bound.

    ``rows`` must come from a limit, and ``key`` must be unique in ``table``. The wanted
    keys are sent to the table, not the table to the rows, so neither side is shuffled, and
    what is broadcast never outgrows the limit.
    """
    wanted = rows.select(key).dropna().distinct()
    hits = table.select(key, *columns).join(F.broadcast(wanted), key, "left_semi")
    return rows.join(F.broadcast(hits), key, "left")
