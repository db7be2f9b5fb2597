"""The scan of single huge texts, each over many tasks.

A text is cut at places that no detection can lie across, and that look the same to every
pattern's look-around: behind a line end with one of ``APART`` before or after it. These
characters are in no pattern but the tail of an address, and that tail ends at a line end; no
pattern begins or ends with white space. So the detections of the pieces, put in order again,
are those of the text. Masking needs the whole text, as a mask goes to the first place where
its value stands; it is linear and done in the row of the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions.detectors import CONTEXTUAL, STRUCTURED, Detector
from maskwell.operators.scan import apply_masks, hits, no_detections

#: Characters that no detected value holds, but for the tail of an address.
APART = "!\"#$&'*;<=>?[\\]^`{|}~"
_PLACE = re.compile(rf"(?<=[{re.escape(APART)}])\n|\n(?=[{re.escape(APART)}])")
PIECE = 1 << 20


def cut(text: str, size: int = PIECE) -> list[str]:
    """Pieces of ``size`` characters or a little more; longer where no safe place follows."""
    out, start = [], 0
    while len(text) - start > size:
        place = _PLACE.search(text, start + size - 1)
        if not place:
            break
        out.append(text[start : place.end()])
        start = place.end()
    out.append(text[start:])
    return out


def _cutter(size: int):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        found = [None if t is None else cut(t, size) for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.string()))

    return run


def _found(df: DataFrame, key: str, text: str, detectors: Sequence[Detector], size: int) -> DataFrame:
    """key and the detections of each text that has any, found piece by piece."""
    pieces = df.select(key, F.posexplode(_cutter(size)(F.col(text))).alias("piece_no", "piece"))
    # One text's pieces lie in one partition until here.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.repartition(n, key, "piece_no")
    found = pieces.select(key, "piece_no", F.explode_outer(hits(F.array("piece"), detectors)).alias("f"))
    rows = found.select(key, "piece_no", F.posexplode("f").alias("ord", "d"))
    numbers = F.array(*[F.lit(d.name) for d in detectors])
    place = F.struct(F.array_position(numbers, F.col("d.pii_type")).alias("type"), "piece_no", "ord", "d")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(place))["d"].alias("found"))


def _step(df: DataFrame, key: str, text: str, detectors, size: int, found: str, masked: str) -> DataFrame:
    of = _found(df, key, text, detectors, size).withColumnRenamed("found", found)
    # By sort and merge: both sides grow with the texts, and what is estimated of them from
    # their files tells little of that.
    rows = df.join(of.hint("merge"), key, "left").withColumn(found, F.coalesce(found, no_detections()))
    texts: Column = apply_masks(df, F.array(text), F.array(found))
    return rows.withColumn(masked, F.get(texts, F.lit(0)))


def scan_split(df: DataFrame, key: str, text: str = "text", size: int = PIECE) -> DataFrame:
    """``scan`` for texts too long for one task; ``key`` is unique and not null.

    Texts are shuffled for it, so tables of ordinary texts are better off with ``scan``.
    """
    first = _step(df, key, text, STRUCTURED, size, "__first", "__text")
    second = _step(first, key, "__text", CONTEXTUAL, size, "__second", "__masked")
    return second.select(
        *df.columns,
        F.concat("__first", "__second").alias("detections"),
        F.col("__masked").alias("masked_text"),
    )
