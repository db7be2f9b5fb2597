"""Line dedup: ranges of line hashes, sorted by document and position, streamed once.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of
``min_chars`` code points or more that stand in ``min_docs`` documents or more lose all
their lines, except in the largest doc_id that holds them. What comes out is one compressed
keep bitmap per document, not text; ``apply`` turns bitmaps into texts.

Lines are range-partitioned by (hash, document), so that a very common line spreads over
many partitions. Within a partition a run of equal hashes is read with a constant number of
values in memory: from the ``min_docs``-th document of a run on, a line is dropped for
certain; those before it wait for the run's total over all partitions, which a small sum by
hash gives.

A null or empty text is one empty line. Rows with the same id and the same text are one
document; rows with the same id and different texts count as one document when documents
are counted. A null id is a document of its own, below all others. An empty table gives no
rows. Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import fresh, partitions, stage, text_key, whole
from maskwell.session import small_batches

SPACE = b" \t\n\v\f\r"
_LINES = "doc_id bigint, doc_key bigint, n_lines int, line binary, positions array<int>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("doc_key", pa.int64()),
        ("n_lines", pa.int32()),
        ("line", pa.binary()),
        ("positions", pa.list_(pa.int32())),
    ]
)
#: Kinds of rows that the stream returns.
DROPPED, WAITS, TOTAL = 0, 1, 2
_STREAM = (
    "kind int, line binary, doc_id bigint, doc_key bigint, positions array<int>, docs bigint"
)


def line_keys(text: bytes, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the positions of each key that is long enough."""
    lines = text.split(b"\n")
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACE).lower()
            if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                found.setdefault(key, []).append(i)
    return len(lines), found


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            ids, keys, texts = (c for c in batch.columns)
            for doc_id, doc_key, text in zip(ids, keys, texts):
                doc_id, doc_key = doc_id.as_py(), doc_key.as_py()
                n, found = line_keys(text.as_py().encode(), min_chars)
                rows.append((doc_id, doc_key, n, None, None))
                rows.extend(
                    (doc_id, doc_key, None, hashlib.md5(k).digest(), at)
                    for k, at in found.items()
                )
                if len(rows) > 5_000:
                    yield _batch(rows, _ARROW)
                    rows = []
        if rows:
            yield _batch(rows, _ARROW)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.record_batch(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


_STREAM_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("line", pa.binary()),
        ("doc_id", pa.int64()),
        ("doc_key", pa.int64()),
        ("positions", pa.list_(pa.int32())),
        ("docs", pa.int64()),
    ]
)


def _first_occurrences(min_docs: int):
    """Read one sorted partition; see the module's docstring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stream(batches, min_docs)

    return run


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    line = top = doc = last = None
    docs, runs = 0, 0

    def total(runs: int) -> None:
        if line is not None and (docs > 1 or runs == 1):
            out.append((TOTAL, line, top, None, None, docs))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            new_line, new_doc, key, at = row
            if new_line != line:
                total(runs)
                line, top, doc, last, docs = new_line, new_doc, new_doc, None, 1
                runs += 1
            elif new_doc != doc:
                doc, last, docs = new_doc, None, docs + 1
            if key == last:
                continue  # a repeated row
            last = key
            if docs >= min_docs:
                out.append((DROPPED, None, doc, key, at, None))
            elif docs > 1 or runs == 1:
                out.append((WAITS, line, doc, key, at, None))
            if len(out) > 5_000:
                yield _batch(out, _STREAM_ARROW)
                out = []
    total(1)  # the last run may go on in the next partition
    if out:
        yield _batch(out, _STREAM_ARROW)


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def pack(n, gone):
        keep = np.ones(int(n), dtype=bool)
        keep[np.asarray(gone, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([pack(n, g) for n, g in zip(n_lines, dropped)], dtype=object)


def keep_bitmaps(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """doc_id, doc_key, n_lines, n_dropped, keep_bitmap: one row per (id, text).

    ``keep_bitmap`` is zlib over one bit per line, the first line in the highest bit.
    ``min_docs`` is 2 or more.
    """
    if min_docs < 2:
        raise ValueError("min_docs is 2 or more")
    small_batches(docs.sparkSession)
    given = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        text_key(F.col(text)).alias("doc_key"),
        whole(F.col(text)).alias("text"),
    )
    lines = stage(given.mapInArrow(_explode(min_chars), _LINES))
    order = [F.col("line"), F.desc("doc_id")]
    streamed = stage(
        lines.filter(F.col("line").isNotNull())
        .select("line", "doc_id", "doc_key", "positions")
        .repartitionByRange(partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order, "doc_key")
        .mapInArrow(_first_occurrences(min_docs), _STREAM)
    )
    totals = (
        streamed.filter(F.col("kind") == TOTAL)
        .groupBy("line")
        .agg(F.sum("docs").alias("docs"), F.max("doc_id").alias("top"))
        .filter(F.col("docs") >= min_docs)
    )
    waits = streamed.filter(F.col("kind") == WAITS).drop("docs")
    late = waits.join(totals, "line").filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = streamed.filter(F.col("kind") == DROPPED)
    columns = ["doc_id", "doc_key", "positions"]
    dropped = drops.select(columns).unionByName(late.select(columns))
    heads = lines.filter(F.col("n_lines").isNotNull()).select(
        "doc_id", "doc_key", "n_lines", F.lit(None).cast("array<int>").alias("positions")
    )
    gone = F.coalesce(F.flatten(F.collect_list("positions")), F.array().cast("array<int>"))
    return (
        heads.groupBy("doc_id", "doc_key")
        .agg(F.max("n_lines").alias("n_lines"))
        .withColumn("positions", F.lit(None).cast("array<int>"))
        .unionByName(dropped.withColumn("n_lines", F.lit(None).cast("int")))
        .groupBy("doc_id", "doc_key")
        .agg(F.max("n_lines").alias("n_lines"), gone.alias("gone"))
        .select(
            "doc_id",
            "doc_key",
            F.col("n_lines").cast("bigint").alias("n_lines"),
            F.size("gone").cast("bigint").alias("n_dropped"),
            _bitmap("n_lines", "gone").alias("keep_bitmap"),
        )
    )


def kept_text(text: str | None, bitmap: bytes) -> str:
    """The text without the lines whose bit is 0."""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))
    return "\n".join(x for x, b in zip(lines, bits) if b)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series(
        [None if b is None else kept_text(t, b) for t, b in zip(text, bitmap)], dtype=object
    )


def apply(
    docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``; other columns stay.

    Adds n_lines and n_dropped under names not yet taken; they are the last two columns.
    Only texts that lose a line are taken apart.
    """
    key = fresh(docs, "doc_key")
    n, gone, bits, own = (fresh(docs, x) for x in ("n_lines", "n_dropped", "bitmap", "id"))
    keyed = docs.withColumn(key, text_key(F.col(text)))
    marks = bitmaps.select(
        F.col("doc_id").alias(own),
        F.col("doc_key").alias(f"{key}_b"),
        F.col("n_lines").alias(n),
        F.col("n_dropped").alias(gone),
        F.when(F.col("n_dropped") > 0, F.col("keep_bitmap")).alias(bits),
    )
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col(own)) & (F.col(key) == F.col(f"{key}_b"))
    lost = F.when(F.col(bits).isNotNull(), F.col(text))
    return (
        keyed.join(marks, same)
        .withColumn(text, F.coalesce(_kept(lost, F.col(bits)), whole(F.col(text))))
        .select(*docs.columns, n, gone)
    )
