"""Helpers shared by the operators: staging, fresh column names, folds, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.session import shared_folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks it was running, and
    columns that depend on the partitioning are fixed once they are written.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key held by more than one row in so many is joined by broadcast: there are at most so
#: many of that kind, however large the table is.
HOT_ONE_IN = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join with a written ``table`` that has one row a key and its ``count`` in ``rows``.

    Rows of very frequent keys are not shuffled to one task: their few keys go to the rows.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_ONE_IN > total
    hot = F.broadcast(table.filter(is_hot))
    few = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(few.join(table.filter(~is_hot), key))


def partitions(spark: SparkSession) -> int:
    """The number of partitions for explicit range or hash shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that does not occur in ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def whole(text: Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(text, F.lit(""))


def text_key(text: Column) -> Column:
    """A number that tells apart rows which share an id but not their text."""
    return F.xxhash64(whole(text))


# --- word hashes --------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)])


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` bytes."""
    if not _TABLES or len(_TABLES[0]) <= n:
        n = max(n, _PIECE + 4096)
        _TABLES[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    return _TABLES


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (longest run without white space), A-Z lower-cased.

    All words at once: a word's polynomial hash is the difference of two prefix sums,
    scaled back by the inverse power of the base.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    starts, ends = edges[::2], edges[1::2]
    lower = b.astype(np.uint64) + np.uint64(1)
    lower[(b >= 65) & (b <= 90)] += np.uint64(32)
    power, inverse = _tables(len(b))
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(lower * power[: len(b)])]
        h = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mix(h)


def pieces(text: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """The text cut at white space into pieces of about ``size`` bytes."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cuts = [x for x in (text.find(c, end) for c in (b" ", b"\n", b"\t")) if x >= 0]
            end = min(cuts, default=len(text))
        yield text[at:end]
        at = end


def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, hash) of every word, in chunks that hold whole texts.

    Short texts share a chunk. A text longer than a piece is hashed piece by piece and has
    a chunk of its own, so memory follows the longest single text, eight bytes a word.
    """
    held: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        starts, h = word_hashes(b"\n".join(texts[i] for i in held))
        begins = np.cumsum([0, *(len(texts[i]) + 1 for i in held[:-1])])
        return np.asarray(held)[np.searchsorted(begins, starts, side="right") - 1], h

    for i, text in enumerate(texts):
        if len(text) > _PIECE:
            h = np.concatenate([word_hashes(p)[1] for p in pieces(text)])
            yield np.full(len(h), i), h
            continue
        if size + len(text) > _PIECE and held:
            yield together()
            held, size = [], 0
        held.append(i)
        size += len(text) + 1
    if held:
        yield together()
