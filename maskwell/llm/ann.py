"""Approximate nearest neighbours by inner product on shifted Hilbert curves.

Vectors are centred, rotated at random and cut to groups of ``dims`` coordinates; each group,
with a random shift of its grid, gives one Hilbert ordering of all rows. An ordering is
range-partitioned and sorted in Spark, and every row gets its rank along the curve. A query
takes the ``window`` share of the rows around its own rank in each ordering. Ranks fall into
slices of at most ``slice_rows`` rows, which bounds what a task holds; a window is all slices
that it touches. What the orderings find is merged and reranked by the exact inner product.

``window`` is a share of the table, fitted by ``fit`` on a bounded sample: the smallest one
whose recall against brute force reaches the goal. Clustered vectors need a small share.
Vectors without structure (all directions alike in 64 dimensions) have no near neighbours to
speak of and need large ones; no curve can help there.

Vectors that are null, zero, or hold null or non-finite components take no part, neither as
candidates nor as queries. Rows that share an id are single candidates each; ties go to the
smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import partitions, stage

BITS = 8


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (a row each)."""
    x = grid.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of each level, the highest bit first
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Projections, grids and shifts of all orderings, and the fitted window."""

    mean: np.ndarray
    axes: np.ndarray  # orderings x size x dims
    low: np.ndarray  # of the grid, orderings x dims
    step: np.ndarray
    window: float

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Curve position of each row in each ordering."""
        out = np.empty((len(self.axes), len(x)), dtype=np.int64)
        for k, axes in enumerate(self.axes):
            cell = np.floor(((x - self.mean) @ axes - self.low[k]) / self.step[k])
            out[k] = hilbert(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64))
        return out


def _recall(curves: Curves, x: np.ndarray, queries: np.ndarray, k: int, share: float) -> float:
    ranks = np.argsort(np.argsort(curves.keys(x), axis=1, kind="stable"), axis=1)
    reach = share * len(x) / 2
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    found = 0
    for q, near in zip(queries, best):
        mine = np.clip(ranks[:, q], reach, len(x) - reach)
        found += (np.abs(ranks[:, near] - mine[:, None]) <= reach).any(axis=0).sum()
    return found / (len(queries) * k)


def fit_local(
    x: np.ndarray, orderings: int, dims: int, goal: float, k: int, seed: int, probes: int = 200
) -> Curves:
    rng = np.random.default_rng(seed)
    size = x.shape[1]
    dims = min(dims, size)
    axes = np.empty((orderings, size, dims))
    pool: list[np.ndarray] = []
    for o in range(orderings):
        if len(pool) < dims:  # a new rotation gives size // dims orderings
            pool = list(np.linalg.qr(rng.normal(size=(size, size)))[0].T)
        axes[o] = np.array([pool.pop() for _ in range(dims)]).T
    mean = x.mean(axis=0)
    flat = np.einsum("nd,odk->onk", x - mean, axes)
    spread = np.maximum(np.abs(flat).max(axis=1), 1e-9)
    step = 3.0 * spread / (1 << BITS)  # room for a shift of a quarter of the grid either way
    low = -1.5 * spread + rng.uniform(-0.4, 0.4, size=spread.shape) * spread
    curves = Curves(mean, axes, low, step, 1.0)
    if len(x) > 10 * k:
        queries = rng.choice(len(x), min(probes, len(x)), replace=False)
        for share in (0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7):
            if _recall(curves, x, queries, k, share) >= goal:
                curves.window = share
                break
    return curves


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v of the vectors that take part; v keeps its type, sums are in doubles.

    Of vectors of several lengths those of the most frequent length take part (ties: the
    shorter one): there is no inner product between lengths.
    """
    v = F.col(embedding)
    fine = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(v, lambda x: x != 0)
    fit_for_use = vectors.filter(v.isNotNull() & fine)
    sizes = fit_for_use.groupBy(F.size(v).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), "size").first()
    kept = fit_for_use if usual is None else fit_for_use.filter(F.size(v) == usual["size"])
    return kept.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))


def fit(
    rows: DataFrame,
    orderings: int = 16,
    dims: int = 4,
    goal: float = 0.95,
    k: int = 20,
    sample: int = 8000,
    seed: int = 7,
) -> Curves | None:
    """Fit on about ``sample`` rows, those with the smallest hash of the id."""
    n = rows.count()
    draw = F.xxhash64("vec_id", F.lit(seed))
    part = rows if n <= sample else rows.filter(F.abs(draw % 1_000_000) < 1_000_000 * sample // n)
    got = part.orderBy(draw).select("v").limit(sample).toPandas()["v"]
    if not len(got):
        return None
    return fit_local(np.vstack(got.to_list()).astype(np.float64), orderings, dims, goal, k, seed)


def _array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def ranked(rows: DataFrame, curves: Curves) -> DataFrame:
    """ordering, rank along it, vec_id and v: every row once for each ordering."""
    schema = T.StructType(
        [
            T.StructField("ordering", T.IntegerType()),
            T.StructField("key", T.LongType()),
            T.StructField("vec_id", T.LongType()),
            T.StructField("v", rows.schema["v"].dataType),
        ]
    )

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            for o, keys in enumerate(curves.keys(_array(v)) if len(v) else []):
                yield pa.record_batch(
                    [pa.array(np.full(len(v), o, np.int32)), pa.array(keys), ids, v],
                    names=["ordering", "key", "vec_id", "v"],
                )

    order = ["ordering", "key", "vec_id"]
    placed = stage(
        rows.select("vec_id", "v")
        .mapInArrow(explode, schema)
        .repartitionByRange(partitions(rows.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select(
            "ordering",
            "vec_id",
            "v",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    # At most a row per partition and ordering.
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy("ordering", "part")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .select(
            "ordering", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
        )
    )
    rank = F.col("place") - F.col("first") + F.col("before")
    return placed.join(F.broadcast(runs), ["ordering", "part"]).select(
        "ordering", rank.alias("rank"), "vec_id", "v"
    )


def top_k(score: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int):
    """The k best candidates of one query, by exact score, then by id."""
    least = np.partition(score, -k)[-k] if len(score) > k else -np.inf
    # A block's sums round off in proportion to the vectors' lengths.
    slack = 1e-9 * max(1.0, float(np.sqrt((q * q).sum() * (x * x).sum(axis=1).max(initial=0))))
    near = np.flatnonzero((score >= least - slack) & (score > -np.inf))
    exact = (x[near] * q).sum(axis=1)  # the same sum for a pair in whatever block it is met
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near][order], exact[order]


def search(
    rows: DataFrame, queries: DataFrame, curves: Curves | None, k: int = 20, slice_rows: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each query (ids of ``rows``)."""
    spark = rows.sparkSession
    if curves is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = rows.count()
    slices = max(1, -(-n // slice_rows))
    place = stage(ranked(rows, curves))
    slice_of = F.floor(F.col("rank") * slices / n).cast("int")
    candidates = place.select("ordering", slice_of.alias("slice"), "vec_id", "v")
    reach = curves.window * n / 2
    centre = F.least(F.greatest(F.col("rank").cast("double"), F.lit(reach)), F.lit(max(n - 1 - reach, reach)))
    edge = lambda x: F.least(F.greatest(F.floor(x * slices / n), F.lit(0)), F.lit(slices - 1)).cast("int")
    asked = (
        place.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
        .withColumn("part", F.explode(F.sequence(edge(centre - reach), edge(centre + reach))))
        .select(F.col("ordering").alias("curve"), "part", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    )
    met = T.StructType.fromDDL("query_id bigint, ids array<bigint>, scores array<double>")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """All queries of a slice, in blocks, against its candidates."""
        left, right = left.combine_chunks(), right.combine_chunks()
        ids, x = left.column("vec_id").to_numpy(), _array(left.column("v"))
        own, q = right.column("query_id").to_numpy(), _array(right.column("q"))
        got = []
        for at in range(0, len(own) if len(ids) else 0, 256):
            score = q[at : at + 256] @ x.T
            score[own[at : at + 256, None] == ids[None, :]] = -np.inf
            got.extend(top_k(s, ids, x, y, k) for s, y in zip(score, q[at : at + 256]))
        return pa.table(
            {
                "query_id": own[: len(got)],
                "ids": pa.array([g[0] for g in got], pa.list_(pa.int64())),
                "scores": pa.array([g[1] for g in got], pa.list_(pa.float64())),
            }
        )

    found = (
        candidates.groupBy("ordering", "slice")
        .cogroup(asked.groupBy("curve", "part"))
        .applyInArrow(meet, met)
    )
    final = "query_id bigint, rank int, vec_id bigint, score double"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, scores = np.concatenate(pdf["ids"].to_list()), np.concatenate(pdf["scores"].to_list())
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, -scores[first]))[:k]
        return pd.DataFrame(
            {
                "query_id": pdf["query_id"].iloc[0],
                "rank": np.arange(1, len(order) + 1, dtype=np.int32),
                "vec_id": ids[order],
                "score": scores[first][order],
            }
        )

    return found.groupBy("query_id").applyInPandas(merge, final)
