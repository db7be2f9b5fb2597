"""Exact k-means whose bounds follow the geometry of moved centroids.

Every vector keeps its centroid, an upper bound on the distance to it and a lower bound on
the distance to all others. While the upper one is below the lower one the nearest centroid
cannot have changed, and the vector is not scanned. When centroids move, the upper bound
grows by the own centroid's way. The lower bound would fall by the longest way of another
centroid; it falls by less here. All vectors of a cluster lie in a sphere around its old
centroid, whose radius is their largest upper bound. How much nearer a centroid that moved
from c to c' can have come to any point of that sphere is a question in the plane through c,
c' and the sphere's centre: for a point x at the angle w to the way, seen from the middle of
c and c', |x - c| - |x - c'| is at most |c' - c| cos w. The largest cosine over the sphere,
zero if the sphere lies behind the middle, bounds it for all vectors. What the bounds leave
open is scanned exactly: distances are whole numbers, ties go to the smaller centroid.

A vector's components x become floor(scale * x). Vectors are packed into blocks, rows of a
bucketed table that is written once. The bounds of a round are another table with the same
buckets, so the blocks are joined with them where they lie; what a round shuffles and writes
is 20 bytes a vector and, for each block, the change of its clusters' sums. The driver sees
sums, counts and radii of the clusters, nothing else.

Vectors that are null, have another number of components than ``size``, or hold a null or
non-finite one take no part; nor do those with a component beyond 2^27 / scale, as their
distances would not fit a long. Rows that share an id are vectors of their own; a null id
counts as an empty text where ids are hashed. With fewer vectors than centroids there are as
many centroids as vectors. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import partitions, stage

#: Largest absolute value of a component after scaling.
REACH = 1 << 27
#: Vectors of a block.
BLOCK = 2048
#: Bounds are widened by this share, far more than doubles round off.
_SLACK = 1e-9


def scaled(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vectors: DataFrame, vec_id: str, embedding: str, size: int, scale: int) -> DataFrame:
    """vec_id and v, the whole-number components of the vectors that take part."""
    kept = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("e"))
    e = F.col("e")
    fine = F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) < float(REACH))
    )
    kept = kept.filter(e.isNotNull() & (F.size(e) == size) & fine)
    return kept.select("vec_id", scaled(F.col("e"), scale).alias("v"))


# --- geometry -----------------------------------------------------------------------------


def nearer_by(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """By how much a centroid can come nearer to any point of a sphere on its way old -> new."""
    way = float(np.linalg.norm(new - old))
    if not way:
        return 0.0
    from_middle = centre - (old + new) / 2
    far = float(np.linalg.norm(from_middle))
    if far <= radius:
        return way
    angle = float(np.arccos(np.clip(from_middle @ (new - old) / (far * way), -1, 1)))
    angle = max(0.0, angle - float(np.arcsin(radius / far)))
    return way * max(0.0, float(np.cos(angle))) * (1 + _SLACK) + _SLACK * way


@dataclass
class Move:
    """Centroids before and after a round, and what it does to the bounds of each cluster."""

    new: np.ndarray  # whole numbers
    up: np.ndarray  # the own centroid's way
    down: np.ndarray  # what the lower bounds lose


def movement(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    k = len(new)
    x, y = old.astype(np.float64), new.astype(np.float64)
    down = np.zeros(k)
    for own in range(k):
        down[own] = max((nearer_by(x[own], radius[own], x[j], y[j]) for j in range(k) if j != own), default=0)
    return Move(new, np.linalg.norm(y - x, axis=1) * (1 + _SLACK), down)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        d = v - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, distance to it, distance to the next one (infinite if none)."""
    d = squared(v, centroids)
    own = np.argmin(d, axis=1)
    at = np.arange(len(v))
    near = d[at, own]
    far = np.full(len(v), np.inf)
    if d.shape[1] > 1:
        rest = d.copy()
        rest[at, own] = np.iinfo(np.int64).max
        far = np.sqrt(rest.min(axis=1).astype(np.float64))
    return own, np.sqrt(near.astype(np.float64)), far


def assign(
    v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The next centroid and bounds of each vector, and how many were scanned in full."""
    upper = upper + move.up[own]
    lower = lower - move.down[own]
    open_ = np.flatnonzero(~(upper * (1 + _SLACK) < lower * (1 - _SLACK)))
    own = own.copy()
    if len(open_):  # first the exact distance to the own centroid, then all the others
        d = v[open_] - move.new[own[open_]]
        upper[open_] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64))
        open_ = open_[~(upper[open_] * (1 + _SLACK) < lower[open_] * (1 - _SLACK))]
    if len(open_):
        own[open_], upper[open_], lower[open_] = scan(v[open_], move.new)
    return own, upper, lower, len(open_)


def _sums(v: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Count and componentwise sums of each cluster."""
    out = np.zeros((k, v.shape[1] + 1), dtype=np.int64)
    for j in range(k):
        mine = own == j
        out[j, 0], out[j, 1:] = mine.sum(), v[mine].sum(axis=0)
    return out


# --- tables -------------------------------------------------------------------------------

_BLOCKS = "block bigint, ids array<bigint>, v binary"
_STATE = (
    "block bigint, own binary, upper binary, lower binary, change array<bigint>,"
    " radius array<double>, scanned bigint"
)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            v = part.column(1).flatten().to_numpy().astype("<i4")
            yield pa.record_batch(
                [pa.array([place]), pa.array([part.column(0)], pa.list_(pa.int64())), pa.array([v.tobytes()])],
                names=["block", "ids", "v"],
            )
            place += 1


def _round(move: Move, size: int):
    """Bounds of a round from the blocks and the bounds of the round before (null in the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(move.new)
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["v"], "<i4").astype(np.int64).reshape(-1, size)
                if row["own"] is None:
                    own, upper, lower = scan(v, move.new)
                    change, scanned = _sums(v, own, k), len(v)
                else:
                    before = np.frombuffer(row["own"], "<i4").astype(np.int64)
                    upper, lower = (np.frombuffer(row[c], "<f8") for c in ("upper", "lower"))
                    own, upper, lower, scanned = assign(v, before, upper, lower, move)
                    moved = own != before
                    change = _sums(v[moved], own[moved], k) - _sums(v[moved], before[moved], k)
                radius = [float(upper[own == j].max(initial=0)) for j in range(k)]
                yield pa.record_batch(
                    [
                        pa.array([row["block"]]),
                        pa.array([own.astype("<i4").tobytes()]),
                        pa.array([upper.astype("<f8").tobytes()]),
                        pa.array([lower.astype("<f8").tobytes()]),
                        pa.array([change.ravel()], pa.list_(pa.int64())),
                        pa.array([radius], pa.list_(pa.float64())),
                        pa.array([scanned]),
                    ],
                    names=["block", "own", "upper", "lower", "change", "radius", "scanned"],
                )

    return run


def _final(size: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["v"], "<i4").astype(np.int64).reshape(-1, size)
                own = np.frombuffer(row["own"], "<i4")
                d = v - centroids[own]
                yield pa.record_batch(
                    [pa.array(row["ids"], pa.int64()), pa.array(own), pa.array(np.einsum("ij,ij->i", d, d))],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


class _Tables:
    """Tables of one run, bucketed by block. Those of rounds that are over are dropped."""

    def __init__(self, vectors: DataFrame):
        self.spark, self.buckets = vectors.sparkSession, partitions(vectors.sparkSession)
        self.name = f"centroids_{uuid.uuid4().hex}"
        self.rounds = 0
        self._write(vectors.mapInArrow(_pack, _BLOCKS).repartition(self.buckets, "block"), "blocks")

    def _write(self, df: DataFrame, part: str) -> None:
        writer = df.write.format("parquet").bucketBy(self.buckets, "block").sortBy("block")
        writer.saveAsTable(f"{self.name}_{part}")

    def blocks(self) -> DataFrame:
        """Blocks with the bounds of the last round."""
        blocks = self.spark.table(f"{self.name}_blocks")
        if not self.rounds:
            none = [F.lit(None).cast("binary").alias(c) for c in ("own", "upper", "lower")]
            return blocks.select("block", "ids", "v", *none)
        state = self.state().select("block", "own", "upper", "lower")
        return blocks.hint("merge").join(state.hint("merge"), "block")

    def state(self) -> DataFrame:
        return self.spark.table(f"{self.name}_round{self.rounds}")

    def next(self, move: Move, size: int) -> None:
        done = self.blocks().drop("ids").mapInArrow(_round(move, size), _STATE)
        # mapInArrow forgets the buckets; a row a block and a few bytes a vector go through here.
        self._write(done.repartition(self.buckets, "block"), f"round{self.rounds + 1}")
        if self.rounds:
            self.spark.sql(f"DROP TABLE {self.name}_round{self.rounds}")
        self.rounds += 1

    def changes(self) -> tuple[list[int], list[float], int]:
        """What the last round changed in the sums, the radii, and the vectors scanned in full."""
        state = self.state()
        sums = (
            state.select(F.posexplode("change").alias("at", "x")).groupBy("at")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        )
        radii = state.select(F.posexplode("radius").alias("at", "x")).groupBy("at").agg(F.max("x").alias("x")).collect()
        by_place = {r["at"]: int(r["x"]) for r in sums}
        radius = {r["at"]: r["x"] for r in radii}
        scanned = state.agg(F.sum("scanned")).first()[0] or 0
        return [by_place[i] for i in range(len(by_place))], [radius[i] for i in range(len(radius))], scanned

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}_blocks")
        if self.rounds:
            self.spark.sql(f"DROP TABLE {self.name}_round{self.rounds}")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``<seed>:<vec_id>``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    size: int = 64,
    scale: int = 1024,
    seed: str = "3",
    scanned: list[int] | None = None,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector.

    ``scanned`` takes the number of vectors scanned in full in each round.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding, size, scale)
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame(
            [],
            "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint,"
            " centroid_sha256 string",
        )
    tables = _Tables(rows)
    held = [[0] * (size + 1) for _ in range(k)]
    move = Move(centroids, np.zeros(k), np.zeros(k))
    for turn in range(rounds + 1):
        tables.next(move, size)
        change, radius, open_ = tables.changes()
        if scanned is not None:
            scanned.append(open_)
        if turn == rounds:
            break
        for j in range(k):
            for i in range(size + 1):
                held[j][i] += change[j * (size + 1) + i]
        new = [[s // h[0] for s in h[1:]] if h[0] else centroids[j].tolist() for j, h in enumerate(held)]
        new = np.array(new, dtype=np.int64)
        move = movement(centroids, new, np.array(radius) * (1 + _SLACK))
        centroids = new
    assigned = stage(
        tables.blocks().select("ids", "v", "own")
        .mapInArrow(_final(size, centroids), "vec_id bigint, cluster int, distance bigint")
    )
    tables.drop()
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    inertia = {r.cluster: int(r.d) for r in sums}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = F.array(*(F.lit(inertia.get(j, 0)).cast("bigint") for j in range(k)))
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(of, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.get(F.array(*map(F.lit, digest)), F.col("cluster")).alias("centroid_sha256"),
    )
