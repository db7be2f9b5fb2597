"""SimHash near duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half the XXH64 values of
the text's three-word shingles. Two fingerprints link if ``limit`` bits or fewer differ.

The 64 bits are grouped into ``parts`` partitions so that correlated bits lie together. If
two fingerprints differ in at most ``limit`` bits, then for any whole thresholds t_1, ...
with t_1 + ... = limit - parts + 1 there is a partition p in which they differ in at most
t_p bits (-1 leaves a partition out). Each fingerprint picks its own thresholds: a dynamic
programme over the partitions takes those with the fewest expected candidates, which the
counts of all values of each partition give. It then probes the values within t_p bits of
its own in each partition; what it meets is verified on all 64 bits.

A partition's value is a bucket. Buckets of more than ``bucket_rows`` rows are taken apart:
members and probes of a bucket are near each other in the bits that the bucket does not fix,
so pigeonhole holds on these again. A bucket that fixes all but 12 bits or fewer has at most
2^12 members, as fingerprints are distinct, so this ends; no bucket or partner list is
capped. A bucket gives out a spanning forest of its links, fewer rows than it has members.

Null and empty texts, and texts of white space, have the fingerprint zero, linked like any
other. Rows that share an id count as rows of their own; a null id is not the smallest id of
anything, and a component of nulls only has none. An empty table gives no rows. Only the id
and the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import join_hot, partitions, stage, whole
from maskwell.llm.prob_minhash import components

SHINGLE = 3
SEED = 42
LIMIT = 3
#: Shingles that are hashed and counted at a time.
_CHUNK = 1 << 16
#: What a probed value costs beside a candidate, in the thresholds' choice.
_PROBE = 4.0
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The 64 bits of a text. Memory follows the words of the text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        return _hash(b" ".join(words))
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    n = len(words) - size + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter(map(_hash, runs), np.dtype("<u8"), min(_CHUNK, n - at))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * ones > n, bitorder="little")
    return int(over.view("<u8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
        yield pa.record_batch(
            [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"]
        )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row."""
    given = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(F.col(text)).alias("text"))
    return given.mapInArrow(_sign, "doc_id bigint, fingerprint bigint")


# --- partitions and thresholds ------------------------------------------------------------


def take(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, put together; the first one is the lowest."""
    out = np.zeros(len(values), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), dtype=np.float64)
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        x = bits.astype(np.float64)
        total += x.T @ x
    yield pa.record_batch(
        [pa.array(np.arange(4096)), pa.array(total.ravel().astype(np.int64))], names=["pair", "n"]
    )


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of equal width; each grows by the bit most correlated with its own."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(near, 0)
    left = list(range(64))
    out = []
    for p in range(parts):
        width = len(left) // (parts - p)
        own = near[np.ix_(left, left)]
        first = left[int(np.argmax(own.max(axis=1)))]
        mine = [first]
        left.remove(first)
        while len(mine) < width:
            best = left[int(np.argmax(near[np.ix_(left, mine)].sum(axis=1)))]
            mine.append(best)
            left.remove(best)
        out.append(sorted(mine))
    return out


def within(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """Row t: how many members have a value within t bits of each value."""
    flips = np.arange(len(counts))[:, None] ^ (1 << np.arange(width))[None, :]
    shells = [counts.astype(np.float64)]
    for t in range(1, most + 1):
        step = shells[-1][flips].sum(axis=1)
        if t > 1:  # flipping back one of t - 1 bits leads inwards
            step -= (width - t + 2) * shells[-2]
        shells.append(step / t)
    return np.cumsum(np.stack(shells), axis=0)


@dataclass
class Plan:
    """Partitions of the bits, and per partition the candidates of each value and threshold.

    The tables have ``limit`` + 1 times 2^width numbers a partition, whatever the data.
    """

    bits: list[list[int]]
    tables: list[np.ndarray]
    limit: int

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each value, a column for each partition."""
        options = range(-1, self.limit + 1)
        goal = self.limit - len(self.bits) + 1
        low, high = -len(self.bits), self.limit * len(self.bits)
        best = {0: np.zeros(len(values))}
        chosen: list[dict[int, np.ndarray]] = []
        for bits, table in zip(self.bits, self.tables):
            own = take(values, bits)
            cost = {-1: np.zeros(len(values))}
            probes = 1.0
            for t in range(self.limit + 1):
                cost[t] = table[t][own] + _PROBE * probes
                probes += float(np.prod([(len(bits) - k) / (k + 1) for k in range(t + 1)]))
            new: dict[int, np.ndarray] = {}
            how: dict[int, np.ndarray] = {}
            for total, so_far in best.items():
                for t in options:
                    at = total + t
                    if not low <= at <= high:
                        continue
                    here = so_far + cost[t]
                    if at not in new:
                        new[at], how[at] = here, np.full(len(values), t)
                    else:
                        how[at] = np.where(here < new[at], t, how[at])
                        new[at] = np.minimum(here, new[at])
            best = new
            chosen.append(how)
        out = np.empty((len(values), len(self.bits)), dtype=np.int64)
        total = np.full(len(values), goal)
        for p in range(len(self.bits) - 1, -1, -1):
            for at, how in chosen[p].items():
                here = total == at
                out[here, p] = how[here]
            total = total - out[:, p]
        return out


def _masks(width: int, most: int) -> list[np.ndarray]:
    """The values with exactly t bits, for t up to ``most``."""
    out = [np.zeros(1, dtype=np.int64)]
    for _ in range(most):
        wider = (out[-1][:, None] | (1 << np.arange(width))[None, :]).ravel()
        wider = np.unique(wider[np.bitwise_count(wider) == len(out)])
        out.append(wider)
    return out


def plan(nodes: DataFrame, parts: int = 4, limit: int = LIMIT) -> Plan:
    """Grouping and counts over all fingerprints; 4,096 and parts x 2^(64 / parts) numbers."""
    pairs = nodes.select("node").mapInArrow(_pair_counts, "pair bigint, n bigint")
    both = np.zeros(4096)
    for row in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        both[row.pair] = row.n
    n = nodes.count()
    bits = group_bits(both.reshape(64, 64), n, parts)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            for p, own in enumerate(bits):
                value, many = np.unique(take(v, own), return_counts=True)
                yield pa.record_batch(
                    [pa.array(np.full(len(value), p, np.int32)), pa.array(value), pa.array(many)],
                    names=["part", "value", "n"],
                )

    counted = nodes.select("node").mapInArrow(values, "part int, value bigint, n bigint")
    got = counted.groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for p, own in enumerate(bits):
        counts = np.zeros(1 << len(own))
        mine = got[got["part"] == p]
        counts[mine["value"].to_numpy(np.int64)] = mine["n"].to_numpy(np.float64)
        tables.append(within(counts, len(own), limit))
    return Plan(bits, tables, limit)


# --- buckets ------------------------------------------------------------------------------

#: fixed: the bits that a bucket fixes; asks: 1 for a probe, 0 for a member.
_ROWS = "bucket bigint, fixed bigint, asks int, node bigint"


def _rows(bucket: np.ndarray, fixed: np.ndarray | int, asks: int, node: np.ndarray) -> pa.RecordBatch:
    n = len(node)
    return pa.record_batch(
        [
            pa.array(bucket.view(np.int64)),
            pa.array(np.broadcast_to(np.asarray(fixed, np.uint64), n).copy().view(np.int64)),
            pa.array(np.full(n, asks, np.int32)),
            pa.array(node.view(np.int64)),
        ],
        names=["bucket", "fixed", "asks", "node"],
    )


def _name(*words: np.ndarray | int) -> np.ndarray:
    """One 64-bit name of a few numbers. Names that clash by chance only share a bucket."""
    out = np.zeros(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            out = (out ^ np.asarray(w).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out = out * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return out


def _probe(made: Plan):
    """Member and probe rows of the partitions' buckets."""
    masks = [_masks(len(b), made.limit) for b in made.bits]
    fixed = [sum(1 << b for b in bits) for bits in made.bits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            reach = made.thresholds(v)
            for p, bits in enumerate(made.bits):
                own = take(v, bits)
                yield _rows(_name(p, own), fixed[p], 0, v)
                for t in range(made.limit + 1):
                    mine = np.flatnonzero(reach[:, p] >= t)
                    if not len(mine):
                        break
                    for at in range(0, len(mine), 1024):
                        some = mine[at : at + 1024]
                        there = own[some][:, None] ^ masks[p][t][None, :]
                        node = np.broadcast_to(v[some][:, None], there.shape)
                        # Whom it could meet there; in its own bucket that is one besides itself.
                        met = made.tables[p][0][there] > (1 if t == 0 else 0)
                        yield _rows(_name(p, there[met]), fixed[p], 1, node[met])

    return run


def _refine(limit: int):
    """Rows of a large bucket, once for each of ``limit`` + 1 parts of the bits left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fixed, node = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1, 3))
            asks = batch.column(2).to_numpy()
            for mask in np.unique(fixed):
                mine = fixed == mask
                free = [b for b in range(64) if not int(mask) >> b & 1]
                for p, part in enumerate(np.array_split(np.array(free), limit + 1)):
                    bits = part.tolist()
                    now = int(mask) | sum(1 << b for b in bits)
                    for kind in (0, 1):
                        some = mine & (asks == kind)
                        v = node[some]
                        yield _rows(_name(bucket[some], p, take(v, bits)), now, kind, v)

    return run


def forest(members: np.ndarray, asking: Iterator[np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links between probes and members connect, and no more.

    Members meet the probes block by block; of a block's links at most one for each row is
    kept, the one to the smallest label seen so far, until nothing changes.
    """
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    label = {int(m): int(m) for m in members}

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for block in asking:
        for q in block:
            near = members[np.bitwise_count(members ^ q) <= limit]
            mine = int(q)
            label.setdefault(mine, mine)
            for m in near.tolist():
                x, y = root(mine), root(m)
                if x != y:
                    label[max(x, y)] = min(x, y)
                    a.append(max(mine, m))
                    b.append(min(mine, m))
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def _verify(limit: int):
    """Read buckets, sorted by name with members first, and give out their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def buckets() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            rest: list[tuple[np.ndarray, np.ndarray]] = []
            name = None
            for batch in batches:
                key, kind, node = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else [0]
                for i, j in zip(edges[:-1], edges[1:]):
                    if key[i] != name:
                        if rest:
                            yield tuple(np.concatenate(x) for x in zip(*rest))
                        rest, name = [], key[i]
                    rest.append((kind[i:j], node[i:j]))
            if rest:
                yield tuple(np.concatenate(x) for x in zip(*rest))

        for kind, node in buckets():
            v = node.view(np.uint64)
            members, asking = np.unique(v[kind == 0]), np.unique(v[kind == 1])
            if len(members) and len(asking) and (len(members) > 1 or len(asking) > 1 or members[0] != asking[0]):
                x, y = forest(members, iter([asking]), limit)
                if len(x):
                    held.append(pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"]))
            if len(held) > 200:
                yield from held
                held.clear()
        yield from held

    return run


def links(nodes: DataFrame, made: Plan, bucket_rows: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that are to be linked."""
    spark = nodes.sparkSession
    n = partitions(spark)
    left = stage(nodes.select("node").mapInArrow(_probe(made), _ROWS))
    found: DataFrame | None = None
    while True:
        sizes = stage(
            left.groupBy("bucket").agg(
                F.count(F.lit(1)).alias("n"), F.sum("asks").alias("asks"), F.max("fixed").alias("fixed")
            )
            .filter((F.col("asks") > 0) & (F.col("asks") < F.col("n")))
            .select("bucket", ((F.col("n") > bucket_rows) & (F.bit_count("fixed") < 52)).alias("large"))
        )
        small = (
            left.join(sizes.filter(~F.col("large")), "bucket", "left_semi")
            .repartition(n, "bucket").sortWithinPartitions("bucket", "asks")
            .mapInArrow(_verify(made.limit), "a bigint, b bigint")
        )
        small = stage(small)
        found = small if found is None else found.unionByName(small)
        large = sizes.filter("large")
        if large.isEmpty():
            return found
        left = stage(
            left.join(large, "bucket", "left_semi").mapInArrow(_refine(made.limit), _ROWS).dropDuplicates()
        )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    parts: int = 4,
    limit: int = LIMIT,
    bucket_rows: int = 8192,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable): one row each."""
    signed = stage(fingerprints(docs, doc_id, text))
    nodes = stage(
        signed.groupBy(F.col("fingerprint").alias("node")).agg(
            F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")
        )
    )
    roots = components(links(nodes, plan(nodes, parts, limit), bucket_rows))
    named = nodes.join(roots, "node", "left").select(
        "node", "low", "n", F.coalesce("root", "node").alias("root")
    )
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = stage(named.join(lows, "root").select(F.col("node").alias("fingerprint"), "n", "component_id"))
    return join_hot(signed, known, "fingerprint", "n").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
