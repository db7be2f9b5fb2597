"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is its five-word shingles (words without white space, A-Z lower-cased), each
weighted by how often it occurs; a document of fewer words has one shingle, all of them. For
each shingle a Poisson process with its weight as rate sends arrivals to random registers; a
register keeps the shingle that reached it first. Two documents agree in a register with the
probability Jaccard similarity of their weighted shingles. A shingle's process stops once it
is later than all registers' first arrivals, so most shingles send a single arrival.

Signatures are cut into bands; documents that agree in a whole band are in one bucket.
Texts with equal word sequences are one class before that. In a bucket every member is
compared with the bucket's centre, its smallest node, which then leaves the bucket. Where the
others are still of more than one component they are compared with one another: in buckets of
up to ``FEW`` members pair by pair, in larger ones by blocks. For that, large buckets that
share members are one cluster; its nodes are dealt over blocks of bounded size, and any two
blocks meet in one task, which compares all their pairs that are not yet of one component and
gives out no pairs but a forest of the links it found. So what is shuffled is a node's text
for each block of its cluster, not for each pair; the comparisons themselves grow with the
square of a cluster, since each of them can be a link. Most are settled by a bound: shingles
that only one text of the two blocks holds cannot be shared. Of any two members of a bucket
that were never compared, both are in one component. No bucket or partner list is capped.
Candidate pairs of small buckets whose signatures agree in fewer than ``screen`` of the
registers are dropped (with the default numbers that loses a pair at the limit once in more
than a million); the rest, and all pairs in blocks, are verified on the whole texts: the exact
probability Jaccard, or the Jaccard of the shingle sets, is at least ``similarity``. Verified
links join documents into groups.

Null and empty texts, and texts of white space, have equal (empty) word sequences and form
one class. Rows that share an id are one vertex per id and text; a null id is an id. An
empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import fresh, join_hot, mix, partitions, stage, text_key, whole, words_of

SHINGLE = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BANDS, _ROWS = 24, 5
#: Arrivals drawn at a time when few processes are left.
_ROUND = 20_000
#: Bits of a shingle's hash in signatures; a chunk holds fewer than 2^22 texts.
_SHARED_BITS = np.uint64(42)
#: Members of buckets whose pairs are compared one by one; those of larger ones meet in blocks.
FEW = 50
#: Up to so many ids go to all tasks, so that the other texts are not shuffled.
SENT_IDS = 1_000_000
#: Texts of a block, and their bytes.
BLOCK_TEXTS, BLOCK_BYTES = 2048, 8 << 20


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole text if it is shorter."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = words[: len(words) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * _GOLD + words[k : k + len(out)]
        return mix(out + np.uint64(n))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """ProbMinHash registers of many documents at once.

    ``doc`` numbers the documents from 0; every document has an element. A round takes one
    more arrival from every process that can still be first somewhere in its document; several
    when few processes are left, which changes no register.
    """
    first = np.full(docs * m, np.inf)
    winner = np.zeros(docs * m, dtype=np.uint64)
    time = np.zeros(len(element))
    live = np.arange(len(element))
    draw = 0
    with np.errstate(over="ignore"):
        while len(live):
            block = min(64, max(1, _ROUND // len(live)))
            number = np.arange(draw + 1, draw + block + 1, dtype=np.uint64)
            draw += block
            h = mix(element[live][:, None] + (np.uint64(2) * number * _GOLD)[None, :])
            now = time[live][:, None] + np.cumsum(-np.log(_uniform(h)), axis=1) / weight[live][:, None]
            time[live] = now[:, -1]
            at = doc[live][:, None] * m + (mix(h + _GOLD) % np.uint64(m)).astype(np.int64)
            np.minimum.at(first, at.ravel(), now.ravel())
            won, place = np.nonzero(first[at] == now)
            winner[at[won, place]] = element[live[won]]
            latest = first.reshape(docs, m).max(axis=1)
            live = live[now[:, -1] < latest[doc[live]]]
    return winner.reshape(docs, m)


def _edges(doc: np.ndarray) -> np.ndarray:
    """Where each document begins, and the end of the last."""
    return np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])


def _weighted(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the document, shingle, count) for words in order of documents.

    The shingles of all documents at once: those that run over a document's end are left out.
    """
    length = np.diff(edges)
    own = np.repeat(np.arange(len(length)), length)
    inside = np.flatnonzero(np.repeat(edges[1:], length) - np.arange(len(words)) >= SHINGLE)
    found = [shingles(words)[inside]] if len(inside) else []
    owner = [own[inside]]
    for i in np.flatnonzero(length < SHINGLE):
        found.append(shingles(words[edges[i] : edges[i + 1]]))
        owner.append(np.array([i]))
    # One sort for both: the document above, the shingle in the bits that are left.
    bits = np.uint64(64 - max(1, int(len(length)).bit_length()))
    key = np.concatenate(found) & ((np.uint64(1) << bits) - np.uint64(1))
    key = np.sort(key | (np.concatenate(owner).astype(np.uint64) << bits))
    start = _edges(key)
    key = key[start[:-1]]
    element = key & ((np.uint64(1) << _SHARED_BITS) - np.uint64(1))
    return (key >> bits).astype(np.int64), element, np.diff(start)


_SIGNED = "doc_id bigint, doc_key bigint, node bigint, words binary, signature binary, bands array<bigint>"


def _sign(bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            sequence = [b""] * len(texts)
            signature: list[bytes | None] = [None] * len(texts)
            keys: list[list[int] | None] = [None] * len(texts)
            for doc, words in words_of(texts):
                if not len(doc):
                    continue
                edges = _edges(doc)
                ids = doc[edges[:-1]]
                own, element, count = _weighted(words, edges)
                sig = signatures(own, element, count.astype(np.float64), len(ids), m)
                short = (sig >> np.uint64(8)).astype(np.uint32)
                band = np.zeros((len(ids), bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        band = mix(band * _GOLD + sig.reshape(len(ids), bands, rows)[:, :, r])
                    place = np.arange(len(words), dtype=np.uint64) - np.repeat(edges[:-1], np.diff(edges)).astype(np.uint64)
                    one = mix(words + place * _GOLD)
                    two = [np.add.reduceat(x, edges[:-1]) for x in (one, mix(one + _GOLD))]
                length = np.diff(edges).astype(np.uint64)
                for i, name, x, k in zip(ids, np.stack([*two, length], axis=1), short, band.view(np.int64)):
                    sequence[i], signature[i], keys[i] = name.tobytes(), x.tobytes(), k.tolist()
            yield pa.record_batch(
                [
                    *(batch.column(k) for k in (0, 1, 3)),
                    pa.array(sequence, pa.binary()),
                    pa.array(signature, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "doc_key", "node", "words", "signature", "bands"],
            )

    return run


class _Counted:
    """Texts' shingles and how often each occurs; those of the last texts, up to ``room`` bytes."""

    def __init__(self, room: int = 16 << 20):
        self.room, self.held = room, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode()
        key = hashlib.md5(data).digest()
        if key in self.held:
            return self.held[key]
        parts = [h for _, h in words_of([data])]
        h = shingles(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        found = np.unique(h, return_counts=True)
        self.room -= 16 * len(found[0])
        while self.room < 0 and self.held:
            self.room += 16 * len(self.held.pop(next(iter(self.held)))[0])
        self.held[key] = found
        return found


def similarity_of(a: str, b: str, counted: _Counted | None = None) -> float:
    """The larger of exact probability Jaccard and set Jaccard of two texts' shingles."""
    counted = counted or _Counted()
    (ha, ca), (hb, cb) = counted(a), counted(b)
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    if ca.max() == cb.max() == 1:  # both measures are the same
        both = len(np.intersect1d(ha, hb, assume_unique=True))
        return both / (len(ha) + len(hb) - both)
    every = np.unique(np.r_[ha, hb])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)], y[np.searchsorted(every, hb)] = ca, cb
    shared = (x > 0) & (y > 0)
    plain = shared.sum() / len(every)
    # Elements with the same pair of counts have the same term: one sum for each pair.
    pairs, times = np.unique(np.stack([x[shared], y[shared]]), axis=1, return_counts=True)
    spread, many = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    weighted = sum(
        n / (many * np.maximum(spread[0] / p, spread[1] / q)).sum() for (p, q), n in zip(pairs.T, times)
    )
    return float(max(plain, weighted))


class _Block:
    """Texts as flat lists of their distinct shingles, numbered over all texts that meet."""

    def __init__(self, texts: list[str]):
        counted = [_Counted(0)(t) for t in texts]
        self.edges = np.cumsum([0, *(len(h) for h, _ in counted)])
        _, flat, held = np.unique(
            np.concatenate([h for h, _ in counted]), return_inverse=True, return_counts=True
        )
        count = np.concatenate([c for _, c in counted])
        self.flat, self.words = flat, len(held)
        self.size = np.diff(self.edges)
        self.share = count / np.repeat(np.add.reduceat(count, self.edges[:-1]), self.size)
        self.repeats = np.maximum.reduceat(count, self.edges[:-1]) > 1
        # What another text can hold as well: as a number, and as a part of the text.
        met = held[flat] > 1
        self.common = np.add.reduceat(met.astype(np.int64), self.edges[:-1])
        self.part = np.add.reduceat(np.where(met, self.share, 0.0), self.edges[:-1])

    def possible(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of ``others`` that the bound does not exclude."""
        least = np.minimum(self.common[i], self.common[others])
        plain = least >= similarity * (self.size[i] + self.size[others] - least) - 1e-6
        part = np.minimum(self.part[i], self.part[others]) >= similarity - 1e-6
        return others[plain | (part & (self.repeats[i] | self.repeats[others]))]

    def measures(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard of the shingle sets, and a bound of the probability Jaccard."""
        own = np.zeros(self.words)
        own[self.flat[self.edges[i] : self.edges[i + 1]]] = self.share[self.edges[i] : self.edges[i + 1]]
        size = self.size[others]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.edges[others] - np.r_[0, ends[:-1]], size)
        theirs = own[self.flat[at]]
        both = np.add.reduceat((theirs > 0).astype(np.int64), np.r_[0, ends[:-1]])
        lesser = np.add.reduceat(np.minimum(theirs, self.share[at]), np.r_[0, ends[:-1]])
        return both / (self.size[i] + size - both), lesser


_MET = "a bigint, b bigint, links bigint"


def _meet(similarity: float):
    """Links between the texts of two blocks, or within one; see ``_by_blocks``."""

    def run(rows: pa.Table) -> pa.Table:
        node, own, left = (rows.column(k).to_numpy() for k in ("node", "own", "left"))
        texts = rows.column("text").to_pylist()
        block = _Block(texts)
        within = left.all()
        # Texts with the most in common come first: they join the others early.
        order = np.argsort(-block.part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        _, root = np.unique(own, return_inverse=True)
        links, found = np.zeros(len(node), np.int64), []
        counted = _Counted()
        for i in order if within else order[left[order]]:
            others = root != root[i]
            others &= place > place[i] if within else ~left
            others = block.possible(i, np.flatnonzero(others), similarity)
            if not len(others):
                continue
            plain, bound = block.measures(i, others)
            same = plain >= similarity
            unsure = ~same & (bound >= similarity - 1e-6) & (block.repeats[i] | block.repeats[others])
            for k in np.flatnonzero(unsure):
                same[k] = similarity_of(texts[i], texts[others[k]], counted) >= similarity
            linked = others[same]
            links[i] += len(linked)
            links[linked] += 1
            _, first = np.unique(root[linked], return_index=True)
            found += [(node[i], node[j]) for j in linked[first]]
            root[np.isin(root, root[linked])] = root[i]
        some = np.flatnonzero(links)
        a, b = zip(*found) if found else ((), ())
        return pa.table(
            {
                "a": pa.array([*a, *node[some]], pa.int64()),
                "b": pa.array([*b, *[None] * len(some)], pa.int64()),
                "links": pa.array([*[None] * len(a), *links[some]], pa.int64()),
            }
        )

    return run


def _by_blocks(buckets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the members (node, own) of large buckets; (a, links) of those met.

    Members are compared if their large buckets are of one cluster and ``own`` differs.
    """
    low = buckets.groupBy("bucket").agg(F.min("node").alias("low"))
    joined = components(buckets.join(low, "bucket").select(F.col("node").alias("a"), F.col("low").alias("b")))
    members = buckets.select("node", "own").distinct().join(joined, "node", "left")
    given = stage(
        members.join(texts, "node").dropDuplicates(["node"])
        .select("node", "own", F.coalesce("root", "node").alias("cluster"), "text")
    )
    sizes = given.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("bytes") / BLOCK_BYTES, F.lit(1)))
    dealt = join_hot(given, stage(sizes.select("cluster", "n", blocks.alias("blocks"))), "cluster", "n")
    home = F.pmod(F.xxhash64("node", F.lit("block")), "blocks")
    pairs = dealt.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    first = F.least("home", "other")
    return (
        pairs.select(
            "cluster", first.alias("x"), F.greatest("home", "other").alias("y"),
            (F.col("home") == first).alias("left"), "node", "own", "text",
        )
        .groupBy("cluster", "x", "y").applyInArrow(_meet(similarity), _MET)
    )


@F.pandas_udf(T.DoubleType())
def _similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    counted = _Counted()  # the texts of a task's pairs, which come in order of one of them
    for a, b in pairs:
        yield pd.Series([similarity_of(x, y, counted) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(v), np.uint32).reshape(len(v), -1) for v in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _checksum(edges: DataFrame) -> tuple:
    return edges.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count(F.lit(1))).first()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links (a, b) connect it with.

    Alternates two steps on the links, each linear in their number: neighbours that are
    larger than a node are tied to its smallest neighbour, then the others. A hub's links are
    split by Spark like any others, since all it takes is a minimum for each node.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    now = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node goes to its smallest one.
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = stage(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (
            joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        new = stage(small)
        edges, before, now = new, now, _checksum(new)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    bands: int = _BANDS,
    rows: int = _ROWS,
    screen: float = 0.6,
) -> DataFrame:
    """doc_id, doc_key, class_id, class_size, links, kept: one row per (id, text).

    ``class_id`` is the smallest id of the group, ``links`` the number of verified links of
    the document's distinct word sequence, ``kept`` is true for one row of each group.
    """
    given = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        text_key(F.col(text)).alias("doc_key"),
        whole(F.col(text)).alias("text"),
    ).withColumn("node", F.xxhash64("doc_id", "doc_key"))
    signed = stage(given.mapInArrow(_sign(bands, rows), _SIGNED))
    order = F.struct("doc_id", "doc_key", "node")
    classes = signed.groupBy("words").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("n"))
    # One representative for each word sequence; only these have buckets.
    reps = stage(
        signed.filter(F.col("signature").isNotNull())
        .join(classes.select(F.col("low.node").alias("node")), "node", "left_semi")
        .dropDuplicates(["node"])
        .select("node", "signature", "bands")
    )
    roots, degree = _components_of_buckets(given, reps, similarity, screen)
    named = (
        classes.select("words", "n", F.col("low.node").alias("rep"))
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .join(degree.select(F.col("node").alias("rep"), "links"), "rep", "left")
        .select("words", "n", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    rows = signed.select("doc_id", "doc_key", "node", "words")
    members = stage(join_hot(rows, stage(named), "words", "n").drop("words", "n").dropDuplicates(["node"]))
    groups = members.groupBy("root").agg(
        F.min(order).alias("low"), F.count(F.lit(1)).alias("class_size")
    )
    return join_hot(members, stage(groups), "root", "class_size").select(
        "doc_id",
        "doc_key",
        F.col("low.doc_id").alias("class_id"),
        "class_size",
        "links",
        (F.col("node") == F.col("low.node")).alias("kept"),
    )


def _extended(
    roots: DataFrame, degree: DataFrame, linked: DataFrame, ends: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``roots`` and ``degree`` after the links (a, b) and the ends (node, links) of more pairs."""
    degree = stage(ends.unionByName(degree).groupBy("node").agg(F.sum("links").alias("links")))
    # All that is known of links from here on: each node with its root.
    forest = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return stage(components(linked.unionByName(forest))), degree


def _components_of_buckets(
    given: DataFrame, reps: DataFrame, similarity: float, screen: float
) -> tuple[DataFrame, DataFrame]:
    """(node, root) of linked representatives, and (node, links) of those with any."""
    spark = reps.sparkSession
    buckets = stage(
        reps.select("node", F.posexplode("bands").alias("band", "key"))
        .select("node", F.xxhash64("band", "key").alias("bucket"))
    )
    sizes = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n"))
    left = stage(
        buckets.join(sizes.filter("n > 1"), "bucket").select(
            "bucket", "node", F.col("node").alias("own"), (F.col("node") == F.col("low")).alias("chosen")
        )
    )
    # Only texts that share a bucket are ever looked at; few ids go to the texts.
    wanted = stage(left.select("node").distinct())
    if wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    texts = stage(given.select("node", "text").join(wanted, "node", "left_semi"))
    roots = spark.createDataFrame([], "node bigint, root bigint")
    degree = spark.createDataFrame([], "node bigint, links bigint")
    tested: DataFrame | None = None
    large: DataFrame | None = None  # buckets for blocks, once every member has met its centre
    while not left.isEmpty():
        centres = left.filter("chosen").select(
            "bucket", F.col("node").alias("centre"), F.col("own").alias("centre_own")
        )
        once = ~F.col("chosen") | (F.col("node") < F.col("centre"))
        distinct = (
            left.join(centres, "bucket").filter(once & (F.col("own") != F.col("centre_own")))
            .select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
            .distinct()
        )
        sign = reps.select("node", "signature")
        close = (
            distinct.join(sign.toDF("a", "sa"), "a").join(sign.toDF("b", "sb"), "b")
            .filter(_agreement("sa", "sb") >= screen).select("a", "b")
        )
        close = stage(close if tested is None else close.join(tested, ["a", "b"], "left_anti"))
        of = texts.join(
            close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct(),
            "node",
        )
        of = stage(of.dropDuplicates(["node"]))
        # Verifying is heavy per row, so the few rows are dealt over all tasks.
        checked = stage(
            close.join(of.toDF("a", "ta"), "a")
            .repartition(partitions(spark), "b").join(of.toDF("b", "tb").hint("merge"), "b")
            .select("a", "b", (_similarity("ta", "tb") >= similarity).alias("same"))
        )
        tested = close if tested is None else tested.unionByName(close)
        linked = checked.filter("same").select("a", "b")
        ends = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node")))
        roots, degree = _extended(roots, degree, linked, ends.withColumn("links", F.lit(1).cast("bigint")))
        if large is not None:
            break
        # Centres have met everyone; the rest goes on where it is of several components.
        rest = stage(
            left.filter(~F.col("chosen")).select("bucket", "node").join(roots, "node", "left")
            .select("bucket", "node", F.coalesce("root", "node").alias("own"))
        )
        sizes = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
        rest = stage(rest.join(sizes.filter("low <> high"), "bucket").select("bucket", "node", "own", "n"))
        large = rest.filter(F.col("n") > FEW).select("bucket", "node")
        left = rest.filter(F.col("n") <= FEW).select("bucket", "node", "own", F.lit(True).alias("chosen"))
    if large is not None and not large.isEmpty():
        now = large.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("own"))
        met = stage(_by_blocks(stage(now), texts, similarity))
        linked = met.filter("b IS NOT NULL").select("a", "b")
        ends = met.filter("b IS NULL").select(F.col("a").alias("node"), "links")
        roots, degree = _extended(roots, degree, linked, ends)
    return roots, degree


def keep_one(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group; columns stay as they are."""
    key, own = fresh(docs, "doc_key"), fresh(docs, "own_id")
    marks = found.filter("kept").select(F.col("doc_id").alias(own), F.col("doc_key").alias(f"{key}_f"))
    keyed = docs.withColumn(key, text_key(F.col(text)))
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col(own)) & (F.col(key) == F.col(f"{key}_f"))
    return (
        keyed.join(marks.distinct(), same, "left_semi").dropDuplicates([doc_id, key]).select(*docs.columns)
    )
