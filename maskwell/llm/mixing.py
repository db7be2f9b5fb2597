"""Mixing sources to target weights by Pfair scheduling.

The mix is a row of slots, each holding one block of ``block_rows`` documents of one source.
A source of weight w owes its j-th block a window of slots: released at floor((j-1)/w), due
at ceil(j/w). In every slot the released block with the earliest deadline goes out (ties: the
smaller source name). With weights that sum to 1 each block goes out inside its window, so
after any number of slots every source is less than one block away from its share.

Windows follow from the exact weights, as ratios of whole numbers; nothing is rounded. The
row is cut into chunks of ``period`` slots (more if a source has fewer than one block in so
many), and chunks are scheduled in Spark tasks apart from each other: ``blocks_before`` says
how many blocks of each source go out before a chunk begins, so that what is left of the
windows can be kept on both sides. So the deviation does not grow with the length of the mix,
and there is no limit to the number of sources but the driver's memory for their sizes.

A source that is used up starts again (the next epoch), and the mix ends when each document
has been used at least once: no document is lost, and the weights hold to the end. Inside a
source, documents go by the MD5 of their id, then by id, then by text key. A null source is
a source of its own (named by ``NO_SOURCE``). Rows that share id and text are told apart by
nothing and each gets its own place. An empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwell.llm.common import fresh, partitions, stage, text_key

NO_SOURCE = "\x00"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period``, at least one each, by largest remainders."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources do not fit a period of {period} slots")
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    left = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        out[s] += 1
    return out


def whole_ratios(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of ``weights``."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if low := [s for s, w in exact.items() if w <= 0]:
        raise ValueError(f"weights of {sorted(low)[:5]} are not above 0")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    ratio = {s: int(w * unit) for s, w in exact.items()}
    common = math.gcd(*ratio.values())
    return {s: r // common for s, r in ratio.items()}


def blocks_before(ratio: dict[str, int], at: int) -> dict[str, int]:
    """Blocks of each source in the slots before ``at``.

    Blocks due by ``at`` are among them. The other places go to blocks whose windows hold
    ``at``: those due first, if they fit in front of it together with what is due there. For
    every start the slots from there to ``at`` must hold the blocks released in them.
    """
    total = sum(ratio.values())
    done = {s: at * r // total for s, r in ratio.items()}
    free = at - sum(done.values())
    if not free:
        return done
    crossing = sorted(
        (-(-(done[s] + 1) * total // r), s, done[s] * total // r) for s, r in ratio.items() if at * r % total
    )
    starts = sorted({release for _, _, release in crossing})
    # Blocks due by ``at``, by their release.
    first = starts[0]
    released = [0] * (at - first)
    for s, r in ratio.items():
        for j in range(-(-first * r // total), done[s]):
            released[j * total // r - first] += 1
    # Between two releases of crossing blocks only the tightest start counts.
    room = [at] * len(starts)
    held, k = 0, len(starts) - 1
    for start in range(at - 1, first - 1, -1):
        held += released[start - first]
        while k and start <= starts[k - 1]:
            k -= 1
        # From ``start`` on, the crossing blocks released at starts[i] >= start are counted.
        i = k if start <= starts[k] else k + 1
        if i < len(starts):
            room[i] = min(room[i], at - start - held)
    place = {release: i for i, release in enumerate(starts)}
    for _, s, release in crossing:
        i = place[release]
        if free and min(room[: i + 1]) > 0:
            room[: i + 1] = [x - 1 for x in room[: i + 1]]
            done[s] += 1
            free -= 1
    if free:
        raise AssertionError("a slot has no block")
    return done


def schedule(ratio: dict[str, int], start: int = 0, stop: int | None = None) -> dict[str, list[int]]:
    """For each source the slots of its blocks from ``start`` to ``stop``, by earliest deadline.

    Left out, ``stop`` is the sum of ``ratio``, after which the windows repeat.
    """
    total = sum(ratio.values())
    stop = total if stop is None else stop
    before, after = blocks_before(ratio, start), blocks_before(ratio, stop)
    waiting = [
        (max(start, before[s] * total // r), s, before[s] + 1) for s, r in ratio.items() if after[s] > before[s]
    ]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    slots: dict[str, list[int]] = {s: [] for s in ratio}
    for slot in range(start, stop):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (min(stop, -(-j * total // ratio[s])), s, j))
        due, s, j = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block missed its deadline")
        slots[s].append(slot)
        if j < after[s]:
            heapq.heappush(waiting, (j * total // ratio[s], s, j + 1))
    return slots


def slots_needed(ratio: dict[str, int], blocks: dict[str, int], chunk: int) -> tuple[int, dict[str, int]]:
    """Slots until each source has had so many ``blocks``, and the blocks of each in them."""
    total = sum(ratio.values())
    done: dict[int, dict[str, list[int]]] = {}
    low = max((blocks[s] - 1) * total // r for s, r in ratio.items())
    length = 0
    for s, r in ratio.items():
        if -(-blocks[s] * total // r) <= low:
            continue  # due before another source's last block is released
        for k in range((blocks[s] - 1) * total // r // chunk, (-(-blocks[s] * total // r) - 1) // chunk + 1):
            earlier = blocks_before(ratio, k * chunk)[s]
            if k not in done:
                done[k] = schedule(ratio, k * chunk, (k + 1) * chunk)
            if earlier < blocks[s] <= earlier + len(done[k][s]):
                length = max(length, done[k][s][blocks[s] - 1 - earlier] + 1)
                break
    k = length // chunk
    last = done[k] if k in done else schedule(ratio, k * chunk, (k + 1) * chunk)
    earlier = blocks_before(ratio, k * chunk)
    return length, {s: earlier[s] + sum(x < length for x in last[s]) for s in ratio}


def _scheduled(ratio: dict[str, int], chunk: int):
    """(source, block from 0, slot) of the chunks whose numbers come in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"].tolist():
                before = blocks_before(ratio, k * chunk)
                for s, slots in schedule(ratio, k * chunk, (k + 1) * chunk).items():
                    if slots:
                        block = range(before[s], before[s] + len(slots))
                        yield pd.DataFrame({"source": s, "block": block, "slot": slots})

    return run


def ranks(docs: DataFrame, source: str, doc_id: str, text: str) -> DataFrame:
    """source, doc_id, doc_key and the rank (from 0) of every row within its source.

    Rows are range-partitioned by source and order, so a large source spreads over many
    partitions; a rank is the place inside the partition plus what earlier partitions hold.
    That table has at most one row per partition and source.
    """
    keyed = docs.select(
        F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("ord"),
        F.col(doc_id).alias("doc_id"),
        text_key(F.col(text)).alias("doc_key"),
    )
    order = ["source", "ord", "doc_id", "doc_key"]
    placed = stage(
        keyed.repartitionByRange(partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select(
            "source",
            "doc_id",
            "doc_key",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("place"),
        )
    )
    runs = placed.groupBy("source", "part").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "source", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    return placed.join(F.broadcast(runs), ["source", "part"]).select(
        "source", "doc_id", "doc_key", (F.col("place") - F.col("first") + F.col("before")).alias("rank")
    )


def tempered(sizes: dict[str, int], power: float) -> dict[str, float]:
    """Target weights proportional to size ** power, the usual way to lift small sources."""
    return {s: n**power for s, n in sizes.items()}


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = 0.7,
    block_rows: int = 16,
    period: int = 1000,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """position, slot, epoch, source, doc_id, doc_key: one row for each place in the mix.

    ``weights`` names every source and is above 0; left out, weights are tempered sizes. What
    is broadcast has one entry for each source, and one for each partition and source; the
    schedule, which grows with the mix, is joined by sort and merge.
    """
    spark = docs.sparkSession
    ranked = stage(ranks(docs, source, doc_id, text))
    sizes = dict(ranked.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect())
    weights = {
        **(weights if weights is not None else tempered(sizes, power)),
    }
    weights = {NO_SOURCE if s is None else s: w for s, w in weights.items()}
    if missing := set(sizes) - set(weights):
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    ratio = whole_ratios({s: weights[s] for s in sizes}) if sizes else {}
    #: Every source has a block in about every chunk.
    chunk = max(period, -(-sum(ratio.values()) // min(ratio.values()))) if sizes else period
    needed = {s: -(-n // block_rows) for s, n in sizes.items()}
    length, blocks = slots_needed(ratio, needed, chunk) if sizes else (0, {})

    plan = spark.createDataFrame(
        [(s, n, blocks[s] * block_rows) for s, n in sizes.items()], "source string, n bigint, used bigint"
    )
    chunks = -(-length // chunk)
    scheduled = spark.range(0, chunks, 1, max(1, min(chunks, partitions(spark)))).mapInPandas(
        _scheduled(ratio, chunk), "source string, block bigint, slot bigint"
    )
    uses = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("used") - 1 - F.col("rank")) / F.col("n")))
    at: Column = F.col("rank") + F.col("epoch") * F.col("n")
    return (
        ranked.join(F.broadcast(plan), "source")
        .withColumn("epoch", F.explode(uses))
        .withColumn("at", at)
        .withColumn("block", F.floor(F.col("at") / block_rows))
        .join(scheduled.hint("merge"), ["source", "block"])
        .select(
            (F.col("slot") * block_rows + F.col("at") % block_rows).alias("position"),
            "slot",
            "epoch",
            F.nullif("source", F.lit(NO_SOURCE)).alias("source"),
            "doc_id",
            "doc_key",
        )
    )


def apply(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in the order of the mix, repeated where it repeats them.

    Rows are sorted by position across partitions; files written from the result keep that
    order by file name. Rows that share id and text are interchangeable, so one of them
    stands for all at each of their places.
    """
    key, at = fresh(docs, "row_key"), fresh(docs, "position")
    # One hash of id and text, null ids included: texts are shuffled once for both steps.
    keyed = docs.withColumn(key, F.xxhash64(F.col(doc_id), text_key(F.col(text)))).dropDuplicates([key])
    places = mixed.select(F.xxhash64("doc_id", "doc_key").alias(key), F.col("position").alias(at))
    return (
        keyed.join(places.hint("merge"), key)
        .repartitionByRange(partitions(docs.sparkSession), at)
        .sortWithinPartitions(at)
        .select(*docs.columns)
    )
