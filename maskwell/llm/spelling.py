"""Spelling variants by a bit-sliced index over (position, letter).

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A
word's form is its near word of largest count (ties: smallest in code-point order), if that
count is at least ``times`` its own.

In a group of words, the index has for each position and letter the set of the words with
that letter there, one bit a word. A word is compared with the whole group at once: letter
by letter, ``same`` are the words without an error so far, ``one`` those with one replaced
letter, and ``shifted`` those with one letter more, read at the next position.

Groups come from pigeonhole: of two near words, either what comes before a middle place or
what comes after it is equal. Words of a group share a prefix and a suffix and differ in the
free middle. A group of more than ``group_words`` words is taken apart at the middle of what
is free, again and again; a middle of one letter has at most as many words as there are
letters. So no group grows with the vocabulary, and no pair list is capped. Each pair has one
place (the replaced letter, or the last letter that may be the inserted one) and so is met in
one group of each level only.

Null texts hold no words. A null id is an empty text in the hash that plants errors. Rows
that are repeated count each time. An empty table gives no rows. Only the id and the text
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import partitions, stage, whole

#: Letters of a word, after lower-casing A-Z.
LETTERS = "a-zÀ-ÿ"
#: Distinct words that a task counts before it hands them on.
_HELD = 500_000


def _counted(min_chars: int, one_in: int):
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{doc_id.as_py()}:".encode())
                # bytes.lower() changes A-Z only.
                lower = text.as_py().encode().lower().decode()
                for word, n in Counter(runs.findall(lower)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    held[word] += n
                if len(held) > _HELD:
                    yield out(held)
                    held.clear()
        if held:
            yield out(held)

    return run


def vocabulary(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 7,
    min_count: int = 2,
    one_in: int = 31,
) -> DataFrame:
    """word, n: what runs of letters become when one in ``one_in`` (id, run) loses a letter."""
    given = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), whole(F.col(text)).alias("text")
    )
    counted = given.mapInArrow(_counted(min_chars, one_in), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- the index ----------------------------------------------------------------------------


class Slices:
    """Bitsets over a list of words: bit i stands for word i."""

    def __init__(self, words: list[str]):
        at: dict[tuple[int, str], list[int]] = defaultdict(list)
        length: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            length[len(word)].append(i)
            for place, letter in enumerate(word):
                at[place, letter].append(i)
        size = (len(words) + 7) // 8

        def bits(members: list[int]) -> int:
            out = bytearray(size)
            for i in members:
                out[i >> 3] |= 1 << (i & 7)
            return int.from_bytes(out, "little")

        self.at = {k: bits(v) for k, v in at.items()}
        self.length = {k: bits(v) for k, v in length.items()}

    def replaced(self, word: str, low: int, high: int) -> int:
        """Words with one other letter, at a place from ``low`` to ``high``."""
        same, one = self.length.get(len(word), 0), 0
        for i, letter in enumerate(word):
            has = self.at.get((i, letter), 0)
            one = (one & has) | (same & ~has if low <= i <= high else 0)
            same &= has
        return one

    def longer(self, word: str, low: int, high: int) -> int:
        """Words with one letter more, whose last possible place is from ``low`` to ``high``."""
        same, shifted = self.length.get(len(word) + 1, 0), 0
        for i, letter in enumerate(word):
            has = self.at.get((i, letter), 0)
            # The letter more stands at i if ``same`` ends here: the last place it can have.
            begun = same & ~has if low <= i <= high else 0
            shifted = (shifted | begun) & self.at.get((i + 1, letter), 0)
            same &= has
        return shifted | (same if low <= len(word) <= high else 0)


def _members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


#: A word in a group: the shorter words of the group have ``size`` letters, of which the first
#: ``head`` and the last ``tail`` are shared. A group of ``more`` = 0 is for replaced letters
#: and has words of that size only, one of ``more`` = 1 is for one letter more. The place of
#: the difference is from ``low`` to ``high``.
_GROUPED = "word string, n bigint, more int, size int, head int, tail int, low int, high int, key bigint"


def _split(size: int, more: int, head: int, tail: int, low: int, high: int):
    """The two smaller groups: differences from the middle on, and those before it."""
    middle = (low + high + 1) // 2
    yield middle, tail, middle, high  # what comes before the middle is equal
    # A difference before the middle leaves all letters from there on as they are.
    yield head, size - middle + (1 if more else 0), low, middle - 1


def _place(word: str, n: int, more: int, size: int, head: int, tail: int, low: int, high: int) -> tuple:
    return (word, n, more, size, head, tail, low, high)


def _keyed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["word", "n", "more", "size", "head", "tail", "low", "high"]
    types = [pa.string(), pa.int64()] + [pa.int32()] * 6
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.record_batch(columns, names=names)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word in its groups of the first level."""
    for batch in batches:
        rows = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            m = len(word)
            for more, size, high in ((0, m, m - 1), (1, m, m), (1, m - 1, m - 1)):
                for part in _split(size, more, 0, 0, 0, high):
                    rows.append((word, n, more, size, *part))
        if rows:
            yield _keyed(rows)


def _next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large groups in the two groups that each is taken apart into."""
    for batch in batches:
        rows = []
        for word, n, more, size, head, tail, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            for part in _split(size, more, head, tail, low, high):
                rows.append((word, n, more, size, *part))
        if rows:
            yield _keyed(rows)


_UNKEYED = "word string, n bigint, more int, size int, head int, tail int, low int, high int"


def _with_key(rows: DataFrame) -> DataFrame:
    """Groups are named by a hash; a task tells groups with the same name apart by their words."""
    head = F.substring(F.col("word"), F.lit(1), F.col("head"))
    tail = F.when(
        F.col("tail") > 0, F.substring(F.col("word"), F.length("word") - F.col("tail") + 1, F.col("tail"))
    ).otherwise("")
    return rows.withColumn("key", F.xxhash64("more", "size", "head", "tail", "low", head, tail))


def _met(group: list[tuple[str, int]], more: int, size: int, low: int, high: int) -> list[tuple]:
    """word, near words met, the best one's count and the best one, for words that met any."""
    words = [w for w, _ in group]
    index = Slices(words)
    found: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        if len(word) != size:
            continue
        if not more:
            found[i].extend(_members(index.replaced(word, low, high)))
        else:
            for j in _members(index.longer(word, low, high)):
                found[i].append(j)
                found[j].append(i)
    out = []
    for i, near in found.items():
        if near:
            best = min(near, key=lambda j: (-group[j][1], words[j]))
            out.append((words[i], len(near), group[best][1], words[best]))
    return out


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups in order of their names."""
    held: dict[tuple, list[tuple[str, int]]] = {}
    last = None
    out: list[tuple] = []

    def settle() -> None:
        for (more, size, _, _, low, high, _, _), group in held.items():
            if len(group) > 1:
                out.extend(_met(group, more, size, low, high))
        held.clear()

    def ready() -> pa.RecordBatch:
        done = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _NEAR)], schema=_NEAR)
        out.clear()
        return done

    for batch in batches:
        for word, n, more, size, head, tail, low, high, key in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                settle()
                last = key
                if len(out) > 10_000:
                    yield ready()
            own = (more, size, head, tail, low, high, word[:head], word[len(word) - tail :])
            held.setdefault(own, []).append((word, n))
    settle()
    if out:
        yield ready()


def near_words(words: DataFrame, group_words: int = 1024) -> DataFrame:
    """word, n_near, near_n, near: how many words are near, and the one of largest count."""
    n = partitions(words.sparkSession)
    left = stage(_with_key(words.select("word", "n").mapInArrow(_first, _UNKEYED)))
    found: DataFrame | None = None
    while True:
        sizes = stage(
            left.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("high") - F.col("low")).alias("free"))
            .filter("m > 1")
            .select("key", ((F.col("m") > group_words) & (F.col("free") > 0)).alias("large"))
        )
        small = stage(
            left.join(sizes.filter(~F.col("large")), "key", "left_semi")
            .select(*[c.split()[0] for c in _GROUPED.split(", ")])
            .repartition(n, "key").sortWithinPartitions("key")
            .mapInArrow(_meet, "word string, n_near bigint, near_n bigint, near string")
        )
        found = small if found is None else found.unionByName(small)
        large = sizes.filter("large")
        if large.isEmpty():
            break
        part = left.join(large, "key", "left_semi").drop("key")
        left = stage(_with_key(part.mapInArrow(_next, _UNKEYED)))
    best = F.min(F.struct((-F.col("near_n")).alias("below"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.below")).alias("near_n"), F.col("best.near").alias("near")
    )


def variants(words: DataFrame, times: int = 10, group_words: int = 1024) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of word and n."""
    near = near_words(words, group_words)
    known = near.filter(F.col("near_n").isNotNull())
    is_form = F.col("near_n") >= F.lit(times) * F.col("n")
    table = stage(
        words.join(known, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        )
    )
    # Counts grow by ``times`` with every step, so chains are short; each round doubles them.
    steps = table.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(steps.join(ahead, "root", "left").select("word", "root", "next"))
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter(F.col("next").isNotNull()).isEmpty():
            break
    return table.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
