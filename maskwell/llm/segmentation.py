"""SentencePiece pieces: n-best segmentation, encoding and decoding without loss.

A text gets one space put before it and is cut into pieces of a given vocabulary so that the
sum of the piece scores is largest (``▁`` in a piece stands for a space). Characters that no
piece covers become their UTF-8 bytes (byte pieces); so does a literal ``▁``, which keeps
decoding exact.

No piece reaches from a non-space into a space or over a line break, so the lattice falls
apart there into words. Each distinct word is solved once: forward Viterbi gives the best
score up to every position, and these scores are exact estimates for an A* search that runs
backwards from the end and meets the n best segmentations in order. The n best of a text
follow from those of its words: only the n-1 words whose second choice costs least can
differ among them, so the search runs for these; the others need their best two scores.

The vocabulary is read from a model file by the driver; its pieces and scores (a bounded
table, about a megabyte) go to the tasks. Null texts are read as empty ones; an empty text
has no pieces. Extra columns are passed on; the added columns' names must be free.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.session import small_batches

SPACE = "▁"
#: Words kept per task with their solutions; beyond it the store is emptied and refilled.
CACHE = 200_000
_WORD = re.compile(r" *[^ \n]+| +|\n")
#: Characters of text that are solved together.
TOGETHER = 1_000_000
#: Words of one length that are solved together: the lattice takes some kilobytes a word.
ROWS = 8_000
_CUT = "\x1f"


def words(text: str) -> list[str]:
    """The stretches of a text, led by a space, that no piece reaches out of."""
    if not text:
        return []
    text = " " + text
    if "  " in text or _CUT in text or " \n" in text:
        return _WORD.findall(text)
    marked = text.replace(" ", _CUT + " ").replace("\n", f"{_CUT}\n{_CUT}")
    return [w for w in marked.split(_CUT) if w]


class _Store(dict):
    """Word to a number; the best segmentation of each word in flat arrays by number."""

    def __init__(self):
        self.score, self.gap = array("d"), array("d")
        self.ids, self.begin = array("i"), array("q", [0])

    def put(self, words: list[str], scores, gaps, ids, counts) -> None:
        """Add words with their scores, gaps, all their ids and the number of ids of each."""
        self.update(zip(words, range(len(self.score), len(self.score) + len(words))))
        self.score.frombytes(np.asarray(scores, dtype=np.float64).tobytes())
        self.gap.frombytes(np.asarray(gaps, dtype=np.float64).tobytes())
        self.ids.frombytes(np.asarray(ids, dtype=np.int32).tobytes())
        ends = self.begin[-1] + np.cumsum(np.asarray(counts, dtype=np.int64))
        self.begin.frombytes(ends.tobytes())


class _PieceTable:
    """Pieces by the hash of their characters, in a sorted array with an index of slots."""

    FACTOR, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)

    def __init__(self, vocabulary: Vocabulary):
        used = [i for i, p in enumerate(vocabulary.pieces) if p]
        keys = np.array([self.key(vocabulary.pieces[i]) for i in used], dtype=np.uint64)
        keys = self.spread(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(used)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.scores = np.array(vocabulary.scores)[self.ids]
        self.longest = max(len(vocabulary.pieces[i]) for i in used)
        slots = (self.keys >> self.SHIFT).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << 20) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max())
        self.keys = np.r_[self.keys, np.zeros(self.deepest, dtype=np.uint64)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the sorted ones, and whether it is there."""
        h = self.spread(h)
        place = self.first[(h >> self.SHIFT).astype(np.int64)]
        hit = self.keys[place] == h
        for _ in range(1, self.deepest):
            place = np.where(hit, place, place + 1)
            hit = self.keys[place] == h
        return place, hit

    def spread(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h ^ (h >> np.uint64(29))) * self.FACTOR

    def key(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def solve(self, chars: np.ndarray):
        """For words of one length (a row each): best score, gap to the second, ids, counts."""
        rows, size = chars.shape
        score: dict[tuple[int, int], np.ndarray] = {}
        at: dict[tuple[int, int], np.ndarray] = {}
        h = np.zeros((rows, size + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, min(size, self.longest) + 1):
                width = size - n + 1
                h = h[:, :width] * self.FACTOR + chars[:, n - 1 :]
                place, hit = self.find(h)
                for start in np.flatnonzero(hit.any(axis=0)).tolist():
                    here = hit[:, start]
                    spot = np.where(here, place[:, start], 0)
                    score[start, n] = np.where(here, self.scores[spot], -np.inf)
                    at[start, n] = spot
        best = np.full((size + 1, rows), -np.inf)
        second = np.full((size + 1, rows), -np.inf)
        back = np.zeros((size + 1, rows), dtype=np.int64)
        piece = np.zeros((size + 1, rows), dtype=np.int64)
        best[0] = 0.0
        for end in range(1, size + 1):
            for n in range(min(end, self.longest), 0, -1):
                if (end - n, n) not in score:
                    continue
                own = score[end - n, n]
                value = best[end - n] + own
                better = value > best[end]
                second[end] = np.maximum(
                    np.maximum(second[end], second[end - n] + own), np.minimum(value, best[end])
                )
                best[end] = np.where(better, value, best[end])
                back[end] = np.where(better, n, back[end])
                piece[end] = np.where(better, at[end - n, n], piece[end])
        where, count = np.full(rows, size), np.zeros(rows, dtype=np.int64)
        out, row = np.zeros((rows, size), dtype=np.int32), np.arange(rows)
        while len(row):
            end = where[row]
            out[row, size - 1 - count[row]] = self.ids[piece[end, row]]
            count[row] += 1
            where[row] = end - back[end, row]
            row = row[where[row] > 0]
        return best[size], best[size] - second[size], out, count


@dataclass
class Vocabulary:
    pieces: list[str]  # with spaces for ▁; empty for control and byte pieces
    scores: list[float]
    bytes_at: list[int]  # id of each byte piece

    def __post_init__(self):
        self._solved: dict = {}
        self._automaton = self._raw = self._store = self._table = None
        self.alone = {p for p in self.pieces if len(p) == 1}
        self.byte_score = min(s for p, s in zip(self.pieces, self.scores) if len(p) == 1) - 10.0

    def __reduce__(self):
        return Vocabulary, (self.pieces, self.scores, self.bytes_at)

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for i, p in enumerate(self.pieces):
                if p:
                    self._automaton.add_word(p, (len(p), self.scores[i], (i,)))
            self._automaton.make_automaton()
        return self._automaton

    @property
    def raw(self) -> list[bytes]:
        """The bytes that each id stands for."""
        if self._raw is None:
            self._raw = [p.encode() for p in self.pieces]
            for b, i in enumerate(self.bytes_at):
                self._raw[i] = bytes([b])
        return self._raw

    def solve(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one word, best first, as (score, ids)."""
        found = self._solved.get((word, n))
        if found is None:
            if len(self._solved) >= CACHE // 8:
                self._solved.clear()
            found = self._solved[word, n] = self._search(word, n)
        return found

    def two_best(self, word: str) -> tuple[float, float, list[int]]:
        """Score and ids of the best segmentation, and how much the second one costs."""
        low = -math.inf
        best, next_best = [0.0] + [low] * len(word), [low] * (len(word) + 1)
        back: list = [None] * (len(word) + 1)
        for end, start, score, ids in self._edges(word):
            value = best[start] + score
            if value > best[end]:
                other = next_best[start] + score
                next_best[end] = best[end] if best[end] > other else other
                best[end], back[end] = value, (start, ids)
            elif value > next_best[end]:
                next_best[end] = value
        at, tail = len(word), []
        while at:
            at, ids = back[at]
            tail.append(ids)
        return best[-1], best[-1] - next_best[-1], [i for ids in reversed(tail) for i in ids]

    def _edges(self, word: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """(end, start, score, ids) of every piece in the word, by end."""
        out = [
            (last + 1, last + 1 - length, score, ids)
            for last, (length, score, ids) in self.automaton.iter(word)
        ]
        if not self.alone.issuperset(word):
            for at, c in enumerate(word):
                if c not in self.alone:
                    ids = tuple(self.bytes_at[b] for b in c.encode())
                    out.append((at + 1, at, self.byte_score * len(ids), ids))
            out.sort(key=lambda x: x[:2])
        return out

    def _search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        size = len(word)
        best, back = [0.0] + [-math.inf] * size, [None] * (size + 1)
        ends: list[list] = [[] for _ in range(size + 1)]
        for edge in self._edges(word):  # forward
            end, start, score, _ = edge
            ends[end].append(edge)
            score += best[start]
            if score > best[end]:
                best[end], back[end] = score, edge
        # Backward. A waiting node stands for all paths through it, the best of which has
        # its estimate exactly. So once n nodes are known to be as good, a worse one is not
        # needed; and the best way on from a node need not wait at all.
        out: list[tuple[float, tuple[int, ...]]] = []
        queue = [(-best[size], 0, size, 0.0, ())]
        known = [best[size]]  # the n best estimates so far
        order = 0
        while queue and len(out) < n:
            estimate, _, at, score, tail = heapq.heappop(queue)
            while at:
                edge = back[at]
                if n > 1:
                    for other in ends[at]:
                        if other is not edge:
                            own = score + other[2]
                            value = own + best[other[1]]
                            if len(known) < n:
                                heapq.heappush(known, value)
                            elif value > known[0]:
                                heapq.heapreplace(known, value)
                            else:
                                continue
                            order += 1
                            item = (-value, order, other[1], own, (other[3], tail))
                            heapq.heappush(queue, item)
                _, at, own, ids = edge
                score += own
                tail = (ids, tail)
            ids_of: list[int] = []
            while tail:
                ids_of.extend(tail[0])
                tail = tail[1]
            out.append((score, tuple(ids_of)))
        return out

    def _fill(self, words: set[str]) -> None:
        """Put the best segmentations of new words into the store, many at once."""
        store, by_size = self._store, {}
        if self._table is None:
            self._table = _PieceTable(self)
        for w in words:
            if len(w) > 2 * self._table.longest or not self.alone.issuperset(w):
                score, gap, ids = self.two_best(w)  # rare: very long, or with bytes
                store.put([w], [score], [gap], ids, [len(ids)])
            else:
                by_size.setdefault(len(w), []).append(w)
        for size, same in by_size.items():
            for a in range(0, len(same), ROWS):
                own = same[a : a + ROWS]
                chars = np.frombuffer("".join(own).encode("utf-32-le"), dtype=np.uint32)
                found = self._table.solve(chars.reshape(-1, size).astype(np.uint64) + np.uint64(1))
                score, gap, ids, counts = found
                filled = np.arange(size) >= size - counts[:, None]
                store.put(own, score, gap, ids[filled], counts)

    def encode(self, texts: list[str], n: int = 1):
        """For many texts: all ids, where each text's ids end, n best scores, changes."""
        return self.encode_words(texts, n)[:4]

    def encode_words(self, texts: list[str], n: int = 1):
        """As ``encode``, and where each word's ids begin and where each text's words end.

        The changes of a text say how its segmentations differ from the best one: for each,
        a list of (word number, ids of that word).
        """
        if self._store is None or len(self._store) > CACHE:
            self._store = _Store()
        store = self._store
        cut = [words(t) for t in texts]
        self._fill({*chain.from_iterable(cut)} - store.keys())
        number = store.__getitem__
        codes = np.array(list(map(number, chain.from_iterable(cut))), dtype=np.int64)
        begin = np.array(store.begin)
        sizes = begin[codes + 1] - begin[codes]
        ends = np.cumsum(sizes)
        from_word = np.repeat(begin[codes] - (ends - sizes), sizes)
        ids = np.array(store.ids, dtype=np.int32)[from_word + np.arange(len(from_word))]
        word_ends = np.cumsum([0, *map(len, cut)])
        id_ends = np.r_[0, ends][word_ends]
        score, gap = np.array(store.score)[codes], np.array(store.gap)[codes]
        scores, changes = [], []
        for w, a, b in zip(cut, word_ends[:-1], word_ends[1:]):
            total, ranked = math.fsum(score[a:b]), [(0.0, [])]
            gaps, k = gap[a:b], min(n - 1, b - a)
            cheap = np.argpartition(gaps, k - 1)[:k].tolist() if k else []
            for i in sorted(cheap, key=lambda i: (gaps[i], i)):
                choices = self.solve(w[i], n)
                ranked = heapq.nsmallest(
                    n,
                    [
                        (cost + choices[0][0] - own, [*others, (i, x)] if j else others)
                        for cost, others in ranked
                        for j, (own, x) in enumerate(choices)
                    ],
                    key=lambda x: x[0],
                )
            scores.append([total - cost for cost, _ in ranked])
            changes.append([x for _, x in ranked])
        return ids, id_ends, scores, changes, np.r_[0, ends], word_ends

    @staticmethod
    def segmentations(ids, id_ends, changes, cuts, word_ends) -> pa.Array:
        """For each text the ids of its n best segmentations: the best one, changed in some words."""
        parts, sizes, counts = [], [], []
        for begin, end, first, own in zip(id_ends[:-1], id_ends[1:], word_ends[:-1], changes):
            counts.append(len(own))
            for change in own:
                at, size = begin, 0
                for k, other in sorted(change):
                    parts += (ids[at : cuts[first + k]], np.array(other, dtype=np.int32))
                    size += len(parts[-2]) + len(parts[-1])
                    at = cuts[first + k + 1]
                parts.append(ids[at:end])
                sizes.append(size + len(parts[-1]))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        one = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), one)

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text as (score, ids), best first."""
        _, _, scores, changes = self.encode([text], n)
        best = [self.solve(w, 1)[0][1] for w in words(text)]
        out = []
        for score, change in zip(scores[0], changes[0]):
            own = dict(change)
            out.append((score, [i for k, x in enumerate(best) for i in own.get(k, x)]))
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


def read_vocabulary(model_file: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    bytes_at = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if len(set(bytes_at)) != 256:
        raise ValueError("the model has no byte pieces")
    pieces = [
        ""
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        else model.id_to_piece(i).replace(SPACE, " ")
        for i in range(n)
    ]
    if any(re.search(r"[^ ] |\n", p) for p in pieces):
        raise ValueError("a piece reaches from a word into the next one")
    return Vocabulary(pieces, [model.get_score(i) for i in range(n)], bytes_at)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, n: int = 1, text: str = "text"
) -> DataFrame:
    """Add ``ids`` (best segmentation), ``scores`` and ``n_best`` (ids) of the n best, best first."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("scores", T.ArrayType(T.DoubleType())),
            T.StructField("n_best", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        gc.disable()  # nothing here makes cycles, and the store of words is large
        for batch in batches:
            sizes = np.cumsum([len(t or "") for t in batch.column(at).to_pylist()])
            cuts = np.flatnonzero(np.diff(sizes // TOGETHER)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(at).to_pylist()]
                flat, ends, best, changes, cuts, word_ends = own.encode_words(texts, n)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                scores = pa.array(best, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, ids, scores, own.segmentations(flat, ends, changes, cuts, word_ends)],
                    names=[*columns, "ids", "scores", "n_best"],
                )

    return docs.mapInArrow(run, schema)


def decoded(ids, vocabulary: Vocabulary):
    """Column of the text that an array of ids stands for."""

    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([vocabulary.decode(x) for x in column], dtype=object)

    return run(ids)
