"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling, scored by its average.

The model has a restaurant for each word that a word can follow (the end, for the first word
of a text), below these one restaurant of words, and below it restaurants of characters. A
word is drawn from the restaurant of the word before; each new table there draws its word
from the word restaurant, and each new table there from the character model, byte by byte,
ending with a space. A character restaurant stands for the bytes before a byte: three, two,
one, none; each context's parent is the context without its first byte, so contexts share
parents, and below the last one all bytes are alike. Longer character contexts are classes
(``CLASSES``), so there are at most 65,536 of them whatever the corpus; the character
restaurants have a proven size bound and travel by broadcast. Words and pairs of words are
unbounded and stay distributed: their counts, tables and probabilities are DataFrames.

One sweep seats all customers of every pair of words anew, given the tables of the others,
then those of every word, whose customers are the tables of its pairs, then those of every
character cell from the longest contexts up. Customers of one dish sit down one after the
other; for frequent dishes in steps that grow with the number already seated. A pair that
training holds once has one table whatever the sweep, so only the others are seated and
travel; sums over all pairs follow from the words' counts and these. After ``burn_in`` sweeps
the predictive probabilities of the samples are averaged.

Texts are held by blocks of some megabytes. Words and pairs travel between the blocks and the
tasks that count them as sorted arrays, one for each block and cell; a cell holds all of a
word's or pair's occurrences, and its answers come back in the order of what was sent.

Tokens are runs without white space with A-Z lower-cased, then one end of text. Null texts
are empty ones: one token, the end. As in the base score, words that training has not seen
are one type: it gets what the known words leave of the probability, so all types sum to 1;
no word is drawn in its context but from the word restaurant. Rows that share an id are
scored one by one. Words are told apart by a 64-bit hash; two that share one (one pair in
some 10^19) are taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from posixpath import dirname

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import mix, partitions, pieces, stage, whole, word_hashes
from maskwell.session import remove, small_batches

END = b"\n"  # no word holds it
STOP = 32  # ends every word in the character model
#: Contexts: the last byte; with 32 classes of the one before; with 8 of the one before that.
CLASSES = (32, 8)
BITS = (5, 3)
LEVELS = 4
SYMBOLS = 256
#: A block ends with the document that reaches this; an end of text counts as a byte.
BLOCK_BYTES = 8_000_000


# --- seating ---------------------------------------------------------------------------------


def seat(n: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, rng) -> np.ndarray:
    """Tables of each dish when its ``n`` customers sit down again.

    ``base`` is the parent's probability of the dish, ``others`` the tables of other dishes.
    """
    t = np.minimum(n, 1)
    seated = t.copy()
    live = np.flatnonzero(n > 1)
    while len(live):
        step = np.minimum(np.maximum(1, seated[live] // 8), n[live] - seated[live])
        new = (theta + d * (others[live] + t[live])) * base[live]
        old = seated[live] - d * t[live]
        chance = new / (new + old)
        came = (rng.random(len(live)) < chance).astype(np.int64)
        many = np.flatnonzero(step > 1)
        came[many] = rng.binomial(step[many], chance[many])
        t[live] += came
        seated[live] += step
        live = live[seated[live] < n[live]]
    return t


@dataclass
class Level:
    """One order of character restaurants: cells by sorted key, sums by context."""

    keys: np.ndarray
    n: np.ndarray
    t: np.ndarray
    total: np.ndarray  # customers of each context
    tables: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, n: np.ndarray, t: np.ndarray, contexts: int) -> Level:
        own = keys // SYMBOLS
        return Level(
            keys, n, t,
            np.bincount(own, weights=n, minlength=contexts),
            np.bincount(own, weights=t, minlength=contexts),
        )

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.n[at], 0), np.where(hit, self.t[at], 0)


CONTEXTS = [1, 256, 256 * CLASSES[0], 256 * CLASSES[0] * CLASSES[1]]


def parent(keys: np.ndarray, level: int) -> np.ndarray:
    """Cell of the parent context, for cells of a level above 0."""
    context, symbol = keys // SYMBOLS, keys % SYMBOLS
    up = np.zeros_like(context) if level == 1 else context >> BITS[level - 2]
    return up * SYMBOLS + symbol


@dataclass
class Characters:
    levels: list[Level]  # from the empty context up
    d: float = 0.5
    theta: float = 1.0

    def probability(self, keys: np.ndarray) -> np.ndarray:
        """Predictive probability of top-level cells."""
        path = [keys]
        for level in range(LEVELS - 1, 0, -1):
            path.append(parent(path[-1], level))
        p = np.full(len(keys), 1.0 / SYMBOLS)
        for level, at in zip(self.levels, reversed(path)):
            n, t = level.find(at)
            context = at // SYMBOLS
            mass = self.theta + self.d * level.tables[context]
            p = (n - self.d * t + mass * p) / (self.theta + level.total[context])
        return p

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word, its end included."""
        if not words:
            return np.zeros(0)
        keys, ends = cells(words)
        unique, back = np.unique(keys, return_inverse=True)
        logs = np.log10(self.probability(unique))[back]
        return np.add.reduceat(logs, np.r_[0, ends[:-1]])


def empty_characters() -> Characters:
    none = np.zeros(0, dtype=np.int64)
    return Characters([Level.of(none, none, none, c) for c in CONTEXTS])


def cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Top-level cell of every byte of every word (and its stop); where each word ends."""
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words])
    place = np.arange(len(data)) - np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, ends]))
    back = [np.where(place >= k, np.r_[np.zeros(k, np.int64), data[:-k]], STOP) for k in (1, 2, 3)]
    context = back[0]
    for b, classes, bits in zip(back[1:], CLASSES, BITS):
        kind = (mix(b.astype(np.uint64) + np.uint64(1)) % np.uint64(classes)).astype(np.int64)
        context = (context << bits) + kind
    return context * SYMBOLS + data, ends


def seat_characters(keys: np.ndarray, n: np.ndarray, before: Characters, rng, sweeps: int = 3) -> Characters:
    """Restaurants of all orders for the customers ``n`` of the longest contexts."""
    model = before
    for _ in range(sweeps):
        own_keys, own_n, levels = keys, n, []
        for k in range(LEVELS - 1, -1, -1):
            base = np.full(len(own_keys), 1.0 / SYMBOLS)
            if k:
                # The parent's predictive probability, from the last state.
                up, path = parent(own_keys, k), []
                for j in range(k - 1, -1, -1):
                    path.append(up)
                    up = parent(up, j) if j else up
                for level, at in zip(model.levels, reversed(path)):
                    cn, ct = level.find(at)
                    mass = model.theta + model.d * level.tables[at // SYMBOLS]
                    base = (cn - model.d * ct + mass * base) / (model.theta + level.total[at // SYMBOLS])
            _, old = model.levels[k].find(own_keys)
            others = np.maximum(model.levels[k].tables[own_keys // SYMBOLS] - old, 0)
            t = seat(own_n, base, others, model.d, model.theta, rng)
            levels.append(Level.of(own_keys, own_n, t, CONTEXTS[k]))
            if k:
                own_keys, index = np.unique(parent(own_keys, k), return_inverse=True)
                own_n = np.bincount(index, weights=t).astype(np.int64)
        model = Characters(levels[::-1], before.d, before.theta)
    return model


# --- counting ----------------------------------------------------------------------------------

#: Spark takes the shuffle files of a query away when it has ended; each step's result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tokens of training whose pairs share a cell.
CELL_TOKENS = 2_000_000

_TEXTS = "block bigint, doc_id array<bigint>, held_out array<boolean>, size array<int>, tokens binary"
_COUNTED = f"{_TEXTS}, cell int, keys binary, n binary, words binary"
_END_KEY = mix(np.array([0x0A], dtype=np.uint64))


def _table(schema: list[tuple], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(schema))


_COUNTED_ARROW = [
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
    ("size", pa.list_(pa.int32())), ("tokens", pa.binary()), ("cell", pa.int32()),
    ("keys", pa.binary()), ("n", pa.binary()), ("words", pa.binary()),
]


def _drop(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        for folder in {dirname(f) for f in table.inputFiles()}:
            remove(table.sparkSession, folder)


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed bytes, all first bytes of its numbers before all second ones."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _array(blob: bytes, kind) -> np.ndarray:
    """The flat array that ``_pack`` was given."""
    size, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _place(keys: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each word key: equal ranges of the keys, so sorted keys lie cell by cell."""
    return ((keys >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def _tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct words of texts by key: tokens as places in that, tokens of each text, keys, words.

    All words are hashed and sorted at once: no word is looked up by itself.
    """
    data = b"\n".join(texts).lower() + b"\n"
    found, at = [], 0
    for piece in pieces(data):
        starts, h = word_hashes(piece)
        found.append((starts + at, h))
        at += len(piece)
    starts, h = (np.concatenate(x) for x in zip(*found))
    begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
    sizes = np.diff(np.searchsorted(starts, begin)) + 1
    ends = np.cumsum(sizes) - 1
    own = np.ones(ends[-1] + 1, dtype=bool)
    own[ends] = False
    keys, place = np.full(len(own), _END_KEY[0]), np.full(len(own), -1, dtype=np.int64)
    keys[own], place[own] = h, starts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.r_[True, keys[1:] != keys[:-1]]
    tokens = np.empty(len(order), dtype=np.int32)
    tokens[order] = np.cumsum(first, dtype=np.int32) - 1
    place = place[order[first]]
    flat = np.frombuffer(data, dtype=np.uint8)
    stops = np.flatnonzero((flat == 32) | ((flat >= 9) & (flat <= 13)))
    stops = stops[np.minimum(np.searchsorted(stops, place), len(stops) - 1)]
    words = [data[a:b] if a >= 0 else END for a, b in zip(place.tolist(), stops.tolist())]
    return tokens, sizes, keys[first], words


def _count(cells: int):
    """Blocks of documents as word numbers, and each block's words with their training counts.

    A block's words are numbered in the order of their keys, so the words of a cell are
    neighbours and an answer for each cell, put end to end, is one for each number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        docs, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, sizes, keys, words = _tokens_of([d[2] for d in docs])
            trained = np.repeat([not d[1] for d in docs], sizes)
            n = np.bincount(tokens[trained], minlength=len(words))
            yield _table(_COUNTED_ARROW, [{
                "block": block, "doc_id": [d[0] for d in docs], "held_out": [d[1] for d in docs],
                "size": sizes.tolist(), "tokens": _pack(tokens),
            }])
            cut = np.searchsorted(_place(keys, cells), np.arange(cells + 1))
            for at in range(0, cells, 64):
                yield _table(_COUNTED_ARROW, [
                    {
                        "block": block, "cell": c, "keys": _pack(keys[cut[c] : cut[c + 1]]),
                        "n": _pack(n[cut[c] : cut[c + 1]].astype(np.int32)),
                        "words": b" ".join(words[cut[c] : cut[c + 1]]),
                    }
                    for c in range(at, min(at + 64, cells)) if cut[c] < cut[c + 1]
                ])

        for batch in batches:
            ids, held_out, texts = batch.columns
            for doc in zip(ids.to_pylist(), held_out.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                docs.append(doc)
                size += len(doc[2]) + 1
                if size >= BLOCK_BYTES:
                    yield from flush()
                    block += 1
                    docs, size = [], 0
        if docs:
            yield from flush()

    return run


_CELL = "cell int, block bigint, at binary, number int, keys binary, c binary, words binary, ones bigint, twos bigint"
_CELL_ARROW = [
    ("cell", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("number", pa.int32()),
    ("keys", pa.binary()), ("c", pa.binary()), ("words", pa.binary()), ("ones", pa.int64()),
    ("twos", pa.int64()),
]


def _cell(rows: pa.Table, least: int) -> pa.Table:
    """What training holds of a cell's keys, and for each block the place of its keys in that.

    Listed are the keys with a count of ``least`` or more. The place of any other is -1 if it
    occurs in training and -2 if it does not.
    """
    cell = rows.column("cell")[0].as_py()
    sent = [_array(x, np.uint64) for x in rows.column("keys").to_pylist()]
    keys, index = np.unique(np.concatenate(sent), return_inverse=True)
    n = np.concatenate([_array(x, np.int32) for x in rows.column("n").to_pylist()])
    c = np.bincount(index, weights=n).astype(np.int64)
    listed = c >= least
    place = np.where(listed, np.cumsum(listed) - 1, np.where(c > 0, -1, -2)).astype(np.int32)
    all_words = b""
    if "words" in rows.column_names:
        first = np.full(len(keys), -1, dtype=np.int64)
        given = [w for x in rows.column("words").to_pylist() for w in x.split(b" ")]
        first[index[::-1]] = np.arange(len(index))[::-1]
        all_words = b" ".join([given[i] for i in first[listed]])
    out = [{
        "cell": cell, "number": int(listed.sum()), "keys": _pack(keys[listed]), "c": _pack(c[listed]),
        "words": all_words, "ones": int((c == 1).sum()), "twos": int((c == 2).sum()),
    }]
    ends = np.cumsum([0, *map(len, sent)])
    for block, a, b in zip(rows.column("block").to_pylist(), ends[:-1], ends[1:]):
        out.append({"cell": cell, "block": block, "at": _pack(place[index[a:b]])})
    return pa.Table.from_batches([_table(_CELL_ARROW, out)])


_NUMBERED = f"{_TEXTS}, ids binary"


def _with_ids(starts):
    """Texts of a block with the ids of its words; -1 for words not in training."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("cell")
        ids = []
        for cell, blob in zip(found.column("cell").to_pylist(), found.column("at").to_pylist()):
            at = _array(blob, np.int32)
            ids.append(np.where(at >= 0, at + starts.value[cell], -1).astype(np.int32))
        return texts.append_column("ids", pa.array([_pack(np.concatenate(ids))], pa.binary()))

    return run


def _pairs_of(sizes: np.ndarray, tokens: np.ndarray, ids: np.ndarray, cells: int):
    """Pairs of known words in a block: the place of each token's pair (-1: none), keys, cells.

    A key is the id of the word before and that of the word; distinct keys come by cell.
    """
    word = ids[tokens].astype(np.int64)
    before = np.r_[word[-1:], word[:-1]]  # an end stands before every text
    key = np.where((word >= 0) & (before >= 0), (before << 32) | word, -1).astype(np.int64)
    keys, index = np.unique(key, return_inverse=True)
    none = int(len(keys) > 0 and keys[0] < 0)
    cell = (mix(keys[none:].astype(np.uint64)) % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    rank = np.full(len(keys), -1, dtype=np.int64)
    rank[none + order] = np.arange(len(order))
    return rank[index], keys[none:][order], cell[order]


_PAIRS_ARROW = [("cell", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())]


def _pairs(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, _, held_out, sizes, tokens, ids = (c[row].as_py() for c in batch.columns)
                sizes = np.array(sizes)
                at, keys, cell = _pairs_of(sizes, _array(tokens, np.int32), _array(ids, np.int32), cells)
                trained = np.repeat(~np.array(held_out, dtype=bool), sizes) & (at >= 0)
                n = np.bincount(at[trained], minlength=len(keys)).astype(np.int32)
                cut = np.searchsorted(cell, np.arange(cells + 1))
                for a in range(0, cells, 64):
                    yield _table(_PAIRS_ARROW, [
                        {
                            "cell": c, "block": block, "keys": _pack(keys[cut[c] : cut[c + 1]]),
                            "n": _pack(n[cut[c] : cut[c + 1]]),
                        }
                        for c in range(a, min(a + 64, cells)) if cut[c] < cut[c + 1]
                    ])

    return run


def _listed(starts, words: bool):
    """A cell's list as rows: words with their ids, or pairs of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, keys, c, text in zip(*(x.to_pylist() for x in batch.columns)):
                c = _array(c, np.int64)
                rank = np.arange(len(c), dtype=np.int32)
                if words:
                    names = text.split(b" ") if len(c) else []
                    one = {"id": rank + np.int32(starts.value[cell]), "word": pa.array(names, pa.binary())}
                else:
                    key = _array(keys, np.int64)
                    one = {"u": (key >> 32).astype(np.int32), "w": (key & 0xFFFFFFFF).astype(np.int32)}
                one = {"cell": np.full(len(c), cell, np.int32), "rank": rank, **one, "c": c}
                whole_cell = pa.table(one)
                yield from whole_cell.to_batches(max_chunksize=50_000)

    return run


# --- sweeps over the words -----------------------------------------------------------------------


@dataclass
class Sample:
    """What one sweep leaves: the character model, and the word restaurant's sums."""

    characters: Characters
    tables: float
    customers: float
    d: float
    theta: float

    def base_mass(self) -> float:
        return (self.theta + self.d * self.tables) / (self.theta + self.customers)

    def predict(self, c: np.ndarray, t: np.ndarray, log_base: np.ndarray) -> np.ndarray:
        own = (c - self.d * t) / (self.theta + self.customers)
        return own + self.base_mass() * 10.0**log_base


#: Words of a cell, one array a column: counts, tables of the context each is, own tables and
#: customers, probability; what is kept of each sample comes after, a row of it for each sample.
_WORDS = "cell int, words binary, c binary, tables binary, t binary, n binary, p binary, kept binary"
_WORDS_ARROW = [("cell", pa.int32()), *((k, pa.binary()) for k in ("words", "c", "tables", "t", "n", "p", "kept"))]
#: Pairs of a cell in the same way.
_LISTS = "cell int, keys binary, c binary, t binary, kept binary"
_LISTS_ARROW = [("cell", pa.int32()), *((k, pa.binary()) for k in ("keys", "c", "t", "kept"))]
#: What a cell of pairs asks of a cell of words or tells it: the words' places there.
_ASKED = "cell int, pairs int, at binary, as_word binary, before binary"
_ASKED_ARROW = [("pairs", pa.int32()), ("at", pa.binary()), ("as_word", pa.binary()), ("before", pa.binary())]
#: Words whose characters are looked at together.
_MANY = 50_000


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows(schema: list[tuple], rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_table(schema, rows)])


def _split(words: bytes) -> list[bytes]:
    return words.split(b" ") if words else []


def _words_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of pairs, and where in that each pair has its context and its word."""
    ids, at = np.unique(np.r_[keys >> 32, keys & 0xFFFFFFFF], return_inverse=True)
    return ids, at[: len(keys)], at[len(keys) :]


def _ask(starts, ids: np.ndarray, pairs: int, **told: np.ndarray) -> list[dict]:
    """A row for each cell of words that the pairs of a cell need, with what they tell it."""
    cell, first = (np.array(x, dtype=np.int64) for x in (list(starts.value), list(starts.value.values())))
    cut = np.searchsorted(ids, np.r_[first, 1 << 32])
    return [
        {
            "cell": int(cell[i]), "pairs": pairs, "at": _pack((ids[a:b] - first[i]).astype(np.int32)),
            **{k: _pack(x[a:b]) for k, x in told.items()},
        }
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if a < b
    ]


def _sums(rows: pa.Table, size: int) -> list[np.ndarray]:
    """Of each word of a cell, what its pairs' tables fall short of: as the word, as the context."""
    out = [np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)]
    for at, *told in zip(*(rows.column(k).to_pylist() for k in ("at", "as_word", "before"))):
        at = _array(at, np.int32)
        for total, x in zip(out, told):
            total[at] += _array(x, np.int64)
    return out


def _first_lists(starts):
    """At first each pair has one table; what the pairs tell of that to their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, keys, c in zip(*(x.to_pylist() for x in batch.columns)):
                one = {"cell": cell, "keys": keys, "c": c, "kept": _pack(np.zeros(0, np.int32))}
                c = _array(c, np.int64)
                yield from _told(starts, one, _words_of(_array(keys, np.int64)), c, np.minimum(c, 1)).to_batches()

    return run


_TOLD_ARROW = [*_LISTS_ARROW, *_ASKED_ARROW]
_TOLD = f"{_LISTS}, {_ASKED.split(', ', 1)[1]}"


def _told(starts, one: dict, words: tuple, c: np.ndarray, t: np.ndarray) -> pa.Table:
    """The row of a cell of pairs, and rows for the cells of words that it tells its tables."""
    ids, u, w = words
    less = (np.bincount(x, weights=c - t, minlength=len(ids)).astype(np.int64) for x in (w, u))
    told = dict(zip(("as_word", "before"), less))
    return _rows(_TOLD_ARROW, [{**one, "t": _pack(t)}, *_ask(starts, ids, one["cell"], **told)])


_CHANCES = "cell int, words int, p binary, tables binary"
_CHANCES_ARROW = [("cell", pa.int32()), ("words", pa.int32()), ("p", pa.binary()), ("tables", pa.binary())]


def _chances(state: pa.Table, asked: pa.Table) -> pa.Table:
    """For each cell of pairs, p and tables of the words it asked for."""
    cell = state.column("cell")[0].as_py()
    p, tables = (_array(state.column(k)[0].as_py(), x) for k, x in (("p", np.float64), ("tables", np.int64)))
    places = [_array(x, np.int32) for x in asked.column("at").to_pylist()]
    return _rows(_CHANCES_ARROW, [
        {"cell": c, "words": cell, "p": _pack(p[at]), "tables": _pack(tables[at])}
        for c, at in zip(asked.column("pairs").to_pylist(), places)
    ])


def _sit(starts, d: float, theta: float, sweep: int, seed: int, keep: bool):
    """Seat the customers of a cell's pairs, given p of the words and tables of the contexts."""

    def run(lists: pa.Table, given: pa.Table) -> pa.Table:
        one = {k: lists.column(k)[0].as_py() for k in _names(_LISTS)}
        rng = np.random.default_rng([seed, sweep, one["cell"], 1])
        keys, c, t = (_array(one[k], np.int64) for k in ("keys", "c", "t"))
        given = given.sort_by("words")
        p, tables = (
            np.concatenate([np.zeros(0, x), *(_array(y, x) for y in given.column(k).to_pylist())])
            for k, x in (("p", np.float64), ("tables", np.int64))
        )
        words = _, u, w = _words_of(keys)
        t = seat(c, p[w], np.maximum(tables[u] - t, 0).astype(np.float64), d, theta, rng)
        if keep:
            one["kept"] = _pack(np.r_[_array(one["kept"], np.int32), t.astype(np.int32)])
        return _told(starts, one, words, c, t)

    return run


_SEATED_ARROW = [
    *_WORDS_ARROW, ("sums", pa.list_(pa.int64())), ("place", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
]
_SEATED = f"{_WORDS}, sums array<bigint>, place array<bigint>, times array<bigint>"


def _sweep(shared, sweep: int, seed: int):
    """Seat the words of a cell given the last sample; with them the customers of the characters.

    A pair's tables are the customers of its word; all of its customers bar those are too many.
    """

    def run(state: pa.Table, told: pa.Table) -> pa.Table:
        sample: Sample = shared.value
        one = {k: state.column(k)[0].as_py() for k in _names(_WORDS)}
        rng = np.random.default_rng([seed, sweep, one["cell"]])
        words, c, t = _split(one["words"]), _array(one["c"], np.int64), _array(one["t"], np.int64)
        as_word, before = _sums(told, len(c))
        n = c - as_word
        keys, sums, new = np.zeros(0, np.int64), np.zeros(0), np.zeros_like(t)
        for a in range(0, len(words), _MANY):
            few, at = words[a : a + _MANY], slice(a, a + _MANY)
            base = 10.0 ** sample.characters.words(few)
            new[at] = seat(n[at], base, np.maximum(sample.tables - t[at], 0), sample.d, sample.theta, rng)
            own, ends = cells(few)
            times = np.repeat(new[at], np.diff(np.r_[0, ends]))
            keys, index = np.unique(np.r_[keys, own], return_inverse=True)
            sums = np.bincount(index, weights=np.r_[sums, times])
        one.update(t=_pack(new), n=_pack(n), tables=_pack(c - before), p=None)
        one["sums"] = [int(x) for x in (new.sum(), n.sum(), (n == 1).sum(), (n == 2).sum())]
        return _rows(_SEATED_ARROW, [{**one, "place": keys, "times": sums.astype(np.int64)}])

    return run


def _predict(shared, keep: bool):
    """Probability of each word in the word restaurant, given its customers and tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample: Sample = shared.value
        for batch in batches:
            for one in batch.to_pylist():
                words = _split(one["words"])
                n, t, tables = (_array(one[k], np.int64) for k in ("n", "t", "tables"))
                logs = [sample.characters.words(words[a : a + _MANY]) for a in range(0, len(words), _MANY)]
                p = sample.predict(n, t, np.concatenate([np.zeros(0), *logs]))
                one["p"] = _pack(p)
                if keep:
                    kept = _array(one["kept"], np.float32)
                    one["kept"] = _pack(np.r_[kept, p.astype(np.float32), tables.astype(np.float32)])
                yield _table(_WORDS_ARROW, [one])

    return run


def _gathered(columns: list[str]):
    """Rows of a cell as one row of arrays."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        one = {"cell": rows.column("cell")[0].as_py()}
        c = rows.column("c").to_numpy()
        if "word" in columns:
            one["words"], zero = b" ".join(rows.column("word").to_pylist()), _pack(np.zeros_like(c))
            one |= {"tables": zero, "t": zero, "kept": _pack(np.zeros(0, np.float32))}
            return _rows(_WORDS_ARROW, [one | {"c": _pack(c), "n": _pack(c), "p": None}])
        u, w = (rows.column(k).to_numpy().astype(np.int64) for k in ("u", "w"))
        return _rows([("cell", pa.int32()), ("keys", pa.binary()), ("c", pa.binary())], [
            one | {"keys": _pack(u << 32 | w), "c": _pack(c)}
        ])

    return run


def _spelled_out(starts, samples: int):
    """Rows of a cell's arrays: of words (with the ``starts`` of their ids) or of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, c, kept in zip(*(x.to_pylist() for x in batch.columns)):
                c = _array(c, np.int64)
                rank = np.arange(len(c), dtype=np.int32)
                one = {"cell": np.full(len(c), cell, np.int32), "rank": rank, "c": c}
                if starts is None:
                    kept = _array(kept, np.int32).reshape(samples, -1)
                    one |= {f"t{k}": kept[k] for k in range(samples)}
                else:
                    kept = _array(kept, np.float32).reshape(2 * samples, -1)
                    one = {"id": rank + np.int32(starts.value[cell]), **one}
                    one |= {f"{x}{k}": kept[2 * k + i] for k in range(samples) for i, x in enumerate(("p", "tables"))}
                yield from pa.table(one).to_batches(max_chunksize=50_000)

    return run


def train(
    words: DataFrame, pairs: DataFrame, d: float, burn_in: int, samples: int, seed: int, theta: float,
    lists: DataFrame | None = None,
):
    """Seat ``words`` (cell, rank, id, word, c) and ``pairs`` (cell, rank, u, w, c; found twice or more).

    Ids count on from cell to cell. ``lists`` holds the pairs once more, as arrays (cell, keys,
    c); left out, they are gathered. Returns words (id, cell, rank, c, and of each sample p in
    ``p0`` ..., tables of the context the word is in ``tables0`` ...) and pairs (cell, rank, c,
    tables ``t0`` ...).

    Words and pairs stay in arrays, a row for each cell. A cell of pairs tells the cells of
    words the sums of its tables, and gets from them the probabilities it needs.
    """
    context = words.sparkSession.sparkContext

    def discount(ones: int, twos: int) -> float:
        return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))

    # A number for each cell of words.
    starts = {r.cell: r.first for r in words.groupBy("cell").agg(F.min("id").alias("first")).collect()}
    starts = context.broadcast(dict(sorted(starts.items())))
    if lists is None:
        lists = pairs.groupBy("cell").applyInArrow(_gathered(["u"]), "cell int, keys binary, c binary")
    pairs_told = stage(lists.mapInArrow(_first_lists(starts), _TOLD))

    def told(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("at").isNotNull()).select(*_names(_ASKED))

    def seat_words(state: DataFrame, sweep: int) -> DataFrame:
        both = state.groupBy("cell").cogroup(told(pairs_told).groupBy("cell"))
        return both.applyInArrow(_sweep(context.broadcast(current), sweep, seed), _SEATED)

    customers, ones, twos = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first()
    current = Sample(empty_characters(), 0.0, float(customers), discount(ones, twos), theta)
    given = words.select("cell", "rank", "word", "c").groupBy("cell").applyInArrow(_gathered(["word"]), _WORDS)

    def first(state: pa.Table, asked: pa.Table) -> pa.Table:
        """The first tables of the contexts."""
        one = {k: state.column(k)[0].as_py() for k in _names(_WORDS)}
        c = _array(one["c"], np.int64)
        return _rows(_WORDS_ARROW, [one | {"tables": _pack(c - _sums(asked, len(c))[1])}])

    state = given.groupBy("cell").cogroup(told(pairs_told).groupBy("cell")).applyInArrow(first, _WORDS)
    state = stage(state.mapInArrow(_predict(context.broadcast(current), False), _WORDS))
    rng = np.random.default_rng(seed)
    for sweep in range(burn_in + samples):
        keep = sweep >= burn_in
        asked = told(pairs_told).select("cell", "pairs", "at")
        chances = state.select("cell", "p", "tables").groupBy("cell").cogroup(asked.groupBy("cell"))
        chances = chances.applyInArrow(_chances, _CHANCES)
        own = pairs_told.filter(F.col("keys").isNotNull()).select(*_names(_LISTS))
        both = own.groupBy("cell").cogroup(chances.groupBy("cell"))
        older = pairs_told
        pairs_told = stage(both.applyInArrow(_sit(starts, d, theta, sweep, seed, keep), _TOLD))
        _drop(older)
        out = stage(seat_words(state, sweep))
        _drop(state)
        # At most 65,536 contexts of 256 symbols, whatever the corpus.
        found = (
            out.select(F.explode(F.arrays_zip("place", "times")).alias("x")).groupBy("x.place")
            .agg(F.sum("x.times").alias("n")).toArrow()
        )
        place, n = (found.column(k).to_numpy().astype(np.int64) for k in ("place", "n"))
        order = np.argsort(place)
        characters = seat_characters(place[order], n[order], current.characters, rng)
        totals = (F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(4))
        tables, customers, ones, twos = out.agg(*totals).first()
        current = Sample(characters, float(tables), float(customers), discount(ones, twos), theta)
        state = out.select(*_names(_WORDS)).mapInArrow(_predict(context.broadcast(current), keep), _WORDS)
        state = stage(state)
        _drop(out)
    of_words = ", ".join(f"p{k} float, tables{k} float" for k in range(samples))
    of_pairs = ", ".join(f"t{k} int" for k in range(samples))
    known = state.select("cell", "c", "kept").mapInArrow(
        _spelled_out(starts, samples), f"id int, cell int, rank int, c bigint, {of_words}"
    )
    own = pairs_told.filter(F.col("keys").isNotNull()).select("cell", "c", "kept")
    return known, own.mapInArrow(_spelled_out(None, samples), f"cell int, rank int, c bigint, {of_pairs}")


# --- scoring -------------------------------------------------------------------------------------

_ANSWER = "block bigint, pair boolean, cell int, c binary, sampled binary"


def _answers(pair: bool, columns: list[str]):
    """For each block its words' or pairs' counts and what the samples say of them, cell by cell."""

    def run(asked: pa.Table, listed: pa.Table) -> pa.Table:
        listed = listed.sort_by("rank")
        # The last two: a key that training holds once (-1, no word has it), one it does not (-2).
        c = np.r_[listed.column("c").to_numpy(), 0, 1].astype(np.int32)
        sampled = np.array([np.r_[listed.column(k).to_numpy(), 0, 1] for k in columns], dtype=np.float32)
        blobs = [_array(x, np.int32) for x in asked.column("at").to_pylist()]
        return pa.table(
            {
                "block": asked.column("block"),
                "pair": np.full(asked.num_rows, pair),
                "cell": asked.column("cell"),
                "c": pa.array([_pack(c[x]) for x in blobs], pa.binary()),
                "sampled": pa.array([_pack(sampled[:, x].T) for x in blobs], pa.binary()),
            }
        )

    return run


def score(
    docs: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    burn_in: int = 1,
    samples: int = 2,
    seed: int = 11,
    theta: float = 1.0,
) -> DataFrame:
    """Score every document; rows where ``held_out`` is true are not learned from.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), held_out.alias("held_out"), whole(F.col(text)).alias("text")
    )
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return _score(given, burn_in, samples, seed, theta)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _score(given: DataFrame, burn_in: int, samples: int, seed: int, theta: float) -> DataFrame:
    spark = given.sparkSession
    share = spark.sparkContext.broadcast
    word_cells = partitions(spark)
    counted = stage(given.mapInArrow(_count(word_cells), _COUNTED))
    sent = counted.filter(F.col("cell").isNotNull()).select("cell", "block", "keys", "n", "words")
    in_words = stage(sent.groupBy("cell").applyInArrow(lambda rows: _cell(rows, 1), _CELL))
    listed = in_words.filter(F.col("block").isNull())
    # One row for each cell, a number that the session sets.
    sizes = {r.cell: r.number for r in listed.select("cell", "number").collect()}
    starts, size = {}, 0
    for cell in sorted(sizes):
        starts[cell], size = size, size + sizes[cell]
    starts = share(starts)
    words = stage(
        listed.select("cell", "keys", "c", "words").mapInArrow(
            _listed(starts, True), "cell int, rank int, id int, word binary, c bigint"
        )
    )
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]

    in_blocks = in_words.filter(F.col("block").isNotNull()).select("cell", "block", "at")
    texts = counted.filter(F.col("cell").isNull()).select(*_names(_TEXTS))
    texts = stage(texts.groupBy("block").cogroup(in_blocks.groupBy("block")).applyInArrow(_with_ids(starts), _NUMBERED))
    _drop(counted)
    pair_cells = max(word_cells, total // CELL_TOKENS)
    sent = texts.mapInArrow(_pairs(pair_cells), "cell int, block bigint, keys binary, n binary")
    in_pairs = stage(sent.groupBy("cell").applyInArrow(lambda rows: _cell(rows, 2), _CELL))
    listed = in_pairs.filter(F.col("block").isNull())
    lists = listed.select("cell", "keys", "c")
    pairs = listed.select("cell", "keys", "c", "words").mapInArrow(
        _listed(starts, False), "cell int, rank int, u int, w int, c bigint"
    )
    ones, twos = listed.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("ones", "twos"))).first()
    d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
    known, seated = train(words, pairs, d, burn_in, samples, seed, theta, lists)
    _drop(words)
    rest = known.agg(*(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(samples))).first()
    unseen = np.maximum(1.0 - np.array(rest), 1e-12)

    of_words = [f"{x}{k}" for x in ("p", "tables") for k in range(samples)]
    of_pairs = [f"t{k}" for k in range(samples)]
    in_pairs = in_pairs.filter(F.col("block").isNotNull()).select("cell", "block", "at")

    def answers(asked: DataFrame, table: DataFrame, pair: bool, columns: list[str]) -> DataFrame:
        table = table.select("cell", "rank", "c", *columns)
        return asked.groupBy("cell").cogroup(table.groupBy("cell")).applyInArrow(_answers(pair, columns), _ANSWER)

    found = answers(in_blocks, known, False, of_words).unionAll(answers(in_pairs, seated, True, of_pairs))

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        """All documents of a block, with what is known of the block's words and pairs."""

        def answer(pair: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
            own = right.filter(pa.compute.equal(right.column("pair"), pair)).sort_by("cell")
            c, sampled = (
                np.concatenate([np.zeros(0, kind), *(_array(x, kind) for x in own.column(k).to_pylist())])
                for k, kind in (("c", np.int32), ("sampled", np.float32))
            )
            return c, sampled.reshape(-1, width).T.astype(np.float64)

        _, ids, held, length, tokens, known_ids = (
            left.column(k)[0].as_py() for k in ("block", "doc_id", "held_out", "size", "tokens", "ids")
        )
        length, tokens = np.array(length), _array(tokens, np.int32)
        at, _, _ = _pairs_of(length, tokens, _array(known_ids, np.int32), pair_cells)
        c, of_word = answer(False, 2 * samples)
        pair_c, pair_t = answer(True, samples)
        pair_c, pair_t = np.r_[pair_c, 0], np.c_[pair_t, np.zeros(samples)]  # no pair: -1
        before = np.r_[tokens[-1:], tokens[:-1]]
        all_of_context = theta + c[before]
        chance = np.zeros(len(tokens))
        for k in range(samples):
            p = np.where(c > 0, of_word[k], unseen[k])[tokens]
            mass = theta + d * of_word[samples + k][before]
            chance += (pair_c[at] - d * pair_t[k][at] + mass * p) / all_of_context
        base = np.log10((c + 0.1) / (total + 0.1 * (size + 1)))[tokens]
        begin = np.r_[0, np.cumsum(length)[:-1]]
        sums = [np.add.reduceat(x, begin) for x in ((c > 0)[tokens].astype(np.int64), base, np.log10(chance / samples))]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": length.astype(np.int64),
                "n_known": sums[0],
                "train_tokens": np.full(len(length), total, dtype=np.int64),
                "base_score": sums[1],
                "score": sums[2],
                "perplexity": 10.0 ** (-sums[2] / length),
            }
        )

    return (
        texts.groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(
            put_together,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
            " base_score double, score double, perplexity double",
        )
    )
