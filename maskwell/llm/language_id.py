"""Language identification with interpolated Kneser-Ney character models.

One model per language, over n-grams of lower-cased characters up to ``order``. Highest-order
n-grams count as often as they occur, lower ones once for each character they follow. Every
n-gram's discounted share and every context's weight for the next lower order lie in arrays
sorted by hash. A text goes to the language with the lowest cross-entropy per character.

``score`` is the posterior of that language for a stretch of ``evidence`` characters at the
text's mean cross-entropies. ``rejected`` marks texts whose cross-entropy lies above what
``calm`` of the language's own held-back training stretches have: no learned language fits.
A text that is null or has no letter gets ``und`` and score 0, as does any text if there is
nothing to learn from.

The models are fitted on a bounded sample: about ``max_chunks`` stretches of ``CHUNK``
characters per language, drawn by hash from all training texts. Texts to classify are read
whole, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import mix

CHUNK = 256
UNKNOWN = "und"
#: Characters that are scored together.
PIECE = 2_000_000
_START = 0x110000  # stands before the first character
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)


def gram(padded: np.ndarray, ends: np.ndarray | slice, n: int) -> np.ndarray:
    """Hash of the n-grams whose last characters stand at ``ends``."""
    h, power = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(n):
            at = (
                slice(ends.start - back, ends.stop - back)
                if isinstance(ends, slice)
                else ends - back
            )
            h = h + (padded[at].astype(np.uint64) + np.uint64(1)) * power
            power = power * _FACTOR
        return mix(h + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))


def grams(x: np.ndarray, order: int, only: int = 0) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each character, for n up to ``order`` or one n."""
    padded = np.r_[np.full(order, _START, np.uint32), x]
    ends = slice(order, order + len(x))
    return [gram(padded, ends, n) for n in ([only] if only else range(1, order + 1))]


@dataclass
class Level:
    """N-grams of one order: sorted hashes with log-free shares; contexts with their weight."""

    keys: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _counts(keys: np.ndarray, *others: np.ndarray):
    unique, first, n = np.unique(keys, return_index=True, return_counts=True)
    return unique, n, *(x[first] for x in others)


def fit_language(texts: list[str], order: int) -> list[Level]:
    """Levels from order 1 up; each with discounts estimated from its own counts."""
    every: list[list[np.ndarray]] = [[] for _ in range(order)]
    contexts: list[list[np.ndarray]] = [[] for _ in range(order)]
    for t in texts:
        x = codes(t)
        if not len(x):
            continue
        g = grams(x, order)
        c = grams(np.r_[np.uint32(_START), x[:-1]], order)
        for n in range(order):
            every[n].append(g[n])
            # The context of an n-gram: the n-1 characters before its last one.
            contexts[n].append(c[n - 1] if n else np.zeros(len(x), np.uint64))
    levels: list[Level] = []
    for n in range(order - 1, -1, -1):
        keys, ctx = np.concatenate(every[n]), np.concatenate(contexts[n])
        if n < order - 1:  # one count for each different character in front
            longer = np.concatenate(every[n + 1])
            _, first = np.unique(longer, return_index=True)
            keys, ctx = keys[first], ctx[first]
        unique, count, own = _counts(keys, ctx)
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, n1 / max(1.0, n1 + 2.0 * n2)))
        where, index = np.unique(own, return_inverse=True)
        total = np.bincount(index, weights=count)
        kinds = np.bincount(index)
        share = np.maximum(count - discount, 0) / total[index]
        levels.append(Level(unique, share, where, discount * kinds / total))
    return levels[::-1]


@dataclass
class Model:
    languages: list[str]
    levels: list[list[Level]]
    order: int
    alphabet: int
    limits: np.ndarray  # cross-entropy per character above which a text is rejected
    evidence: float

    def surprise(self, x: np.ndarray) -> np.ndarray:
        """Nats for each character of ``x`` (a row per language). Distinct n-grams only once."""
        back, top = pd.factorize(grams(x, self.order, only=self.order)[0])
        first = np.zeros(len(top), dtype=np.int64)
        first[back[::-1]] = np.arange(len(x) - 1, -1, -1)
        padded = np.r_[np.full(self.order, _START, np.uint32), x]
        g, c = ([gram(padded, first + self.order - e, n) for n in range(1, self.order + 1)] for e in (0, 1))
        out = np.empty((len(self.languages), len(x)), dtype=np.float32)
        for k, levels in enumerate(self.levels):
            p = np.full(len(top), 1.0 / self.alphabet)
            for n, level in enumerate(levels):
                ctx = c[n - 1] if n else np.zeros(len(first), np.uint64)
                weight = lookup(level.contexts, level.weight, ctx, 1.0)
                p = lookup(level.keys, level.share, g[n], 0.0) + weight * p
            out[k] = -np.log(np.maximum(p, 1e-12))[back]
        return out

    def entropy(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per character, a row per text; nan for an empty text."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        held: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> None:
            if held:
                sums = self.surprise(np.concatenate(parts))
                ends = np.cumsum([len(p) for p in parts])[:-1]
                for i, own in zip(held, np.split(sums, ends, axis=1)):
                    total = own.sum(axis=1, dtype=np.float64)
                    out[i] = total if np.isnan(out[i, 0]) else out[i] + total
                held.clear()
                parts.clear()

        size = 0
        lengths = np.zeros(len(texts))
        gap = np.full(self.order - 1, 10, np.uint32)  # line breaks keep texts apart
        for i, t in enumerate(texts):
            x = codes(t)
            lengths[i] = len(x)
            for at in range(0, len(x), PIECE):
                piece = x[at : at + PIECE]
                held.append(i)
                parts.append(np.r_[gap, piece] if at == 0 else piece)
                lengths[i] += len(gap) if at == 0 else 0
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        with np.errstate(invalid="ignore", divide="ignore"):
            return out / lengths[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected; ``und`` if no language was learned."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        h = self.entropy([t if t and any(map(str.isalpha, t)) else "" for t in texts])
        langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rejected = np.ones(len(texts), dtype=bool)
        for i in np.flatnonzero(~np.isnan(h[:, 0])):
            best = int(np.argmin(h[i]))
            langs[i] = self.languages[best]
            score[i] = 1 / np.exp(-self.evidence * (h[i] - h[i, best])).sum()
            rejected[i] = h[i, best] > self.limits[best]
        return langs, score, rejected


def fit_local(chunks: dict[str, list[str]], order: int, evidence: float, calm: float) -> Model:
    """Nine tenths of the stretches make the models, the last tenth the limits."""
    names = sorted(k for k, v in chunks.items() if v)
    levels = [fit_language([c for i, c in enumerate(chunks[k]) if i % 10] or chunks[k], order) for k in names]
    alphabet = len({ch for k in names for c in chunks[k] for ch in c.lower()}) + 1000
    model = Model(names, levels, order, alphabet, np.full(len(names), np.inf), evidence)
    for i, k in enumerate(names):
        own = model.entropy(chunks[k][::10])[:, i]
        own = own[~np.isnan(own)]
        if len(own) >= 10:
            model.limits[i] = np.quantile(own, calm) * 1.25
    return model


def fit(
    training: DataFrame,
    text: str = "text",
    lang: str = "lang",
    order: int = 4,
    max_chunks: int = 2000,
    evidence: float = 20.0,
    calm: float = 0.99,
) -> Model:
    """Fit on rows with a language. Expected sample: ``max_chunks`` stretches a language."""
    rows = training.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = rows.groupBy("lang").agg(F.sum(F.ceil(F.char_length("text") / CHUNK)).alias("n"))
    share = {r["lang"]: max_chunks / max(1, r["n"]) for r in sizes.collect()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for k, t, h in zip(*(c.to_pylist() for c in batch.columns)):
                n = -(-len(t) // CHUNK)
                with np.errstate(over="ignore"):
                    u = mix(np.arange(n, dtype=np.uint64) * _FACTOR + np.uint64(h & 0xFFFFFFFFFFFFFFFF))
                limit = np.uint64(int(min(share[k], 1.0) * (2**63 - 1)))
                for i in np.flatnonzero(u >> np.uint64(1) <= limit).tolist():
                    out.append((k, int(u[i] >> np.uint64(1)), t[i * CHUNK : (i + 1) * CHUNK]))
            yield pa.record_batch(
                [pa.array([o[j] for o in out], ty) for j, ty in enumerate((pa.string(), pa.int64(), pa.string()))],
                names=["lang", "draw", "chunk"],
            )

    sample = rows.withColumn("h", F.xxhash64("text")).mapInArrow(
        draw, "lang string, draw bigint, chunk string"
    )
    chunks: dict[str, list[str]] = {}
    # Copies of a stretch are drawn together; one of them is enough.
    for k, _, c in sample.distinct().orderBy("lang", "draw").collect():
        chunks.setdefault(k, []).append(c)
    return fit_local(chunks, order, evidence, calm)


def predicted(text: Column, model: Model) -> Column:
    """Column of (lang, score, rejected)."""

    @F.pandas_udf(
        T.StructType(
            [
                T.StructField("lang", T.StringType()),
                T.StructField("score", T.DoubleType()),
                T.StructField("rejected", T.BooleanType()),
            ]
        )
    )
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            langs, score, rejected = model.predict(column.tolist())
            yield pd.DataFrame({"lang": langs, "score": score, "rejected": rejected})

    return run(text)
