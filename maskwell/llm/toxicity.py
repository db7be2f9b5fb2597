"""Toxicity by compression distance: which of two zstandard dictionaries fits a window better.

One dictionary is trained on toxic and one on ordinary text. A text is cut at white space
into windows of about ``window`` bytes, and each window is compressed with either
dictionary. A window that the toxic dictionary makes shorter by at least a calibrated margin
is a hit. The score of a text comes from the hits and the largest margins of its windows by
a logistic calibration.

A toxic text is mostly ordinary text. So the toxic dictionary is trained on those words of
toxic texts that are far more frequent there than in ordinary texts, and carries
the ordinary dictionary's content behind its own: on an ordinary window both do equally
well, and the difference of the two lengths shows toxic content alone.

Fitting uses a bounded sample: at most ``max_texts`` labelled texts a class are expected
(those with the smallest hash of id and text; the number is a documented bound, the scoring
reads all texts whole). Null texts are empty. An empty text has no window and gets the score
of a text without hits. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.llm.common import text_key, whole

#: Length of the stretches that a dictionary is made of: about a word.
SEGMENT = 16
#: A telling word stands after so many different words, and so many times as many as in
#: ordinary texts of the same length.
LEAST, CONTRAST = 8, 12
#: Bytes that one text may give to the training sample; a longer one gives a spread of windows.
TEXT_SAMPLE = 8_000


def windows(text: str, size: int) -> list[bytes]:
    """The text, lower-cased, in windows cut at spaces; unbroken runs are cut by force."""
    data, out, at = text.lower().encode("utf-8", "replace"), [], 0
    while at < len(data):
        end = at + size
        if end < len(data):
            space = data.find(b" ", end, end + size)
            end = end + size if space < 0 else space
        out.append(data[at:end])
        at = end + 1 if data[end : end + 1] == b" " else end
    return out


@dataclass
class Model:
    toxic: bytes  # the two dictionaries
    ordinary: bytes
    window: int
    level: int
    margin: float  # a window with at least this many bytes less is a hit
    weights: np.ndarray  # of the features, the constant first
    _ready: tuple | None = None

    def __reduce__(self):
        return Model, (
            self.toxic, self.ordinary, self.window, self.level, self.margin, self.weights,
        )

    def lengths(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Compressed length of each window with the toxic and the ordinary dictionary."""
        if self._ready is None:
            self._ready = tuple(compressor(d, self.level) for d in (self.toxic, self.ordinary))
        return tuple(compressed(c, parts) for c in self._ready)

    def features(self, text: str) -> np.ndarray:
        return self.features_of([text])[0]

    def features_of(self, texts: list[str]) -> np.ndarray:
        """A row for each text: 1, hits, hits per window, the three largest margins."""
        cut = [windows(t, self.window) for t in texts]
        toxic, ordinary = self.lengths([w for own in cut for w in own])
        gain, at = ordinary - toxic, 0
        out = np.zeros((len(texts), 6))
        out[:, 0] = 1
        for row, own in zip(out, cut):
            mine = gain[at : at + len(own)]
            at += len(own)
            if len(own):
                hits = (mine >= self.margin).sum()
                top = np.sort(mine)[::-1][:3]
                row[1], row[2] = np.log1p(hits), 10 * hits / len(own)
                row[3 : 3 + len(top)] = np.maximum(top, 0) / max(self.margin, 1)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.clip(self.features_of(texts) @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-x))


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False
    )


def compressed(by: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    one = by.compress
    return np.array([len(one(p)) for p in parts], dtype=np.int32)


def _train(samples: list[bytes], size: int, level: int) -> bytes:
    """A dictionary; from very few samples their text itself serves as one."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6, level=level).as_bytes()
    except zstandard.ZstdError:
        return (b" ".join(samples) or b"none")[-size:].rjust(8)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_local(
    toxic: list[str], ordinary: list[str], window: int, size: int, level: int
) -> Model:
    """Dictionaries from two thirds of each class, margin and calibration from the last third."""
    learn_t, learn_o = ([t for i in (0, 1) for t in x[i::3]] for x in (toxic, ordinary))
    rest_t, rest_o = toxic[2::3], ordinary[2::3]
    plain = _train([w for t in learn_o for w in _spread(windows(t, window), window)], 2 * size, level)
    telling = _telling(learn_t, learn_o)
    stretches = [s for t in learn_t for s in _stretches(t, telling)]
    model = Model(_train(stretches, size, level) + plain, plain, window, level, 1.0, np.zeros(6))
    if not rest_t or not rest_o:
        model.weights[0] = -4.0
        return model
    calm = [w for t in rest_o for w in windows(t, window)]
    if calm:
        a, b = model.lengths(calm)
        model.margin = max(1.0, float(np.quantile(b - a, 0.999)) + 1)
    y = np.r_[np.ones(len(rest_t)), np.zeros(len(rest_o))]
    model.weights = _logistic(model.features_of([*rest_t, *rest_o]), y)
    return model


def _stretches(text: str, telling: set[bytes]) -> list[bytes]:
    """The telling words of a text, each with the white space before it."""
    data = text.lower().encode("utf-8", "replace")
    return [m[0] for m in re.finditer(rb"\s?[^\s.,;:!?]+", data) if m[0].strip() in telling]


_WORD = re.compile(rb"[^\s.,;:!?]+")


def _telling(toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Words that stand after far more different words in toxic texts than in ordinary ones.

    Counting what stands before a word, not how often it stands, leaves out the words of
    texts that were copied many times.
    """
    before: list[dict[bytes, set[bytes]]] = [defaultdict(set), defaultdict(set)]
    for seen, texts in zip(before, (toxic, ordinary)):
        for t in texts:
            last = b""
            for w in _WORD.findall(t.lower().encode("utf-8", "replace")):
                seen[w].add(last)
                last = w
    ratio = max(1, sum(map(len, ordinary))) / max(1, sum(map(len, toxic)))
    return {
        w
        for w, x in before[0].items()
        if len(x) >= LEAST and len(x) * ratio > CONTRAST * (len(before[1].get(w, ())) + 0.5)
    }


def _spread(parts: list[bytes], window: int) -> list[bytes]:
    """Evenly spaced windows, so that one very long text does not fill the sample."""
    step = max(1, len(parts) * window // TEXT_SAMPLE)
    return parts[::step]


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "toxic",
    max_texts: int = 3000,
    window: int = 64,
    size: int = 4096,
    level: int = 6,
) -> Model:
    """Fit on a sample of ``labelled``; rows with a null label are left out."""
    rows = labelled.select(
        whole(F.col(text)).alias("text"),
        (F.col(label) == 1).alias("toxic"),
        F.abs(F.xxhash64(text_key(F.col(text)), F.lit("sample")) % 1_000_000).alias("draw"),
    ).filter(F.col("toxic").isNotNull())
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample: dict[bool, list[str]] = {True: [], False: []}
    for kind, n in counts.items():
        part = rows.filter(F.col("toxic") == kind)
        if n > max_texts:
            part = part.filter(F.col("draw") < int(1_000_000 * max_texts / n))
        # Of a text only what the sample may use travels to the driver.
        for (cut,) in part.orderBy("draw", "text").select(_sampled(F.col("text"), window)).limit(max_texts).collect():
            sample[kind].append(cut)
    return fit_local(sample[True], sample[False], window, size, level)


def _sampled(text: Column, window: int) -> Column:
    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        return column.map(
            lambda t: t
            if len(t) <= TEXT_SAMPLE
            else " ".join(w.decode("utf-8", "replace") for w in _spread(windows(t, window), window))
        )

    return run(text)


def score(text: Column, model: Model) -> Column:
    """Column of scores from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts = ["" if t is None else t for t in column]
            yield pd.Series(
                np.concatenate([model.score(texts[i : i + 64]) for i in range(0, len(texts), 64)] or [np.zeros(0)])
            )

    return run(text)
