"""Word boxes to black out on images, from a table of recognised words.

Input rows are words with their place (doc, block, paragraph, line, order) and box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from maskwell.functions.detectors import IMAGE_TYPES as WANTED
from maskwell.functions.detectors import Signals
from maskwell.functions.text import STRIP_CHARS, computed_once, let
from maskwell.operators.scan import pick, placed

LINE = ("doc_id", "block_num", "par_num", "line_num")
METHOD = "regex+ocr"
MARGIN = 3
#: The types looked for, in registry order.
IMAGE_TYPES = tuple(d.name for d in pick(WANTED))
_TEXT, _WHOLE, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()


def _rows_of(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


SPANS = _rows_of(
    pii_type=_TEXT, original_value=_TEXT, masked_value=_TEXT, detection_method=_TEXT,
    confidence=_REAL, start=_WHOLE, end=_WHOLE, ord=_WHOLE,
)
BOXES = _rows_of(
    ord=_WHOLE, pii_type=_TEXT, word_ord=_WHOLE, word=_TEXT,
    x0=_WHOLE, y0=_WHOLE, x1=_WHOLE, y1=_WHOLE,
)


_PLACE = ("word_ord", "left", "top", "width", "height")


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for words of a line that follow each other: the line, their numbers, the words."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, dtype=bool)
        new[0] = True
        keys = batch.columns[: len(LINE)]
        for key in keys:
            other = pc.not_equal(key.slice(1), key.slice(0, n - 1))
            new[1:] |= pc.fill_null(other, True).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        ends = np.r_[first, n].astype(np.int32)
        place = batch.columns[len(LINE) : -1]
        flat = np.stack([pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in place], axis=1)
        gone = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in place], axis=1)
        numbers = pa.array(flat.ravel(), type=place[0].type, mask=gone.ravel())
        yield pa.record_batch(
            [
                *(key.take(pa.array(first)) for key in keys),
                pa.ListArray.from_arrays(pa.array(ends * len(_PLACE)), numbers),
                pa.ListArray.from_arrays(pa.array(ends), batch.columns[-1]),
            ],
            names=[*LINE, "numbers", "texts"],
        )


def lines(words: DataFrame) -> DataFrame:
    """One row per line: its words in order, and its text.

    Blank words are left out; the others are joined by one space. Words that lie together in
    the table travel as one row with two flat lists, which take a fraction of a row each; words
    in any other order are put together as well.
    """
    types = [words.schema[c].dataType for c in _PLACE]
    wide = _WHOLE if set(types) <= {_WHOLE} else T.LongType() if set(types) <= {_WHOLE, T.LongType()} else _REAL
    given = words.withColumn("word", F.trim(F.col("text"), F.lit(STRIP_CHARS))).filter("word != ''")
    given = given.select(*LINE, *[F.col(c).cast(wide) for c in _PLACE], "word")
    key = T.StructType([T.StructField(c, words.schema[c].dataType) for c in LINE])
    runs = given.mapInArrow(_in_runs, key.add("numbers", T.ArrayType(wide)).add("texts", T.ArrayType(_TEXT)))
    order = ("word_ord", "word", "left", "top", "width", "height")

    def entry(word: Column, i: Column) -> Column:
        at = {c: F.get("numbers", i * len(_PLACE) + k).cast(types[k]) for k, c in enumerate(_PLACE)}
        return F.struct(*[({"word": word} | at)[c].alias(c) for c in order])

    return (
        runs.groupBy(*LINE)
        .agg(F.collect_list(F.struct("numbers", "texts")).alias("runs"))
        .select(*LINE, F.flatten("runs.numbers").alias("numbers"), F.flatten("runs.texts").alias("texts"))
        .select(*LINE, F.array_sort(F.transform("texts", entry)).alias("words"))
        .withColumn("line_text", F.array_join("words.word", " "))
    )


def _line_hits(text: Column) -> Column:
    """Matches of all image types in a line, with the characters between them."""

    def search(t: Column, sig: Column) -> Column:
        signals = Signals.read(t, sig)
        return F.concat(*[placed(d, i, signals) for i, d in enumerate(pick(IMAGE_TYPES))])

    return let(text, lambda t: let(Signals.compute(t), lambda sig: search(t, sig)))


def _hit_lines(words: DataFrame) -> DataFrame:
    """The lines with a detection, and their matches."""
    # exploding a one-element array drops the other lines without a second search
    hits = computed_once(lines(words), "hits", _line_hits(F.col("line_text")))
    return hits.filter(F.exists("hits", lambda h: h["value"].isNotNull()))


def _located(matches: list[dict]) -> list[dict]:
    """The detections of a line, numbered, with their place; one step for each match."""
    out: list[dict] = []
    at, last = 0, None
    for m in matches:
        if m["number"] != last:
            at, last = 0, m["number"]
        at += m["gap"]
        if m["value"] is not None:
            kind = IMAGE_TYPES[m["number"]]
            out.append(
                {
                    "pii_type": kind, "original_value": m["value"], "masked_value": m["mask"],
                    "detection_method": METHOD, "confidence": 1.0, "start": at,
                    "end": at + len(m["value"]), "ord": len(out),
                }
            )
        at += m["size"]
    return out


@F.arrow_udf(SPANS)
def _spans(matches: pa.Array) -> pa.Array:
    return pa.array([_located(m) for m in matches.to_pylist()], to_arrow_type(SPANS))


def line_detections(words: DataFrame) -> DataFrame:
    """One row per detection in a line, with its span."""
    rows = _hit_lines(words).select(*LINE, F.explode(_spans("hits")).alias("s"))
    return rows.select(*LINE, "s.*")


def _stays_visible(span: dict, word: str, start: int) -> bool:
    """Card: its first group. Phones: the country code. Email: from the @ on."""
    kind = span["pii_type"]
    if kind == "credit_card":
        return start == span["start"]
    if kind in ("phone", "us_phone"):
        return word.startswith("+")
    at = span["original_value"].find("@")
    return kind == "email" and at >= 0 and start >= span["start"] + at


def _covered(words: list[dict], matches: list[dict]) -> list[dict]:
    """The box of every word that a detection covers.

    Words and detections are met in order of place: a detection goes back only over the words
    that an earlier one covers too.
    """
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w["word"]) + 1
    out = []
    first = 0
    for span in sorted(_located(matches), key=lambda s: s["start"]):
        while first < len(words) and starts[first] + len(words[first]["word"]) <= span["start"]:
            first += 1
        for i in range(first, len(words)):
            if starts[i] >= span["end"]:
                break
            w = words[i]
            if not _stays_visible(span, w["word"], starts[i]):
                out.append(
                    {
                        "ord": span["ord"], "pii_type": span["pii_type"], "word_ord": w["word_ord"],
                        "word": w["word"], "x0": w["left"] - MARGIN, "y0": w["top"] - MARGIN,
                        "x1": w["left"] + w["width"] + MARGIN,
                        "y1": w["top"] + w["height"] + MARGIN,
                    }
                )
    return out


@F.arrow_udf(BOXES)
def _boxes(words: pa.Array, matches: pa.Array) -> pa.Array:
    rows = zip(words.to_pylist(), matches.to_pylist())
    return pa.array([_covered(w, m) for w, m in rows], to_arrow_type(BOXES))


def redaction_boxes(words: DataFrame) -> DataFrame:
    """Boxes to black out: one row per detection and covered word.

    Only the lines with a detection are looked at word by word, each once, in its own row.
    """
    return _hit_lines(words).select(*LINE, F.explode(_boxes("words", "hits")).alias("b")).select(
        *LINE, "b.*"
    )
