"""Detection and masking of text columns.

A scan works on an array of texts: one text, the cells of a row or record, the pages of a
document. Detection is a projection in the JVM, in which each pattern runs once per text. It
is added by an explode of one item, so the optimizer neither copies it nor repeats it in a
filter on its result. Rows with a detection, and no others, then go to an Arrow function
that puts the masks in. Its time is near linear in text and detections together, and it is
the same for every text, short or long, alone or in an array. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.functions.detectors import (
    BY_NAME,
    CONTEXTUAL,
    STRUCTURED,
    Detector,
    Signals,
    matches,
)
from maskwell.functions.folding import (
    mask_spans,
    replace_by_last,
    replace_every,
    replace_in_order,
)
from maskwell.functions.text import STRIP_CHARS, computed_once, let
from maskwell.schemas import DETECTIONS
from maskwell.session import small_batches

TOKEN_PREFIX = "PII_TOKEN_"
REDACTED = "[REDACTED]"
# Columns that a scan needs on its way.
_TEXTS, _FIRST, _LAST = "__texts", "__first_masked", "__masked"
_FOUND, _MORE = "__found", "__found_later"


def no_detections() -> Column:
    return F.array().cast(DETECTIONS)


def _run(
    detector: Detector, signals: Signals, method: str | None, nothing: Column
) -> Column:
    def describe(m: Column) -> Column:
        return F.struct(
            F.lit(detector.name).alias("pii_type"),
            m.alias("original_value"),
            detector.mask(m).alias("masked_value"),
            F.lit(method or detector.method).alias("detection_method"),
            F.lit(detector.confidence).alias("confidence"),
        )

    found = F.transform(matches(detector, signals.text), describe)
    return F.when(detector.gate(signals), found).otherwise(nothing)


def detect(
    signals: Signals, detectors: Sequence[Detector] = STRUCTURED, method: str | None = None
) -> Column:
    """All detections of the given detectors, in registry order, then in text order.

    Every detector looks at the same text: they do not compete, so one stretch of text can
    be reported under several types. Null text has no detections.
    """
    nothing = no_detections()
    found = F.concat(*[_run(d, signals, method, nothing) for d in detectors])
    return F.coalesce(found, nothing)


def pick(types: Iterable[str] | None, among: Sequence[Detector] = STRUCTURED) -> list[Detector]:
    """The detectors of the given types, in registry order."""
    if types is None:
        return list(among)
    unknown = set(types) - set(BY_NAME)
    if unknown:
        raise ValueError(f"unknown types: {sorted(unknown)}")
    return [d for d in among if d.name in set(types)]


# --- masking -------------------------------------------------------------------------------


def _replacer(replace: Callable[[str, list[str], list[str]], str]):
    """An Arrow function over (texts, values of each text, masks of each text)."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, values: pa.Array, masks: pa.Array) -> pa.Array:
        out: list[list[str | None] | None] = [None] * len(texts)
        for i in range(len(texts)):
            if texts[i].is_valid:
                rows = zip(texts[i].as_py(), values[i].as_py(), masks[i].as_py())
                out[i] = [t if t is None or not v else replace(t, v, m) for t, v, m in rows]
        return pa.array(out, pa.list_(pa.string()))

    return run


_HOW = {"first": replace_in_order, "every": replace_every, "by last": replace_by_last}


@lru_cache(maxsize=16)
def _function(session: SparkSession, how: str):
    return _replacer(_HOW[how])


def _replaced(
    df: DataFrame, texts: Column, values: Column, masks: Column, how: str = "first"
) -> Column:
    """``texts`` with each value replaced; rows without values never leave the JVM."""
    small_batches(df.sparkSession)
    replace = _function(df.sparkSession, how)
    any_hit = F.exists(values, lambda v: F.size(v) > 0)
    done = replace(F.when(any_hit, texts), F.when(any_hit, values), F.when(any_hit, masks))
    return F.coalesce(done, texts)


def apply_masks(df: DataFrame, texts: Column, found: Column) -> Column:
    """Apply the detections of each text, one after the other, to the text as masked so far.

    Each one replaces the first place where its original value still stands. That place may
    lie before the match, and a value that an earlier mask has changed is not found again.
    """
    values = F.transform(found, lambda d: d["original_value"])
    return _replaced(df, texts, values, F.transform(found, lambda d: d["masked_value"]))


def hits(texts: Column, detectors: Sequence[Detector], method: str | None = None) -> Column:
    """The detections of each text of an array."""

    def one(t: Column) -> Column:
        return let(Signals.compute(t), lambda sig: detect(Signals.read(t, sig), detectors, method))

    return F.transform(texts, one)


@lru_cache(maxsize=64)
def _built(session: SparkSession, kind: str, source: str) -> Column:
    """Detection in a named column, built once per session: building takes about a second."""
    return hits(F.col(source), STRUCTURED if kind == "structured" else CONTEXTUAL)


def _scan_texts(df: DataFrame) -> DataFrame:
    """Fixed formats first, then names and addresses in what the first step has masked.

    Adds, for the array of texts in ``_TEXTS``, the masked texts and the detections of each.
    """
    spark = df.sparkSession
    first = computed_once(df, _FOUND, _built(spark, "structured", _TEXTS))
    first = first.withColumn(_FIRST, apply_masks(df, F.col(_TEXTS), F.col(_FOUND)))
    second = computed_once(first, _MORE, _built(spark, "contextual", _FIRST))
    return second.withColumn(_LAST, apply_masks(df, F.col(_FIRST), F.col(_MORE)))


_BOTH = (_FOUND, _MORE)


def _all_found() -> Column:
    return F.zip_with(*_BOTH, lambda a, b: F.concat(a, b))


def _one_text(df: DataFrame, text: str, found: Callable[[DataFrame], Column]) -> DataFrame:
    """Add ``detections`` and ``masked_text`` of a single step over a text column."""
    rows = computed_once(df.withColumn(_TEXTS, F.array(text)), _FOUND, found(df))
    masked = apply_masks(df, F.col(_TEXTS), F.col(_FOUND))
    return rows.withColumn(_LAST, masked).select(
        *df.columns,
        F.get(_FOUND, F.lit(0)).alias("detections"),
        F.get(_LAST, F.lit(0)).alias("masked_text"),
    )


def scan_structured(
    df: DataFrame,
    text: str = "text",
    types: Iterable[str] | None = None,
    method: str | None = None,
) -> DataFrame:
    """Add ``detections`` and ``masked_text`` for the fixed-format types only."""
    if types is None and method is None:
        return _one_text(df, text, lambda df: _built(df.sparkSession, "structured", _TEXTS))
    return _one_text(df, text, lambda df: hits(F.col(_TEXTS), pick(types), method))


def scan_with(df: DataFrame, detectors: Sequence[Detector], text: str = "text") -> DataFrame:
    """``scan_structured`` with detectors of one's own, in the given order."""
    return _one_text(df, text, lambda df: hits(F.col(_TEXTS), detectors))


def scan_with_maskers(
    df: DataFrame,
    detectors: Sequence[Detector],
    maskers: Mapping[str, Callable[[str], str]],
    text: str = "text",
) -> DataFrame:
    """``scan_with`` where the masks of some types come from Python functions.

    A function runs once for each distinct value of a batch; rows without a value of these
    types stay in the JVM. A function that fails on a value gives the fixed word. This is
    slower than a mask that is a Column.
    """

    @F.arrow_udf("array<string>")
    def masked(types: pa.Array, values: pa.Array, masks: pa.Array) -> pa.Array:
        known: dict[tuple[str, str], str] = {}

        def one(kind: str, value: str, mask: str) -> str:
            if kind not in maskers:
                return mask
            if (kind, value) not in known:
                try:
                    known[kind, value] = maskers[kind](value)
                except Exception:  # noqa: BLE001 - whatever a user's function raises
                    known[kind, value] = REDACTED
            return known[kind, value]

        rows = zip(types.to_pylist(), values.to_pylist(), masks.to_pylist())
        out = [None if t is None else [one(*x) for x in zip(t, v, m)] for t, v, m in rows]
        return pa.array(out, pa.list_(pa.string()))

    rows = computed_once(df.withColumn(_TEXTS, F.array(text)), _FOUND, hits(F.col(_TEXTS), detectors))
    found = F.get(_FOUND, F.lit(0))
    theirs = F.exists(found, lambda d: d["pii_type"].isin(*maskers))
    fields = [F.when(theirs, found[c]) for c in ("pii_type", "original_value", "masked_value")]
    new = F.zip_with(found, masked(*fields), lambda d, m: d.withField("masked_value", m))
    rows = rows.withColumn(_MORE, F.array(F.when(theirs, new).otherwise(found)))
    rows = rows.withColumn(_LAST, apply_masks(df, F.col(_TEXTS), F.col(_MORE)))
    return rows.select(
        *df.columns,
        F.get(_MORE, F.lit(0)).alias("detections"),
        F.get(_LAST, F.lit(0)).alias("masked_text"),
    )


def scan_contextual(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``detections`` and ``masked_text`` for names and addresses only."""
    return _one_text(df, text, lambda df: _built(df.sparkSession, "contextual", _TEXTS))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``detections`` and ``masked_text`` of the whole scan."""
    return _scan_texts(df.withColumn(_TEXTS, F.array(text))).select(
        *df.columns,
        F.get(_all_found(), F.lit(0)).alias("detections"),
        F.get(_LAST, F.lit(0)).alias("masked_text"),
    )


def scan_array(df: DataFrame, texts: str, found: str = "detections") -> DataFrame:
    """Mask an array of texts in place; each text is scanned by itself.

    Adds ``found``, the detections of all texts in order. Blank texts hold none and stay as
    they are; a null text stays null, and a null array has no detections.
    """
    done = _scan_texts(df.withColumn(_TEXTS, F.col(texts)))
    flat = F.coalesce(F.flatten(_all_found()), no_detections())
    masked = [F.col(_LAST).alias(c) if c == texts else F.col(c) for c in df.columns]
    return done.select(*masked, flat.alias(found))


# --- masking by place --------------------------------------------------------------------------

SPANNED = (
    "struct<masked_text:string,detections:array<struct<pii_type:string,original_value:string,"
    "masked_value:string,detection_method:string,confidence:double,start:int,end:int>>>"
)
_MATCHES = "array<struct<number:int,gap:int,size:int,value:string,mask:string>>"


def placed(d: Detector, number: int, signals: Signals) -> Column:
    """Matches of one detector with the characters between them; a value that is no
    detection is null."""
    pattern = F.lit(d.pattern)
    parts = F.struct(
        F.regexp_extract_all(signals.text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(signals.text, pattern, F.lit(d.group)).alias("value"),
        F.split(signals.text, pattern, -1).alias("between"),
    )

    def value_of(m: Column) -> Column:
        m = F.rtrim(m, F.lit(STRIP_CHARS)) if d.trim else m
        return F.when((m != "") & (F.length(m) > (d.longer_than or 0)), m)

    def item(p: Column, i: Column, whole: Column, value: Column) -> Column:
        return F.struct(
            F.lit(number).alias("number"),
            F.length(F.get(p["between"], i)).alias("gap"),
            F.length(whole).alias("size"),
            value.alias("value"),
            d.mask(value).alias("mask"),
        )

    def items(p: Column) -> Column:
        return F.transform(
            p["whole"], lambda m, i: let(value_of(F.get(p["value"], i)), lambda v: item(p, i, m, v))
        )

    return F.when(d.gate(signals), let(parts, items)).otherwise(F.array().cast(_MATCHES))


@lru_cache(maxsize=16)
def _all_placed(session: SparkSession, text: str) -> Column:
    def search(t: Column, sig: Column) -> Column:
        signals = Signals.read(t, sig)
        found = [placed(d, i, signals) for i, d in enumerate(STRUCTURED + CONTEXTUAL)]
        return F.concat(*found)

    return let(F.col(text), lambda t: let(Signals.compute(t), lambda sig: search(t, sig)))


@lru_cache(maxsize=4)
def _span_masker(session: SparkSession):
    about = [(d.name, d.method, d.confidence) for d in STRUCTURED + CONTEXTUAL]

    @F.arrow_udf(SPANNED)
    def run(texts: pa.Array, matches: pa.Array) -> pa.Array:
        return pa.array([mask_spans(t, m, about) for t, m in zip(texts.to_pylist(), matches.to_pylist())], _SPAN_ARROW)

    return run


_SPAN_ARROW = pa.struct(
    [
        ("masked_text", pa.string()),
        (
            "detections",
            pa.list_(
                pa.struct(
                    [
                        ("pii_type", pa.string()),
                        ("original_value", pa.string()),
                        ("masked_value", pa.string()),
                        ("detection_method", pa.string()),
                        ("confidence", pa.float64()),
                        ("start", pa.int32()),
                        ("end", pa.int32()),
                    ]
                )
            ),
        ),
    ]
)


def scan_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``detections`` and ``masked_text`` by the places of all detections in the text.

    All detectors look at the text as given. Of detections that overlap the longest stays,
    then the first in registry order, then in text order. Each that stays is replaced where
    it stands; what others held beyond it is covered with X, so no detected value stays in
    clear. ``detections`` are those that stay, by place, with ``start`` and ``end``.
    """
    small_batches(df.sparkSession)
    rows = computed_once(df, _FOUND, _all_placed(df.sparkSession, text))
    any_hit = F.exists(_FOUND, lambda m: m["value"].isNotNull())
    done = _span_masker(df.sparkSession)(F.when(any_hit, F.col(text)), F.when(any_hit, F.col(_FOUND)))
    rows = rows.withColumn(_LAST, done)
    nothing = F.array().cast(SPANNED.split("detections:", 1)[1][:-1])
    return rows.select(
        *df.columns,
        F.coalesce(F.col(_LAST)["detections"], nothing).alias("detections"),
        F.coalesce(F.col(_LAST)["masked_text"], F.col(text)).alias("masked_text"),
    )


def summarize(detections: Column) -> Column:
    """Map of type to number of detections, keys in first-seen order."""

    def count_in(types: Column) -> Column:
        return F.map_from_entries(
            F.transform(
                F.array_distinct(types),
                lambda k: F.struct(
                    k, F.size(F.filter(types, lambda t: t == k)).cast("bigint")
                ),
            )
        )

    return let(detections["pii_type"], count_in)


def token_of(position: Column) -> Column:
    """Token of the detection at a zero-based position."""
    return F.concat(F.lit(TOKEN_PREFIX), (position + 1).cast("string"))


MODES = ("partial", "token", "redact")


def rewrite(df: DataFrame, mode: str) -> DataFrame:
    """Turn the output of ``scan`` into the chosen mask mode.

    token: the i-th detection owns the token number i. Masked values are replaced in the
    order in which they first appear, each of them everywhere in the text, by the token of
    the last detection that has it. redact: every masked value, wherever it stands, becomes
    one fixed word, and so do the masked values of the detections.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "partial":
        return df
    values = F.col("detections.masked_value")
    if mode == "redact":
        words = F.transform(values, lambda v: F.lit(REDACTED))
        change = lambda d, i: d.withField("masked_value", F.lit(REDACTED))
    else:
        words = F.transform(values, lambda v, i: token_of(i))
        change = lambda d, i: d.withField("token", token_of(i))
    how = {"redact": "every", "token": "by last"}[mode]
    texts = _replaced(df, F.array("masked_text"), F.array(values), F.array(words), how)
    return df.withColumns(
        {"masked_text": F.get(texts, F.lit(0)), "detections": F.transform("detections", change)}
    )


def stats(detections: Column) -> list[Column]:
    """Counts shown next to a scan result."""

    def by_method(name: str) -> Column:
        return F.size(F.filter(detections, lambda d: d["detection_method"] == name))

    total = F.size(detections)
    return [
        total.cast("bigint").alias("pii_found"),
        by_method("regex").cast("bigint").alias("via_regex"),
        (total - by_method("regex")).cast("bigint").alias("via_pattern"),
        F.size(F.array_distinct(detections["pii_type"])).cast("bigint").alias("pii_types"),
    ]


def explode_with_position(df: DataFrame, items: Column, name: str, *keys: str) -> DataFrame:
    """One row per array item, as ``ord`` and the given name.

    The outer form, followed by a filter, keeps the optimizer from testing the array for
    emptiness below the projection that computes it, which would compute it twice.
    """
    rows = df.select(*keys, F.posexplode_outer(items).alias("ord", name))
    return rows.filter(F.col("ord").isNotNull())


def explode_detections(df: DataFrame, *keys: str) -> DataFrame:
    """One row per detection, numbered from 0 within its text."""
    return explode_with_position(df, F.col("detections"), "d", *keys).select(
        *keys, "ord", "d.*"
    )


def mask_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mask the given string columns cell by cell.

    Adds ``detections``: those of all cells of the row, left to right. The cells are scanned
    as one array, so the plan does not grow with the number of columns.
    """
    done = _scan_texts(df.withColumn(_TEXTS, F.array(*columns)))
    masked = {c: F.get(_LAST, F.lit(i)) for i, c in enumerate(columns)}
    found = F.flatten(_all_found()).alias("detections")
    return done.select(*[masked.get(c, F.col(c)).alias(c) for c in df.columns], found)
