"""Registry of sensitive-data detectors.

A detector is a Java regex, a mask written as a Column function, and a gate: a cheap
condition that every text with a match is sure to meet. The gate saves the regex on
the texts that cannot match and never changes a result.

Two habits keep the regexes fast on long texts. Patterns that start with a digit test
that digit before they look behind it, so letters are passed over at once; for patterns
that start with letters the gate looks for their digits instead. And where a failed
start would have to be retried all along one run of characters (``email``, ``address``),
a second alternative swallows the rest of the run: no later start in it can match, so
the cost stays linear. Only capture group 1 counts as a match there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.text import (
    AFTER_WORD,
    DIGIT,
    NOT_AFTER_DIGIT,
    NOT_AFTER_WORD,
    NOT_BEFORE_DIGIT,
    NOT_BEFORE_WORD,
    SPACE,
    STRIP_CHARS,
    contains_any,
    fold_case,
    let,
)

D = DIGIT
S = SPACE
START = NOT_AFTER_WORD
END = NOT_BEFORE_WORD
START_AT_DIGIT = rf"(?={D}){START}"
# What a case-blind [A-Z] accepts, for patterns that run without the flag.
LETTER = r"[A-Za-z\u0130\u0131\u017f\u212a]"


@dataclass(frozen=True)
class Signals:
    """Cheap facts about one text, computed once and shared by all gates.

    Masks never bring in a digit or an @, so the facts of a text also serve as gates for
    the same text after masking.
    """

    text: Column
    has_at: Column
    has_digit: Column
    folded: Column

    @staticmethod
    def compute(text: Column) -> Column:
        return F.struct(
            F.contains(text, F.lit("@")).alias("has_at"),
            text.rlike(D).alias("has_digit"),
            fold_case(text).alias("folded"),
        )

    @classmethod
    def read(cls, text: Column, packed: Column) -> Signals:
        return cls(
            text,
            packed.getField("has_at"),
            packed.getField("has_digit"),
            packed.getField("folded"),
        )


@dataclass(frozen=True)
class Detector:
    name: str
    pattern: str
    mask: Callable[[Column], Column]
    gate: Callable[[Signals], Column]
    method: str = "regex"
    confidence: float = 1.0
    group: int = 0
    trim: bool = False
    longer_than: int = 0
    # The same matches without the run-skipping alternative, for cutting a text at them.
    span_pattern: str | None = None


# --- masks -------------------------------------------------------------------------


def _constant(value: str) -> Callable[[Column], Column]:
    return lambda m: F.lit(value)


def _keep_ends(m: Column, head: int, tail: int) -> Column:
    return F.concat(
        F.left(m, F.lit(head)),
        F.repeat(F.lit("X"), F.length(m) - (head + tail)),
        F.right(m, F.lit(tail)),
    )


def _mask_phone(m: Column) -> Column:
    return F.when(F.startswith(m, F.lit("+91")), _keep_ends(m, 4, 2)).otherwise(
        _keep_ends(m, 1, 2)
    )


def _mask_email(m: Column) -> Column:
    halves = F.split(m, "@")
    words = F.transform(
        F.split(halves[0], "[.]"), lambda w: F.rpad(F.left(w, F.lit(1)), F.length(w), F.lit("*"))
    )
    return F.concat(F.array_join(words, "."), F.lit("@"), halves[1])


def _mask_ip(m: Column) -> Column:
    octets = F.split(m, "[.]")
    hidden = F.transform(F.slice(octets, 2, 3), lambda o: F.repeat(F.lit("X"), F.length(o)))
    return F.concat(octets[0], F.lit("."), F.array_join(hidden, "."))


def _mask_card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.concat(F.left(digits, F.lit(4)), F.lit(" **** **** "), F.right(digits, F.lit(4)))


def _mask_swift(m: Column) -> Column:
    return F.regexp_replace(m, r"(?iu)[A-Za-z]{6}[A-Za-z0-9]{2,5}", "[SWIFT REDACTED]")


# --- gates -------------------------------------------------------------------------


def _at(s: Signals) -> Column:
    return s.has_at


def _digit(s: Signals) -> Column:
    return s.has_digit


def _digits_like(core: str) -> Callable[[Signals], Column]:
    return lambda s: s.has_digit & s.text.rlike(core)


def _words(*words: str) -> Callable[[Signals], Column]:
    return lambda s: contains_any(s.folded, words)


def _digit_and_words(*words: str) -> Callable[[Signals], Column]:
    return lambda s: s.has_digit & contains_any(s.folded, words)


# --- fixed values --------------------------------------------------------------------
# The order of the detectors, their patterns, the provider and street words, the titles,
# and the mask texts must stay as they are for results to agree with existing data.

UPI_PROVIDERS = (
    "upi", "oksbi", "okaxis", "okicici", "okhdfcbank", "paytm", "ybl", "ibl", "axl",
    "waicici", "wahdfcbank",
)

NAME_TITLES = (
    r"Mr\.?", r"Mrs\.?", r"Ms\.?", r"Dr\.?", r"Prof\.?", "Shri", r"Smt\.?", "Sri",
)

STREET_WORDS = (
    "Road", "Street", "Nagar", "Colony", "Sector", "Phase", "Block", "Avenue", "Lane",
    "Marg", "Chowk", "Layout", "Extension", "Society", "Residency", "Apartments?",
    "Towers?", "Floor", "Flat", "Plot",
)
STREET_STEMS = tuple(w.lower().removesuffix("s?") for w in STREET_WORDS)

_MAIL_LOCAL = r"[A-Za-z0-9._%+\-]"
_MAIL = rf"{_MAIL_LOCAL}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{END}"
_MAIL_START = rf"(?:{START}(?=[A-Za-z0-9_])|{AFTER_WORD}(?=[.%+\-]))"
_UPI_START = rf"(?:{START}(?=[A-Za-z0-9_])|{AFTER_WORD}(?=[.\-]))"
_US_START = rf"(?=[+({D}])(?:{START}(?={D})|{AFTER_WORD}(?=[+(]))"
_OCTET = rf"(?:25[0-5]|2[0-4]{D}|[01]?{D}{D}?)"
_STREET_RUN = rf"[A-Za-z0-9{S},\-.]"

STRUCTURED = (
    Detector(
        "aadhaar",
        rf"{START_AT_DIGIT}{D}{{4}}[{S}]{D}{{4}}[{S}]{D}{{4}}{END}",
        lambda m: F.concat(F.left(m, F.lit(4)), F.lit(" XXXX XXXX")),
        _digit,
    ),
    Detector(
        "pan",
        rf"(?iu){START}[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z]{END}",
        lambda m: F.concat(F.left(m, F.lit(2)), F.lit("XXX"), F.substring(m, 6, 5)),
        _digits_like(rf"[0-9](?<={LETTER}[0-9])[0-9]{{3}}{LETTER}"),
    ),
    Detector(
        "phone",
        rf"(?=[+6-9]){NOT_AFTER_DIGIT}(?:\+91[{S}\-]?)?[6-9]{D}{{9}}{NOT_BEFORE_DIGIT}",
        _mask_phone,
        _digit,
    ),
    Detector(
        "us_phone",
        rf"{_US_START}(?:\+1[{S}\-]?)?\(?{D}{{3}}\)?[{S}\-]{D}{{3}}[{S}\-]{D}{{4}}{END}",
        lambda m: F.concat(
            F.lit("***-***-"), F.right(F.translate(m, " -()", ""), F.lit(4))
        ),
        _digit,
    ),
    Detector(
        "email",
        rf"(?iu){_MAIL_START}(?:({_MAIL})|{_MAIL_LOCAL}{{64,}}+)",
        _mask_email,
        _at,
        group=1,
        span_pattern=rf"(?iu){_MAIL_START}{_MAIL}",
    ),
    Detector(
        "ip_address",
        rf"{START_AT_DIGIT}(?:{_OCTET}\.){{3}}{_OCTET}{END}",
        _mask_ip,
        _digit,
    ),
    Detector(
        "passport",
        rf"(?iu){START}[A-Za-z][0-9]{{7}}{END}",
        lambda m: F.concat(F.left(m, F.lit(1)), F.lit("XXXXXXX")),
        _digits_like(rf"[0-9](?<={LETTER}[0-9])[0-9]{{6}}"),
    ),
    Detector(
        "ifsc",
        rf"(?iu){START}[A-Za-z]{{4}}0[A-Za-z0-9]{{6}}{END}",
        lambda m: F.concat(F.left(m, F.lit(4)), F.lit("0XXXXXX")),
        _digits_like(rf"0(?<={LETTER}0)(?:{LETTER}|[0-9]){{6}}"),
    ),
    Detector(
        "account_number",
        rf"{START_AT_DIGIT}(?![6-9]{D}{{9}}{END}){D}{{9,18}}{END}",
        lambda m: F.concat(
            F.repeat(F.lit("X"), F.length(m) - 4), F.right(m, F.lit(4))
        ),
        _digit,
    ),
    Detector(
        "upi",
        rf"(?iu){_UPI_START}[A-Za-z0-9.\-_]{{2,256}}+@(?:{'|'.join(UPI_PROVIDERS)}){END}",
        lambda m: F.concat(F.left(m, F.lit(1)), F.lit("***@"), F.split(m, "@")[1]),
        _at,
    ),
    Detector(
        "credit_card",
        rf"{START_AT_DIGIT}(?:{D}{{4}}[{S}\-]){{3}}{D}{{4}}{END}",
        _mask_card,
        _digit,
    ),
    Detector(
        "cvv",
        rf"(?iu){START}cvv[{S}:]*{D}{{3,4}}{END}",
        lambda m: F.regexp_replace(m, rf"{D}{{3,4}}", "***"),
        _digit_and_words("cvv"),
    ),
    Detector(
        "expiry_date",
        rf"(?=[01]){START}(?:0[1-9]|1[0-2])/[0-9]{{2,4}}{END}",
        lambda m: F.concat(F.lit("**/"), F.split(m, "/")[1]),
        _digit,
    ),
    Detector(
        "device_id",
        rf"(?iu){START}(?:android|ios)-[a-f0-9]{{8,}}{END}",
        lambda m: F.concat(F.split(m, "-")[0], F.lit("-XXXXXXXX")),
        _words("android-", "ios-"),
    ),
    Detector(
        "fingerprint",
        rf"(?iu){START}fp_hash_[a-f0-9]+{END}",
        _constant("fp_hash_XXXXXXXX"),
        _words("fp_hash_"),
    ),
    Detector(
        "face_template",
        rf"(?iu){START}face_tmp_[a-f0-9]+{END}",
        _constant("face_tmp_XXXXXXXX"),
        _words("face_tmp_"),
    ),
    Detector(
        "dob",
        rf"{START_AT_DIGIT}(?:0?[1-9]|[12]{D}|3[01])[/\-](?:0?[1-9]|1[0-2])[/\-]"
        rf"(?:19|20){D}{{2}}{END}",
        _constant("[DOB REDACTED]"),
        _digit,
    ),
    Detector(
        "pincode",
        rf"(?iu)(?:pin|pincode|zip)[{S}:]*[1-9][0-9]{{5}}{END}",
        lambda m: F.regexp_replace(m, "[1-9][0-9]{5}", "XXXXXX"),
        _digit_and_words("pin", "zip"),
    ),
    Detector(
        "vehicle_number",
        rf"(?iu){START}[A-Za-z]{{2}}[{S}\-]?{D}{{2}}[{S}\-]?[A-Za-z]{{1,2}}[{S}\-]?{D}{{4}}{END}",
        _constant("[VEHICLE REDACTED]"),
        _digits_like(rf"{D}(?<={LETTER}[{S}\-]?{D}){D}{{3}}"),
    ),
    Detector(
        "voter_id",
        rf"(?iu){START}[A-Za-z]{{3}}[0-9]{{7}}{END}",
        _constant("[VOTER ID REDACTED]"),
        _digits_like(rf"[0-9](?<={LETTER}{{3}}[0-9])[0-9]{{6}}"),
    ),
    Detector(
        "gstin",
        rf"(?iu){START_AT_DIGIT}{D}{{2}}[A-Za-z]{{5}}{D}{{4}}[A-Za-z][1-9A-Za-z]Z[0-9A-Za-z]{END}",
        _constant("[GSTIN REDACTED]"),
        _digit,
    ),
    Detector(
        "swift_code",
        rf"(?iu)(?:swift|bic)[{S}:]+[A-Za-z]{{6}}[A-Za-z0-9]{{2}}(?:[A-Za-z0-9]{{3}})?",
        _mask_swift,
        _words("swift", "bic"),
    ),
)

CONTEXTUAL = (
    Detector(
        "name",
        rf"(?=[MDPS]){START}(?:{'|'.join(NAME_TITLES)})[{S}]+"
        rf"[A-Z][a-z]+(?:[{S}]+[A-Z][a-z]+){{0,2}}{END}",
        _constant("[NAME REDACTED]"),
        lambda s: contains_any(s.text, [t.removesuffix(r"\.?") for t in NAME_TITLES]),
        method="pattern",
        confidence=0.9,
    ),
    Detector(
        "address",
        rf"(?iu){START_AT_DIGIT}(?:"
        rf"({D}+[,{S}]{_STREET_RUN}+(?:{'|'.join(STREET_WORDS)})[^.\n]{{0,60}})"
        rf"|{D}+[,{S}]{_STREET_RUN}*+{NOT_BEFORE_DIGIT})",
        lambda m: F.concat(F.regexp_extract(m, rf"^{D}+", 0), F.lit(", ***, ***, ***")),
        lambda s: s.has_digit
        & s.text.rlike(rf"{D}[,{S}]")
        & let(fold_case(s.text), lambda folded: contains_any(folded, STREET_STEMS)),
        method="pattern",
        confidence=0.85,
        group=1,
        trim=True,
        longer_than=10,
    ),
)

# The types looked for in the words of an image.
IMAGE_TYPES = ("credit_card", "cvv", "phone", "us_phone", "email")
# --- end of fixed values ---------------------------------------------------------------

BY_NAME = {d.name: d for d in STRUCTURED + CONTEXTUAL}


def matches(detector: Detector, text: Column) -> Column:
    """All non-overlapping matches of one detector, in text order."""
    found = F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(detector.group))
    if detector.group:
        found = F.filter(found, lambda m: m != "")
    if detector.trim:
        found = F.transform(found, lambda m: F.rtrim(m, F.lit(STRIP_CHARS)))
    if detector.longer_than:
        found = F.filter(found, lambda m: F.length(m) > detector.longer_than)
    return found
