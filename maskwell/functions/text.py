"""Small Column helpers shared by the scanners.

The scanned texts follow Python's idea of a digit, a space and a word character,
so those classes are spelled out here in Java regex syntax instead of relying on
``\\d``, ``\\s``, ``\\w`` and ``\\b``, whose meaning changes with Java's flags and
version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Java character classes, to be used inside square brackets.
DIGIT = r"\p{Nd}"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# Java looks back by code point only if the look-behind itself holds a character
# beyond the basic plane. U+10000 is a letter, so it adds nothing to the class.
_BEYOND = "\U00010000"
NOT_AFTER_WORD = f"(?<![{WORD}{_BEYOND}])"
AFTER_WORD = f"(?<=[{WORD}{_BEYOND}])"
NOT_BEFORE_WORD = rf"(?![{WORD}])"
_DIGIT_BEYOND = "\U0001d7ce"
NOT_AFTER_DIGIT = f"(?<![{DIGIT}{_DIGIT_BEYOND}])"
NOT_BEFORE_DIGIT = rf"(?!{DIGIT})"

# Every character Python's str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The four non-ASCII characters that match an ASCII letter when case is ignored.
_FOLDED_FROM = "\u0130\u0131\u017f\u212a"
_FOLDED_TO = "iisk"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body`` so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column as the only item of an exploded array.

    A later filter on a plain column is moved below it and computes it a second time. No
    filter passes the explode, and the outer form keeps every row.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def fold_case(text: Column) -> Column:
    """Lower-case text in which ``contains`` finds whatever a case-blind regex would."""
    unusual = contains_any(text, _FOLDED_FROM)
    return F.when(unusual, F.lower(F.translate(text, _FOLDED_FROM, _FOLDED_TO))).otherwise(
        F.lower(text)
    )


def is_blank(text: Column) -> Column:
    return F.trim(text, F.lit(STRIP_CHARS)) == ""


def decode_utf8(content: Column) -> Column:
    """Bytes to text, with U+FFFD in place of what is not UTF-8."""
    return F.make_valid_utf8(content.cast("string"))
