"""File names, storage keys and content types."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwell.functions.text import WORD

# --- fixed values --------------------------------------------------------------------
ORIGINALS, SANITIZED = "originals/", "sanitized/"
BUCKETS = {ORIGINALS: "pii-originals", SANITIZED: "pii-sanitized"}
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "sql": "text/plain",
    "csv": "text/csv",
    "txt": "text/plain",
    "json": "application/json",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
ROUTES = {
    "pdf": "page",
    "docx": "run",
    "csv": "cell",
    "png": "image",
    "jpg": "image",
    "jpeg": "image",
}
# --- end of fixed values ---------------------------------------------------------------


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def extension(filename: Column) -> Column:
    """Lower-cased text after the last dot; the whole name if it has no dot."""
    return F.lower(F.substring_index(filename, ".", -1))


def content_type(filename: Column) -> Column:
    return _lookup(CONTENT_TYPES, extension(filename), DEFAULT_CONTENT_TYPE)


def route(filename: Column) -> Column:
    """The kind of text unit a file is cut into; ``text`` for anything not listed."""
    return _lookup(ROUTES, extension(filename), "text")


def clean_key(key: Column) -> Column:
    """Replace every character but word characters, dot and hyphen in the last segment."""
    name = F.substring_index(key, "/", -1)
    folder = F.left(key, F.length(key) - F.length(name))
    return F.concat(
        F.when(folder == "/", F.lit("")).otherwise(folder),
        F.regexp_replace(name, rf"[^{WORD}.\-]", "_"),
    )


def clean_key_text(key: str) -> str:
    """``clean_key`` for one key at hand, as when a single object is opened."""
    folder, slash, name = key.rpartition("/")
    return (folder + slash if folder else "") + re.sub(r"[^\w.\-]", "_", name)


def bucket(key: Column) -> Column:
    return F.when(
        F.startswith(key, F.lit(SANITIZED)), F.lit(BUCKETS[SANITIZED])
    ).otherwise(F.lit(BUCKETS[ORIGINALS]))


def path_in_bucket(key: Column) -> Column:
    return (
        F.when(F.startswith(key, F.lit(ORIGINALS)), F.substr(key, F.lit(len(ORIGINALS) + 1)))
        .when(F.startswith(key, F.lit(SANITIZED)), F.substr(key, F.lit(len(SANITIZED) + 1)))
        .otherwise(key)
    )


def original_key(upload_id: Column, filename: Column) -> Column:
    return clean_key(F.concat(F.lit(ORIGINALS), upload_id, F.lit("/"), filename))


def sanitized_key(upload_id: Column, filename: Column) -> Column:
    return clean_key(
        F.concat(F.lit(SANITIZED), upload_id, F.lit("/sanitized_"), filename)
    )


def preview(text: Column, max_chars: int = 2000) -> Column:
    return F.coalesce(F.left(text, F.lit(max_chars)), F.lit("[Preview unavailable]"))


def csv_line(cells: Column) -> Column:
    """One CSV record without its line end; cells are quoted only where they must be."""

    def quote(cell: Column) -> Column:
        return F.when(
            cell.rlike('[,"\r\n]'),
            F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"')),
        ).otherwise(cell)

    lone_blank = (F.size(cells) == 1) & (F.get(cells, F.lit(0)) == "")
    return F.when(lone_blank, F.lit('""')).otherwise(
        F.array_join(F.transform(cells, quote), ",")
    )


def escape_markup(text: Column) -> Column:
    """Escape ampersand and angle brackets, as needed for text put into markup."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text
