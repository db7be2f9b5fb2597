"""Records and cells of CSV text, and text from cells.

A cell that starts with a quote goes on to the closing one, over commas and line ends; a
doubled quote stands for one. What follows the closing quote up to the comma belongs to the
cell. A quote inside a cell that does not start with one is a plain character. A line end
outside quotes (CR, LF or both) ends the record; an empty line is a record without cells.
Quotes that are never closed hold all that is left.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CELL = re.compile(r'"([^"]*(?:""[^"]*)*)"?([^,\r\n]*)|([^,\r\n]*)')
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
_NEXT = re.compile(r"[,\r]")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open at the end of a line, given whether they were at its start."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:  # at the start of a cell
            if line[at : at + 1] == '"':
                at += 1
                inside = True
            else:
                found = _NEXT.search(line, at)
                if not found:
                    return False
                at = found.end()
                continue
        at = _QUOTED.match(line, at).end()
        if at == len(line):
            return True
        inside = False
        found = _NEXT.search(line, at + 1)
        if not found:
            return False
        at = found.end()


def records(text: str) -> list[list[str]]:
    """All records of a text, or of whole records of one."""
    if '"' not in text:
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if not lines[-1]:
            lines.pop()
        return [line.split(",") if line else [] for line in lines]
    out: list[list[str]] = []
    at, end = 0, len(text)
    while at < end:
        cells: list[str] = []
        while True:
            m = _CELL.match(text, at)
            quoted, rest, plain = m.groups()
            cells.append(plain if quoted is None else quoted.replace('""', '"') + rest)
            start, at = at, m.end()
            if at < end and text[at] == ",":
                at += 1
                continue
            break
        if len(cells) == 1 and at == start:
            cells = []
        out.append(cells)
        at += 2 if text.startswith("\r\n", at) else 1
    return out


def line_of(cells: list[str]) -> str:
    """One record without its line end; cells are quoted only where they must be."""
    if cells == [""]:
        return '""'
    return ",".join(
        '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in cells
    )


_CELLS = T.StructType(
    [
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("widths", T.ArrayType(T.IntegerType())),
    ]
)


@F.arrow_udf(_CELLS)
def cells_of(texts: pa.Array) -> pa.Array:
    """All cells of a text in order, and the number of cells of each record."""
    cells, widths = [], []
    for text in texts.to_pylist():
        found = records(text or "")
        cells.append([c for r in found for c in r])
        widths.append([len(r) for r in found])
    return pa.StructArray.from_arrays(
        [pa.array(cells, pa.list_(pa.string())), pa.array(widths, pa.list_(pa.int32()))],
        names=["cells", "widths"],
    )


@F.arrow_udf(T.StringType())
def text_of(cells: pa.Array, widths: pa.Array) -> pa.Array:
    """The text of records that ``cells_of`` has taken apart, each ending with CR LF."""
    out = []
    for flat, sizes in zip(cells.to_pylist(), widths.to_pylist()):
        if flat is None or sizes is None:
            out.append(None)
            continue
        at, lines = 0, []
        for n in sizes:
            lines.append(line_of(flat[at : at + n]) + "\r\n")
            at += n
        out.append("".join(lines))
    return pa.array(out, pa.string())
