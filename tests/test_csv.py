"""CSV text and files against Python's csv module."""

import csv
import io
import random

import pytest

from maskwell.functions import csv_text
from maskwell.plans import sanitize as upload
from maskwell.sources import readers


def random_csv(rng, n):
    parts = ["a", "b", ",", ",", '"', '"', '"', '""', "\n", "\n", "\r\n", " ", "é"]
    return "".join(rng.choice(parts) for _ in range(n))


def plain(text):
    return list(csv.reader(io.StringIO(text, newline="\n")))


def test_records_and_lines():
    rng = random.Random(1)
    for _ in range(20_000):
        text = random_csv(rng, rng.randint(0, 25))
        want = plain(text)
        assert csv_text.records(text) == want, repr(text)
        out = io.StringIO()
        csv.writer(out).writerows(want)
        assert "".join(csv_text.line_of(r) + "\r\n" for r in want) == out.getvalue()


def test_state_at_line_ends():
    rng = random.Random(2)
    for _ in range(10_000):
        text = random_csv(rng, rng.randint(1, 25)) + "\n"
        inside, held, got = False, [], []
        for line in text.split("\n")[:-1]:
            held.append(line)
            inside = csv_text.ends_inside(line, inside)
            if not inside:
                got += csv_text.records("\n".join(held) + "\n")
                held = []
        if held:
            got += csv_text.records("\n".join(held) + "\n")
        assert got == plain(text), repr(text)


def test_odd_line_ends():
    assert csv_text.records("a\rb,c\r\r\nd") == [["a"], ["b", "c"], [], ["d"]]
    assert csv_text.records('"a\rb"\r"c"') == [["a\rb"], ["c"]]
    assert csv_text.records("") == []


def read(spark, path, size="128m"):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = readers.read_csv_cells(spark, path)
        rows = df.orderBy("path", "block", "row_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return rows


@pytest.mark.parametrize("size, few", [("40b", 100), ("40b", 0), ("500b", 100), ("128m", 100)])
def test_files_over_many_blocks(spark, tmp_path, monkeypatch, size, few):
    """Records over block ends, blocks inside one cell, several files, no cell lost."""
    monkeypatch.setattr(readers, "FEW_BLOCKS", few)
    rng = random.Random(3)
    texts = {f"r{i}.csv": random_csv(rng, 400) for i in range(6)}
    texts["long.csv"] = 'a,b\n"' + "line\n" * 60 + '",x,,\nshort\n\n\n"q ""1"" ",2\n'
    texts["open.csv"] = "a,b\n" * 30 + 'x,"never\nclosed\n' + "y,z\n" * 30
    texts["plain.csv"] = "".join(f"{i},x{i}\r\n" for i in range(80))
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    got = {}
    for r in read(spark, str(tmp_path), size):
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.cells)
    for name, text in texts.items():
        # Quotes that are never closed hold the rest, with a line end after it.
        want = plain(text if text.endswith("\n") else text + "\n")
        assert got.get(name, []) == want, name
    if size == "40b":
        assert len({(r.path, r.block) for r in read(spark, str(tmp_path), size)}) > 20


def test_cells_are_masked_and_written(spark, tmp_path):
    import brute

    text = (
        'name,mail,"my 9876543210"\n"Mr. Rahul\nSharma",a.bc@d.co,"x, ""y"" 10.0.0.1"\n'
        'short\n"",blank first,\na,,b\n,,\n\nx,"",\ny,,""\n1,2,3,4821 7391 6625\n""\n'
    )
    (tmp_path / "in.csv").write_text(text, newline="")
    rows = upload.sanitize_csv(spark, str(tmp_path / "in.csv")).orderBy("block", "row_ord").collect()
    want = [[brute.full(c) if c.strip() else (c, []) for c in row] for row in plain(text)]
    out = io.StringIO()
    csv.writer(out).writerows([[c[0] for c in row] for row in want])
    assert "".join(r.line + "\r\n" for r in rows) == out.getvalue()
    found = [d[1] for row in want for c in row for d in c[1]]
    assert [d.original_value for r in rows for d in r.detections] == found


def test_no_files_with_records(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read(spark, str(tmp_path)) == []
