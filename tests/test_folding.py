import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from maskwell.functions import folding
from maskwell.operators import scan as S


@pytest.mark.parametrize("piece", [3, 7, 512])
def test_against_one_by_one(monkeypatch, piece):
    monkeypatch.setattr(folding, "PIECE", piece)
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("ab1X;\n") for _ in range(rng.randint(0, 60)))
        values = ["".join(rng.choice("ab1X") for _ in range(rng.randint(1, 4))) for _ in range(12)]
        masks = [rng.choice(["X", "XX", "a", "[b]", "1X", "", v]) for v in values]
        first = every = by_last = text
        for v, m in zip(values, masks):
            first, every = first.replace(v, m, 1), every.replace(v, m)
        for v, m in dict(zip(values, masks)).items():
            by_last = by_last.replace(v, m)
        assert folding.replace_in_order(text, values, masks) == first
        assert folding.replace_every(text, values, masks) == every
        assert folding.replace_by_last(text, values, masks) == by_last


@pytest.mark.parametrize("replace", [folding.replace_in_order, folding.replace_every])
@pytest.mark.parametrize("between", [" ", "\n", ""])
def test_cost_follows_the_hits(replace, between):
    """Ten times the text and hits take about ten times as long, whatever stands between."""

    def seconds(n):
        values = [f"u{i}@m.co" for i in range(n)]
        text, masks = between.join(values), [v.replace("@", "*") for v in values]
        start = time.perf_counter()
        replace(text, values, masks)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(30_000) < 40 * max(seconds(3_000), 0.01)


def dump(n):
    return "".join(
        f"insert into t values ('ann{i}@mail.com', '10.0.{i % 256}.{i // 256 % 256}',"
        f" '4821 7391 {i % 10000:04d}');\n"
        for i in range(n)
    )


def test_texts_of_all_lengths_are_scanned_alike(spark):
    texts = ["short a.bc@d.co", dump(40), "Mr. Rahul Sharma of 12, Park Lane block 5\n" * 30, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in S.scan(df).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i].masked_text is None and got[i].detections == []
            continue
        masked, found = brute.full(text)
        assert got[i].masked_text == masked
        assert [(d.pii_type, d.original_value, d.masked_value) for d in got[i].detections] == found


@pytest.mark.parametrize("mode", ["partial", "token", "redact"])
def test_many_detections_in_one_text(spark, mode):
    df = spark.createDataFrame([(dump(20000),)], "text string")
    start = time.time()
    done = S.rewrite(S.scan(df), mode)
    r = done.select(F.size("detections").alias("n"), "masked_text").first()
    assert r.n >= 60000 and "ann7@" not in r.masked_text
    assert time.time() - start < 60


def test_arrays_are_masked_in_place(spark):
    rows = [(1, ["a.bc@d.co", "", None, " \t", "4821 7391", "6625 10.0.0.1"]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, parts array<string>")
    got = {r.id: r for r in S.scan_array(df, "parts").collect()}
    assert got[1].parts == ["a.b*@d.co", "", None, " \t", "4821 7391", "6625 10.X.X.X"]
    assert [d.pii_type for d in got[1].detections] == ["email", "ip_address"]
    assert (got[2].parts, got[2].detections) == ([], [])
    assert (got[3].parts, got[3].detections) == (None, [])


# --- masking by place ------------------------------------------------------------------------


def test_settled_spans():
    rng = random.Random(4)
    for _ in range(500):
        spans = []
        for i in range(rng.randint(0, 12)):
            a = rng.randint(0, 40)
            spans.append((a, a + rng.randint(1, 9), i))
        kept = folding.settled(spans)
        assert kept == sorted(kept) and set(kept) <= set(spans)
        assert all(x[1] <= y[0] for x, y in zip(kept, kept[1:]))
        for s in set(spans) - set(kept):  # something at least as long stands in its way
            assert any(k[0] < s[1] and s[0] < k[1] and k[1] - k[0] >= s[1] - s[0] for k in kept)
        cover = {i for a, b, _ in spans for i in range(a, b)}
        rest = [i for a, b in folding._beyond(spans, kept) for i in range(a, b)]
        held = {i for a, b, _ in kept for i in range(a, b)}
        assert len(rest) == len(set(rest)) and set(rest) == cover - held


def test_no_detected_value_stays_in_clear(spark):
    """On random texts: what stays is masked where it stands, the rest of a hit is covered."""
    from test_scan import random_texts

    texts = random_texts(1500, seed=21) + ["12/05/2024 and 05/2024", "4012 3456 7890 1234", "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, text string").repartition(4)
    for r in S.scan_spans(df).collect():
        if r.text is None:
            assert r.masked_text is None and r.detections == []
            continue
        at, out = 0, ""
        for d in r.detections:
            assert r.text[d.start : d.end] == d.original_value and d.start >= at
            gap = r.text[at : d.start]
            shown = r.masked_text[len(out) : len(out) + len(gap)]
            assert all(s in (g, "X") for s, g in zip(shown, gap))
            out += shown + d.masked_value
            at = d.end
        rest = r.masked_text[len(out) :]
        assert r.masked_text.startswith(out) and len(rest) == len(r.text) - at
        found = brute.structured(r.text) + brute.contextual(r.text)
        kept = [(d.pii_type, d.original_value) for d in r.detections]
        assert {k for k in kept} <= {f[:2] for f in found}
        if found:
            longest = max(len(f[1]) for f in found)
            assert longest in {len(v) for _, v in kept}


def test_python_maskers(spark):
    from maskwell.functions.detectors import BY_NAME, Detector

    badge = Detector("badge", r"B-[0-9]+", lambda m: F.lit("B-*"), lambda s: s.has_digit)
    calls = {"badge": lambda v: "#" + str(1 // (int(v[2:]) - 7))}
    texts = ["B-8 a.bc@d.co B-7 B-8", "none", None, "a.bc@d.co"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    done = S.scan_with_maskers(df, [badge, BY_NAME["email"]], calls)
    got = {r.id: r for r in done.collect()}
    assert got[0].masked_text == "#1 a.b*@d.co [REDACTED] #1"
    assert [d.masked_value for d in got[0].detections] == ["#1", "[REDACTED]", "#1", "a.b*@d.co"]
    assert (got[1].masked_text, got[2].masked_text, got[3].masked_text) == ("none", None, "a.b*@d.co")
    assert got[2].detections == []
