"""Golden rows, random texts against the restated rules, and the mask modes."""

import pathlib
import random
import re
import time

import brute
import pytest
from pyspark.sql import functions as F

from maskwell.functions.detectors import BY_NAME, matches
from maskwell.operators import scan as S

ROOT = pathlib.Path(__file__).resolve().parent.parent

GOLDEN = [
    (name, source.replace("⏎", "\n"), want.replace("⏎", "\n"))
    for name, source, want in re.findall(
        r"\*\*(G\d)\*\* in: `(.*?)`\n- out.*?: `(.*?)`\n", (ROOT / "FIXTURES.md").read_text()
    )
]

PIECES = [
    "4821 7391 6625", "4821 7391 6625", "٤٤٤٤ 1234 5678", "1234\x1c5678\x1f9012",
    "ABCDE1234F", "abcde1234f", "ABCDK1234F", "İBCDE1234ſ", "+91 9876543210", "+91-9876543210",
    "9876543210", "919876543210", "9٧٧٧٧٧٧٧٧٧", "(212) 555-0187", "+1 212-555-0187", "212 555 0187",
    "ann.b.c@mail.example.com", "x..y@z.co", "%a@b.co", ".a@b.co", "é.ann@b.org", "ann@b", "a" * 70 + "@x.com",
    "a.b." * 30 + "c", "a" * 80 + " @", "10.0.0.255", "256.1.1.1", "1.2.3.4.5", "U1234567", "SBIN0ABC123", "HDFC0K23456",
    "123456789", "12345678901234567", "1234567890123456789", "bob@paytm", "b_1@PAYTM", "x.y-z@upi", "-bob@upi", "ann@okaxıs",
    "4012-3456 7890-1234", "cvv 123", "CVV:: 9999", "cvv12345", "08/2027", "12/05/2024", "1-2-1999", "31/12/2001",
    "android-9f31acb8d1", "İOS-deadbeef1", "ıoſ-deadbeef99", "fp_haſh_ab12", "face_tmp_00ff", "pin 380015",
    "pıncode:380015", "zip 123456", "GJ 01 AB 1234", "in 12 of 2024", "DL3C1234", "ABC1234567", "22AAAAA0000A1Z5",
    "swift: HDFCINBB", "bıc HDFCINBBXXX", "ſwift movement", "Mr. Rahul Sharma", "Dr  Meera Nair Iyer Rao", "dr. Who", "Sri Ravi",
    "Prof.Anand", "Smt. Asha Rani", "12, Park Lane near gate", "7 Road", "45 MG Road, Pune", "9  \t Old Mill Towers x",
    "12٣ MG Road xyz", "5 a b c d", "77,, Flat", "123 ſtreet 4 ſtreet", "8 Extension ", "१२, Nagar Marg",
]
GLUE = [
    " ", " ", ", ", "\n", ".", "-", "x", "_", "é", "ि", "²", "½", "‍", "‿", "😀", "𝐀", "𝟗", "1",
    "", "(", "@", ":", "/", "́", "\x1d", "Ⅷ", "ª", "क", "中", " a b ", "; ",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    out = ["", " ", "\n\t", "plain words only"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 7)):
            parts += [rng.choice(GLUE), rng.choice(PIECES), rng.choice(GLUE)]
        out.append("".join(parts))
    return out


def as_tuples(detections):
    return [(d.pii_type, d.original_value, d.masked_value) for d in detections]


@pytest.mark.parametrize("name, source, want", GOLDEN)
def test_golden(spark, name, source, want):
    df = spark.createDataFrame([(source,)], "text string")
    assert S.scan(df).first().masked_text == want


def test_random_texts(spark):
    texts = random_texts(4000, seed=7)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    rows = S.scan(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        masked, detections = brute.full(r.text)
        assert as_tuples(r.detections) == detections, repr(r.text)
        assert r.masked_text == masked, repr(r.text)


def test_every_type_fires_in_random_texts():
    seen = {d[0] for t in random_texts(2000, seed=7) for d in brute.full(t)[1]}
    assert seen == set(BY_NAME)


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    r = S.scan(df).first()
    assert r.masked_text is None and r.detections == []


def test_contextual_alone_reads_the_text_as_given(spark):
    texts = random_texts(500, seed=11)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for r in S.scan_contextual(df).collect():
        want = brute.contextual(r.text)
        assert as_tuples(r.detections) == want
        assert r.masked_text == brute.apply(r.text, want)


def test_address_cut_agrees_with_the_plain_pattern(spark):
    rng = random.Random(3)
    words = ["12", "7", "٣", "5٣", "٣5", "road", "Street", "towers", "a", "b.", "c,", "é", "-", "\n", "(",
             "flat", "  ", "apartment", "99", "plotx", "ſtreet"]
    glue = [" ", " ", " ", "", ", ", "\n"]
    texts = [
        "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(1, 40)))
        for _ in range(4000)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found = matches(BY_NAME["address"], F.col("text"))
    for r in df.select("text", found.alias("found")).collect():
        assert r.found == [a[1] for a in brute.addresses(r.text)], repr(r.text)


@pytest.mark.parametrize(
    "text",
    [
        "".join(f"{i} word " for i in range(20000)),
        "road " + "".join(f"{i} word " for i in range(20000)),
        "5 flat " + "".join(f"{i} word " for i in range(20000)) + " x 9 ",
        "a.b" * 60000 + " x@y ",
        "7 " + " " * 100000 + "x",
        "1," * 60000,
        "insert into " * 20000 + "union select " * 20000 + "<script>" * 20000 + "<iframe " * 20000,
    ],
    ids=["numbers", "keyword first", "one match", "dotted run", "blanks", "commas", "openers"],
)
def test_long_hostile_texts_stay_cheap(spark, text):
    from maskwell.functions.threats import malicious_content

    df = spark.createDataFrame([("warm 1 up",), (text,)], "text string").coalesce(1)
    checked = S.scan(df).withColumn("m", malicious_content(F.col("text"), F.lit("txt")))
    checked.filter("text like 'warm%'").collect()
    start = time.time()
    checked.select(F.size("detections"), "m.safe", F.length("masked_text")).collect()
    assert time.time() - start < 20


def token_mode(masked, detections):
    tokens = {}
    for i, (_, _, value) in enumerate(detections, 1):
        tokens[value] = f"PII_TOKEN_{i}"
    for value, token in tokens.items():
        masked = masked.replace(value, token)
    return masked


def test_modes(spark):
    texts = random_texts(800, seed=5) + ["a@b.co c@d.co a@b.co PAN ABCDE1234F ABCDE1234F"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    scanned = S.scan(df)
    for r in S.rewrite(scanned, "token").collect():
        masked, found = brute.full(r.text)
        assert r.masked_text == token_mode(masked, found)
        assert [d.token for d in r.detections] == [
            f"PII_TOKEN_{i + 1}" for i in range(len(found))
        ]
    for r in S.rewrite(scanned, "redact").collect():
        masked, found = brute.full(r.text)
        for _, _, value in found:
            masked = masked.replace(value, "[REDACTED]")
        assert r.masked_text == masked
        assert {d.masked_value for d in r.detections} <= {"[REDACTED]"}
    for r in S.rewrite(scanned, "partial").collect():
        assert r.masked_text == brute.full(r.text)[0]


def test_summary_and_stats(spark):
    texts = random_texts(300, seed=9)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    scanned = S.scan(df).select(
        "text", S.summarize(F.col("detections")).alias("summary"), *S.stats(F.col("detections"))
    )
    for r in scanned.collect():
        kinds = [d[0] for d in brute.full(r.text)[1]]
        assert r.summary == {k: kinds.count(k) for k in kinds}
        assert r.pii_found == len(kinds) == sum(r.summary.values())
        assert r.via_pattern == sum(k in ("name", "address") for k in kinds)
        assert r.via_regex == r.pii_found - r.via_pattern
        assert r.pii_types == len(set(kinds))


def test_type_subset(spark):
    df = spark.createDataFrame([("a@b.co 10.0.0.1 cvv 123",)], "text string")
    r = S.scan_structured(df, types=["cvv", "email"], method="regex+ocr").first()
    assert as_tuples(r.detections) == [("email", "a@b.co", "a@b.co"), ("cvv", "cvv 123", "cvv ***")]
    assert r.detections[0].detection_method == "regex+ocr"
    with pytest.raises(ValueError):
        S.scan_structured(df, types=["nothing"])


def test_own_detectors(spark):
    from maskwell.functions.detectors import Detector

    badge = Detector("badge", r"B-\d+", lambda m: F.lit("B-*"), lambda s: s.has_digit)
    df = spark.createDataFrame([("B-12 a@b.co B-7",)], "text string")
    r = S.scan_with(df, [badge, BY_NAME["email"]]).first()
    assert r.masked_text == "B-* a@b.co B-*"
    assert [d.pii_type for d in r.detections] == ["badge", "badge", "email"]


def test_mask_table_scans_each_cell_by_itself(spark):
    rows = [("4821 7391", "6625 a@b.co"), ("  ", None), ("ABCDE1234F", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = S.mask_table(df, ["a", "b"]).collect()
    for (a, b), r in zip(rows, got):
        want_a = brute.full(a) if a else (a, [])
        want_b = brute.full(b) if b else (b, [])
        assert (r.a, r.b) == (want_a[0], want_b[0])
        assert as_tuples(r.detections) == want_a[1] + want_b[1]


def test_scan_runs_each_pattern_once(spark):
    df = spark.createDataFrame([("a",)], "text string").repartition(3)
    scanned = S.scan(df)
    for rows in (
        S.explode_detections(scanned, "text").filter("pii_type <> 'x'"),
        scanned.filter(F.size("detections") > 0).filter("masked_text <> 'x'"),
        S.mask_table(df, ["text"]).filter(F.size("detections") > 0),
    ):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("fp_hash_[a-f0-9]+") == 1
        assert plan.count("Exchange") == 1
