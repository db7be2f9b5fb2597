"""The scan of texts cut in pieces against the scan of whole texts."""

import random

from pyspark.sql import functions as F
from test_scan import random_texts

from maskwell.operators import scan as S
from maskwell.operators import split_scan


def test_pieces_are_the_text():
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice('ab1;<"\n\n .') for _ in range(rng.randint(0, 80)))
        pieces = split_scan.cut(text, rng.randint(1, 9))
        assert "".join(pieces) == text
        for a, b in zip(pieces, pieces[1:]):
            assert a.endswith("\n") and (a[-2:-1] in split_scan.APART or b[:1] in split_scan.APART)


def hostile(seed):
    """Hits, half hits and street words around the places where texts may be cut."""
    rng = random.Random(seed)
    parts = random_texts(60, seed) + ["12, Park Lane", "7 road ; x", "Mr.", "Rahul Sharma", "4821", "7391 6625", "cvv:"]
    glue = [";\n", "\n<", ">\n", "\n", " ", ";", '"\n', "\n\n", ";\n\n;", " ;\n "]
    return "".join(rng.choice(parts) + rng.choice(glue) for _ in range(120))


def test_equal_to_the_scan_of_whole_texts(spark):
    texts = [(i, hostile(i)) for i in range(30)] + [(90, None), (91, ""), (92, ";\n" * 500), (93, "no place at all " * 50)]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    want = {r.id: r for r in S.scan(df).collect()}
    for size in (5, 200):
        got = {r.id: r for r in split_scan.scan_split(df, "id", size=size).collect()}
        assert set(got) == set(want)
        for i, r in want.items():
            assert got[i].masked_text == r.masked_text, i
            assert got[i].detections == r.detections, i


def test_one_text_goes_to_several_tasks(spark):
    line = "insert into t values ('ann{}@mail.com', '10.0.0.1', '4821 7391 6625');\n"
    text = "".join(line.format(i) for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    cut = df.select("id", F.posexplode(split_scan._cutter(1 << 18)(F.col("text"))).alias("n", "piece"))
    tasks = cut.repartition(4, "id", "n").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 4 and all(r["count"] > 1 for r in tasks)
    r = split_scan.scan_split(df, "id", size=1 << 18).select(F.size("detections").alias("n"), "masked_text").first()
    whole = S.scan(df).select(F.size("detections").alias("n"), "masked_text").first()
    assert (r.n, r.masked_text) == (whole.n, whole.masked_text) and r.n >= 180_000


def test_what_is_found_goes_through_no_broadcast(spark, tmp_path):
    """A few bytes of keys in a file can stand for long texts with many hits."""
    spark.range(100).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    df = keys.withColumn("text", F.repeat(F.lit("a@b.com;\n"), 50))
    plan = split_scan.scan_split(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
