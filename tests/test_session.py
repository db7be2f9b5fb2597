"""How work is dealt over tasks and handed to Python."""

from pyspark.sql import functions as F

from maskwell import session
from maskwell.llm import line_dedup
from maskwell.operators import scan
from maskwell.sources import readers


def test_many_rows_make_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    assert session.spread(spark.range(0, 95, 1, 2), "id").rdd.getNumPartitions() == 10
    assert session.spread(spark.range(0, 95, 1, 12), "id").rdd.getNumPartitions() == 12
    assert session.spread(spark.range(3), "id").rdd.getNumPartitions() == 4


def test_python_gets_small_batches(spark):
    key, most = session.BATCH_BYTES
    before = spark.conf.get(key)
    try:
        for given, left in (("64m", str(most)), ("8k", "8k")):
            spark.conf.set(key, given)
            scan.scan(spark.createDataFrame([("a@b.com",)], "text string"))
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)


def test_a_task_reads_many_small_splits(spark, tmp_path):
    rows = spark.range(3000).select(F.concat("id", F.lit(',"a\n'), "id", F.lit('"')).alias("value"))
    rows.coalesce(1).write.text(str(tmp_path / "csv"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256")
    try:
        assert readers._csv_lines(spark, str(tmp_path / "csv")).rdd.getNumPartitions() == 16
        cells = [r.cells for r in readers.read_csv_cells(spark, str(tmp_path / "csv")).collect()]
    finally:
        spark.conf.set(key, before)
    assert sorted(cells, key=lambda c: int(c[0])) == [[str(i), f"a\n{i}"] for i in range(3000)]


def test_line_dedup_reads_small_batches(spark):
    key, most = session.BATCH_BYTES
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        line_dedup.keep_bitmaps(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
        assert spark.conf.get(key) == str(most)
    finally:
        spark.conf.set(key, before)
