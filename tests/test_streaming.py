import datetime as dt

from pyspark.sql import functions as F

from maskwell.operators import audit as A
from maskwell.plans import catalog
from maskwell.streaming import jobs

SCHEMA = "log_id bigint, user_id bigint, action string, details string, timestamp timestamp"
DAY0 = dt.datetime(2024, 1, 1)


def write(spark, folder, rows):
    at = [(i, u, a, d, DAY0 + dt.timedelta(minutes=m)) for i, u, a, d, m in rows]
    spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, result, out):
    query = jobs.drain(result, out)
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/data")


def test_late_rows_are_dropped_and_state_survives_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ann = '{"username":"ann"}'
    write(spark, src, [(i, None, "failed_login", ann, 5 + i) for i in range(6)])
    stream = jobs.read_stream(spark, src, spark.read.parquet(src).schema)
    result = jobs.failed_login_windows(stream)
    assert run(spark, result, out).count() == 0
    write(spark, src, [(10, None, "failed_login", ann, 100), (11, 1, "login", "{}", 101)])
    (r,) = run(spark, result, out).collect()
    assert (r.username, r.attempts, r.tier) == ("ann", 6, "suspicious")
    write(spark, src, [(12, None, "failed_login", ann, 6), (13, None, "failed_login", ann, 300)])
    rows = run(spark, result, out).collect()
    assert sorted(r.attempts for r in rows) == [1, 6]


def test_sessions_agree_with_the_batch_report(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, i % 3, "view", "{}", (i * i * 7) % 600) for i in range(60)]
    write(spark, src, rows + [(99, 9, "view", "{}", 5000)])
    schema = spark.read.parquet(src).schema
    got = run(spark, jobs.session_stream(jobs.read_stream(spark, src, schema)), out)
    batch = A.sessions(spark.read.parquet(src)).filter("user_id <> 9")
    want = {(r.user_id, r.session_start, r.last_active, r.events) for r in batch.collect()}
    assert {tuple(r) for r in got.collect()} == want


def test_scan_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a.txt", b"a.bc@d.co"), ("b.txt", b"<script>x</script> a.bc@d.co")]
    spark.createDataFrame(rows, "filename string, content binary").write.parquet(src)
    stream = jobs.read_stream(spark, src, spark.read.parquet(src).schema)
    got = run(spark, jobs.scan_stream(stream, F.lit("now")), out)
    assert {r.filename: (r.masked_text, len(r.detections)) for r in got.collect()} == {
        "a.txt": ("a.b*@d.co", 1), "b.txt": (None, 0),
    }


def test_a_finished_stream_gives_out_what_it_holds(spark, tmp_path):
    """Given out and still open together are the batch report; closing can be repeated."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, i % 3, "view", "{}", (i * i * 7) % 600) for i in range(60)]
    write(spark, src, rows)
    result = jobs.session_stream(jobs.read_stream(spark, src, spark.read.parquet(src).schema))
    first = run(spark, result, out)
    want = {(r.user_id, r.session_start, r.last_active, r.events) for r in A.sessions(spark.read.parquet(src)).collect()}
    for _ in range(2):
        done = jobs.close(spark, result, jobs.open_sessions(spark, out), out)
        got = [tuple(r) for r in done.collect()]
        assert set(got) == want and len(got) == len(want)
    assert 0 < first.count() < len(want)
    # The stream goes on: an open session grows, and closing follows.
    write(spark, src, [(99, 1, "view", "{}", 4000)])
    run(spark, result, out)
    done = jobs.close(spark, result, jobs.open_sessions(spark, out), out)
    assert {tuple(r) for r in done.collect()} == {
        (r.user_id, r.session_start, r.last_active, r.events) for r in A.sessions(spark.read.parquet(src)).collect()
    }


def test_open_login_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    name = '{"username":"ann"}'
    write(spark, src, [(i, None, "failed_login", name, m) for i, m in enumerate([5, 6, 200, 201, 202])])
    result = jobs.failed_login_windows(jobs.read_stream(spark, src, spark.read.parquet(src).schema))
    assert [r.attempts for r in run(spark, result, out).collect()] == [2]
    (r,) = jobs.open_login_windows(spark, out).collect()
    assert (r.username, r.attempts, r.tier, r.window_start.hour) == ("ann", 3, "warn", 3)


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    from maskwell.plans import sanitize as upload

    out = str(tmp_path / "out")
    rows = [(1, "a.txt", b"a.bc@d.co"), (2, "b.sql", b"drop table x"), (3, "c.csv", b"x,10.0.0.1\n")]
    df = spark.createDataFrame(rows, "file_id bigint, filename string, content binary").select(
        "*", F.substring_index("filename", ".", -1).alias("file_type"),
        F.lit(7).cast("bigint").alias("uploaded_by"),
        F.lit("2024-01-31").cast("timestamp").alias("upload_time"),
    )

    def tables():
        return {t: sorted(map(str, d.collect())) for t, d in upload.open_tables(spark, out).items()}

    jobs.sanitize_batch(df, 0, out, F.lit("2024-01-31").cast("timestamp"))
    first = tables()
    assert len(first["files"]) == 2 and len(first["quarantine"]) == 1
    jobs.sanitize_batch(df, 0, out, F.lit("2024-01-31").cast("timestamp"))
    assert tables() == first
    later = df.withColumn("file_id", F.col("file_id") + 10)
    jobs.sanitize_batch(later, 1, out, F.lit("2024-01-31").cast("timestamp"))
    assert len(tables()["files"]) == 4


def test_scans_of_streams_shuffle_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", b"x")], "filename string, content binary")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.read.parquet(str(tmp_path / "in"))
    plan = jobs.scan_stream(stream, F.lit("now"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_table_of_a_stream_is_a_file_or_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a{i}@b.com", "web") for i in range(20)], "doc_id bigint, text string, source string")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/parts")
    (part,) = (tmp_path / "parts").glob("*.parquet")
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "documents.parquet")
    got = [
        {tuple(r) for r in catalog.stream_uploads(spark, f"{tmp_path}/{kind}").collect()} for kind in ("folder", "file")
    ]
    assert got[0] == got[1] and ("files_log", "7", 2) in got[0]
    assert catalog.stream_scan(spark, f"{tmp_path}/folder").count() == 20
