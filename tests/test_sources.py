from pyspark.sql import functions as F

from maskwell.functions import keys
from maskwell.plans import sanitize as upload
from maskwell.sources import readers, writers


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_read_files_and_units(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes(b"mail a.bc@d.co \xff")
    (tmp_path / "c.JSON").write_bytes(b'{"k": "10.0.0.1"}')
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "noext").write_bytes(b" \n")
    files = readers.read_files(spark, str(tmp_path))
    got = {r.filename: r for r in files.collect()}
    assert {n: (r.file_type, r.route) for n, r in got.items()} == {
        "a b.txt": ("txt", "text"),
        "c.JSON": ("json", "text"),
        "d.pdf": ("pdf", "page"),
        "noext": ("noext", "text"),
    }
    units = readers.text_units(files, "filename")
    masked = {r.doc_id: r.masked_text for r in upload.sanitize_units(units).collect()}
    assert masked == {
        "a b.txt": "mail a.b*@d.co �",
        "c.JSON": '{"k": "10.X.X.X"}',
        "noext": " \n",
    }


def test_keys(spark):
    names = ["a/b c.PDF", "/x y", "plain", "originals/1/é(1).txt", "sanitized/a/b.tar.gz", "x.", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    n = F.col("n")
    got = df.select(
        keys.extension(n), keys.content_type(n), keys.clean_key(n), keys.bucket(n),
        keys.path_in_bucket(n),
    ).collect()
    assert [r[0] for r in got] == ["pdf", "/x y", "plain", "txt", "gz", "", ""]
    assert got[0][1] == "application/pdf" and got[2][1] == "application/octet-stream"
    assert [r[2] for r in got] == [
        "a/b_c.PDF", "x_y", "plain", "originals/1/é_1_.txt", "sanitized/a/b.tar.gz", "x.", "",
    ]
    assert got[3][3:] == ("pii-originals", "1/é(1).txt")
    assert got[4][3:] == ("pii-sanitized", "a/b.tar.gz")
    assert got[0][3:] == ("pii-originals", "a/b c.PDF")


def test_previews(spark):
    df = spark.createDataFrame([("x" * 4000, "txt"), (None, "txt"), ('{"a":1}', "json")], "t string, k string")
    got = df.select(keys.preview(F.col("t"), 1500), readers.display_text(F.col("t"), F.col("k"))).collect()
    assert [len(r[0]) for r in got] == [1500, len("[Preview unavailable]"), 7]
    assert [r[1] and len(r[1]) for r in got] == [3000, None, 7]


def batch(spark):
    rows = [
        (1, "a.txt", b"mail a.bc@d.co and 10.0.0.1"),
        (2, "b c.sql", b"drop table x; a.bc@d.co"),
        (3, "d.json", b"{}"),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, filename string, content binary")
    return df.select(
        "*", keys.extension(F.col("filename")).alias("file_type"),
        F.lit(7).cast("bigint").alias("uploaded_by"), as_of().alias("upload_time"),
    )


def test_upload_job_and_rerun(spark, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        tables = upload.sanitize(batch(spark), out, "r1", as_of())
    upload.sanitize(batch(spark).withColumn("file_id", F.col("file_id") + 10), out, "r2", as_of())
    tables = upload.open_tables(spark, out)
    files = {r.file_id: r for r in tables["files"].collect()}
    assert set(files) == {1, 3, 11, 13}
    assert files[1].status == "done" and files[1].pii_count == 2
    assert files[1].pii_summary == {"email": 1, "ip_address": 1} and files[3].pii_summary == {}
    assert files[1].sanitized_key == "sanitized/1/sanitized_a.txt"
    assert tables["files_log"].count() == 8
    assert tables["pii_detections"].count() == 4
    events = [(r.action, r.file_id) for r in tables["audit_logs"].collect()]
    assert sorted(events, key=str) == sorted(
        [("upload", f) for f in ("1", "3", "11", "13")] + [("blocked_upload", None)] * 2, key=str
    )
    assert {r.filename for r in tables["quarantine"].collect()} == {"b c.sql"}
    texts = {r.file_id: r.masked_text for r in tables["sanitized"].collect()}
    assert texts[1] == "mail a.b*@d.co and 10.X.X.X" and len(texts) == 4

    kept = {r.file_id: (r.original_key, bytes(r.content)) for r in tables["originals"].collect()}
    assert kept[1] == ("originals/1/a.txt", b"mail a.bc@d.co and 10.0.0.1") and len(kept) == 4
    assert not (tmp_path / "out" / "staged" / "run_id=r1").exists()

    event = upload.delete_events(tables["files"].filter("file_id = 1"), as_of(), F.lit(9)).first()
    assert (event.action, event.user_id, event.file_id) == ("delete", "9", "1")
    assert event.details == '{"filename":"a.txt"}'


def bytes_of(folder):
    return {p: p.read_bytes() for p in folder.rglob("*.parquet")}


def test_delete_touches_only_the_runs_that_hold_the_file(spark, tmp_path):
    out = tmp_path / "out"
    upload.sanitize(batch(spark), str(out), "r1", as_of())
    upload.sanitize(batch(spark).withColumn("file_id", F.col("file_id") + 10), str(out), "r2", as_of())
    others = {t: bytes_of(out / t / "run_id=r2") for t in upload.TABLES}
    ids = spark.createDataFrame([(1,), (2,), (99,)], "file_id bigint")
    for _ in range(2):  # again, as after a failure
        runs = upload.delete_files(spark, str(out), ids)
        tables = upload.open_tables(spark, str(out))
        assert {t: bytes_of(out / t / "run_id=r2") for t in upload.TABLES} == others
        assert sorted(r.file_id for r in tables["originals"].collect()) == [3, 11, 13]
        assert sorted(r.file_id for r in tables["files"].collect()) == [3, 11, 13]
        assert {r.file_id for r in tables["pii_detections"].collect()} == {11}
        assert sorted(r.file_id for r in tables["quarantine"].collect()) == [12]
        events = [r.file_id for r in tables["audit_logs"].collect() if r.file_id]
        assert sorted(events) == ["11", "13", "3"]
    assert runs == []


def test_delete_writes_what_stays_once(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    upload.sanitize(batch(spark), out, "r1", as_of())
    upload.sanitize(batch(spark).withColumn("file_id", F.col("file_id") + 10), out, "r2", as_of())
    written, staged, write = [], [], upload.write_run
    monkeypatch.setattr(upload, "write_run", lambda df, *rest: (written.append(rest), write(df, *rest)))
    monkeypatch.setattr(upload, "stage", lambda df: staged.append(df) or df.localCheckpoint())
    upload.delete_files(spark, out, spark.createDataFrame([(1,)], "file_id bigint"))
    assert staged == [] and len(written) == len({w[0] for w in written}) == 5
    tables = upload.open_tables(spark, out)
    assert sorted(r.file_id for r in tables["originals"].collect()) == [3, 11, 13]
    assert not (tmp_path / "out" / "kept").exists()


def test_upload_of_all_kinds(spark, tmp_path):
    """Text, CSV, pages, runs and words in one run, each put together again."""
    rows = [
        (1, "a.txt", b"mail a.bc@d.co", None),
        (2, "b.csv", b'x,"a.bc@d.co, ""q"""\r\n\r\n4821,7391 6625,\n', None),
        (3, "c.pdf", b"%PDF", ["page a.bc@d.co", "", None, "10.0.0.1"]),
        (4, "d.docx", b"PK", ["Mr. Rahul ", " ", "Sharma a.bc@d.co"]),
        (5, "e.png", b"PNG", None),
        (6, "f.jpg", b"JPG", None),
        (7, "g.pdf", b"%PDF", None),
        (8, "h.csv", b"a,drop table x\n", None),
    ]
    schema = "file_id bigint, filename string, content binary, units array<string>"
    files = spark.createDataFrame(rows, schema).select(
        "*", keys.extension(F.col("filename")).alias("file_type"),
        F.lit(7).cast("bigint").alias("uploaded_by"), as_of().alias("upload_time"),
    )
    words = [(5, 1, 1, 1, i, w, i * 50, 5, 40, 10) for i, w in enumerate(["mail", "a.bc@d.co", "now"])]
    words = spark.createDataFrame(
        words, "file_id bigint, block_num int, par_num int, line_num int, word_ord int, text string,"
        " left int, top int, width int, height int"
    )
    out = str(tmp_path / "out")
    tables = upload.sanitize(files, out, "r", as_of(), words)
    texts = {r.file_id: r.masked_text for r in tables["sanitized"].collect()}
    assert texts == {
        1: "mail a.b*@d.co",
        2: 'x,"a.b*@d.co, ""q"""\r\n\r\n4821,7391 6625,\r\n',
        3: "page a.b*@d.co\n\n\n\n\n\n10.X.X.X",
        4: "[NAME REDACTED]  Sharma a.b*@d.co",
        5: None, 6: None, 7: None,
    }
    counts = {r.file_id: (r.pii_count, r.pii_summary) for r in tables["files"].collect()}
    assert counts[5] == (1, {"email": 1}) and counts[6] == (0, {}) and counts[7] == (0, {})
    assert counts[2] == (1, {"email": 1}) and counts[3][0] == 2 and counts[4][0] == 2
    methods = {r.file_id: r.detection_method for r in tables["pii_detections"].collect()}
    assert methods[5] == "regex+ocr" and methods[1] == "regex"
    assert spark.read.parquet(f"{out}/boxes").select("file_id", "word").collect() == [(5, "a.bc@d.co")]
    assert {r.file_id for r in tables["quarantine"].collect()} == {8}


def test_joined_units_keep_their_order(spark):
    rows = [("d", "page", i, f"page {i} a.bc@d.co") for i in range(12)] + [("e", "page", 0, " ")]
    df = spark.createDataFrame(rows, "doc_id string, unit_kind string, unit_id bigint, text string")
    done = upload.join_units(upload.sanitize_units(df.repartition(5)))
    got = {r.doc_id: r for r in done.collect()}
    assert got["d"].masked_text == "\n\n".join(f"page {i} a.b*@d.co" for i in range(12))
    assert got["d"].pii_count == 12
    assert (got["e"].masked_text, got["e"].pii_count) == (" ", 0)


def test_open_stored(spark, tmp_path):
    for folder, name in (("pii-originals/7", "a_b_.txt"), ("pii-sanitized/7", "x.txt")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / name).write_bytes(name.encode())
    for key, want in (
        ("originals/7/a b(.txt", b"a_b_.txt"), ("7/a b(.txt", b"a_b_.txt"),
        ("sanitized/7/x.txt", b"x.txt"),
    ):
        assert bytes(readers.open_stored(spark, str(tmp_path), key).first().content) == want
    names = ["a/b c.PDF", "/x y", "plain", "originals/1/é(1).txt", "x.", "", "//q r", "a/"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", keys.clean_key(F.col("n")).alias("c")).collect():
        assert r.c == keys.clean_key_text(r.n)


def test_event_defaults(spark, tmp_path):
    df = spark.createDataFrame([("ann",)], "username string")
    r = writers.event_rows(df, "login", as_of(), F.lit(4)).first()
    assert (r.user_id, r.file_id, r.details, r.ip_address) == ("4", None, "{}", None)
    f = writers.failed_login_rows(df, as_of()).first()
    assert (f.user_id, f.action, f.details) == (None, "failed_login", '{"username":"ann"}')
    writers.write_export(df.withColumn("file_type", F.lit("txt")), str(tmp_path / "x"))
    assert (tmp_path / "x" / "file_type=txt").is_dir()
    writers.write_lines(df.select(F.col("username").alias("value")), str(tmp_path / "y"))
    assert spark.read.text(str(tmp_path / "y")).first().value == "ann"


def test_rerun_leaves_nothing_behind(spark, tmp_path):
    """A table that is written again holds the new rows only, also in other value folders."""
    from maskwell.sources.writers import write_run

    out = f"{tmp_path}/out"
    rows = spark.createDataFrame([(1, "email"), (2, "ip")], "file_id bigint, pii_type string")
    write_run(rows, f"{out}/pii_detections", "r1", "pii_type")
    write_run(rows.filter("file_id = 2"), f"{out}/pii_detections", "r1", "pii_type")
    found = spark.read.parquet(f"{out}/pii_detections")
    assert [r["file_id"] for r in found.collect()] == [2]


def test_file_names_are_kept(spark, tmp_path):
    from maskwell.sources.readers import read_files

    for name in ("a+b.txt", "50%.txt", "c d.txt"):
        (tmp_path / name).write_text("x")
    got = {r["filename"] for r in read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a+b.txt", "50%.txt", "c d.txt"}
