import datetime as dt
import json
import random

from pyspark.sql import functions as F

from maskwell.functions import rules
from maskwell.operators import audit as A
from maskwell.operators import files as R
from maskwell.operators import lifecycle as L
from maskwell.operators import words as W
from maskwell.operators.ranking import latest_per_key

DAY0 = dt.datetime(2024, 1, 1)
AUDIT = (
    "log_id bigint, user_id bigint, action string, file_id bigint, details string,"
    " ip_address string, timestamp timestamp_ntz"
)
FILES = (
    "file_id bigint, original_filename string, file_type string, uploaded_by bigint,"
    " status string, pii_count bigint, pii_summary map<string,bigint>, upload_time timestamp_ntz"
)


def event(i, user, action, seconds, file_id=None, details=None):
    return (i, user, action, file_id, details, None, DAY0 + dt.timedelta(seconds=seconds))


def file(i, ftype="txt", user=1, status="done", count=0, summary=None, days=0, name=None):
    at = DAY0 + dt.timedelta(days=days)
    return (i, name or f"f{i}.{ftype}", ftype, user, status, count, summary, at)


def test_bands_and_tiers(spark):
    counts = [None, 0, 1, 10, 11, 50, 51]
    df = spark.createDataFrame([(c,) for c in counts], "c bigint")
    bands = [r[0] for r in df.select(rules.band_of(F.col("c"))).collect()]
    assert bands == ["0 PII"] * 2 + ["1-10 PII"] * 2 + ["11-50 PII"] * 2 + ["50+ PII"]
    df = spark.createDataFrame([(n,) for n in (1, 2, 4, 5)], "n bigint")
    tiers = [r[0] for r in df.select(rules.login_tier(F.col("n"))).collect()]
    assert tiers == ["normal", "warn", "warn", "suspicious"]
    share = spark.range(1).select(
        rules.share_percent(F.lit(29), F.lit(100)), rules.share_percent(F.lit(1), F.lit(0))
    )
    assert tuple(share.first()) == (int(0.29 * 100), None)


def test_times(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    texts = [("2024-01-30T00:00:00Z",), ("2024-01-29T23:59:59+00:00",), ("rubbish",)]
    df = spark.createDataFrame(texts, "t string")
    when = rules.parse_time(F.col("t"), as_of)
    assert [r[0] for r in df.select(rules.since(when, "Today", as_of)).collect()] == [
        True, False, True,
    ]


def test_risk_and_threats(spark):
    cases = [
        ({"pan": 1, "email": 1}, "HIGH", []),
        ({"email": 2, "xss": 1}, "MEDIUM", ["xss"]),
        ({"name": 1, "path_traversal": 1, "sql_injection": 1}, "LOW", ["sql_injection", "path_traversal"]),
        ({"xss": 1}, "NONE", ["xss"]),
        ({}, "NONE", []),
        (None, "NONE", []),
    ]
    df = spark.createDataFrame([file(i, summary=c[0]) for i, c in enumerate(cases)], FILES)
    got = R.with_risk(df).orderBy("file_id").collect()
    assert [(r.risk, r.threats) for r in got] == [c[1:] for c in cases]
    assert [r.has_threat for r in got] == [bool(c[2]) for c in cases]


def test_file_reports_with_nulls(spark):
    files = [
        file(1, "pdf", count=3, summary={"email": 2, "name": None, "xss": 5}),
        file(2, "txt", count=None, summary=None),
        file(3, "pdf", status="processing", count=None, summary={"pan": 9}),
        file(4, "csv", user=9, count=2, summary={"name": 2}, days=40),
    ]
    df = spark.createDataFrame(files, FILES)
    assert tuple(R.overview(df).first()) == (4, 3, 5, 1)
    assert tuple(R.overview(df.limit(0)).first()) == (0, 0, 0, 0)
    assert [tuple(r) for r in R.totals_by_type(df).collect()] == [("email", 2), ("name", 2)]
    assert ("xss", 5) in [tuple(r) for r in R.totals_by_type(df, True).collect()]
    heat = {r.pii_type: (r.PDF, r.TXT, r.CSV) for r in R.heatmap(df, ["PDF", "TXT", "CSV"]).collect()}
    assert heat == {"email": (2, 0, 0), "name": (0, 0, 2)}
    share = [tuple(r) for r in R.file_type_share(df).collect()]
    assert share == [("CSV", 2, 100, True), ("PDF", 2, 100, False), ("TXT", 0, 0, False)]
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    days = R.upload_timeline(df, as_of).collect()
    assert len(days) == 31 and days[0].day == "2024-01-01" and sum(r.uploads for r in days) == 3
    users = spark.createDataFrame([(1, "ann")], "user_id bigint, username string")
    named = {r.file_id: r.uploader for r in R.with_uploader(df, users).collect()}
    assert named == {1: "ann", 2: "ann", 3: "ann", 4: None}
    assert R.with_uploader(df, users, "unknown").filter("uploader = 'unknown'").count() == 1
    assert R.visible_to(df, 9, False).count() == 1 and R.visible_to(df, 9, True).count() == 4
    assert R.search(df, "F1.P").count() == 1 and R.search(df, file_type="pdf").count() == 2


def test_latest_per_key_with_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(i, 0 if i % 3 else rng.randint(1, 40), rng.randint(0, 50)) for i in range(9000)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, v bigint").repartition(7)
    order = [F.desc("v"), F.desc("id")]
    got = latest_per_key(df, "k", 25, order, spread_by="id", salts=8).collect()
    want = set()
    for key in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], -r[0]))[:25]
        want |= {(r[0], n) for n, r in enumerate(best, 1)}
    assert {(r.id, r["rank"]) for r in got} == want


def test_inactivity_edges(spark):
    half = 30 * 60
    rows = [
        event(1, 1, "login", 0), event(2, 1, "view", half), event(3, 1, "view", 2 * half + 1),
        event(4, 2, "login", 10), event(5, 2, "logout", 20), event(6, 2, "login", 9000),
        event(7, 3, "login", 0), event(8, 3, "session_timeout", 4000), event(9, 3, "login", 9000),
        event(10, None, "failed_login", 0), event(11, None, "failed_login", 9000),
        event(12, 4, "view", 899), event(13, 4, "logout", 899), event(14, 4, "view", 9000),
    ]
    df = spark.createDataFrame(rows, AUDIT)
    got = {(r.user_id, r.timed_out_at) for r in A.inactivity_timeouts(df).collect()}
    assert got == {
        (1, DAY0 + dt.timedelta(seconds=2 * half + 1)), (3, DAY0 + dt.timedelta(seconds=4000)),
    }
    sessions = A.sessions(df).groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in sessions} == {1: 2, 2: 2, 3: 3, 4: 2}


def test_sessions_against_a_plain_walk(spark):
    rng = random.Random(8)
    rows = [
        event(i, rng.randint(0, 5), rng.choice(["view", "login", "logout"]), rng.randint(0, 400000))
        for i in range(1500)
    ]
    df = spark.createDataFrame(rows, AUDIT)
    timeouts, sessions = set(), set()
    for user in range(6):
        own = sorted((r for r in rows if r[1] == user), key=lambda r: (r[6], r[0]))
        current = [own[0]]
        for before, now in zip(own, own[1:] + [None]):
            if now is None or now[6] - before[6] > dt.timedelta(minutes=30):
                sessions.add((user, current[0][6], current[-1][6], len(current)))
                current = []
                if now is not None and before[2] != "logout":
                    timeouts.add((user, before[6], now[6]))
            current.append(now)
    assert {tuple(r) for r in A.inactivity_timeouts(df).collect()} == timeouts
    got = A.sessions(df).select("user_id", "session_start", "last_active", "events").collect()
    assert {tuple(r) for r in got} == sessions


def test_failed_logins(spark):
    details = ['{"username":"ann"}'] * 5 + ['{"username":"bob"}'] * 2 + [None, "{}"]
    rows = [event(i, None, "failed_login", i, None, d) for i, d in enumerate(details)]
    rows.append(event(99, 1, "login", 5, None, '{"username":"ann"}'))
    got = [tuple(r) for r in A.failed_logins(spark.createDataFrame(rows, AUDIT)).collect()]
    at = [DAY0 + dt.timedelta(seconds=s) for s in range(9)]
    assert got == [
        ("ann", 5, at[4], "suspicious"), ("unknown", 2, at[8], "warn"), ("bob", 2, at[6], "warn"),
    ]


def test_latest_events_and_exports(spark):
    rows = [event(i, i % 3 or None, "view", i, i, '{"k": 1}') for i in range(30)]
    audit = spark.createDataFrame(rows, AUDIT)
    users = spark.createDataFrame([(1, "ann")], "user_id bigint, username string")
    files = spark.createDataFrame([file(28)], FILES)
    top = A.latest_events(audit, users, files, n=5)
    got = [(r.log_id, r.username, r.original_filename) for r in top.collect()]
    assert got == [
        (29, None, None), (28, "ann", "f28.txt"), (27, None, None), (26, None, None),
        (25, "ann", None),
    ]
    first = json.loads(A.siem_lines(top.filter("log_id = 27")).first().value)
    assert first["user"] == {"name": None} and first["metadata"] == {"k": 1}
    assert first["event"] == {
        "kind": "event", "category": "file", "action": "view", "outcome": "success",
    }
    raw = json.loads(A.raw_lines(top.filter("log_id = 27")).first().value)
    assert raw["username"] is None and raw["details"] == '{"k": 1}'
    own = A.user_activity(audit, files, 1, n=3).collect()
    assert [(r.log_id, r.original_filename) for r in own] == [(28, "f28.txt"), (25, ""), (22, "")]
    assert A.events_table(top, "view", "ann").count() == 2


def test_current_rows_and_cascade(spark):
    log = spark.createDataFrame(
        [(1, 1, "processing"), (1, 2, "done"), (2, 1, "processing")],
        "file_id bigint, version int, status string",
    )
    got = {r.file_id: r.status for r in L.current_rows(log, "file_id").collect()}
    assert got == {1: "done", 2: "processing"}
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "file_id bigint")
    gone = spark.createDataFrame([(1,), (1,)], "file_id bigint")
    kept = L.cascade_delete(ids, ids, ids, gone)
    assert [sorted(r.file_id or 0 for r in k.collect()) for k in kept] == [[0, 2]] * 3


def words(*texts, line=0):
    return [("d", 1, 1, line, i, t, 100 * i, 20, 50, 10) for i, t in enumerate(texts)]


def test_word_boxes(spark):
    rows = (
        words("Card", "4012", "3456", " ", "7890", "1234", "cvv:", "123")
        + words("+91", "9876543210", "mail", "ann@x.com,bob@y.com", line=1)
        + words("19876543210", "9876543210", "+1", "212", "555-0187", line=2)
    )
    schema = (
        "doc_id string, block_num int, par_num int, line_num int, word_ord int, text string,"
        " left int, top int, width int, height int"
    )
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.line_num, r.pii_type, r.word) for r in W.redaction_boxes(df).collect()}
    assert got == {
        (0, "credit_card", "3456"), (0, "credit_card", "7890"), (0, "credit_card", "1234"),
        (0, "cvv", "cvv:"), (0, "cvv", "123"),
        (1, "phone", "9876543210"), (1, "email", "ann@x.com,bob@y.com"),
        (2, "phone", "9876543210"), (2, "us_phone", "212"), (2, "us_phone", "555-0187"),
    }
    box = W.redaction_boxes(df).filter("word = '3456'").first()
    assert (box.x0, box.y0, box.x1, box.y1) == (197, 17, 253, 33)
    line = W.lines(df).filter("line_num = 0").first()
    assert line.line_text == "Card 4012 3456 7890 1234 cvv: 123"


def test_words_of_a_line_travel_together(spark):
    schema = (
        "doc_id string, block_num int, par_num int, line_num int, word_ord int, text string,"
        " left int, top int, width int, height int"
    )
    rows = [w for k in range(40) for w in words(*[f"w{k}x{i}" for i in range(30)], line=k)]
    rows += [(None, 1, 1, None, i, t, None, 2, 3, 4) for i, t in enumerate(["no", " ", "key", "\u00a0"])]
    plain = spark.createDataFrame(rows, schema).coalesce(1)
    want = {
        (k, " ".join(f"w{k}x{i}" for i in range(30)), tuple((i, f"w{k}x{i}", 100 * i, 20, 50, 10) for i in range(30)))
        for k in range(40)
    }
    for df in (plain, plain.repartition(3, F.rand(1))):
        got = W.lines(df).filter("doc_id = 'd'").collect()
        assert {(r.line_num, r.line_text, tuple(tuple(w) for w in r.words)) for r in got} == want
        assert len(got) == 40
    none = W.lines(plain).filter("doc_id IS NULL").collect()
    assert [r.line_text for r in none] == ["no key"]
    assert [tuple(w) for w in none[0].words] == [(0, "no", None, 2, 3, 4), (2, "key", None, 2, 3, 4)]
    assert [f.dataType.simpleString() for f in W.lines(plain).schema["words"].dataType.elementType] == (
        ["int", "string", "int", "int", "int", "int"]
    )
    plan = W.lines(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.index("Exchange")  # below the exchange


def test_current_rows_need_no_sort(spark):
    from maskwell.operators.lifecycle import current_rows

    rows = [(i, v, {"a": v}, "x") for i in range(20) for v in range(1, 2 + i % 3)]
    rows += [(None, 1, None, "y"), (3, 1, {"b": 1}, "tie"), (3, 1, {"b": 1}, "tie two")]
    log = spark.createDataFrame(rows, "file_id bigint, version int, summary map<string,int>, s string")
    got = current_rows(log, "file_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    found = {r.file_id: r.version for r in got.collect()}
    assert found == {i: 1 + i % 3 for i in range(20)}
    assert got.count() == 20


def test_rows_without_a_key_are_dealt_over_all_tasks(spark):
    from maskwell.operators.ranking import left_join

    rows = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.col("id") % 7).alias("user_id"), F.col("id").alias("log_id")
    )
    users = spark.range(5).select(F.col("id").alias("user_id"), F.lit("n").alias("name"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = left_join(rows, users.hint("merge"), "user_id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 2000
    assert joined.count() == 4000 and joined.filter("name = 'n'").count() == 714
    assert left_join(rows, users, "user_id", "left_anti").filter("user_id IS NULL").count() == 3000


def test_equal_events_have_ids_of_their_own(spark):
    from maskwell.sources.writers import failed_login_rows

    tried = spark.createDataFrame([("ann",), ("ann",), (None,)], "username string")
    rows = failed_login_rows(tried, F.lit("2024-01-01").cast("timestamp"))
    assert rows.select("log_id").distinct().count() == 3
