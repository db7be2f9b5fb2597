"""Every query by name. Each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.functions import keys, rules
from maskwell.functions.detectors import BY_NAME, Detector
from maskwell.functions.text import computed_once
from maskwell.functions.threats import malicious_content
from maskwell.operators import audit as audits
from maskwell.operators import files as filing
from maskwell.operators import lifecycle, scan, split_scan, threat_scan, words
from maskwell.plans import fixtures as fx
from maskwell.plans import sanitize as upload
from maskwell.plans import templates as tp
from maskwell.session import shared_folder, spread, stage
from maskwell.sources import readers, writers
from maskwell.streaming import jobs

# --- text scan ---------------------------------------------------------------------------


def detect_documents(spark, sf):
    return scan.explode_detections(scan.scan_structured(fx.documents(spark, sf)), "doc_id")


def mask_documents(spark, sf):
    return scan.scan_structured(fx.documents(spark, sf)).select("doc_id", "masked_text")


def scan_documents(spark, sf):
    return scan.scan(fx.documents(spark, sf)).select(
        "doc_id", "masked_text", F.size("detections").cast("bigint").alias("pii_count")
    )


def scan_split_documents(spark, sf):
    """The scan with every text cut into pieces of two thousand characters or so."""
    docs = fx.documents(spark, sf)
    return split_scan.scan_split(docs, "doc_id", size=2000).select(
        "doc_id", "masked_text", F.size("detections").cast("bigint").alias("pii_count")
    )


def scan_split_templated(spark, sf):
    """Texts of many lines with hits in each, cut behind lines; every detection in its order."""
    texts = tp.templated(spark, sf, tp.MIXED_TEMPLATE, tp.CONTEXT_TEMPLATE)
    line = F.concat(F.lit("<"), "text", F.lit(">;\n"))
    texts = texts.withColumn("text", F.repeat(line, (F.col("doc_id") % 5).cast("int")))
    done = split_scan.scan_split(texts, "doc_id", size=60)
    return scan.explode_detections(done, "doc_id", "masked_text")


def pii_type_counts(spark, sf):
    found = scan.explode_detections(scan.scan(fx.documents(spark, sf)))
    return found.groupBy("pii_type").agg(F.count(F.lit(1)).alias("pii_count"))


def scan_pages(spark, sf):
    pages = spread(readers.read_table(spark, sf, "pages", "page_id", "html"), "page_id")
    return scan.explode_detections(scan.scan(pages, "html"), "page_id")


def templated_type(name, spark, sf):
    scanned = scan.scan(tp.templated(spark, sf, tp.TYPE_TEMPLATES[name]))
    return scan.explode_detections(scanned, "doc_id", "masked_text")


def names_addresses(spark, sf):
    scanned = scan.scan_contextual(tp.templated(spark, sf, tp.CONTEXT_TEMPLATE))
    return scan.explode_detections(scanned, "doc_id", "masked_text")


def scan_mixed(spark, sf):
    scanned = scan.scan(tp.templated(spark, sf, tp.MIXED_TEMPLATE, tp.CONTEXT_TEMPLATE))
    return scan.explode_detections(scanned, "doc_id", "masked_text")


def _mode(mode, texts):
    return scan.rewrite(scan.scan(texts), mode)


def token_mode(spark, sf):
    done = _mode("token", tp.templated(spark, sf, tp.MIXED_TEMPLATE, tp.CONTEXT_TEMPLATE))
    return scan.explode_detections(done, "doc_id", "masked_text")


def redact_mode(spark, sf):
    done = _mode("redact", tp.templated(spark, sf, tp.MIXED_TEMPLATE, tp.CONTEXT_TEMPLATE))
    return scan.explode_detections(done, "doc_id", "masked_text")


def token_documents(spark, sf):
    return _mode("token", fx.documents(spark, sf)).select("doc_id", "masked_text")


def redact_documents(spark, sf):
    return _mode("redact", fx.documents(spark, sf)).select("doc_id", "masked_text")


def doc_pii_summary(spark, sf):
    summary = scan.summarize(F.col("detections"))
    rows = scan.scan(fx.documents(spark, sf)).select(
        "doc_id", F.explode_outer(summary).alias("pii_type", "pii_count")
    )
    return rows.filter("pii_type IS NOT NULL")


def span_documents(spark, sf):
    """Documents masked by place: no overlaps, no detected value left in clear."""
    return scan.scan_spans(fx.documents(spark, sf)).select(
        "doc_id", "masked_text", F.size("detections").cast("bigint").alias("n_kept")
    )


def span_templated(spark, sf):
    texts = tp.templated(spark, sf, tp.MIXED_TEMPLATE, tp.CONTEXT_TEMPLATE, tp.OVERLAP_TEMPLATE)
    done = scan.scan_spans(texts)
    return scan.explode_detections(done, "doc_id", "masked_text")


def python_masks(spark, sf):
    """An own detector, and masks by Python functions, one of which fails on some values."""
    badge = Detector("badge", r"B-[0-9]+", lambda m: F.lit("B-*"), lambda s: s.has_digit)
    texts = tp.templated(spark, sf, "badge B-{k} of a{k}@corp.org, or B-{k}{k} and B-{k}")

    def backwards(value):
        if value.endswith("3"):
            raise ValueError(value)
        return value[::-1]

    maskers = {"badge": backwards}
    done = scan.scan_with_maskers(texts, [badge, BY_NAME["email"]], maskers)
    return scan.explode_detections(done, "doc_id", "masked_text")


def scan_stats(spark, sf):
    texts = tp.templated(spark, sf, tp.MIXED_TEMPLATE, tp.CONTEXT_TEMPLATE, "nothing {k}")
    return scan.scan(texts).select("doc_id", *scan.stats(F.col("detections")))


# --- tables, cells, units ------------------------------------------------------------------


def mask_customers(spark, sf):
    rows = readers.read_table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment")
    contact = tp.as_column(tp.MIXED_TEMPLATE, F.col("c_custkey"))
    blank = F.when(F.col("c_custkey") % 3 == 0, F.lit(" \t")).otherwise(F.col("c_name"))
    rows = spread(rows, "c_custkey").withColumns({"contact": contact, "c_name": blank})
    masked = scan.mask_table(rows, ["c_name", "c_mktsegment", "contact"])
    return masked.select(
        "c_custkey", "c_name", "c_mktsegment", "contact",
        F.size("detections").cast("bigint").alias("pii_count"),
    )


def mask_conversations(spark, sf):
    rows = readers.read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    masked = scan.mask_table(spread(rows, "conv_id", "turn"), ["role", "text"])
    return masked.select(
        "conv_id", "turn", "role", "text",
        F.size("detections").cast("bigint").alias("pii_count"),
    )


def mask_event_props(spark, sf):
    rows = readers.read_table(spark, sf, "events", "event_id", "props")
    masked = scan.mask_table(spread(rows, "event_id"), ["props"])
    return masked.select("event_id", "props", F.size("detections").cast("bigint").alias("n"))


def csv_lines(spark, sf):
    """CSV records, masked cell by cell, as the lines of the sanitized file."""
    rows = readers.read_table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment")
    cells = F.array(
        "c_name", F.lit(""), tp.as_column(tp.MIXED_TEMPLATE, F.col("c_custkey")),
        F.concat(F.lit('say "'), "c_mktsegment", F.lit('"')),
    )
    done = scan.scan_array(spread(rows, "c_custkey").withColumn("cells", cells), "cells")
    return done.select(
        "c_custkey",
        keys.csv_line(F.col("cells")).alias("line"),
        F.size("detections").cast("bigint").alias("pii_count"),
    )


def csv_files(spark, sf):
    """Customers written as CSV files, read back as cells, masked, and counted by type."""
    folder = shared_folder(spark)
    rows = spread(readers.read_table(spark, sf, "customer", "c_custkey", "c_name"), "c_custkey")
    contact = tp.as_column(tp.MIXED_TEMPLATE, F.col("c_custkey"))
    rows.select("c_custkey", "c_name", contact.alias("contact")).write.option(
        "escape", '"'
    ).csv(f"{folder}/customers")
    done = upload.sanitize_csv(spark, f"{folder}/customers")
    return done.select(
        F.get("cells", F.lit(0)).cast("bigint").alias("c_custkey"),
        "line",
        F.size("detections").cast("bigint").alias("pii_count"),
    )


def csv_ragged_files(spark, sf):
    """Documents as CSV text: quoted line breaks, records of all widths, blank records.

    The files are split in blocks of 64 KB, so that records lie across blocks.
    """
    folder = shared_folder(spark)
    docs = readers.read_table(spark, sf, "documents", "doc_id", "text")
    key = F.col("doc_id")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    record = F.concat(
        key.cast("string"), F.lit(","), quoted,
        F.repeat(F.lit(",x"), (key % 4).cast("int")), F.repeat(F.lit(","), (key % 3).cast("int")),
        F.when(key % 5 == 0, "\n").otherwise(""),
    )
    docs.select(record.alias("value")).write.text(f"{folder}/ragged")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        done = stage(readers.read_csv_cells(spark, f"{folder}/ragged"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return done.select(
        F.get("cells", F.lit(0)).cast("bigint").alias("doc_id"),
        F.size("cells").cast("bigint").alias("n_cells"),
        F.md5(F.get("cells", F.lit(1))).alias("text_md5"),
        F.get("cells", F.size("cells") - 1).alias("last"),
    )


def _parts(spark, sf, cut):
    """Texts as arrays of units, in the row of their document."""
    return fx.documents(spark, sf).select("doc_id", F.split("text", cut).alias("units"))


def _units(spark, sf, kind, cut):
    return _parts(spark, sf, cut).select(
        "doc_id", F.lit(kind).alias("unit_kind"), F.posexplode("units").alias("unit_id", "text")
    )


def _rebuilt(spark, sf, kind, cut):
    done = scan.scan_array(_parts(spark, sf, cut), "units")
    return done.select(
        "doc_id",
        upload.joined_units(F.col("units"), kind).alias("masked_text"),
        F.size("detections").cast("bigint").alias("pii_count"),
    )


def page_units(spark, sf):
    """Texts cut into pages at line ends, scanned page by page and joined again."""
    return _rebuilt(spark, sf, "page", "\n")


def run_rebuild(spark, sf):
    """Texts cut into runs at sentence ends, scanned run by run and joined again."""
    return _rebuilt(spark, sf, "run", "[.]")


def run_units(spark, sf):
    """Texts cut into runs at sentence ends, scanned run by run."""
    scanned = upload.sanitize_units(_units(spark, sf, "run", "[.]"))
    return scan.explode_detections(scanned, "doc_id", "unit_id")


def file_previews(spark, sf):
    kind = F.col("file_type")
    rows = spread(
        readers.read_table(spark, sf, "documents", "doc_id", "source", "text"), "doc_id"
    ).withColumn("file_type", fx._file_columns()["file_type"])
    return rows.select(
        "doc_id",
        keys.preview(F.col("text"), 1500).alias("preview"),
        readers.display_text(F.col("text"), kind).alias("shown"),
    )


def before_and_after(spark, sf):
    return readers.before_and_after(scan.scan(fx.documents(spark, sf)), "doc_id")


def display_paragraphs(spark, sf):
    docs = fx.documents(spark, sf)
    shown = readers.display_paragraphs(F.split("text", "\n"))
    return docs.select("doc_id", shown.alias("shown"))


def masked_detections_table(spark, sf):
    rows = writers.detection_rows(fx.scanned_files(spark, sf))
    table = filing.detections_table(rows, with_original=False)
    return table.toDF("type", "masked_as", "method")


def display_events(spark, sf):
    """Display text of JSON values: whole where they parse, else cut."""
    rows = readers.read_table(spark, sf, "events", "event_id", "props")
    broken = F.concat(F.lit("{"), F.repeat("props", 400))
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(broken)
    return rows.select("event_id", readers.display_text(text, F.lit("json")).alias("shown"))


def normalised_keys(spark, sf):
    rows = readers.read_table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    kind = F.element_at(
        F.array(*[F.lit(x) for x in (*keys.CONTENT_TYPES, "exe", "TXT")]),
        (F.col("p_partkey") % (len(keys.CONTENT_TYPES) + 2) + 1).cast("int"),
    )
    prefix = F.element_at(
        F.array(F.lit("originals/"), F.lit("sanitized/"), F.lit("other dir/"), F.lit("")),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    dot = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(".")
    key = F.concat(
        prefix, F.col("p_partkey"), F.lit("/"), "p_name", F.lit(" é#-_("), "p_type", F.lit(")"),
        dot, kind,
    )
    cleaned = keys.clean_key(key)
    return rows.select(
        "p_partkey",
        keys.extension(key).alias("extension"),
        keys.content_type(key).alias("content_type"),
        keys.route(key).alias("route"),
        cleaned.alias("clean_key"),
        keys.bucket(cleaned).alias("bucket"),
        keys.path_in_bucket(cleaned).alias("path"),
        keys.path_in_bucket(key).alias("delete_path"),
    )


def escaped_pages(spark, sf):
    pages = readers.read_table(spark, sf, "pages", "page_id", "html")
    return pages.select("page_id", keys.escape_markup(F.col("html")).alias("escaped"))


# --- hostile content -------------------------------------------------------------------------


def _threat_rows(df: DataFrame, key: str, text: str, extension, kept=None) -> DataFrame:
    found = malicious_content(F.col(text), extension, kept)
    details = df.select(key, F.explode_outer(found["details"]).alias("threat", "found"))
    return scan.explode_with_position(details, F.col("found"), "value", key, "threat")


def threats_pages(spark, sf):
    pages = spread(readers.read_table(spark, sf, "pages", "page_id", "html"), "page_id")
    return _threat_rows(pages, "page_id", "html", F.lit("html"))


def threats_first_three(spark, sf):
    """At most three hits of each pattern, as a short report shows them."""
    pages = spread(readers.read_table(spark, sf, "pages", "page_id", "html"), "page_id")
    return _threat_rows(pages, "page_id", "html", F.lit("html"), kept=3)


def threats_documents(spark, sf):
    docs = fx.documents(spark, sf).withColumn("source", F.lit("txt"))
    found = malicious_content(F.col("text"), F.col("source"))
    return docs.select("doc_id", found.alias("m")).select(
        "doc_id",
        F.col("m.safe").alias("safe"),
        F.size("m.threats").cast("bigint").alias("threats"),
    )


def threats_templated(spark, sf):
    texts = tp.templated(spark, sf, *tp.THREAT_TEMPLATES)
    kind = F.when(F.col("doc_id") % 9 == 0, "png").otherwise("txt")
    return _threat_rows(texts, "doc_id", "text", kind)


def file_hashes(spark, sf):
    docs = fx.documents(spark, sf)
    digests = threat_scan.hashes(F.encode("text", "utf-8"))
    return docs.select("doc_id", digests.alias("h")).select("doc_id", "h.*")


def _security(spark, sf) -> DataFrame:
    texts = tp.templated(spark, sf, *tp.THREAT_TEMPLATES)
    files = texts.select(
        "doc_id",
        F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("filename"),
        F.encode("text", "utf-8").alias("content"),
    )
    return threat_scan.security_scan(files, fx.as_of())


def quarantine_split(spark, sf):
    s = F.col("security")
    return _security(spark, sf).select(
        "doc_id", F.when(s["safe"], "continue").otherwise("block").alias("verdict"),
        s["file_size"].alias("file_size"), s["hashes"]["sha256"].alias("sha256"),
        F.array_join(s["malicious_content"]["threats"], ",").alias("threats"),
        s["scanned_at"].alias("scanned_at"),
    )


def blocked_uploads(spark, sf):
    """Details of the events written for blocked files, read back field by field."""
    _, blocked = threat_scan.split_by_verdict(_security(spark, sf))
    details = threat_scan.blocked_details(F.col("security"))
    return blocked.select("doc_id", details.alias("d")).select(
        "doc_id",
        F.get_json_object("d", "$.filename").alias("filename"),
        F.get_json_object("d", "$.threats[0]").alias("first_threat"),
        F.get_json_object("d", "$.sha256").alias("sha256"),
    )


# --- files and users -----------------------------------------------------------------------


def all_users(spark, sf):
    return filing.all_users(fx.users(spark, sf))


def active_user(spark, sf):
    return filing.active_user(fx.users(spark, sf), "Customer#000000042").select(
        "user_id", "username", "role"
    )


def file_by_id(spark, sf):
    return filing.file_by_id(fx.file_facts(spark, sf), 22).select(
        "file_id", "original_filename", "status"
    )


def detections_of_file(spark, sf):
    rows = writers.detection_rows(fx.scanned_files(spark, sf))
    return filing.detections_of(rows, 22)


def saved_detections(spark, sf):
    return writers.detection_rows(fx.scanned_files(spark, sf))


def files_enriched(spark, sf):
    files = filing.with_uploader(fx.file_facts(spark, sf), fx.users(spark, sf))
    return filing.newest_first(files).select(
        "file_id", "original_filename", "file_type", "status", "uploader", "upload_time"
    )


def files_of_user(spark, sf):
    """One user's files, with the uploader named even if unknown."""
    own = filing.visible_to(fx.file_facts(spark, sf), 42, is_admin=False)
    known = fx.users(spark, sf).filter("user_id <> 42")
    files = filing.with_uploader(own, known, missing="unknown")
    return filing.newest_first(files).select("file_id", "original_filename", "uploader")


def admin_files(spark, sf):
    files = filing.visible_to(fx.file_facts(spark, sf), 0, is_admin=True)
    return filing.with_status(files, "done").select("file_id", "original_filename")


def user_files_table(spark, sf):
    return filing.user_files_table(fx.files(spark, sf), 42).toDF(
        "filename", "type", "pii_count", "status", "uploaded_at"
    )


def file_search(spark, sf):
    done = filing.with_status(fx.files(spark, sf), "done")
    found = filing.search(done, "SRC1", "pdf", "0 PII", "Last 30 days", fx.as_of())
    return found.select("file_id", "original_filename", "pii_count", "upload_time")


def file_bands(spark, sf):
    files = fx.files(spark, sf)
    return files.select("file_id", "pii_count", rules.band_of(F.col("pii_count")).alias("band"))


def uploads_in_range(spark, sf):
    return filing.uploads_per_range(fx.file_facts(spark, sf), fx.as_of())


def file_type_options(spark, sf):
    done = filing.with_status(fx.file_facts(spark, sf), "done")
    return filing.options(done, F.lower("file_type"), "file_type")


def shown_of_total(spark, sf):
    done = filing.with_status(fx.files(spark, sf), "done")
    return filing.shown_of_total(done, rules.in_band(F.col("pii_count"), "1-10 PII"))


def dashboard_overview(spark, sf):
    return filing.overview(fx.files(spark, sf))


def overview_by_user(spark, sf):
    return filing.overview_by_user(fx.files(spark, sf))


def _flagged_files(spark, sf, files=None) -> DataFrame:
    """The files, some with threat keys, an empty count, or no summary at all."""
    files = fx.files(spark, sf) if files is None else files
    key = F.col("file_id")
    threat = F.create_map(F.lit("xss"), F.lit(2).cast("bigint"))
    others = F.map_filter("pii_summary", lambda k, v: ~k.isin("xss", "pan", "voter_id"))
    risky = F.create_map(F.lit("pan"), key % 5, F.lit("voter_id"), F.lit(None).cast("bigint"))
    return files.withColumn(
        "pii_summary",
        F.when(key % 11 == 0, F.map_concat(others, threat))
        .when(key % 13 == 0, F.map_concat(others, risky))
        .when(key % 17 == 0, F.lit(None))
        .otherwise(F.col("pii_summary")),
    )


def pii_by_type(spark, sf):
    return filing.totals_by_type(_flagged_files(spark, sf))


def pii_by_type_all(spark, sf):
    return filing.totals_by_type(_flagged_files(spark, sf), with_threats=True)


def pii_heatmap(spark, sf):
    kinds = [t.upper() for t in fx.FILE_TYPES]
    table = filing.heatmap(_flagged_files(spark, sf), kinds)
    return table.select("pii_type", *[F.col(k).alias(k.lower()) for k in kinds])


def filetype_share(spark, sf):
    return filing.file_type_share(_flagged_files(spark, sf))


def upload_timeline(spark, sf):
    return filing.upload_timeline(fx.file_facts(spark, sf), fx.as_of())


def risk_levels(spark, sf):
    return filing.with_risk(_flagged_files(spark, sf)).select(
        "file_id", "risk", "has_threat", F.array_join("threats", ",").alias("threats")
    )


def recent_files(spark, sf):
    """The newest files are picked first; only their texts are scanned."""
    newest = filing.newest_first(fx.file_facts(spark, sf)).limit(8).select("file_id")
    files = fx.files(spark, sf, only=newest)
    return filing.recent(_flagged_files(spark, sf, files)).select("file_id", "risk", "pii_count")


def bulk_export(spark, sf):
    wanted = filing.search(
        fx.file_facts(spark, sf), file_type="txt", date_range="Last 30 days", as_of=fx.as_of()
    )
    ids = wanted.select(F.col("file_id").alias("doc_id"))
    texts = fx.documents(spark, sf).join(ids, "doc_id", "left_semi")
    sanitized = scan.scan(texts).withColumnRenamed("doc_id", "file_id")
    return filing.export_filtered(wanted, sanitized)


# --- audit -------------------------------------------------------------------------------------


def _audit_parts(spark, sf):
    files = fx.file_facts(spark, sf).select("file_id", "original_filename")
    return fx.audit(spark, sf), fx.users(spark, sf), files


def audit_top(spark, sf):
    return audits.latest_events(*_audit_parts(spark, sf), n=200).select(
        "log_id", "timestamp", "username", "action", "original_filename"
    )


def audit_filtered(spark, sf):
    audit, users, files = _audit_parts(spark, sf)
    one = users.filter(F.col("username") == "Customer#000000042").select("user_id")
    own = audit.filter(F.col("action") == "download").join(one, "user_id", "left_semi")
    shown = audits.events_table(audits.latest_events(own, users, files, n=200))
    return shown.toDF("timestamp", "username", "action", "file")


def audit_action_options(spark, sf):
    events = audits.latest_events(*_audit_parts(spark, sf), n=None)
    return filing.options(events, F.col("action"), "action")


def user_activity(spark, sf):
    audit, _, files = _audit_parts(spark, sf)
    return audits.user_activity(audit, files, 42).select(
        "log_id", "timestamp", "action", "original_filename"
    )


def login_timeline(spark, sf):
    audit, _, files = _audit_parts(spark, sf)
    return audits.login_timeline(audits.user_activity(audit, files, 42)).select(
        "log_id", "timestamp", "action"
    )


def recent_activity(spark, sf):
    return audits.latest_per_user(fx.audit(spark, sf), 50).select(
        "user_id", "rank", "log_id", "action"
    )


def user_action_counts(spark, sf):
    return audits.action_counts(fx.audit(spark, sf), 200)


def user_action_counts_all(spark, sf):
    return audits.action_counts(fx.audit(spark, sf), None)


def failed_logins(spark, sf):
    return audits.failed_logins(fx.audit(spark, sf))


def failed_login_rows(spark, sf):
    """Failed logins written anew as audit rows and counted from these."""
    tried = fx.audit(spark, sf).filter("action = 'failed_login'")
    names = tried.select(
        audits.username_in(F.col("details")).alias("username"), F.col("timestamp").alias("at")
    )
    rows = writers.failed_login_rows(names, F.col("at"))
    return audits.failed_logins(rows).select("username", "attempts", "tier")


def inactivity_timeouts(spark, sf):
    return audits.inactivity_timeouts(fx.audit(spark, sf))


def sessions(spark, sf):
    return audits.sessions(fx.audit(spark, sf))


def siem_events(spark, sf):
    events = audits.latest_events(*_audit_parts(spark, sf), n=None)
    lines = audits.siem_lines(events, host="audit-host", tags=("audit", "export"))
    paths = {
        "timestamp": '$["@timestamp"]',
        "kind": "$.event.kind",
        "category": "$.event.category",
        "action": "$.event.action",
        "outcome": "$.event.outcome",
        "user_name": "$.user.name",
        "file_name": "$.file.name",
        "source_ip": "$.source.ip",
        "metadata_k": "$.metadata.k",
        "metadata_user": "$.metadata.username",
        "host": "$.host.name",
        "first_tag": "$.tags[0]",
    }
    parsed = computed_once(lines, "record", F.parse_json("value"))
    return parsed.select(
        *[F.try_variant_get("record", path, "string").alias(name) for name, path in paths.items()]
    )


def raw_audit_export(spark, sf):
    lines = audits.raw_lines(audits.latest_events(*_audit_parts(spark, sf), n=None))
    return lines.select(
        F.get_json_object("value", "$.log_id").alias("log_id"),
        F.get_json_object("value", "$.timestamp").alias("timestamp"),
        F.get_json_object("value", "$.username").alias("username"),
        F.get_json_object("value", "$.details").alias("details"),
    )


# --- lifecycle ------------------------------------------------------------------------------------


def files_current(spark, sf):
    current = lifecycle.current_rows(fx.files_log(spark, sf), "file_id")
    count = F.coalesce("pii_count", F.lit(0)).cast("bigint").alias("pii_count")
    return current.select("file_id", "status", count, "sanitized_key", "version")


def cascade_delete(spark, sf):
    """What remains of three tables once every file of one type is deleted."""
    facts = fx.file_facts(spark, sf)
    gone = facts.filter("file_type = 'csv'")
    rows = writers.detection_rows(fx.scanned_files(spark, sf))
    parts = lifecycle.cascade_delete(facts, rows, fx.audit(spark, sf), gone)
    out = None
    for name, part in zip(("files", "pii_detections", "audit_logs"), parts):
        owner = rules.or_value(F.col("file_id").cast("string"), "no file")
        counts = part.groupBy(owner.alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select(F.lit(name).alias("table_name"), "file_id", "n")
        out = counts if out is None else out.unionByName(counts)
    return out


def _upload_batch(spark, sf) -> DataFrame:
    docs = readers.read_table(spark, sf, "documents", "doc_id", "source", "text")
    return _as_uploads(spread(docs, "doc_id"))


def _as_uploads(docs: DataFrame) -> DataFrame:
    hostile = tp.one_of(tp.THREAT_TEMPLATES, F.col("doc_id"))
    text = F.when(F.col("doc_id") % 8 == 0, F.concat("text", hostile)).otherwise(F.col("text"))
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("up load "), "doc_id", F.lit(".txt")).alias("filename"),
        F.lit("txt").alias("file_type"),
        (F.col("doc_id") % 150).alias("uploaded_by"),
        fx.as_of().alias("upload_time"),
        F.encode(text, "utf-8").alias("content"),
    )


def sanitize_uploads(spark, sf):
    """The upload job over all documents; the current file rows it leaves."""
    out = shared_folder(spark)
    tables = upload.sanitize(_upload_batch(spark, sf), out, "first", fx.as_of())
    return tables["files"].select(
        "file_id", "original_filename", "original_key", "sanitized_key", "status", "pii_count"
    )


def _mixed_batch(spark, sf) -> DataFrame:
    """The batch as files of seven types; pages and runs come as units, images as words."""
    batch = _upload_batch(spark, sf)
    key = F.col("file_id")
    kind = F.element_at(F.array(*map(F.lit, fx.FILE_TYPES)), (key % len(fx.FILE_TYPES) + 1).cast("int"))
    text = F.decode("content", "utf-8")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    hit = tp.as_column(tp.MIXED_TEMPLATE, key)
    csv = F.concat(F.lit("id,"), quoted, F.lit("\r\n\r\n"), key, F.lit(',"'), hit, F.lit('",,\n'))
    json = F.concat(F.lit('{"v": "'), hit, F.lit('"}'))
    return (
        batch.withColumn("file_type", kind)
        .withColumn("filename", F.concat(F.lit("mixed "), "file_id", F.lit("."), "file_type"))
        .withColumn(
            "units",
            F.when(F.col("file_type") == "pdf", F.split(text, "\n"))
            .when(F.col("file_type") == "docx", F.split(text, "[.]")),
        )
        .withColumn(
            "content",
            F.when(F.col("file_type") == "csv", F.encode(csv, "utf-8"))
            .when(F.col("file_type") == "json", F.encode(json, "utf-8"))
            .otherwise(F.col("content")),
        )
    )


def sanitize_mixed_types(spark, sf):
    """One run over text, JSON, SQL, CSV, page, run and image files; what each file became."""
    out = shared_folder(spark)
    files = _mixed_batch(spark, sf)
    images = files.filter("file_type = 'png'").select("file_id")
    lines = F.concat(F.lit("scan of\n"), tp.as_column(tp.MIXED_TEMPLATE, F.col("file_id")))
    words = fx.words_of(images.select(F.col("file_id").alias("doc_id"), lines.alias("text")), "doc_id")
    tables = upload.sanitize(files, out, "mixed", fx.as_of(), words.withColumnRenamed("doc_id", "file_id"))
    boxes = _counted(spark.read.parquet(f"{out}/boxes"), "n_boxes")
    return (
        tables["files"].join(tables["sanitized"].drop("run_id", "file_type"), "file_id")
        .join(boxes, "file_id", "left")
        .select(
            "file_id", "file_type", "masked_text", "pii_count",
            F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"),
        )
    )


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias(name))


def _table_counts(tables) -> DataFrame:
    """Rows per table and file; events of refused files count as of no file."""
    out = None
    for name in upload.TABLES:
        owner = rules.or_value(F.col("file_id").cast("string"), "no file")
        part = tables[name].groupBy(owner.alias("file_id")).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(name).alias("table_name"), "file_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _two_runs(spark, sf, out):
    batch = _upload_batch(spark, sf)
    for run, rest in (("even", 0), ("odd", 1), ("even", 0)):
        tables = upload.sanitize(batch.filter(F.col("file_id") % 2 == rest), out, run, fx.as_of())
    return tables


def upload_rerun(spark, sf):
    """Rows per table and file after two runs, one of them repeated."""
    return _table_counts(_two_runs(spark, sf, shared_folder(spark)))


def delete_rewrite(spark, sf):
    """Rows per table and file after the deletion of files of one of two runs."""
    out = shared_folder(spark)
    files = _two_runs(spark, sf, out)["files"]
    upload.delete_files(spark, out, files.filter("file_id % 14 = 4"))
    return _table_counts(upload.open_tables(spark, out))


def upload_events(spark, sf):
    """The audit rows the upload job leaves, with the fields of their details."""
    out = shared_folder(spark)
    tables = upload.sanitize(_upload_batch(spark, sf), out, "first", fx.as_of())
    return tables["audit_logs"].select(
        F.get_json_object("details", "$.filename").alias("filename"),
        "action",
        "user_id",
        "file_id",
        F.coalesce(F.get_json_object("details", "$.pii_count").cast("bigint"), F.lit(0)).alias(
            "pii_count"
        ),
        F.get_json_object("details", "$.threats[0]").alias("first_threat"),
    )


# --- word boxes -----------------------------------------------------------------------------------


def _word_texts(spark, sf):
    return tp.templated(spark, sf, tp.MIXED_TEMPLATE, *[
        tp.TYPE_TEMPLATES[t] for t in ("credit_card", "cvv", "phone", "us_phone", "email")
    ])


def word_lines(spark, sf):
    lines = words.lines(fx.words_of(fx.documents(spark, sf), "doc_id"))
    return lines.select("doc_id", "line_num", "line_text", F.size("words").alias("n_words"))


def image_detections(spark, sf):
    found = words.line_detections(fx.words_of(_word_texts(spark, sf), "doc_id"))
    return found.drop("start", "end", "block_num", "par_num")


def word_boxes(spark, sf):
    return words.redaction_boxes(fx.words_of(fx.documents(spark, sf), "doc_id"))


def word_boxes_templated(spark, sf):
    return words.redaction_boxes(fx.words_of(_word_texts(spark, sf), "doc_id"))


# --- streams -----------------------------------------------------------------------------------------


def _drained(spark, result, rest=None):
    """All rows of a stream that has ended; ``rest`` gives those it still holds."""
    out = shared_folder(spark)
    query = jobs.drain(result, out)
    query.awaitTermination()
    if rest is not None:
        return jobs.close(spark, result, rest(spark, out), out)
    return spark.read.schema(result.schema).parquet(f"{out}/data")


def _stream(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # The glob finds the table by its name, be it one file or a folder of files.
    return jobs.read_stream(spark, f"{sf}/{{{name}.parquet}}", schema)


def stream_scan(spark, sf):
    files = _stream(spark, sf, "documents").select(
        "doc_id",
        F.concat("source", F.lit(".txt")).alias("filename"),
        F.encode("text", "utf-8").alias("content"),
    )
    cores = spark.sparkContext.defaultParallelism
    done = jobs.scan_stream(files, fx.as_of(), partitions=cores)
    return _drained(spark, done).select(
        "doc_id", "masked_text", F.size("detections").cast("bigint").alias("pii_count"),
        F.col("security.safe").alias("safe"),
    )


def stream_uploads(spark, sf):
    """Rows per table and file that the upload job leaves when files arrive as a stream."""
    out = shared_folder(spark)
    docs = _stream(spark, sf, "documents").select("doc_id", "source", "text")
    jobs.sanitize_stream(_as_uploads(docs), out, fx.as_of()).awaitTermination()
    return _table_counts(upload.open_tables(spark, out))


def _audit_stream(spark, sf):
    events = _stream(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "error", "failed_login").otherwise("other").alias("action"),
        F.concat(F.lit('{"username":"user'), F.col("user_id"), F.lit('"}')).alias("details"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def stream_failed_logins(spark, sf):
    rows = _drained(
        spark, jobs.failed_login_windows(_audit_stream(spark, sf)), jobs.open_login_windows
    )
    zoneless = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rows.withColumns(zoneless)


def stream_sessions(spark, sf):
    rows = _drained(spark, jobs.session_stream(_audit_stream(spark, sf)), jobs.open_sessions)
    zoneless = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "last_active")}
    return rows.withColumns(zoneless)


def queries() -> dict:
    plain = (
        detect_documents, mask_documents, scan_documents, scan_split_documents,
        scan_split_templated, pii_type_counts, scan_pages,
        names_addresses, scan_mixed, token_mode, redact_mode, token_documents, redact_documents,
        doc_pii_summary, span_documents, span_templated, python_masks, scan_stats, mask_customers, mask_conversations, mask_event_props,
        csv_lines, csv_files, csv_ragged_files, page_units, run_units, run_rebuild, file_previews, before_and_after,
        display_paragraphs, masked_detections_table, display_events,
        normalised_keys, escaped_pages, threats_pages, threats_first_three, threats_documents,
        threats_templated,
        file_hashes, quarantine_split, blocked_uploads, all_users, active_user, file_by_id,
        detections_of_file, saved_detections, files_enriched, files_of_user, admin_files,
        user_files_table, file_search, file_bands, uploads_in_range, file_type_options,
        shown_of_total, dashboard_overview, overview_by_user, pii_by_type, pii_by_type_all,
        pii_heatmap, filetype_share, upload_timeline, risk_levels, recent_files, bulk_export,
        audit_top, audit_filtered, audit_action_options, user_activity, login_timeline,
        recent_activity, user_action_counts, user_action_counts_all, failed_logins,
        failed_login_rows, inactivity_timeouts, sessions, siem_events, raw_audit_export,
        files_current, cascade_delete, sanitize_uploads, sanitize_mixed_types, upload_rerun,
        delete_rewrite, upload_events, word_lines,
        image_detections, word_boxes, word_boxes_templated, stream_scan, stream_uploads,
        stream_failed_logins, stream_sessions,
    )
    named = {f"detect_templated_{t}": partial(templated_type, t) for t in tp.TYPE_TEMPLATES}
    return {f.__name__: f for f in plain} | named
