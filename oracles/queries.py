"""Oracle SQL by query name."""

from __future__ import annotations

from maskwell.plans import templates as tp
from oracles import fragments as fr

# --- templated texts ----------------------------------------------------------------------


def text_sql(template: str, key: str) -> str:
    parts, at = [], 0
    for field in tp.FIELD.finditer(template):
        parts.append(fr.quoted(template[at : field.start()]))
        width = field[1]
        if width:
            parts.append(f"lpad(({key} % {10 ** int(width)})::VARCHAR, {width}, '0')")
        else:
            parts.append(f"{key}::VARCHAR")
        at = field.end()
    parts.append(fr.quoted(template[at:]))
    return "(" + " || ".join(parts) + ")"


def one_of_sql(templates, key: str) -> str:
    choices = ", ".join(text_sql(t, key) for t in templates)
    return f"[{choices}][{key} % {len(templates)} + 1]"


def templated(*templates: str) -> str:
    return (
        f"SELECT c_custkey AS doc_id, {one_of_sql(templates, 'c_custkey')} AS text FROM customer"
    )


MIXED = (tp.MIXED_TEMPLATE, tp.CONTEXT_TEMPLATE)
WORD_TEXTS = (tp.MIXED_TEMPLATE,) + tuple(
    tp.TYPE_TEMPLATES[t] for t in ("credit_card", "cvv", "phone", "us_phone", "email")
)


def templated_scan(*templates: str) -> str:
    ctes = fr.scan_ctes(templated(*templates), "doc_id")
    return f"WITH {ctes} {fr.exploded('scanned', 'doc_id, masked_text')}"


def _split_rows() -> str:
    source = f"""SELECT doc_id, repeat('<' || text || '>;' || chr(10), doc_id % 5) AS text
FROM ({templated(*MIXED)})"""
    ctes = fr.scan_ctes(source, "doc_id")
    return f"WITH {ctes} {fr.exploded('scanned', 'doc_id, masked_text')}"


# --- mask modes -----------------------------------------------------------------------------


def _mode_ctes(source: str, mode: str) -> str:
    values = "list_transform(detections, lambda d: d.masked_value)"
    if mode == "token":
        # first appearance gives the order, last appearance the number
        pairs = (
            "list_transform(list_sort(list_transform(list_distinct(vals),"
            " lambda v: {'at': list_position(vals, v), 'v': v,"
            " 'last': len(vals) + 1 - list_position(list_reverse(vals), v)})),"
            " lambda e: {'v': e.v, 'w': 'PII_TOKEN_' || e.last})"
        )
    else:
        pairs = "list_transform(vals, lambda v: {'v': v, 'w': '[REDACTED]'})"
    return f"""{fr.scan_ctes(source, 'doc_id')},
valued AS (SELECT *, {values} AS vals FROM scanned),
paired AS (SELECT *, {pairs} AS pairs FROM valued),
rewritten AS (SELECT doc_id, detections, list_reduce(
    list_prepend({{'v': '', 'w': masked_text}}, pairs),
    lambda a, e: {{'v': '', 'w': replace(a.w, e.v, e.w)}}).w AS masked_text FROM paired)"""


def _token_rows() -> str:
    ctes = _mode_ctes(templated(*MIXED), "token")
    rows = fr.exploded("rewritten", "doc_id, masked_text")
    return f"WITH {ctes} SELECT *, 'PII_TOKEN_' || (ord + 1) AS token FROM ({rows})"


def _redact_rows() -> str:
    ctes = _mode_ctes(templated(*MIXED), "redact")
    rows = fr.exploded("rewritten", "doc_id, masked_text")
    return f"WITH {ctes} SELECT * REPLACE ('[REDACTED]' AS masked_value) FROM ({rows})"


# --- cells and units --------------------------------------------------------------------------


def _customer_cells() -> str:
    """CTEs: three cells per customer, scanned, as ``cells(c_custkey, c, masked_text, n)``."""
    contact = text_sql(tp.MIXED_TEMPLATE, "c_custkey")
    source = f"""
SELECT c_custkey, 1 AS c, CASE WHEN c_custkey % 3 = 0 THEN ' ' || chr(9) ELSE c_name END AS text
  FROM customer
UNION ALL SELECT c_custkey, 2, c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 3, {contact} FROM customer"""
    return fr.scan_ctes(source, "c_custkey, c")


def _mask_customers() -> str:
    return f"""WITH {_customer_cells()}
SELECT c_custkey, max(masked_text) FILTER (c = 1) AS c_name,
  max(masked_text) FILTER (c = 2) AS c_mktsegment, max(masked_text) FILTER (c = 3) AS contact,
  sum(len(detections))::BIGINT AS pii_count FROM scanned GROUP BY c_custkey"""


def _csv_cell(cell: str) -> str:
    return (
        f"CASE WHEN regexp_matches({cell}, '[,\"\\r\\n]') THEN '\"' || "
        f"replace({cell}, '\"', '\"\"') || '\"' ELSE {cell} END"
    )


def _csv_source(cells: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT c_custkey, {i} AS c, {cell} AS text FROM customer" for i, cell in enumerate(cells)
    )


def _csv(*cells: str) -> str:
    """Each cell scanned by itself, then the cells of a record joined by commas."""
    return f"""WITH {fr.scan_ctes(_csv_source(cells), 'c_custkey, c')}
SELECT c_custkey, string_agg({_csv_cell('masked_text')}, ',' ORDER BY c) AS line,
  sum(len(detections))::BIGINT AS pii_count FROM scanned GROUP BY c_custkey"""


def _csv_lines() -> str:
    contact = text_sql(tp.MIXED_TEMPLATE, "c_custkey")
    return _csv("c_name", "''", contact, "'say \"' || c_mktsegment || '\"'")


def _csv_files() -> str:
    return _csv("c_custkey::VARCHAR", "c_name", text_sql(tp.MIXED_TEMPLATE, "c_custkey"))


def _units(cut: str) -> str:
    return f"""SELECT doc_id, (i - 1)::INTEGER AS unit_id, parts[i] AS text FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_id, string_split(text, {cut}) AS parts FROM documents))"""


def _rebuilt(cut: str, between: str) -> str:
    return f"""WITH {fr.scan_ctes(_units(cut), 'doc_id, unit_id')}
SELECT doc_id, string_agg(masked_text, {between} ORDER BY unit_id) AS masked_text,
  sum(len(detections))::BIGINT AS pii_count FROM scanned GROUP BY doc_id"""


def _csv_ragged() -> str:
    return """SELECT doc_id, (2 + doc_id % 4 + doc_id % 3)::BIGINT AS n_cells, md5(text) AS text_md5,
  CASE WHEN doc_id % 3 > 0 THEN '' WHEN doc_id % 4 > 0 THEN 'x' ELSE text END AS last
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
UNION ALL SELECT NULL, 0, NULL, NULL FROM documents WHERE doc_id % 5 = 0"""


# --- masking by place ---------------------------------------------------------------------------

# A detection stays if no longer one that stays overlaps it; each character is then what its
# detection makes of it.
_SPANS = f"""
src AS ({{source}}),
spanned AS (SELECT doc_id, text, {{spans}} AS spans FROM src),
kept AS (SELECT *, list_sort(list_reduce(list_prepend([]::STRUCT(a BIGINT, b BIGINT, n BIGINT,
    d STRUCT(pii_type VARCHAR, original_value VARCHAR, masked_value VARCHAR,
      detection_method VARCHAR, confidence DOUBLE))[],
    list_transform(list_sort(list_transform(spans,
      lambda s: {{{{'w': s.a - s.b, 'n': s.n, 'a': s.a, 's': s}}}})), lambda e: [e.s])),
    lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: k.a < e[1].b AND e[1].a < k.b)) = 0
      THEN list_concat(acc, e) ELSE acc END)) AS kept FROM spanned),
masked AS (SELECT doc_id, kept, CASE WHEN len(spans) = 0 THEN text ELSE array_to_string(
    list_transform(range(0, length(text)), lambda i:
      CASE WHEN len(list_filter(kept, lambda k: k.a <= i AND i < k.b)) > 0
        THEN coalesce(list_filter(kept, lambda k: k.a = i)[1].d.masked_value, '')
      WHEN len(list_filter(spans, lambda k: k.a <= i AND i < k.b)) > 0 THEN 'X'
      ELSE substr(text, i + 1, 1) END), '') END AS masked_text FROM kept)"""


def _span_documents() -> str:
    ctes = _SPANS.format(source="SELECT doc_id, text FROM documents", spans=fr.spans("text"))
    return f"WITH {ctes} SELECT doc_id, masked_text, len(kept)::BIGINT AS n_kept FROM masked"


def _span_templated() -> str:
    source = templated(*MIXED, tp.OVERLAP_TEMPLATE)
    ctes = _SPANS.format(source=source, spans=fr.spans("text"))
    return f"""WITH {ctes} SELECT doc_id, masked_text, (i - 1)::INTEGER AS ord,
  kept[i].d.pii_type AS pii_type, kept[i].d.original_value AS original_value,
  kept[i].d.masked_value AS masked_value, kept[i].d.detection_method AS detection_method,
  kept[i].d.confidence AS confidence, kept[i].a::INTEGER AS start, kept[i].b::INTEGER AS "end"
FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM masked)"""


def _python_masks() -> str:
    badge = (
        "list_transform(regexp_extract_all(text, 'B-[0-9]+'), lambda m: {'pii_type': 'badge',"
        " 'original_value': m, 'masked_value': CASE WHEN m LIKE '%3' THEN '[REDACTED]'"
        " ELSE reverse(m) END, 'detection_method': 'regex', 'confidence': 1.0::DOUBLE})"
    )
    source = templated("badge B-{k} of a{k}@corp.org, or B-{k}{k} and B-{k}")
    return f"""WITH src AS ({source}),
seen AS (SELECT *, list_concat({badge}, {fr.structured('text', ('email',))}) AS detections FROM src),
scanned AS (SELECT *, {fr.masked('text', 'detections')} AS masked_text FROM seen)
{fr.exploded('scanned', 'doc_id, masked_text')}"""


def _run_units() -> str:
    return f"""WITH {fr.scan_ctes(_units("'.'"), 'doc_id, unit_id')}
{fr.exploded('scanned', 'doc_id, unit_id')}"""


# --- hostile content --------------------------------------------------------------------------

# Patterns in order, and the capture group that is reported.
THREATS = {
    "sql_injection": (
        (r"(DROP\s+TABLE|DROP\s+DATABASE|TRUNCATE\s+TABLE)", 1),
        (r"(DELETE\s+FROM\s+\w+\s+WHERE\s+1\s*=\s*1)", 1),
        (r"(INSERT\s+INTO.*SELECT\s+\*)", 1),
        (r"(UNION\s+SELECT.*FROM)", 1),
        (r"(xp_cmdshell|exec\s*\(|execute\s*\()", 1),
        (r"(;\s*DROP|;\s*DELETE|;\s*TRUNCATE|;\s*ALTER)", 1),
    ),
    "xss": (
        (r"<script[^>]*>.*?</script>", 0),
        (r"javascript\s*:", 0),
        (r"on(load|click|mouseover|error|focus)\s*=", 1),
        (r"<iframe[^>]*>", 0),
        (r"document\.cookie", 0),
        (r"window\.location", 0),
    ),
    "shell_commands": (
        (r"(rm\s+-rf|rmdir\s+/s)", 1),
        (r"(wget|curl)\s+https?://", 1),
        (r"(bash|sh|cmd|powershell)\s+-c", 1),
        (r"(__import__\s*\(\s*['\"]os['\"]|subprocess\.call|os\.system)", 1),
        (r"(eval\s*\(|exec\s*\()", 1),
        (r"/etc/passwd|/etc/shadow", 0),
    ),
    "path_traversal": (
        (r"\.\./\.\./", 0),
        (r"%2e%2e%2f", 0),
        (r"\.\.\\", 0),
    ),
}


def _threat_list(name: str, text: str, kept: str = "") -> str:
    parts = [
        f"regexp_extract_all({text}, {fr.quoted('(?is)' + p)}, {g}){kept}" for p, g in THREATS[name]
    ]
    return "flatten([" + ", ".join(parts) + "])"


def _threat_rows(source: str, key: str, kept: str = "") -> str:
    """``found(key, threat, list)`` over a source with ``text``."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{name}' AS threat, {_threat_list(name, 'text', kept)} AS list FROM ({source})"
        for name in THREATS
    )


def _threat_values(source: str, key: str, kept: str = "") -> str:
    return f"""WITH found AS ({_threat_rows(source, key, kept)})
SELECT {key}, threat, (i - 1)::INTEGER AS ord, list[i] AS value FROM (
  SELECT *, unnest(range(1, len(list) + 1)) AS i FROM found)"""


THREAT_TEXTS = templated(*tp.THREAT_TEMPLATES)
_ORDER = "list_position(['sql_injection','xss','shell_commands','path_traversal'], threat)"

VERDICTS = f"""
found AS ({_threat_rows(THREAT_TEXTS, 'doc_id')}),
per_doc AS (SELECT doc_id,
  coalesce(string_agg(threat, ',' ORDER BY {_ORDER}) FILTER (len(list) > 0), '') AS threats
  FROM found GROUP BY doc_id)"""

# --- files --------------------------------------------------------------------------------------

FLAGGED = """
flagged AS (
  SELECT s.file_id, s.pii_type, s.n FROM summaries s
    WHERE NOT (s.file_id % 17 = 0 AND s.file_id % 11 <> 0 AND s.file_id % 13 <> 0)
  UNION ALL SELECT file_id, 'xss', 2 FROM files WHERE file_id % 11 = 0
  UNION ALL SELECT file_id, 'pan', file_id % 5 FROM files
    WHERE file_id % 13 = 0 AND file_id % 11 <> 0
  UNION ALL SELECT file_id, 'voter_id', NULL FROM files
    WHERE file_id % 13 = 0 AND file_id % 11 <> 0),
flagged_done AS (SELECT g.*, upper(f.file_type) AS ft FROM flagged g
  JOIN files f USING (file_id) WHERE f.status = 'done')"""

NO_THREAT = "pii_type NOT IN ('sql_injection', 'xss', 'shell_commands', 'path_traversal')"

OVERVIEW = """count(*) AS total_files, count(*) FILTER (status = 'done') AS sanitized,
  coalesce(sum(pii_count) FILTER (status = 'done'), 0)::BIGINT AS pii_items,
  count(*) FILTER (status = 'processing') AS processing"""

BAND = """CASE WHEN coalesce(pii_count, 0) = 0 THEN '0 PII' WHEN pii_count <= 10 THEN '1-10 PII'
  WHEN pii_count <= 50 THEN '11-50 PII' ELSE '50+ PII' END"""

RISK = """
risks AS (SELECT f.file_id, f.upload_time, f.pii_count,
  CASE WHEN bool_or(g.pii_type IN ('aadhaar','pan','passport','credit_card','cvv',
      'account_number')) THEN 'HIGH'
    WHEN bool_or(g.pii_type IN ('phone','us_phone','email','upi','dob','voter_id','gstin'))
      THEN 'MEDIUM'
    WHEN bool_or(g.pii_type NOT IN ('sql_injection','xss','shell_commands','path_traversal'))
      THEN 'LOW' ELSE 'NONE' END AS risk,
  coalesce(bool_or(g.pii_type = 'xss'), false) AS has_threat
  FROM files f LEFT JOIN flagged g USING (file_id) GROUP BY ALL)"""

TOP_EVENTS = f"""{fr.USERS}, {fr.FACTS}, {fr.AUDIT},
top AS (SELECT * FROM audit ORDER BY timestamp DESC, log_id DESC LIMIT 200),
joined AS (SELECT top.*, username, original_filename FROM top
  LEFT JOIN users USING (user_id) LEFT JOIN facts USING (file_id))"""

ALL_EVENTS = TOP_EVENTS.replace(" ORDER BY timestamp DESC, log_id DESC LIMIT 200", "")

OWN_EVENTS = f"""{fr.FACTS}, {fr.AUDIT},
own AS (SELECT a.*, coalesce(f.original_filename, '') AS original_filename FROM (
    SELECT * FROM audit WHERE user_id = 42 ORDER BY timestamp DESC, log_id DESC LIMIT 200) a
  LEFT JOIN facts f USING (file_id))"""

RANKED = f"""{fr.AUDIT},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY timestamp DESC, log_id DESC)::INTEGER AS rank
  FROM audit WHERE user_id IS NOT NULL)"""


def _action_counts(source: str) -> str:
    actions = ("login", "logout", "upload", "download", "text_scan")
    columns = ", ".join(f"count(*) FILTER (action = '{a}') AS {a}s" for a in actions)
    return f"SELECT user_id, {columns} FROM {source} GROUP BY user_id"


GAPS = f"""{fr.AUDIT},
gaps AS (SELECT user_id, log_id, timestamp, action,
  lag(timestamp) OVER w AS last_active, lag(action) OVER w AS last_action
  FROM audit WHERE user_id IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, log_id))"""


def _sessions() -> str:
    return f"""{GAPS},
numbered AS (SELECT *, sum(CASE WHEN last_active IS NULL
    OR timestamp > last_active + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY timestamp, log_id)::BIGINT AS session_no FROM gaps)"""


# --- uploads and words ----------------------------------------------------------------------------

_HOSTILE = one_of_sql(tp.THREAT_TEMPLATES, "doc_id")
UPLOADS = f"""SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN text || {_HOSTILE} ELSE text END AS text
  FROM documents"""


def _upload_ctes() -> str:
    return f"""up AS ({UPLOADS}),
found AS ({_threat_rows('SELECT * FROM up', 'doc_id')}),
verdicts AS (SELECT doc_id, bool_and(len(list) = 0) AS safe,
  min_by(threat, {_ORDER}) FILTER (len(list) > 0) AS first_threat FROM found GROUP BY doc_id),
{fr.scan_ctes('SELECT up.* FROM up JOIN verdicts USING (doc_id) WHERE safe', 'doc_id')}"""


def _words(texts: str) -> str:
    return f"texts AS ({texts}),{fr.WORDS}"


_TRIMMED = r"regexp_replace(regexp_replace(text, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')"

LINES = f"""
kept AS (SELECT *, {_TRIMMED} AS word FROM words WHERE {_TRIMMED} <> ''),
placed AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_num
    ORDER BY word_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start
  FROM kept),
lines AS (SELECT doc_id, line_num, string_agg(word, ' ' ORDER BY word_ord) AS text,
  count(*)::INTEGER AS n_words FROM placed GROUP BY doc_id, line_num)"""


def _line_detections() -> str:
    """Detections per line, with offsets found by searching on from the last match."""
    found = fr.structured("text", fr.IMAGE_TYPES, "regex+ocr")
    return f"""{LINES},
seen AS (SELECT doc_id, line_num, text, {found} AS ds FROM lines),
dets AS (SELECT doc_id, line_num, text, (i - 1)::INTEGER AS ord, ds[i] AS d FROM (
  SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM seen))"""


def _image_detections() -> str:
    return f"""WITH {_words(templated(*WORD_TEXTS))},{_line_detections()}
SELECT doc_id, line_num, ord, d.pii_type AS pii_type, d.original_value AS original_value,
  d.masked_value AS masked_value, d.detection_method AS detection_method,
  d.confidence AS confidence FROM dets"""


def _boxes(texts: str) -> str:
    # The n-th occurrence of a value within its type starts where n-1 earlier ones end.
    return f"""WITH RECURSIVE {_words(texts)},{_line_detections()},
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_num, d.pii_type ORDER BY ord)
  AS k FROM dets),
located AS (
  SELECT doc_id, line_num, text, ord, d, k,
    {_next_start('0')} AS start FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.doc_id, o.line_num, o.text, o.ord, o.d, o.k,
    {_next_start('l.start + length(l.d.original_value)', 'o.')} AS start
  FROM ordered o JOIN located l ON o.doc_id = l.doc_id AND o.line_num = l.line_num
    AND o.d.pii_type = l.d.pii_type AND o.k = l.k + 1),
spans AS (SELECT *, start + length(d.original_value) AS stop FROM located)
SELECT s.doc_id, 1 AS block_num, 1 AS par_num, s.line_num, s.ord, s.d.pii_type AS pii_type,
  w.word_ord, w.word, (w."left" - 3)::INTEGER AS x0, (w.top - 3)::INTEGER AS y0,
  (w."left" + w.width + 3)::INTEGER AS x1, (w.top + w.height + 3)::INTEGER AS y1
FROM spans s JOIN placed w ON s.doc_id = w.doc_id AND s.line_num = w.line_num
  AND w.start < s.stop AND w.start + length(w.word) > s.start
WHERE NOT CASE s.d.pii_type WHEN 'credit_card' THEN w.start = s.start
  WHEN 'phone' THEN starts_with(w.word, '+') WHEN 'us_phone' THEN starts_with(w.word, '+')
  WHEN 'email' THEN w.start >= s.start + instr(s.d.original_value, '@') - 1
  ELSE false END"""


def _next_start(after: str, prefix: str = "") -> str:
    """First place from ``after`` on where the value stands as a match of its type would."""
    text, value, kind = f"{prefix}text", f"{prefix}d.original_value", f"{prefix}d.pii_type"
    digit = r"'\d$'"
    return (
        f"list_min(list_filter(range({after}, length({text})), lambda p: "
        f"substr({text}, p + 1, length({value})) = {value}"
        f" AND NOT ({kind} IN ('phone', 'credit_card')"
        f" AND regexp_matches(left({text}, p), {digit}))"
        f" AND NOT ({kind} IN ('cvv', 'email')"
        rf" AND regexp_matches(left({text}, p), '\w$'))))"
    )


def _mixed_types() -> str:
    """Units of each file by its type; images have words instead of text."""
    hit = text_sql(tp.MIXED_TEMPLATE, "doc_id")
    scanned = fr.scan_ctes(
        f"""SELECT doc_id, ft, 0 AS c, content AS text FROM safe_files WHERE ft IN ('sql', 'txt', 'json')
UNION ALL SELECT doc_id, ft, u, parts[u] FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS u FROM (
  SELECT doc_id, ft, string_split(text, CASE ft WHEN 'pdf' THEN chr(10) ELSE '.' END) AS parts
  FROM safe_files WHERE ft IN ('pdf', 'docx')))
UNION ALL SELECT doc_id, ft, 1, text FROM safe_files WHERE ft = 'csv'
UNION ALL SELECT doc_id, ft, 2, {hit} FROM safe_files WHERE ft = 'csv'""",
        "doc_id, ft, c",
    )
    lines = f"SELECT doc_id, 'scan of' || chr(10) || {hit} AS text FROM documents WHERE doc_id % 7 = 6"
    quote = "'\"' || replace({}, '\"', '\"\"') || '\"'"
    crlf = "chr(13) || chr(10)"
    return f"""WITH up AS ({UPLOADS}),
typed AS (SELECT *, ['pdf','docx','sql','csv','txt','json','png'][doc_id % 7 + 1] AS ft FROM up),
files AS (SELECT *, CASE ft WHEN 'json' THEN '{{"v": "' || {hit} || '"}}'
    WHEN 'csv' THEN 'id,' || {quote.format('text')} || {crlf} || {crlf} || doc_id || ',"' || {hit}
      || '",,' || chr(10) ELSE text END AS content FROM typed),
found AS ({_threat_rows('SELECT doc_id, content AS text FROM files', 'doc_id')}),
verdicts AS (SELECT doc_id, bool_and(len(list) = 0) AS safe FROM found GROUP BY doc_id),
safe_files AS (SELECT f.* FROM files f JOIN verdicts USING (doc_id) WHERE safe OR ft = 'png'),
{scanned},
done AS (SELECT doc_id, ft, sum(len(detections))::BIGINT AS n,
    CASE ft WHEN 'pdf' THEN string_agg(masked_text, chr(10) || chr(10) ORDER BY c)
      WHEN 'docx' THEN string_agg(masked_text, '' ORDER BY c)
      WHEN 'csv' THEN 'id,' || {_csv_cell("max(masked_text) FILTER (c = 1)")} || {crlf} || {crlf}
        || doc_id || ',' || {_csv_cell("max(masked_text) FILTER (c = 2)")} || ',,' || {crlf}
      ELSE max(masked_text) END AS masked_text FROM scanned GROUP BY doc_id, ft),
image_hits AS (SELECT doc_id, count(*) AS n FROM (WITH {_words(lines)},{_line_detections()}
  SELECT doc_id FROM dets) GROUP BY doc_id),
boxed AS (SELECT doc_id, count(*) AS n_boxes FROM ({_boxes(lines)}) GROUP BY doc_id)
SELECT s.doc_id AS file_id, s.ft AS file_type, masked_text,
  coalesce(d.n, h.n, 0)::BIGINT AS pii_count, coalesce(n_boxes, 0)::BIGINT AS n_boxes
FROM safe_files s LEFT JOIN done d USING (doc_id) LEFT JOIN image_hits h USING (doc_id)
  LEFT JOIN boxed b USING (doc_id)"""


def _table_counts(gone: str) -> str:
    """Rows per table and file the upload job leaves, without the files in ``gone``."""
    return f"""WITH {_upload_ctes()},
kept AS (SELECT doc_id::VARCHAR AS file_id, len(detections) AS n FROM scanned WHERE NOT ({gone}))
SELECT 'files_log' AS table_name, file_id, 2 AS n FROM kept
UNION ALL SELECT 'pii_detections', file_id, n FROM kept WHERE n > 0
UNION ALL SELECT 'audit_logs', file_id, 1 FROM kept
UNION ALL SELECT 'audit_logs', 'no file', count(*) FROM verdicts WHERE NOT safe HAVING count(*) > 0
UNION ALL SELECT 'sanitized', file_id, 1 FROM kept
UNION ALL SELECT 'originals', file_id, 1 FROM kept
UNION ALL SELECT 'quarantine', doc_id::VARCHAR, 1 FROM verdicts WHERE NOT safe"""


# --- streams --------------------------------------------------------------------------------------
def _stream_failed() -> str:
    return """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, username,
  count(*) AS attempts,
  CASE WHEN count(*) >= 5 THEN 'suspicious' WHEN count(*) >= 2 THEN 'warn' ELSE 'normal' END
    AS tier
FROM (SELECT date_trunc('hour', ts) AS window_start, 'user' || user_id AS username
  FROM events WHERE event_type = 'error')
GROUP BY window_start, username"""


def _stream_sessions() -> str:
    return f"""WITH {_sessions()}
SELECT user_id, min(timestamp) AS session_start, max(timestamp) AS last_active,
  count(*) AS events FROM numbered GROUP BY user_id, session_no"""


def oracle_sql() -> dict[str, str]:
    docs = fr.scan_ctes("SELECT * FROM documents", "doc_id")
    out = {
        "detect_documents": f"""WITH s AS (SELECT doc_id, {fr.structured('text')} AS detections
            FROM documents) {fr.exploded('s', 'doc_id')}""",
        "mask_documents": f"WITH {docs} SELECT doc_id, first_text AS masked_text FROM scanned",
        "scan_documents": f"""WITH {docs} SELECT doc_id, masked_text,
            len(detections)::BIGINT AS pii_count FROM scanned""",
        "scan_split_documents": f"""WITH {docs} SELECT doc_id, masked_text,
            len(detections)::BIGINT AS pii_count FROM scanned""",
        "scan_split_templated": _split_rows(),
        "pii_type_counts": f"""WITH {docs}, t AS (SELECT unnest(detections).pii_type AS pii_type
            FROM scanned) SELECT pii_type, count(*) AS pii_count FROM t GROUP BY pii_type""",
        "scan_pages": f"""WITH {fr.scan_ctes('SELECT page_id, html AS text FROM pages', 'page_id')}
            {fr.exploded('scanned', 'page_id')}""",
        "names_addresses": f"""WITH src AS ({templated(tp.CONTEXT_TEMPLATE)}),
            d AS (SELECT *, {fr.contextual('text')} AS detections FROM src),
            m AS (SELECT *, {fr.masked('text', 'detections')} AS masked_text FROM d)
            {fr.exploded('m', 'doc_id, masked_text')}""",
        "scan_mixed": templated_scan(*MIXED),
        "token_mode": _token_rows(),
        "redact_mode": _redact_rows(),
        "token_documents": f"""WITH {_mode_ctes('SELECT * FROM documents', 'token')}
            SELECT doc_id, masked_text FROM rewritten""",
        "redact_documents": f"""WITH {_mode_ctes('SELECT * FROM documents', 'redact')}
            SELECT doc_id, masked_text FROM rewritten""",
        "doc_pii_summary": f"""WITH {docs}, t AS (SELECT doc_id,
            unnest(detections).pii_type AS pii_type FROM scanned)
            SELECT doc_id, pii_type, count(*) AS pii_count FROM t GROUP BY ALL""",
        "scan_stats": f"""WITH {fr.scan_ctes(templated(*MIXED, 'nothing {k}'), 'doc_id')}
            SELECT doc_id, len(detections)::BIGINT AS pii_found, len(d1)::BIGINT AS via_regex,
            (len(detections) - len(d1))::BIGINT AS via_pattern,
            len(list_distinct(list_transform(detections, lambda d: d.pii_type)))::BIGINT
              AS pii_types FROM scanned""",
        "mask_customers": _mask_customers(),
        "mask_conversations": f"""WITH {fr.scan_ctes('SELECT * FROM conversations',
            'conv_id, turn, role')} SELECT conv_id, turn, role, masked_text AS text,
            len(detections)::BIGINT AS pii_count FROM scanned""",
        "mask_event_props": f"""WITH {fr.scan_ctes('SELECT event_id, props AS text FROM events',
            'event_id')} SELECT event_id, masked_text AS props, len(detections)::BIGINT AS n
            FROM scanned""",
        "csv_lines": _csv_lines(),
        "csv_files": _csv_files(),
        "csv_ragged_files": _csv_ragged(),
        "page_units": _rebuilt("chr(10)", "chr(10) || chr(10)"),
        "run_rebuild": _rebuilt("'.'", "''"),
        "span_documents": _span_documents(),
        "span_templated": _span_templated(),
        "python_masks": _python_masks(),
        "run_units": _run_units(),
        "file_previews": """SELECT doc_id, left(text, 1500) AS preview,
            left(text, 3000) AS shown FROM documents""",
        "before_and_after": f"""WITH {docs.replace('SELECT doc_id, first', 'SELECT doc_id, text, first')}
            SELECT doc_id, left(text, 1500) AS original, left(masked_text, 1500) AS sanitized
            FROM scanned""",
        "display_paragraphs": r"""SELECT doc_id, array_to_string(list_filter(
            string_split(text, chr(10)),
            lambda p: NOT regexp_full_match(p, '[\s\p{Z}]*')), chr(10)) AS shown
            FROM documents""",
        "masked_detections_table": f"""WITH {fr.files_ctes()} SELECT pii_type AS type,
            masked_value AS masked_as, detection_method AS method
            FROM ({fr.exploded('scanned', 'file_id')})""",
        "display_events": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props
            ELSE left('{' || repeat(props, 400), 3000) END AS shown FROM events""",
        "normalised_keys": r"""WITH k AS (SELECT p_partkey,
            ['originals/', 'sanitized/', 'other dir/', ''][p_partkey % 4 + 1] || p_partkey || '/'
            || p_name || ' é#-_(' || p_type || ')' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.'
            END || ['pdf','docx','sql','csv','txt','json','png','jpg','jpeg','exe','TXT']
            [p_partkey % 11 + 1] AS key FROM part),
          c AS (SELECT *, string_split(key, '/') AS seg, lower(string_split(key, '.')[-1]) AS ext
            FROM k),
          d AS (SELECT *, array_to_string(list_append(seg[:-2],
            regexp_replace(seg[-1], '[^\p{L}\p{N}_.\-]', '_', 'g')), '/') AS clean FROM c)
          SELECT p_partkey, ext AS extension, CASE ext WHEN 'pdf' THEN 'application/pdf'
            WHEN 'docx' THEN
              'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
            WHEN 'sql' THEN 'text/plain' WHEN 'csv' THEN 'text/csv' WHEN 'txt' THEN 'text/plain'
            WHEN 'json' THEN 'application/json' WHEN 'png' THEN 'image/png'
            WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg'
            ELSE 'application/octet-stream' END AS content_type,
            CASE WHEN ext = 'pdf' THEN 'page' WHEN ext = 'docx' THEN 'run' WHEN ext = 'csv'
              THEN 'cell' WHEN ext IN ('png', 'jpg', 'jpeg') THEN 'image' ELSE 'text' END AS route,
            clean AS clean_key,
            CASE WHEN starts_with(clean, 'sanitized/') THEN 'pii-sanitized'
              ELSE 'pii-originals' END AS bucket,
            regexp_replace(clean, '^(originals|sanitized)/', '') AS path,
            regexp_replace(key, '^(originals|sanitized)/', '') AS delete_path FROM d""",
        "escaped_pages": """SELECT page_id, replace(replace(replace(html, '&', '&amp;'),
            '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""",
        "threats_pages": _threat_values("SELECT page_id, html AS text FROM pages", "page_id"),
        "threats_first_three": _threat_values(
            "SELECT page_id, html AS text FROM pages", "page_id", "[1:3]"
        ),
        "threats_documents": f"""WITH found AS ({_threat_rows('SELECT * FROM documents',
            'doc_id')}) SELECT doc_id, bool_and(len(list) = 0) AS safe,
            count(*) FILTER (len(list) > 0) AS threats FROM found GROUP BY doc_id""",
        "threats_templated": _threat_values(
            f"SELECT * FROM ({THREAT_TEXTS}) WHERE doc_id % 9 <> 0", "doc_id"
        ),
        "file_hashes": """SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1,
            sha256(text) AS sha256 FROM documents""",
        "quarantine_split": f"""WITH src AS ({THREAT_TEXTS}), {VERDICTS}
            SELECT doc_id, CASE WHEN threats = '' THEN 'continue' ELSE 'block' END AS verdict,
            strlen(text)::BIGINT AS file_size, sha256(text) AS sha256, threats,
            {fr.AS_OF} AS scanned_at FROM src JOIN per_doc USING (doc_id)""",
        "blocked_uploads": f"""WITH src AS ({THREAT_TEXTS}), {VERDICTS}
            SELECT doc_id, 'f' || doc_id || '.txt' AS filename,
            split_part(threats, ',', 1) AS first_threat, sha256(text) AS sha256
            FROM src JOIN per_doc USING (doc_id) WHERE threats <> ''""",
        "all_users": f"""WITH {fr.USERS} SELECT user_id, username, email, role, created_at,
            is_active FROM users""",
        "active_user": f"""WITH {fr.USERS} SELECT user_id, username, role FROM users
            WHERE username = 'Customer#000000042' AND is_active LIMIT 1""",
        "file_by_id": f"""WITH {fr.FACTS} SELECT file_id, original_filename, status FROM facts
            WHERE file_id = 22""",
        "detections_of_file": f"""WITH {fr.files_ctes()} SELECT * FROM (
            {fr.exploded('scanned', 'file_id')}) WHERE file_id = 22""",
        "saved_detections": f"WITH {fr.files_ctes()} {fr.exploded('scanned', 'file_id')}",
        "files_enriched": f"""WITH {fr.FACTS}, {fr.USERS} SELECT file_id, original_filename,
            file_type, status, username AS uploader, upload_time FROM facts
            LEFT JOIN users ON uploaded_by = user_id""",
        "files_of_user": f"""WITH {fr.FACTS} SELECT file_id, original_filename,
            'unknown' AS uploader FROM facts WHERE uploaded_by = 42""",
        "admin_files": f"""WITH {fr.FACTS} SELECT file_id, original_filename FROM facts
            WHERE status = 'done'""",
        "user_files_table": f"""WITH {fr.files_ctes()} SELECT original_filename AS filename,
            file_type AS type, pii_count, status,
            strftime(upload_time, '%Y-%m-%d %H:%M') AS uploaded_at FROM files
            WHERE uploaded_by = 42""",
        "file_search": f"""WITH {fr.files_ctes()} SELECT file_id, original_filename, pii_count,
            upload_time FROM files WHERE status = 'done'
            AND contains(lower(original_filename), 'src1') AND file_type = 'pdf'
            AND pii_count = 0 AND upload_time >= {fr.AS_OF} - INTERVAL 30 DAY""",
        "file_bands": f"WITH {fr.files_ctes()} SELECT file_id, pii_count, {BAND} AS band FROM files",
        "uploads_in_range": f"""WITH {fr.FACTS}, r AS (SELECT * FROM (VALUES ('Today', 1),
            ('Last 7 days', 7), ('Last 30 days', 30)) v(date_range, days))
            SELECT date_range, count(file_id) AS n FROM r LEFT JOIN facts
            ON upload_time >= {fr.AS_OF} - to_days(days) GROUP BY date_range""",
        "file_type_options": f"""WITH {fr.FACTS} SELECT DISTINCT file_type FROM facts
            WHERE status = 'done'""",
        "shown_of_total": f"""WITH {fr.files_ctes()} SELECT
            count(*) FILTER (pii_count BETWEEN 1 AND 10) AS shown, count(*) AS total
            FROM files WHERE status = 'done'""",
        "dashboard_overview": f"WITH {fr.files_ctes()} SELECT {OVERVIEW} FROM files",
        "overview_by_user": f"""WITH {fr.files_ctes()} SELECT uploaded_by, {OVERVIEW} FROM files
            GROUP BY uploaded_by""",
        "pii_by_type": f"""WITH {fr.files_ctes()},{FLAGGED} SELECT pii_type,
            sum(coalesce(n, 0))::BIGINT AS pii_count FROM flagged_done WHERE {NO_THREAT}
            GROUP BY pii_type""",
        "pii_by_type_all": f"""WITH {fr.files_ctes()},{FLAGGED} SELECT pii_type,
            sum(coalesce(n, 0))::BIGINT AS pii_count FROM flagged_done GROUP BY pii_type""",
        "pii_heatmap": f"""WITH {fr.files_ctes()},{FLAGGED} SELECT pii_type, """
        + ", ".join(
            f"coalesce(sum(n) FILTER (ft = '{t.upper()}'), 0)::BIGINT AS {t}"
            for t in ("pdf", "docx", "sql", "csv", "txt", "json", "png")
        )
        + f" FROM flagged_done WHERE {NO_THREAT} GROUP BY pii_type",
        "filetype_share": f"""WITH {fr.files_ctes()},{FLAGGED},
            t AS (SELECT upper(f.file_type) AS file_type, coalesce(sum(g.n), 0)::BIGINT AS total
              FROM files f LEFT JOIN (SELECT * FROM flagged WHERE {NO_THREAT}) g USING (file_id)
              WHERE f.status = 'done' GROUP BY ALL)
            SELECT file_type, total,
            floor(total::DOUBLE / nullif(max(total) OVER (), 0)::DOUBLE * 100)::BIGINT AS share_pct,
            row_number() OVER (ORDER BY total DESC, file_type) = 1 AS riskiest FROM t""",
        "upload_timeline": f"""WITH {fr.FACTS}, days AS (SELECT unnest(generate_series(
            DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day)
            SELECT strftime(day, '%Y-%m-%d') AS day, count(file_id) AS uploads FROM days
            LEFT JOIN facts ON upload_time::DATE = day
              AND upload_time >= {fr.AS_OF} - INTERVAL 30 DAY GROUP BY day""",
        "risk_levels": f"""WITH {fr.files_ctes()},{FLAGGED},{RISK} SELECT file_id, risk,
            has_threat, CASE WHEN has_threat THEN 'xss' ELSE '' END AS threats FROM risks""",
        "recent_files": f"""WITH {fr.files_ctes()},{FLAGGED},{RISK} SELECT file_id, risk, pii_count
            FROM risks ORDER BY upload_time DESC, file_id LIMIT 8""",
        "bulk_export": f"""WITH {fr.files_ctes()} SELECT file_id, file_type,
            'sanitized_' || original_filename AS export_name, masked_text
            FROM files JOIN scanned USING (file_id) WHERE sanitized_key IS NOT NULL
            AND file_type = 'txt' AND upload_time >= {fr.AS_OF} - INTERVAL 30 DAY""",
        "audit_top": f"""WITH {TOP_EVENTS} SELECT log_id, timestamp, username, action,
            original_filename FROM joined""",
        "audit_filtered": f"""WITH {ALL_EVENTS} SELECT
            strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, username, action,
            original_filename AS file FROM joined
            WHERE action = 'download' AND username = 'Customer#000000042'
            ORDER BY joined.timestamp DESC, log_id DESC LIMIT 200""",
        "audit_action_options": f"""WITH {ALL_EVENTS} SELECT DISTINCT action FROM joined
            WHERE action IS NOT NULL""",
        "user_activity": f"""WITH {OWN_EVENTS} SELECT log_id, timestamp, action,
            original_filename FROM own""",
        "login_timeline": f"""WITH {OWN_EVENTS} SELECT log_id, timestamp, action FROM own
            WHERE action IN ('login', 'logout') ORDER BY timestamp DESC, log_id DESC LIMIT 20""",
        "recent_activity": f"""WITH {RANKED} SELECT user_id, rank, log_id, action FROM ranked
            WHERE rank <= 50""",
        "user_action_counts": f"""WITH {RANKED}
            {_action_counts('(SELECT * FROM ranked WHERE rank <= 200)')}""",
        "user_action_counts_all": f"WITH {RANKED} {_action_counts('ranked')}",
        "failed_logins": f"""WITH {fr.AUDIT} SELECT
            coalesce(details ->> '$.username', 'unknown') AS username, count(*) AS attempts,
            max(timestamp) AS last_attempt, CASE WHEN count(*) >= 5 THEN 'suspicious'
            WHEN count(*) >= 2 THEN 'warn' ELSE 'normal' END AS tier
            FROM audit WHERE action = 'failed_login' GROUP BY 1""",
        "failed_login_rows": f"""WITH {fr.AUDIT} SELECT
            coalesce(details ->> '$.username', 'unknown') AS username, count(*) AS attempts,
            CASE WHEN count(*) >= 5 THEN 'suspicious' WHEN count(*) >= 2 THEN 'warn'
            ELSE 'normal' END AS tier FROM audit WHERE action = 'failed_login' GROUP BY 1""",
        "inactivity_timeouts": f"""WITH {GAPS} SELECT user_id, last_active,
            timestamp AS timed_out_at FROM gaps
            WHERE timestamp > last_active + INTERVAL 30 MINUTE
            AND last_action NOT IN ('logout', 'session_timeout')""",
        "sessions": f"""WITH {_sessions()} SELECT user_id, session_no,
            min(timestamp) AS session_start, max(timestamp) AS last_active, count(*) AS events
            FROM numbered GROUP BY user_id, session_no""",
        "siem_events": f"""WITH {ALL_EVENTS} SELECT rtrim(rtrim(
              strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS timestamp,
            'event' AS kind,
            CASE WHEN file_id IS NOT NULL THEN 'file' ELSE 'authentication' END AS category,
            action, 'success' AS outcome, username AS user_name, original_filename AS file_name,
            NULL::VARCHAR AS source_ip, details ->> '$.k' AS metadata_k,
            details ->> '$.username' AS metadata_user, 'audit-host' AS host,
            'audit' AS first_tag FROM joined""",
        "raw_audit_export": f"""WITH {ALL_EVENTS} SELECT log_id::VARCHAR AS log_id,
            rtrim(rtrim(strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS timestamp,
            username, details FROM joined""",
        "files_current": f"""WITH {fr.files_ctes()} SELECT file_id, status,
            CASE WHEN status = 'done' THEN pii_count ELSE 0 END AS pii_count, sanitized_key,
            CASE WHEN status = 'done' THEN 2 ELSE 1 END AS version FROM files""",
        "cascade_delete": f"""WITH {fr.files_ctes()}, {fr.AUDIT},
            gone AS (SELECT file_id FROM facts WHERE file_type = 'csv')
            SELECT 'files' AS table_name, file_id::VARCHAR AS file_id, count(*) AS n FROM facts
              WHERE file_id NOT IN (FROM gone) GROUP BY file_id
            UNION ALL SELECT 'pii_detections', file_id::VARCHAR, count(*) FROM found
              WHERE file_id NOT IN (FROM gone) GROUP BY file_id
            UNION ALL SELECT 'audit_logs', coalesce(file_id::VARCHAR, 'no file'), count(*) FROM audit
              WHERE file_id IS NULL OR file_id NOT IN (FROM gone) GROUP BY file_id""",
        "sanitize_uploads": f"""WITH {_upload_ctes()} SELECT doc_id AS file_id,
            'up load ' || doc_id || '.txt' AS original_filename,
            'originals/' || doc_id || '/up_load_' || doc_id || '.txt' AS original_key,
            'sanitized/' || doc_id || '/sanitized_up_load_' || doc_id || '.txt' AS sanitized_key,
            'done' AS status, len(detections)::BIGINT AS pii_count FROM scanned""",
        "sanitize_mixed_types": _mixed_types(),
        "upload_rerun": _table_counts("false"),
        "delete_rewrite": _table_counts("doc_id % 14 = 4"),
        "upload_events": f"""WITH {_upload_ctes()} SELECT
            'up load ' || v.doc_id || '.txt' AS filename,
            CASE WHEN safe THEN 'upload' ELSE 'blocked_upload' END AS action,
            (v.doc_id % 150)::VARCHAR AS user_id,
            CASE WHEN safe THEN v.doc_id::VARCHAR END AS file_id,
            coalesce(len(detections), 0)::BIGINT AS pii_count, first_threat
            FROM verdicts v LEFT JOIN scanned USING (doc_id)""",
        "word_lines": f"""WITH {_words('SELECT doc_id, text FROM documents')},{LINES}
            SELECT doc_id, line_num, text AS line_text, n_words FROM lines""",
        "image_detections": _image_detections(),
        "word_boxes": _boxes("SELECT doc_id, text FROM documents"),
        "word_boxes_templated": _boxes(templated(*WORD_TEXTS)),
        "stream_scan": f"""WITH {docs}, found AS ({_threat_rows('SELECT * FROM documents',
            'doc_id')}), v AS (SELECT doc_id, bool_and(len(list) = 0) AS safe FROM found
            GROUP BY doc_id)
            SELECT doc_id, CASE WHEN safe THEN masked_text END AS masked_text,
            CASE WHEN safe THEN len(detections) ELSE 0 END::BIGINT AS pii_count, safe
            FROM scanned JOIN v USING (doc_id)""",
        "stream_uploads": _table_counts("false"),
        "stream_failed_logins": _stream_failed(),
        "stream_sessions": _stream_sessions(),
    }
    for name, template in tp.TYPE_TEMPLATES.items():
        out[f"detect_templated_{name}"] = templated_scan(template)
    return out
