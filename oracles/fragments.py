"""SQL fragments shared by the oracle queries: detectors, masks, fixture tables.

Written for DuckDB, whose regex engine has no look-around; the two rules that need it are
put as an extraction followed by a filter.
"""

from __future__ import annotations

# --- fixed values: pattern and mask of each type, in order ----------------------------
STRUCTURED = {
    "aadhaar": (r"\b\d{4}\s\d{4}\s\d{4}\b", "left(m, 4) || ' XXXX XXXX'"),
    "pan": (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "left(m, 2) || 'XXX' || substr(m, 6)"),
    "phone": (
        None,
        "CASE WHEN starts_with(m, '+91')"
        " THEN left(m, 4) || repeat('X', length(m) - 6) || right(m, 2)"
        " ELSE left(m, 1) || repeat('X', length(m) - 3) || right(m, 2) END",
    ),
    "us_phone": (
        r"\b(?:\+1[\s\-]?)?\(?\d{3}\)?[\s\-]\d{3}[\s\-]\d{4}\b",
        r"'***-***-' || right(regexp_replace(m, '[ ()\-]', '', 'g'), 4)",
    ),
    "email": (
        r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        "array_to_string(list_transform(string_split(split_part(m, '@', 1), '.'),"
        " lambda p: left(p, 1) || repeat('*', greatest(length(p) - 1, 0))), '.')"
        " || '@' || split_part(m, '@', 2)",
    ),
    "ip_address": (
        r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
        "split_part(m, '.', 1) || '.' || array_to_string(list_transform("
        "string_split(m, '.')[2:], lambda p: repeat('X', length(p))), '.')",
    ),
    "passport": (r"\b[A-Z][0-9]{7}\b", "left(m, 1) || 'XXXXXXX'"),
    "ifsc": (r"\b[A-Z]{4}0[A-Z0-9]{6}\b", "left(m, 4) || '0XXXXXX'"),
    "account_number": (None, "repeat('X', length(m) - 4) || right(m, 4)"),
    "upi": (
        r"\b[a-zA-Z0-9.\-_]{2,256}@(?:upi|oksbi|okaxis|okicici|okhdfcbank|paytm|ybl|ibl|axl"
        r"|waicici|wahdfcbank)\b",
        "left(m, 1) || '***@' || split_part(m, '@', 2)",
    ),
    "credit_card": (
        r"\b(?:\d{4}[\s\-]){3}\d{4}\b",
        r"left(regexp_replace(m, '[ \-]', '', 'g'), 4) || ' **** **** '"
        r" || right(regexp_replace(m, '[ \-]', '', 'g'), 4)",
    ),
    "cvv": (r"\bcvv[\s:]*\d{3,4}\b", r"regexp_replace(m, '\d{3,4}', '***', 'g')"),
    "expiry_date": (r"\b(?:0[1-9]|1[0-2])/[0-9]{2,4}\b", "'**/' || split_part(m, '/', 2)"),
    "device_id": (
        r"\b(?:android|ios)-[a-f0-9]{8,}\b", "split_part(m, '-', 1) || '-XXXXXXXX'",
    ),
    "fingerprint": (r"\bfp_hash_[a-f0-9]+\b", "'fp_hash_XXXXXXXX'"),
    "face_template": (r"\bface_tmp_[a-f0-9]+\b", "'face_tmp_XXXXXXXX'"),
    "dob": (
        r"\b(?:0?[1-9]|[12]\d|3[01])[/\-](?:0?[1-9]|1[0-2])[/\-](?:19|20)\d{2}\b",
        "'[DOB REDACTED]'",
    ),
    "pincode": (
        r"(?:pin|pincode|zip)[\s:]*[1-9][0-9]{5}\b",
        "regexp_replace(m, '[1-9][0-9]{5}', 'XXXXXX', 'g')",
    ),
    "vehicle_number": (
        r"\b[A-Z]{2}[\s\-]?\d{2}[\s\-]?[A-Z]{1,2}[\s\-]?\d{4}\b", "'[VEHICLE REDACTED]'",
    ),
    "voter_id": (r"\b[A-Z]{3}[0-9]{7}\b", "'[VOTER ID REDACTED]'"),
    "gstin": (
        r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", "'[GSTIN REDACTED]'",
    ),
    "swift_code": (
        r"(?:swift|bic)[\s:]+[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?",
        "regexp_replace(m, '(?i)[A-Z]{6}[A-Z0-9]{2,5}', '[SWIFT REDACTED]', 'g')",
    ),
}
NAME = (
    r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|Shri|Smt\.?|Sri)\s+[A-Z][a-z]+"
    r"(?:\s+[A-Z][a-z]+){0,2}\b"
)
ADDRESS = (
    r"\b\d+[,\s]+[A-Za-z0-9\s,\-\.]+(?:Road|Street|Nagar|Colony|Sector|Phase|Block|Avenue"
    r"|Lane|Marg|Chowk|Layout|Extension|Society|Residency|Apartments?|Towers?|Floor|Flat"
    r"|Plot)[^.\n]{0,60}"
)
IMAGE_TYPES = ("phone", "us_phone", "email", "credit_card", "cvv")
# --- end of fixed values --------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(name: str, pattern: str | None, text: str) -> str:
    if name == "phone":
        return (
            rf"list_filter(regexp_extract_all({text}, '(?:\+91[\s\-]?)?\d+'),"
            r" lambda m: regexp_full_match(m, '(?:\+91[\s\-]?)?[6-9]\d{9}'))"
        )
    if name == "account_number":
        return (
            rf"list_filter(regexp_extract_all({text}, '\b\d{{9,18}}\b'),"
            r" lambda m: NOT regexp_full_match(m, '[6-9]\d{9}'))"
        )
    return f"regexp_extract_all({text}, {quoted('(?i)' + pattern)})"


def _described(found: str, name: str, mask: str, method: str, confidence: float) -> str:
    return (
        f"list_transform({found}, lambda m: {{'pii_type': '{name}', 'original_value': m,"
        f" 'masked_value': {mask}, 'detection_method': '{method}',"
        f" 'confidence': {confidence}::DOUBLE}})"
    )


def structured(text: str, types=None, method: str = "regex") -> str:
    """List of detections of the fixed-format types."""
    parts = [
        _described(_found(name, pattern, text), name, mask, method, 1.0)
        for name, (pattern, mask) in STRUCTURED.items()
        if types is None or name in types
    ]
    return "flatten([" + ",\n  ".join(parts) + "])"


def contextual(text: str) -> str:
    """List of detections of names, then addresses."""
    names = _described(
        f"regexp_extract_all({text}, {quoted(NAME)})", "name", "'[NAME REDACTED]'", "pattern", 0.9
    )
    found = (
        f"list_filter(list_transform(regexp_extract_all({text}, {quoted('(?i)' + ADDRESS)}),"
        r" lambda a: regexp_replace(a, '\s+$', '')), lambda a: length(a) > 10)"
    )
    addresses = _described(
        found, "address", r"regexp_extract(m, '^\d+') || ', ***, ***, ***'", "pattern", 0.85
    )
    return f"flatten([{names},\n  {addresses}])"


def spans(text: str) -> str:
    """List of {a, b, n, d}: place, number of the type, and the detection.

    A match's place is what lies before it: the pieces between matches and the matches.
    """
    parts = []
    kinds = [(n, p, m, "regex", 1.0) for n, (p, m) in STRUCTURED.items()]
    kinds += [("name", None, "'[NAME REDACTED]'", "pattern", 0.9)]
    kinds += [("address", None, r"regexp_extract(m, '^\d+') || ', ***, ***, ***'", "pattern", 0.85)]
    for number, (name, pattern, mask, method, confidence) in enumerate(kinds):
        value, good = "m", "true"
        pattern = {
            "phone": r"(?:\+91[\s\-]?)?\d+", "account_number": r"\b\d{9,18}\b",
            "name": NAME, "address": "(?i)" + ADDRESS,
        }.get(name) or "(?i)" + pattern
        if name == "phone":
            good = r"regexp_full_match(m, '(?:\+91[\s\-]?)?[6-9]\d{9}')"
        if name == "account_number":
            good = r"NOT regexp_full_match(m, '[6-9]\d{9}')"
        if name == "address":
            value, good = r"regexp_replace(m, '\s+$', '')", r"length(regexp_replace(m, '\s+$', '')) > 10"
        found = f"regexp_extract_all({text}, {quoted(pattern)})"
        between = f"string_split_regex({text}, {quoted(pattern)})"
        place = (
            f"(list_sum(list_transform({between}[1:i], lambda x: length(x)))"
            f" + coalesce(list_sum(list_transform({found}[1:i - 1], lambda x: length(x))), 0))::BIGINT"
        )
        one = (
            f"{{'a': {place}, 'b': {place} + length({value}), 'n': {number}::BIGINT, 'd': {{'pii_type':"
            f" '{name}', 'original_value': {value}, 'masked_value': {mask},"
            f" 'detection_method': '{method}', 'confidence': {confidence}::DOUBLE}}}}"
        )
        parts.append(
            f"list_transform(list_filter(list_transform({found}, lambda m, i: {{'m': m, 'i': i}}),"
            f" lambda e: {good.replace('(m,', '(e.m,')}), lambda e:"
            f" list_transform([e.m], lambda m: list_transform([e.i], lambda i: {one})[1])[1])"
        )
    return "flatten([" + ",\n  ".join(parts) + "])"


def masked(text: str, detections: str) -> str:
    """Apply detections in order, each to the first occurrence of its value."""
    step = (
        "{'o': '', 'm': CASE WHEN instr(a.m, d.o) = 0 THEN a.m ELSE"
        " left(a.m, instr(a.m, d.o) - 1) || d.m || substr(a.m, instr(a.m, d.o) + length(d.o))"
        " END}"
    )
    pairs = (
        f"list_transform({detections}, lambda d: "
        "{'o': d.original_value, 'm': d.masked_value})"
    )
    return (
        f"list_reduce(list_prepend({{'o': '', 'm': {text}}}, {pairs}),"
        f" lambda a, d: {step}).m"
    )


def scan_ctes(source: str, keys: str, text: str = "text") -> str:
    """CTEs ending in ``scanned(keys..., masked_text, detections)``."""
    return f"""
src AS ({source}),
s1 AS (SELECT *, {structured(text)} AS d1 FROM src),
s2 AS (SELECT *, {masked(text, 'd1')} AS first_text FROM s1),
s3 AS (SELECT *, {contextual('first_text')} AS d2 FROM s2),
scanned AS (SELECT {keys}, first_text, d1, {masked('first_text', 'd2')} AS masked_text,
  list_concat(d1, d2) AS detections FROM s3)"""


def exploded(table: str, keys: str, detections: str = "detections") -> str:
    """SELECT of one row per detection, numbered from 0."""
    return f"""
SELECT {keys}, (i - 1)::INTEGER AS ord, {detections}[i].pii_type AS pii_type,
  {detections}[i].original_value AS original_value,
  {detections}[i].masked_value AS masked_value,
  {detections}[i].detection_method AS detection_method,
  {detections}[i].confidence AS confidence
FROM (SELECT *, unnest(range(1, len({detections}) + 1)) AS i FROM {table})"""


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

USERS = """
users AS (SELECT c_custkey AS user_id, c_name AS username,
  'user' || c_custkey || '@example.com' AS email,
  CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'standard' END AS role,
  c_acctbal >= 0 AS is_active,
  TIMESTAMP '2023-01-01 00:00:00' + to_hours(c_custkey) AS created_at FROM customer)"""

_FILE = """
  doc_id AS file_id,
  source || '_' || doc_id || '.' || ['pdf','docx','sql','csv','txt','json','png'][doc_id % 7 + 1]
    AS original_filename,
  ['pdf','docx','sql','csv','txt','json','png'][doc_id % 7 + 1] AS file_type,
  doc_id % 150 AS uploaded_by,
  CASE WHEN doc_id % 10 = 3 THEN 'processing' ELSE 'done' END AS status,
  TIMESTAMP '2023-12-02 00:00:00' + to_hours((doc_id * 7) % 1440) AS upload_time"""

FACTS = f"facts AS (SELECT {_FILE} FROM documents)"

AUDIT = """
audit AS (SELECT event_id AS log_id,
  CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
  CASE event_type WHEN 'click' THEN 'view' WHEN 'purchase' THEN 'download'
    WHEN 'error' THEN 'failed_login'
    WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'logout' ELSE 'login' END
    WHEN 'signup' THEN CASE WHEN event_id % 4 = 1 THEN 'text_scan' ELSE 'upload' END
  END AS action,
  CASE WHEN event_type IN ('click', 'purchase') OR (event_type = 'signup' AND event_id % 4 <> 1)
    THEN (props ->> '$.k')::BIGINT END AS file_id,
  CASE WHEN event_type = 'error' THEN '{"username":"user' || user_id || '"}' ELSE props END
    AS details,
  NULL::VARCHAR AS ip_address, ts AS timestamp FROM events)"""


def files_ctes() -> str:
    """CTEs ending in ``files`` and ``summaries(file_id, pii_type, n)``."""
    return (
        scan_ctes("SELECT * FROM documents", "doc_id, doc_id AS file_id")
        + f""",
{FACTS},
found AS (SELECT file_id, unnest(detections).pii_type AS pii_type FROM scanned),
summaries AS (SELECT file_id, pii_type, count(*) AS n FROM found GROUP BY ALL),
files AS (SELECT f.*, len(s.detections)::BIGINT AS pii_count,
    CASE WHEN f.status = 'done' THEN 'sanitized/' || f.file_id || '/sanitized_'
      || f.original_filename END AS sanitized_key
  FROM facts f JOIN scanned s USING (file_id))"""
    )


WORDS = """
words AS (SELECT doc_id, 1 AS block_num, 1 AS par_num, (l - 1)::INTEGER AS line_num,
  (w - 1)::INTEGER AS word_ord, parts[w] AS text, (w - 1) * 40 AS "left", (l - 1) * 20 AS top,
  length(parts[w]) * 8 AS width, 16 AS height
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS w FROM (
    SELECT doc_id, l, string_split(lines[l], ' ') AS parts FROM (
      SELECT *, unnest(range(1, len(lines) + 1)) AS l FROM (
        SELECT doc_id, string_split(text, chr(10)) AS lines FROM texts)))))"""
