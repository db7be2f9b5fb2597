"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINES = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, line, pos, top IS NOT NULL AND doc_id <> top AS gone
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# crc32 of `<doc_id>:<run>`, byte by byte; letters above U+007F have two bytes in UTF-8.
_CRC = """
SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1
  THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS t FROM range(256) AS r(n)
"""

_SPELLING = f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC}), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
    '[a-z\u00C0-\u00FF]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b::BIGINT) & 255) + 1]), 4294967295::BIGINT)) AS h
  FROM counted, crc
), typed AS (
  SELECT CASE WHEN h % 31 = 0
    THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS MATERIALIZED (
  SELECT word, i, left(word, i - 1) AS a, substr(word, i + 1) AS b
  FROM words, (SELECT unnest(range(1, 1 + (SELECT max(length(word)) FROM words))) AS i)
  WHERE i <= length(word)
), pairs AS (
  SELECT x.word AS word, y.word AS near FROM cuts AS x JOIN cuts AS y
    ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word FROM cuts AS c JOIN words AS w ON c.a || c.b = w.word
  UNION SELECT w.word, c.word FROM cuts AS c JOIN words AS w ON c.a || c.b = w.word
), ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM pairs AS p JOIN words AS w ON p.near = w.word
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN near_n >= 10 * w.n THEN near END AS form,
         CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words AS w LEFT JOIN ranked AS r ON r.word = w.word AND r.place = 1
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain AS c JOIN formed AS f ON c.root = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.root FROM chain AS c JOIN formed AS f ON c.root = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed AS f JOIN roots AS r USING (word)
"""


def _centroids(rounds: int = 10) -> str:
    """Each round as two tables: who is nearest, and the centroids after it."""
    near = """
SELECT rid, any_value(vec_id) AS vec_id, any_value(v.e) AS e, arg_min(j, (d, j)) AS j, min(d) AS d
FROM (SELECT v.rid, v.vec_id, v.e, c.j, list_sum(list_transform(range(1, 65),
        lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT AS d
      FROM vectors AS v, c{t} AS c) AS v GROUP BY rid
"""
    after = """
SELECT c.j, coalesce(m.e, c.e) AS e FROM c{t} AS c LEFT JOIN (
  SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e
  FROM (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n
        FROM (SELECT j, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY j, i)
  GROUP BY j) AS m ON c.j = m.j
"""
    steps = []
    for t in range(rounds):
        steps.append(f"a{t} AS MATERIALIZED ({near.format(t=t)})")
        steps.append(f"c{t + 1} AS MATERIALIZED ({after.format(t=t)})")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(t=rounds)})")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS j, e
  FROM vectors ORDER BY j LIMIT 8
), {", ".join(steps)}
SELECT vec_id, a.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.j = c.j
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": _EXACT,
        "op10_line_dedup": _LINES,
        "op11_spelling": _SPELLING,
        "op13_centroids": _centroids(),
    }
