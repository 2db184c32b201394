"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS site FROM documents),
lines AS (
  SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base
),
spread AS (
  SELECT line FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 1 GROUP BY line HAVING count(DISTINCT site) >= 5
),
kept AS (
  SELECT doc_id, string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE s.line IS NULL) AS text, count(*) AS n_lines,
         count(s.line) AS n_removed
  FROM lines l LEFT JOIN spread s ON l.line = s.line GROUP BY doc_id
)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM kept
"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), concat('null:', md5(coalesce(text, '')))))) AS key
  FROM documents
),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight,
         source_size * 3 AS cap, row_number() OVER (ORDER BY source IS NULL, source) AS rk
  FROM src
),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, sum(weight) OVER () AS all_weight,
         coalesce(CAST(sum(cap) OVER w AS BIGINT), 0) AS caps_before, coalesce(sum(weight) OVER w, 0.0) AS weight_before
  FROM ranked WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
marked AS (SELECT *, CAST(cap AS DOUBLE) / weight <= CAST(total - caps_before AS DOUBLE) / (all_weight - weight_before) AS capped FROM filled),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS DOUBLE) * weight
                   / sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () END AS target
  FROM marked
),
queued AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, s.key,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
copies AS (
  SELECT *, CAST(source_size * e + upto AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0 AND target > 0
),
totals AS (
  SELECT doc_id, sum(size) OVER (ORDER BY finish, key, doc_id, size, upto ROWS UNBOUNDED PRECEDING) AS so_far FROM copies
),
taken AS (
  SELECT doc_id, count(*) AS copies FROM totals WHERE so_far <= (SELECT coalesce(sum(size), 0) FROM sized) GROUP BY doc_id
)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, CAST(coalesce(t.copies, 0) AS INT) AS copies,
       q.size * coalesce(t.copies, 0) AS taken
FROM queued q LEFT JOIN taken t USING (doc_id)
"""

_KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "github": (r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    # The value is the group; what comes before it (a character that can't be part of it, or none) is no part of the span.
    "jwt": (r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 30),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
}
_GATES = {"access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "github": "gh[opsu]_[A-Za-z0-9]{36}"}
_FOUND = "\nUNION ALL\n".join(
    f"""SELECT doc_id, source, {no} AS kind_no, '{kind}' AS kind,
       list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0){" + length(found[i]) - length(vals[i])" if kind == "jwt" else ""} AS start_at,
       length({"vals" if kind == "jwt" else "found"}[i]) AS size, vals[i] AS v
FROM (SELECT doc_id, source, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found,
             regexp_extract_all(text, '{pattern}', {group}) AS vals, unnest(generate_series(1, len(regexp_extract_all(text, '{pattern}')))) AS i
      FROM base WHERE regexp_matches(text, '{_GATES.get(kind, pattern)}')) WHERE length(vals[i]) >= {least}"""
    for no, (kind, (pattern, group, least)) in enumerate(_KINDS.items())
)
OP4 = rf"""
WITH base AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
written AS (
  SELECT *, concat(kind, ':', CAST(start_at AS BIGINT), ':', CAST(start_at + size AS BIGINT)) AS span, sha256(v) AS digest FROM found
),
spread AS (SELECT digest, count(DISTINCT source) >= 3 OR count(DISTINCT doc_id) >= 25 AS copied FROM written GROUP BY digest),
judged AS (
  SELECT w.*, s.copied, NOT s.copied AND len(list_distinct(string_split(v, ''))) >= 8 AS live FROM written w JOIN spread s USING (digest)
),
per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind_no = 0) AS n_assign, count(*) FILTER (WHERE kind_no = 1) AS n_access,
         count(*) FILTER (WHERE kind_no = 2) AS n_hex, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE copied) AS n_copied,
         string_agg(span, ',' ORDER BY start_at, kind_no) FILTER (WHERE kind_no < 3) AS base_spans,
         string_agg(span, ',' ORDER BY start_at, kind_no) AS spans,
         string_agg(span, ',' ORDER BY start_at, kind_no) FILTER (WHERE live) AS live_spans
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(live_spans, '') AS live_spans
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE = {"op1_line_dedup": OP1, "op3_mixing": OP3, "op4_secrets": OP4, "op7_exact_dedup": OP7}
