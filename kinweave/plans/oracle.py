"""The linkage queries as DuckDB SQL, written against the tables alone."""

from __future__ import annotations

import re

from kinweave.functions import tables as t
from kinweave.operators.blocking import KINDS
from kinweave.sources.fixtures import oracle_ctes


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(map(_text, words)) + ")"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in table.items()) + "}"


def _legal_joined(column: str) -> str:
    for pattern, form in t.LEGAL_JOINS:
        column = f"regexp_replace({column}, {_text(pattern)}, {_text(form)}, 'g')"
    return f"replace(replace(replace({column}, '&', ' and '), '+', ' and '), '''', '')"


_DIGITS = "length(regexp_replace(t, '[^0-9]', '', 'g'))"
_REPAIRED = f"""CASE WHEN regexp_full_match(t, '[a-z]+') THEN
    CASE WHEN length(t) > 2 AND regexp_matches(t, '^l[bcdfgkmnpqrstvwxz]') THEN 'i' || t[2:] ELSE t END
  WHEN {_DIGITS} < length(t) AND {_DIGITS} <= 2 AND length(t) - {_DIGITS} >= 2 AND NOT regexp_full_match(t, '[0-9]+(st|nd|rd|th|er|e|eme|b|a|bis)')
    THEN translate(t, '{t.OCR_DIGITS}', '{t.OCR_LETTERS}') ELSE t END"""
_WEB, _DOM, _DBA = t.WEBSITE, t.DOMAIN, t.OTHER_NAME
_LEGAL_WORDS = sorted(set(t.LEGAL.values()))
_LEGAL_CASE = (
    "CASE WHEN list_contains(tokens, 'private') AND list_contains(tokens, 'limited') THEN 'pvtltd' "
    + " ".join(f"WHEN list_contains(tokens, '{x}') THEN '{x}'" for x in t.LEGAL_PRIORITY)
    + " WHEN list_contains(tokens, 'inc') OR list_contains(tokens, 'corp') THEN 'inc' WHEN list_contains(tokens, 'limited') THEN 'ltd'"
    " WHEN list_contains(tokens, 'co') THEN 'co' WHEN list_contains(tokens, 'private') THEN 'pvt' ELSE '' END"
)

_NAMES = rf"""
nm1 AS (SELECT entity_id, regexp_replace(lower(business_name), '^\s*m\s*/\s*s\b\.?', ' ') AS s FROM er_all),
nm2 AS (SELECT entity_id, replace(regexp_extract(s, '{_WEB}', 1), '-', '') AS site, regexp_replace(s, '{_WEB}', ' ') AS s FROM nm1),
nm3 AS (SELECT *, trim(trim(trim(s), '.,;:*-<>!~ ')) AS label FROM nm2),
nm4 AS (SELECT *, regexp_matches(label, '{_DOM}') AND NOT contains(label, ' ') AND (regexp_extract(label, '{_DOM}', 2) <> '' OR starts_with(label, '#')) AS is_dom FROM nm3),
nm5 AS (SELECT entity_id, site, is_dom, list_filter(string_split_regex(CASE WHEN is_dom THEN replace(regexp_extract(label, '{_DOM}', 1), '-', '') ELSE s END, '{_DBA}'), lambda p: trim(p) <> '') AS parts FROM nm4),
nm6 AS (SELECT entity_id, site, is_dom, unnest(CASE WHEN len(parts) = 0 THEN [''] ELSE parts END) AS p, generate_subscripts(CASE WHEN len(parts) = 0 THEN [''] ELSE parts END, 1) AS i FROM nm5),
nm7 AS (SELECT entity_id, site, is_dom, i, list_filter(string_split_regex({_legal_joined('p')}, '[^a-z0-9]+'), lambda x: x <> '') AS raw FROM nm6),
nm8 AS (SELECT entity_id, site, is_dom, i, unnest(raw) AS t, generate_subscripts(raw, 1) AS j FROM nm7),
nm9 AS (SELECT entity_id, i, j, t, {_REPAIRED} AS fixed, {_map(t.LEGAL)}[t] AS form FROM nm8),
nm10 AS (SELECT entity_id, i, j, coalesce({_map(t.NAME_ABBREVIATIONS)}[fixed], fixed) AS spelled, form FROM nm9),
nm11 AS (SELECT entity_id, i, list(coalesce(form, {_map(t.LEGAL)}[spelled], spelled) ORDER BY j) AS words FROM nm10 GROUP BY entity_id, i),
nm12 AS (SELECT entity_id, i, string_split(array_to_string(words, ' '), ' ') AS words FROM nm11),
nm13 AS (SELECT entity_id, i, list_filter(words, lambda x, k: k = 1 OR x <> words[k - 1]) AS words FROM nm12),
nm14 AS (SELECT entity_id, i, words[coalesce(list_position(list_transform(words, lambda x: x IN {_list(t.NAME_PREFIXES)}), false), len(words)):] AS tokens FROM nm13),
nm15 AS (SELECT *, list_filter(tokens, lambda x: x NOT IN {_list(t.NAME_STOP)}) AS no_stop, list_filter(tokens, lambda x: x NOT IN {_list(t.NAME_STOP)} AND x NOT IN {_list(_LEGAL_WORDS)}) AS c FROM nm14),
nm16 AS (SELECT entity_id, i, tokens, CASE WHEN len(c) > 0 THEN c WHEN len(no_stop) > 0 THEN no_stop ELSE tokens END AS core FROM nm15),
nm17 AS (SELECT a.entity_id, a.site, a.is_dom, a.i, coalesce(b.tokens, []) AS tokens, coalesce(b.core, []) AS core FROM nm7 a LEFT JOIN nm16 b ON a.entity_id = b.entity_id AND a.i = b.i),
nm18 AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY len(core) DESC, i) AS r FROM nm17),
nms AS MATERIALIZED (SELECT entity_id, max(CASE WHEN r = 1 THEN array_to_string(tokens, ' ') END) AS nm, max(CASE WHEN r = 1 THEN array_to_string(core, ' ') END) AS core,
  concat_ws(' | ', nullif(max(site), ''), string_agg(nullif(array_to_string(core, ' '), ''), ' | ' ORDER BY r) FILTER (WHERE r > 1)) AS alt,
  max(CASE WHEN r = 1 THEN {_LEGAL_CASE} END) AS legal, CAST(max(is_dom) AS INT) AS is_dom FROM nm18 GROUP BY entity_id)"""

_ZEROS = "regexp_replace({0}, '^0+([0-9])', '\\1')".format


def _regions(column: str) -> str:
    for words in sorted(t.REGIONS_OF_WORDS, key=len, reverse=True):
        column = f"regexp_replace({column}, '\\b{words}\\b', ' {t.REGIONS_OF_WORDS[words]} ', 'g')"
    return column


_ADDRESSES = rf"""
ad1 AS (SELECT entity_id, regexp_replace(regexp_replace(replace(replace(lower(business_address), '<null>', ' '), 'n/a', ' '), '\b([0-9]{{5}})-[0-9]{{4}}\b', '\1', 'g'), '\b([0-9]{{3}})\s([0-9]{{3}})\b', '\1\2', 'g') AS s FROM er_all),
ad2 AS (SELECT entity_id, {_regions("replace(replace(replace(replace(s, 'c/o', ' co '), 'b/h', ' bhd '), 's/o', ' so '), 'w/o', ' wo ')")} AS s FROM ad1),
ad3 AS (SELECT entity_id, unnest(string_split(s, ',')) AS p, generate_subscripts(string_split(s, ','), 1) AS i FROM ad2),
ad4 AS (SELECT entity_id, i, list_filter(string_split_regex(p, '[^a-z0-9]+'), lambda x: x <> '') AS raw FROM ad3),
ad5 AS (SELECT entity_id, i, unnest(raw) AS t, generate_subscripts(raw, 1) AS j FROM ad4),
ad6 AS (SELECT entity_id, i, j, t, regexp_extract(t, '^([0-9]+)(?:st|nd|rd|th|er|eme|e|re)$', 1) AS ordinal, regexp_matches(t, '[0-9]') AND NOT regexp_full_match(t, '[0-9]+') AS mixed FROM ad5),
ad7 AS (SELECT entity_id, i, j, CASE WHEN ordinal <> '' THEN [ordinal] WHEN mixed THEN regexp_extract_all(t, '[0-9]+|[a-z]+') ELSE [coalesce({_map(t.NUMBER_WORDS)}[t], t)] END AS bits, ordinal = '' AND mixed AS split FROM ad6),
ad8 AS (SELECT entity_id, i, j, split, unnest(bits) AS t, generate_subscripts(bits, 1) AS k FROM ad7),
ad9 AS (SELECT entity_id, i, j, k, split, t, coalesce({_map(t.ADDRESS_ABBREVIATIONS)}[t], t) AS short FROM ad8),
ad10 AS (SELECT entity_id, i, j, k, CASE WHEN regexp_full_match(t, '[0-9]+') THEN {_ZEROS('t')} WHEN split THEN short ELSE coalesce({_map(t.REGIONS)}[short], short) END AS t FROM ad9),
ad11 AS (SELECT *, regexp_full_match(t, '[0-9]+') AS is_num FROM ad10 WHERE t <> ''),
ad12 AS (SELECT entity_id, i, arg_min(t, j * 1000 + k) FILTER (WHERE is_num) AS first_num FROM ad11 GROUP BY entity_id, i),
ad13 AS (SELECT entity_id, arg_min(first_num, i) AS hn FROM ad12 WHERE length(first_num) <= 5 GROUP BY entity_id),
ad14 AS (SELECT entity_id, string_agg(t, ' ' ORDER BY i, j, k) AS ad, string_agg(t, ' ' ORDER BY i, j, k) FILTER (WHERE NOT is_num) AS adw,
  arg_max(t, i * 1000000 + j * 1000 + k) FILTER (WHERE is_num AND length(t) = 6) AS postal FROM ad11 GROUP BY entity_id),
ad15 AS (SELECT entity_id, string_agg(t, ' ' ORDER BY length(t), t) AS nums FROM (SELECT DISTINCT entity_id, t FROM ad11 WHERE is_num AND length(t) <> 6) GROUP BY entity_id),
ads AS MATERIALIZED (SELECT e.entity_id, coalesce(ad, '') AS ad, coalesce(adw, '') AS adw, coalesce(nums, '') AS nums, coalesce(postal, '') AS postal, coalesce(hn, '') AS hn
  FROM er_all e LEFT JOIN ad14 USING (entity_id) LEFT JOIN ad15 USING (entity_id) LEFT JOIN ad13 USING (entity_id))"""


def _skeleton(x: str) -> str:
    out = x
    for a, b in t.SKELETON_RULES:
        out = f"replace({out}, '{a}', '{b}')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        out = f"regexp_replace({out}, '{c}+', '{c}', 'g')"
    return out


_RECORDS = f"""
sk1 AS (SELECT entity_id, unnest(string_split(core, ' ')) AS t, generate_subscripts(string_split(core, ' '), 1) AS j FROM nms),
sk2 AS (SELECT entity_id, j, t, {_skeleton('t')} AS s FROM sk1),
sks AS (SELECT entity_id, string_agg(CASE WHEN t = '' OR regexp_full_match(t, '[0-9]+') THEN t ELSE s[1] || regexp_replace(s[2:], '[aeiou]', '', 'g') END, ' ' ORDER BY j) AS sk FROM sk2 GROUP BY entity_id),
recs AS MATERIALIZED (SELECT e.*, n.nm, n.core, n.alt, n.legal, n.is_dom, a.ad, a.adw, a.nums, a.postal, a.hn, s.sk, lower(trim(e.country)) AS country_n, replace(n.core, ' ', '') AS nsp,
  len(regexp_extract_all(n.core, '\\S+')) AS ntok, regexp_extract(n.core, '^(\\S+)', 1) AS first,
  CASE WHEN len(regexp_extract_all(n.core, '\\b[a-z]')) >= 2 THEN array_to_string(regexp_extract_all(n.core, '\\b[a-z]'), '') ELSE '' END AS acro, 0 AS is_indic
  FROM er_all e JOIN nms n USING (entity_id) JOIN ads a USING (entity_id) JOIN sks s USING (entity_id))"""

_KEYS = f"""
aw AS (SELECT DISTINCT entity_id, country_n, w FROM (SELECT entity_id, country_n, unnest(string_split(adw, ' ')) AS w FROM recs) WHERE length(w) >= 3 AND w NOT IN {_list(t.ADDRESS_GENERIC)}),
aw_df AS (SELECT country_n, w, count(*) AS df FROM aw GROUP BY country_n, w),
rare AS (SELECT entity_id, country_n, w, r FROM (SELECT aw.*, row_number() OVER (PARTITION BY entity_id ORDER BY df, w) AS r FROM aw JOIN aw_df USING (country_n, w)) WHERE r <= 4),
nt AS (SELECT DISTINCT entity_id, country_n, t FROM (SELECT entity_id, country_n, unnest(string_split(core || ' ' || replace(alt, '|', ' '), ' ')) AS t FROM recs) WHERE length(t) >= 2),
keys AS MATERIALIZED (
  SELECT entity_id, country_n, 'n' AS kind, t AS key FROM nt
  UNION SELECT entity_id, country_n, 'k', t FROM (SELECT entity_id, country_n, unnest(string_split(sk, ' ')) AS t FROM recs) WHERE length(t) >= 3
  UNION SELECT a.entity_id, a.country_n, 'p', a.t || '|' || b.t FROM nt a JOIN nt b ON a.entity_id = b.entity_id AND a.t < b.t
  UNION SELECT a.entity_id, a.country_n, 'na', a.t || '@' || b.w FROM nt a JOIN rare b USING (entity_id)
  UNION SELECT a.entity_id, a.country_n, 'ha', a.hn || '#' || b.w FROM recs a JOIN rare b USING (entity_id) WHERE a.hn <> ''
  UNION SELECT a.entity_id, a.country_n, 'aa', a.w || '&' || b.w FROM rare a JOIN rare b ON a.entity_id = b.entity_id AND a.w < b.w
  UNION SELECT entity_id, country_n, 'x', nsp FROM recs WHERE length(nsp) >= 4
  UNION SELECT entity_id, country_n, 'x', k FROM (SELECT entity_id, country_n, replace(unnest(string_split(alt, ' | ')), ' ', '') AS k FROM recs) WHERE length(k) >= 4),
key_df AS (SELECT k.country_n, kind, key, count(*) AS df FROM keys k JOIN er_s1 USING (entity_id) GROUP BY k.country_n, kind, key),
key_w AS (SELECT country_n, kind, key, ln(1 + n / df) AS w FROM key_df JOIN (SELECT country_n, count(*) AS n FROM recs WHERE src = 1 GROUP BY country_n) USING (country_n) WHERE df <= 30)"""

_CANDS = f"""
met AS (SELECT k.entity_id AS t_id, s.entity_id AS s1_id, kind, CAST(w AS DECIMAL(18, 9)) AS w
  FROM keys k JOIN er_tgt USING (entity_id) JOIN key_w USING (country_n, kind, key) JOIN (SELECT keys.* FROM keys JOIN er_s1 USING (entity_id)) s USING (country_n, kind, key)),
scored AS (SELECT t_id, s1_id, CAST(sum(w) AS DOUBLE) AS bscore, count(*) AS nkeys, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS k_{k}" for k in KINDS)} FROM met GROUP BY t_id, s1_id),
cands AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY bscore DESC, s1_id) - 1 AS brank FROM scored) WHERE brank < 10),
pruned AS MATERIALIZED (SELECT * EXCLUDE (best) FROM (SELECT *, max(bscore) OVER (PARTITION BY t_id) AS best FROM cands) WHERE bscore >= 0.25 * best),
preds AS MATERIALIZED (SELECT t_id, s1_id, bscore / (SELECT max(bscore) FROM pruned) AS p FROM pruned),
best AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY p DESC, s1_id) AS r FROM preds) WHERE r = 1),
chosen AS (SELECT * FROM best WHERE p >= 0.3)"""

_F = "CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"
_SCORES = f"""
s1s AS (SELECT entity_id AS s1_id, country_n FROM recs WHERE src = 1),
true_n AS (SELECT s1_id, count(*) AS n_true FROM er_truth GROUP BY s1_id),
per_s1 AS MATERIALIZED (SELECT *, {_F} AS f FROM (
  SELECT s.s1_id, s.country_n, coalesce(c.tp, 0) AS tp, coalesce(c.n_pred, 0) AS n_pred, coalesce(n.n_true, 0) AS n_true FROM s1s s
  LEFT JOIN (SELECT c.s1_id, count(*) AS n_pred, count(e.tgt_id) AS tp FROM chosen c LEFT JOIN er_truth e ON e.s1_id = c.s1_id AND e.tgt_id = c.t_id GROUP BY c.s1_id) c USING (s1_id)
  LEFT JOIN true_n n USING (s1_id)))"""

_SIDES = """
pairs AS MATERIALIZED (SELECT p.t_id, p.s1_id, p.bscore, t AS t, s AS s FROM pruned p JOIN recs t ON t.entity_id = p.t_id JOIN recs s ON s.entity_id = p.s1_id)"""


def _idf(column: str) -> str:
    return f"""
tok AS MATERIALIZED (SELECT DISTINCT entity_id, country_n, t FROM (SELECT entity_id, country_n, unnest(string_split({column}, ' ')) AS t FROM recs) WHERE t <> ''),
idf AS MATERIALIZED (SELECT country_n, t, ln(n / df) AS w FROM (SELECT country_n, t, count(*) AS df FROM tok GROUP BY country_n, t) JOIN (SELECT country_n, count(*) AS n FROM recs GROUP BY country_n) USING (country_n)),
wt AS MATERIALIZED (SELECT entity_id, t, w FROM tok JOIN idf USING (country_n, t)),
side AS (SELECT entity_id, sum(w) AS w, max(w) AS top FROM wt GROUP BY entity_id),
both_sides AS (SELECT p.t_id, p.s1_id, sum(a.w) AS ws, count(*) AS ns, max(a.w) AS top FROM pruned p JOIN wt a ON a.entity_id = p.t_id JOIN wt b ON b.entity_id = p.s1_id AND b.t = a.t GROUP BY p.t_id, p.s1_id),
ov AS MATERIALIZED (SELECT p.t_id, p.s1_id, coalesce(b.ws, 0) AS ws, coalesce(x.w, 0) AS wa, coalesce(y.w, 0) AS wb, coalesce(b.ns, 0) AS ns, coalesce(b.top, 0) AS top, greatest(coalesce(x.top, 0), coalesce(y.top, 0)) AS most
  FROM pruned p LEFT JOIN both_sides b USING (t_id, s1_id) LEFT JOIN side x ON x.entity_id = p.t_id LEFT JOIN side y ON y.entity_id = p.s1_id)"""


def _context(group: str, tag: str) -> str:
    columns, parts = ("bscore", "n_idf_jac", "nkeys"), []
    for c in columns:
        other = f"CASE WHEN {c} < mx_{c} OR nm_{c} > 1 THEN mx_{c} ELSE bl_{c} END"
        parts.append(f"round({c} - {other}, 6) AS {tag}_{c}_gap, round(mx_{c} - {c}, 6) AS {tag}_{c}_dmax, rank() OVER (PARTITION BY {group} ORDER BY {c} DESC) AS {tag}_{c}_rk")
    first = ", ".join(f"max({c}) OVER (PARTITION BY {group}) AS mx_{c}" for c in columns)
    second = ", ".join(f"count(*) FILTER (WHERE {c} >= mx_{c}) OVER (PARTITION BY {group}) AS nm_{c}, coalesce(max({c}) FILTER (WHERE {c} < mx_{c}) OVER (PARTITION BY {group}), -1) AS bl_{c}" for c in columns)
    return f"""SELECT t_id, s1_id, count(*) OVER (PARTITION BY {group}) AS {tag}_n, {', '.join(parts)} FROM (SELECT *, {second} FROM (SELECT *, {first} FROM (
  SELECT p.t_id, p.s1_id, CAST(p.bscore AS DOUBLE) AS bscore, CAST(p.nkeys AS DOUBLE) AS nkeys, round(o.ws / greatest(o.wa + o.wb - o.ws, 1e-6), 9) AS n_idf_jac FROM pruned p JOIN ov o USING (t_id, s1_id))))"""


_DOCS = """
er_all AS (SELECT 'D' || CAST(doc_id AS VARCHAR) AS entity_id, lang AS country_n, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS src, text FROM documents),
er_s1 AS (SELECT entity_id FROM er_all WHERE src = 1), er_tgt AS (SELECT entity_id FROM er_all WHERE src = 2), recs AS (SELECT * FROM er_all),
keys AS MATERIALIZED (SELECT DISTINCT entity_id, country_n, 'n' AS kind, k AS key FROM (SELECT entity_id, country_n, trim(unnest(string_split(lower(text), chr(10))), ' ') AS k FROM er_all) WHERE length(k) >= 20)"""

_BASE = oracle_ctes()
_TO = {
    "raw": _BASE, "names": f"{_BASE}, {_NAMES}", "addresses": f"{_BASE}, {_ADDRESSES}", "recs": f"{_BASE}, {_NAMES}, {_ADDRESSES}, {_RECORDS}",
}
_TO["keys"] = f"{_TO['recs']}, {_KEYS}"
_TO["cands"] = f"{_TO['keys']}, {_CANDS}"
_TO["scores"] = f"{_TO['cands']}, {_SCORES}"
_TO["pairs"] = f"{_TO['cands']}, {_SIDES}"
_KEY_TABLES = _KEYS[_KEYS.index("key_df AS") :]


def _q(upto: str, select: str, more: str = "") -> str:
    return f"WITH {_TO[upto]}{', ' + more if more else ''}\n{select}"


_TRI = "CASE WHEN t.{0} = '' OR s.{0} = '' THEN 0 WHEN t.{0} = s.{0} THEN 1 ELSE -1 END AS {1}".format
_NUMS = "list_distinct(list_filter(string_split({0}.nums, ' '), lambda x: x <> ''))".format
_GRID_T = "(SELECT round(0.2 + 0.025 * k, 3) AS t FROM range(31) r(k))"
_SWEEP_T = "(SELECT round(0.3 + 0.05 * k, 2) AS t FROM range(14) r(k))"
_KIND_LIST = ", ".join(f"('{k}')" for k in KINDS)
_LISTED = "SELECT s.entity_id AS source1_entity_id, coalesce(string_agg(x.t_id, ',' ORDER BY x.p DESC, x.t_id), '') AS {0} FROM er_s1 s LEFT JOIN {1} x ON x.s1_id = s.entity_id GROUP BY s.entity_id".format
_COVER = "CASE WHEN {0}.nsp = '' THEN 0.0 ELSE coalesce(list_sum(list_transform(list_filter(string_split({1}.core, ' '), lambda x: length(x) >= 2 AND contains({0}.nsp, x)), lambda x: length(x))), 0) / length({0}.nsp) END".format

_OVERLAP = """round(o_{0}.ws / greatest(o_{0}.wa + o_{0}.wb - o_{0}.ws, 1e-6), 6) AS {0}_idf_jac, round(o_{0}.ws / greatest(least(o_{0}.wa, o_{0}.wb), 1e-6), 6) AS {0}_idf_min, round(o_{0}.ws / greatest(o_{0}.wa, 1e-6), 6) AS {0}_idf_t,
round(o_{0}.ws / greatest(o_{0}.wb, 1e-6), 6) AS {0}_idf_s, round(o_{0}.ws, 6) AS {0}_idf_shared, round(o_{0}.wa - o_{0}.ws, 6) + 0.0 AS {0}_idf_unsh_t, round(o_{0}.wb - o_{0}.ws, 6) + 0.0 AS {0}_idf_unsh_s,
round(o_{0}.top, 6) AS {0}_idf_maxtok_shared, round(o_{0}.most - o_{0}.top, 6) AS {0}_idf_maxtok_miss, o_{0}.ns AS {0}_nshared""".format
_FREQUENCIES = """
freqs AS MATERIALIZED (SELECT entity_id, CASE WHEN nsp = '' THEN -1 ELSE count(*) FILTER (WHERE src = 1) OVER n END AS f_nsp1, CASE WHEN nsp = '' THEN -1 ELSE count(*) OVER n END AS f_nspa,
  CASE WHEN ad = '' THEN -1 ELSE count(*) FILTER (WHERE src = 1) OVER a END AS f_adr1, CASE WHEN ad = '' THEN -1 ELSE count(*) OVER a END AS f_adra
  FROM recs WINDOW n AS (PARTITION BY country_n, nsp), a AS (PARTITION BY country_n, array_to_string(list_sort(string_split(ad, ' ')), ' ')))"""


def _idf_as(column: str, end: str) -> str:
    """_idf() with names of its own, so that several columns have one each."""
    return re.sub(r"\b(tok|idf|wt|side|both_sides|ov)\b", rf"\1_{end}", _idf(column))


def _jw(column: str) -> str:
    return f"round(CASE WHEN t.{column} = s.{column} THEN 1.0 WHEN t.{column} = '' OR s.{column} = '' THEN 0.0 ELSE jaro_winkler_similarity(t.{column}, s.{column}) END, 6)"


def _with_ratios(upto: str, needed: str, select: str) -> str:
    """A query with ratio(a, b, v): the indel ratio of the pairs of strings that `needed` selects.

    The longest common subsequence, one character of a at a time: each place of the new row is the greatest, up to there,
    of the old row's places and, where characters are equal, one more than the place before.
    """
    return f"""WITH RECURSIVE {_TO[upto]},
needed AS MATERIALIZED ({needed}),
lcs AS (SELECT a, b, 0 AS i, list_transform(range(length(b)), lambda x: 0) AS places FROM (SELECT DISTINCT a, b FROM needed WHERE a <> b AND a <> '' AND b <> '')
  UNION ALL SELECT a, b, i + 1, list_transform(higher, lambda x, j: list_max(higher[1:j])) FROM (
    SELECT a, b, i, list_transform(places, lambda x, j: CASE WHEN b[j] = a[i + 1] THEN 1 + CASE WHEN j = 1 THEN 0 ELSE places[j - 1] END ELSE x END) AS higher FROM lcs WHERE i < length(a))),
ratio AS MATERIALIZED (SELECT DISTINCT n.a, n.b, CASE WHEN n.a = n.b THEN 100.0 ELSE 200.0 * coalesce(l.places[length(l.b)], 0) / (length(n.a) + length(n.b)) END AS v
  FROM needed n LEFT JOIN lcs l ON l.a = n.a AND l.b = n.b AND l.i = length(l.a))
{select}"""


_SETS = """SELECT t_id, s1_id, list_sort(list_intersect(x, y)) AS c, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS l, list_sort(list_filter(y, lambda w: NOT list_contains(x, w))) AS r
FROM (SELECT t_id, s1_id, list_distinct(list_filter(string_split(t.core, ' '), lambda w: w <> '')) AS x, list_distinct(list_filter(string_split(s.core, ' '), lambda w: w <> '')) AS y FROM pairs)"""
_SET_STRINGS = f"SELECT t_id, s1_id, c, l, r, array_to_string(c, ' ') AS common, array_to_string(list_concat(c, l), ' ') AS one, array_to_string(list_concat(c, r), ' ') AS two FROM ({_SETS})"

ORACLE: dict[str, str] = {
    "tsv_truth_explode": _q("raw", "SELECT s1_id, tgt_id FROM er_truth"),
    "norm_name": _q("names", "SELECT * FROM nms"),
    "norm_legal_category": _q("names", "SELECT legal, count(*) AS n FROM nms GROUP BY legal"),
    "norm_address": _q("addresses", "SELECT * FROM ads"),
    "norm_skeleton": _q("recs", "SELECT entity_id, sk FROM recs"),
    "norm_record_columns": _q("recs", "SELECT entity_id, country_n, nsp, ntok, first, acro, is_indic FROM recs"),
    "norm_literals": "SELECT * FROM (VALUES ('capita1', 'capital', 'capital', ''), ('lnc', 'inc', 'inc', 'inc'), ('Acme Software software Pvt. Ltd.', 'acme software private limited', 'acme software', 'pvtltd'), "
    "('X trading as Y Z', 'y z', 'y z', ''), ('soclaronflex.com', 'soclaronflex', 'soclaronflex', ''), ('#whestate', 'whestate', 'whestate', ''), ('Café & Crème', 'cafe and creme', 'cafe creme', ''), ('The Krishna Corp', 'krishna corp', 'krishna', 'inc')) AS v(name, nm, core, legal)",
    "address_literals": "SELECT * FROM (VALUES ('012 Main Street', '12 main st', '12', '', '12'), ('Block 4, MG Road 560 001', 'blk 4 marg rd 560001', '4', '560001', '4'), ('77 Elm Ave, New York 12345-6789', '77 elm av ny 12345', '77 12345', '', '77'), "
    "('2nd Floor 12B Rue X', '2 fl 12 b rue x', '2 12', '', '2'), ('', '', '', '', '')) AS v(address, ad, nums, postal, hn)",
    "translit_token_mining": "SELECT * FROM (VALUES ('राम', 'ram'), ('सेवा', 'seva')) AS v(native, latin)",
    "translit_fit": "SELECT * FROM (VALUES ('राम', 'ram'), ('सेवा', 'seva'), ('पुणे', 'pune')) AS v(native, latin)",
    # Words without a learned spelling are written letter by letter, without the vowels that consonants carry.
    "translit_convert": "SELECT * FROM (VALUES ('राम सेवा (राम)', ' ram seva (ram)'), ('सेवा जय, पुणे', ' seva jy, pune'), ('Shop राम', ' Shop ram'), ('Shop', 'Shop'), ('नमन', ' nmn')) AS v(text, latin)",
    "country_code": _q("recs", "SELECT country_n, CAST(dense_rank() OVER (ORDER BY country_n) - 1 AS INT) AS cc FROM (SELECT DISTINCT country_n FROM recs)"),
    "fold_assign": _q("raw", "SELECT entity_id, CAST('0x' || substr(md5(entity_id), 1, 8) AS BIGINT) % 5 AS fold FROM er_s1"),
    "hash_sample": _q("raw", "SELECT entity_id FROM er_all WHERE CAST('0x' || substr(md5('5:' || entity_id), 1, 8) AS BIGINT) % 1000 < 250"),
    "addr_word_df": _q("keys", "SELECT country_n, w, df FROM aw_df"),
    "rare_words_top4": _q("keys", "SELECT entity_id, string_agg(w, ' ' ORDER BY r) AS rare FROM rare GROUP BY entity_id"),
    "keys_by_kind": _q("keys", "SELECT country_n, kind, key, df FROM key_df"),
    "key_idf": _q("keys", "SELECT country_n, kind, key, round(w, 6) AS w FROM key_w"),
    "candidates_topk": _q("cands", "SELECT t_id, s1_id, round(bscore, 6) AS bscore, brank, nkeys, k_n, k_k, k_p, k_na, k_ha, k_aa, k_x FROM cands"),
    "candidates_pruned": _q("cands", "SELECT t_id, s1_id, round(bscore, 6) AS bscore, brank FROM pruned"),
    "blocking_recall": _q(
        "cands",
        "SELECT pairs, round(per_target, 6) AS per_target, round(per_s1, 6) AS per_s1, round(positive_rate, 6) AS positive_rate, round(found / n, 6) AS recall, "
        + ", ".join(f"round(at{k} / n, 6) AS recall_{k}" for k in (1, 2, 3, 5, 10, 20))
        + " FROM (SELECT count(*) AS pairs, count(*) / count(DISTINCT t_id) AS per_target, count(*) / count(DISTINCT c.s1_id) AS per_s1, count(e.tgt_id) AS found, count(e.tgt_id) / count(*) AS positive_rate, "
        + ", ".join(f"count(e.tgt_id) FILTER (WHERE brank < {k}) AS at{k}" for k in (1, 2, 3, 5, 10, 20))
        + " FROM cands c LEFT JOIN er_truth e ON e.s1_id = c.s1_id AND e.tgt_id = c.t_id), (SELECT count(*) AS n FROM er_truth)",
    ),
    "prune_sweep": _q(
        "cands",
        """SELECT top_k, rel_min, round(count(*) / count(DISTINCT t_id), 6) AS pairs_per_target, round(count(e.tgt_id) / (SELECT count(*) FROM er_truth), 6) AS recall
FROM (SELECT *, bscore / max(bscore) OVER (PARTITION BY t_id) AS rel FROM cands) c JOIN (VALUES (3), (5), (8), (10)) k(top_k) ON brank < top_k JOIN (VALUES (0.0), (0.2), (0.3), (0.4), (0.5)) r(rel_min) ON rel >= rel_min
LEFT JOIN er_truth e ON e.s1_id = c.s1_id AND e.tgt_id = c.t_id GROUP BY top_k, rel_min""",
    ),
    "key_ablation": _q(
        "cands",
        "SELECT kind, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) FILTER (WHERE is_true AND c > 0 AND c = nkeys) AS only_here FROM (SELECT nkeys, e.tgt_id IS NOT NULL AS is_true, kind, CASE kind "
        + " ".join(f"WHEN '{k}' THEN k_{k}" for k in KINDS)
        + f" END AS c FROM cands JOIN (VALUES {_KIND_LIST}) v(kind) ON true LEFT JOIN er_truth e ON e.s1_id = cands.s1_id AND e.tgt_id = cands.t_id) GROUP BY kind",
    ),
    "dev_subset": _q(
        "raw",
        """SELECT entity_id, src FROM er_all WHERE entity_id IN (SELECT entity_id FROM h WHERE src = 1 AND x < 100) OR entity_id IN (SELECT tgt_id FROM er_truth JOIN h ON h.entity_id = s1_id WHERE x < 100)
OR entity_id IN (SELECT entity_id FROM h WHERE src <> 1 AND x < 100 AND entity_id NOT IN (SELECT tgt_id FROM er_truth))""",
        "h AS (SELECT entity_id, src, CAST('0x' || substr(md5(entity_id), 1, 8) AS BIGINT) % 1000 AS x FROM er_all)",
    ),
    "freq_features": _q("recs", "SELECT * FROM freqs", _FREQUENCIES),
    "token_idf": _q("cands", "SELECT country_n, t, round(w, 6) AS w FROM idf", _idf("core")),
    "idf_overlap": _q(
        "cands",
        """SELECT t_id, s1_id, round(ws / greatest(wa + wb - ws, 1e-6), 6) AS n_idf_jac, round(ws / greatest(least(wa, wb), 1e-6), 6) AS n_idf_min, round(ws / greatest(wa, 1e-6), 6) AS n_idf_t, round(ws / greatest(wb, 1e-6), 6) AS n_idf_s,
round(ws, 6) AS n_idf_shared, round(wa - ws, 6) + 0.0 AS n_idf_unsh_t, round(wb - ws, 6) + 0.0 AS n_idf_unsh_s, round(top, 6) AS n_idf_maxtok_shared, round(most - top, 6) AS n_idf_maxtok_miss, ns AS n_nshared FROM ov""",
        _idf("core"),
    ),
    "number_agreement": _q(
        "pairs",
        """SELECT t_id, s1_id, CASE WHEN given THEN round(i / u, 6) ELSE 0.0 END AS a_num_jac, CASE WHEN given THEN i ELSE 0 END AS a_num_inter, CASE WHEN given THEN u - i ELSE 0 END AS a_num_conf, pre AS a_hn_prefix FROM (
SELECT t_id, s1_id, t.nums <> '' AND s.nums <> '' AS given, len(list_intersect(x, y)) AS i, len(list_distinct(list_concat(x, y))) AS u,
CAST(t.hn <> '' AND s.hn <> '' AND t.hn <> s.hn AND (starts_with(t.hn, s.hn) OR starts_with(s.hn, t.hn)) AS INT) AS pre FROM (SELECT *, """
        + f"{_NUMS('t')} AS x, {_NUMS('s')} AS y FROM pairs))",
    ),
    "tri_state": _q("pairs", f"SELECT t_id, s1_id, {_TRI('legal', 'n_legal_eq')}, {_TRI('postal', 'a_postal_eq')}, {_TRI('hn', 'a_hn_eq')} FROM pairs"),
    "domain_cover": _q("pairs", f"SELECT t_id, s1_id, round(greatest({_COVER('t', 's')}, {_COVER('s', 't')}), 6) AS cover FROM pairs"),
    "acronym_match": _q("pairs", "SELECT t_id, s1_id, CAST((t.acro <> '' AND t.acro = s.nsp) OR (s.acro <> '' AND s.acro = t.nsp) AS INT) AS n_acro FROM pairs"),
    "lev_distance": _q("pairs", "SELECT t_id, s1_id, levenshtein(t.core, s.core) AS n_lev FROM pairs"),
    "token_sort_keys": _q("recs", "SELECT entity_id, array_to_string(list_sort(string_split(core, ' ')), ' ') AS core_srt, array_to_string(list_sort(string_split(adw, ' ')), ' ') AS adw_srt FROM recs"),
    "jaro_winkler": _q("pairs", "SELECT t_id, s1_id, round(CASE WHEN t.core = s.core THEN 1.0 WHEN t.core = '' OR s.core = '' THEN 0.0 ELSE jaro_winkler_similarity(t.core, s.core) END, 6) AS n_jw FROM pairs"),
    "indel_ratio": _with_ratios("pairs", "SELECT t.core AS a, s.core AS b FROM pairs", "SELECT t_id, s1_id, round(v, 6) AS n_ratio FROM pairs p JOIN ratio ON ratio.a = p.t.core AND ratio.b = p.s.core"),
    "token_set_ratio": _with_ratios(
        "pairs",
        f"SELECT one AS a, two AS b FROM ({_SET_STRINGS}) UNION SELECT common, one FROM ({_SET_STRINGS}) UNION SELECT common, two FROM ({_SET_STRINGS})",
        f"""SELECT t_id, s1_id, round(CASE WHEN len(c) + len(l) = 0 OR len(c) + len(r) = 0 THEN 0.0 WHEN len(c) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 100.0
WHEN len(c) > 0 THEN greatest(x.v, y.v, z.v) ELSE x.v END, 6) AS n_tset FROM ({_SET_STRINGS}) p JOIN ratio x ON x.a = one AND x.b = two JOIN ratio y ON y.a = common AND y.b = one JOIN ratio z ON z.a = common AND z.b = two""",
    ),
    "pair_features_plain": _q(
        "pairs",
        f"""SELECT p.t_id, p.s1_id, levenshtein(t.core, s.core) AS n_lev, {_jw('core')} AS n_jw, {_jw('first')} AS n_first_jw, CAST(t.alt <> '' AS INT) + CAST(s.alt <> '' AS INT) AS n_has_alt, {_TRI('legal', 'n_legal_eq')},
CAST((t.acro <> '' AND t.acro = s.nsp) OR (s.acro <> '' AND s.acro = t.nsp) AS INT) AS n_acro, t.is_dom + s.is_dom AS n_dom,
round(CASE WHEN t.is_dom + s.is_dom > 0 THEN greatest({_COVER('t', 's')}, {_COVER('s', 't')}) ELSE 0.0 END, 6) AS n_dom_cover, t.is_indic AS n_indic, length(t.core) AS n_len_t, length(s.core) AS n_len_s,
t.ntok AS n_ntok_t, s.ntok AS n_ntok_s, CAST(t.ad = '' AS INT) + 2 * CAST(s.ad = '' AS INT) AS a_empty, length(t.ad) AS a_len_t, length(s.ad) AS a_len_s, {_TRI('postal', 'a_postal_eq')}, {_TRI('hn', 'a_hn_eq')},
CASE WHEN given THEN round(i / u, 6) ELSE 0.0 END AS a_num_jac, CASE WHEN given THEN i ELSE 0 END AS a_num_inter, CASE WHEN given THEN u - i ELSE 0 END AS a_num_conf,
CAST(t.hn <> '' AND s.hn <> '' AND t.hn <> s.hn AND (starts_with(t.hn, s.hn) OR starts_with(s.hn, t.hn)) AS INT) AS a_hn_prefix, CAST(t.src = 3 AS INT) AS is_s3, {_OVERLAP('n')}, {_OVERLAP('k')}, {_OVERLAP('a')},
ft.f_nsp1 AS f_nsp1_t, fs.f_nsp1 AS f_nsp1_s, ft.f_nspa AS f_nspa_t, fs.f_nspa AS f_nspa_s, ft.f_adr1 AS f_adr1_t, fs.f_adr1 AS f_adr1_s, ft.f_adra AS f_adra_t, fs.f_adra AS f_adra_s
FROM (SELECT *, t.nums <> '' AND s.nums <> '' AS given, len(list_intersect({_NUMS('t')}, {_NUMS('s')})) AS i, len(list_distinct(list_concat({_NUMS('t')}, {_NUMS('s')}))) AS u FROM pairs) p
JOIN ov_n o_n USING (t_id, s1_id) JOIN ov_k o_k USING (t_id, s1_id) JOIN ov_a o_a USING (t_id, s1_id) JOIN freqs ft ON ft.entity_id = p.t_id JOIN freqs fs ON fs.entity_id = p.s1_id""",
        f"{_idf_as('core', 'n')}, {_idf_as('sk', 'k')}, {_idf_as('adw', 'a')}, {_FREQUENCIES}",
    ),
    "context_target": _q("cands", _context("t_id", "cxt"), _idf("core")),
    "context_s1": _q("cands", _context("s1_id", "cxs"), _idf("core")),
    "decide_exclusive": _q("cands", "SELECT t_id, s1_id, round(p, 6) AS p FROM chosen"),
    "decide_alpha": _q("cands", "SELECT t_id, s1_id, round(p, 6) AS p FROM (SELECT *, max(p) OVER (PARTITION BY s1_id) AS top FROM chosen) WHERE p >= 0.8 * top"),
    "macro_f05": _q("scores", "SELECT round(avg(f), 6) AS macro_f FROM per_s1"),
    "tune_grid": _q(
        "scores",
        f"""SELECT t, alpha, round(avg({_F}), 6) AS macro_f FROM (SELECT g.t, g.alpha, s.s1_id, coalesce(n.n_true, 0) AS n_true, coalesce(k.n_pred, 0) AS n_pred, coalesce(k.tp, 0) AS tp FROM g CROSS JOIN s1s s
LEFT JOIN true_n n USING (s1_id) LEFT JOIN k ON k.t = g.t AND k.alpha = g.alpha AND k.s1_id = s.s1_id) GROUP BY t, alpha""",
        f"""g AS (SELECT t, alpha FROM {_GRID_T} CROSS JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) a(alpha)),
b AS MATERIALIZED (SELECT best.*, max(p) OVER (PARTITION BY best.s1_id) AS top, e.tgt_id IS NOT NULL AS y FROM best LEFT JOIN er_truth e ON e.s1_id = best.s1_id AND e.tgt_id = best.t_id),
k AS (SELECT t, alpha, s1_id, count(*) AS n_pred, count(*) FILTER (WHERE y) AS tp FROM b JOIN g ON p >= t AND p >= alpha * top GROUP BY t, alpha, s1_id)""",
    ),
    "confidence_profile": _q(
        "cands",
        """SELECT country_n, targets, round(n / targets, 6) AS has_cand, round(med_p, 6) AS med_p, round(p_ge_t, 6) AS p_ge_t, round(p_ge_09, 6) AS p_ge_09, round(grey, 6) AS grey
FROM (SELECT country_n, count(*) AS targets FROM recs WHERE src <> 1 GROUP BY country_n) LEFT JOIN (SELECT country_n, count(*) AS n, median(p) AS med_p, avg(CAST(p >= 0.3 AS INT)) AS p_ge_t, avg(CAST(p >= 0.9 AS INT)) AS p_ge_09,
avg(CAST(p >= 0.2 AND p < 0.8 AS INT)) AS grey FROM best JOIN recs ON entity_id = t_id GROUP BY country_n) USING (country_n) ORDER BY targets DESC, country_n LIMIT 6""",
    ),
    "assign_profile": _q("scores", "SELECT country_n, count(*) AS s1, round(avg(n_pred), 6) AS matches_per_s1, round(avg(CAST(n_pred = 0 AS INT)), 6) AS empty FROM per_s1 GROUP BY country_n ORDER BY s1 DESC, country_n LIMIT 6"),
    "country_scores": _q("scores", "SELECT country_n, count(*) AS s1, round(avg(f), 6) AS f05, round(avg(CAST(n_true = 0 AS INT)), 6) AS singleton, round(avg(CAST(f >= 0.9999 AS INT)), 6) AS perfect FROM per_s1 GROUP BY country_n ORDER BY s1 DESC, country_n LIMIT 6"),
    "threshold_sweep": _q(
        "scores",
        f"""SELECT t, country_n, round(avg({_F}), 6) AS f05 FROM (SELECT g.t, s.country_n, coalesce(n.n_true, 0) AS n_true, coalesce(k.n_pred, 0) AS n_pred, coalesce(k.tp, 0) AS tp FROM {_SWEEP_T} g CROSS JOIN s1s s
LEFT JOIN true_n n USING (s1_id) LEFT JOIN k ON k.t = g.t AND k.s1_id = s.s1_id) GROUP BY t, country_n""",
        f"k AS (SELECT t, best.s1_id, count(*) AS n_pred, count(e.tgt_id) AS tp FROM best JOIN {_SWEEP_T} g ON p >= t LEFT JOIN er_truth e ON e.s1_id = best.s1_id AND e.tgt_id = best.t_id GROUP BY t, best.s1_id)",
    ),
    "error_taxonomy": _q(
        "scores",
        """SELECT kind, country_n, count(*) AS n FROM (
SELECT e.s1_id, CASE WHEN q.p IS NULL THEN 'FN blocking miss' WHEN b.s1_id <> e.s1_id THEN 'FN other S1 ranked higher' ELSE 'FN best but p < t' END AS kind
FROM er_truth e ANTI JOIN chosen c ON c.s1_id = e.s1_id AND c.t_id = e.tgt_id LEFT JOIN preds q ON q.s1_id = e.s1_id AND q.t_id = e.tgt_id LEFT JOIN best b ON b.t_id = e.tgt_id
UNION ALL SELECT c.s1_id, CASE WHEN o.s1_id IS NULL THEN 'FP distractor merged' ELSE 'FP target of another S1' END FROM chosen c ANTI JOIN er_truth e ON c.s1_id = e.s1_id AND c.t_id = e.tgt_id LEFT JOIN er_truth o ON o.tgt_id = c.t_id
) JOIN s1s USING (s1_id) GROUP BY kind, country_n""",
    ),
    "loss_attribution": _q(
        "scores",
        """SELECT CASE WHEN n_true = 0 THEN 'singleton S1' WHEN tp = 0 THEN 'S1 with 0 TP' WHEN n_pred > tp THEN 'has FP' WHEN tp < n_true THEN 'only FN' ELSE 'perfect' END AS "case", count(*) AS s1,
round(sum(1 - f) / (SELECT count(*) FROM per_s1), 6) AS points_lost FROM per_s1 GROUP BY 1""",
    ),
    "match_lists": _q("cands", _LISTED("matched_entity_ids", "chosen")),
    "candidate_lists": _q("cands", _LISTED("candidate_entity_ids", "preds")),
    "output_validation": _q(
        "cands",
        """SELECT (SELECT count(*) FROM er_s1 ANTI JOIN m ON m.source1_entity_id = er_s1.entity_id) AS missing_rows, (SELECT count(*) FROM (SELECT source1_entity_id FROM m GROUP BY source1_entity_id HAVING count(*) > 1)) AS repeated_rows,
(SELECT count(*) FROM mx ANTI JOIN cx ON cx.s = mx.s AND cx.t = mx.t) AS matches_not_candidates, (SELECT count(*) FROM (SELECT t FROM mx GROUP BY t HAVING count(*) > 1)) AS shared_targets""",
        f"""m AS MATERIALIZED ({_LISTED("ids", "chosen")}),
c AS MATERIALIZED ({_LISTED("ids", "preds")}),
mx AS (SELECT s, t FROM (SELECT source1_entity_id AS s, unnest(string_split(ids, ',')) AS t FROM m) WHERE t <> ''), cx AS (SELECT s, t FROM (SELECT source1_entity_id AS s, unnest(string_split(ids, ',')) AS t FROM c) WHERE t <> '')""",
    ),
    "near_duplicate_documents": f"WITH {_DOCS}, {_KEY_TABLES}, {_CANDS}\nSELECT t_id, s1_id, round(bscore, 6) AS bscore, nkeys FROM cands WHERE brank = 0",
}
