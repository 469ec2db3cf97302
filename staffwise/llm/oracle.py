"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

from .license_texts import NOTICES, SPELLINGS, TEXTS
from .secrets import ACCESS, ASSIGN, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, GENERIC, HEX

SPACE = r"[\x20\x09-\x0D]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{SPACE}'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s
    FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id,
       coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = d.doc_id
"""

_KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("owned", GENERIC)]
_FOUND = "\n  UNION ALL ".join(
    f"""SELECT rid, doc_id, owner, repo, {k} AS kind, unnest(m) AS m, unnest(g[1:len(m)]) AS g,
         unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rid, doc_id, owner, repo, regexp_extract_all(t, {quoted(p)}) AS m,
           string_split_regex(t, {quoted(p)}) AS g FROM d)""" for k, (_, p) in enumerate(_KINDS))

OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
         concat_ws('/', source, lang) AS repo FROM documents),
f AS (
  {_FOUND}),
placed AS (
  SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop,
         CASE WHEN kind = 0 THEN regexp_extract(m, {quoted(ASSIGN)}, 1) ELSE m END AS v FROM f),
spans AS (
  SELECT rid, owner, repo, kind, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop, v FROM placed
  WHERE (kind = 0 AND length(v) >= 12) OR (kind = 1 AND length(v) >= 18) OR (kind = 2 AND length(v) >= 16)
     OR (kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]')
         AND regexp_matches(v, '[A-Z]'))),
judged AS (
  SELECT s.*, n, m, CASE WHEN n >= {EXAMPLE_OWNERS} OR m >= {EXAMPLE_REPOSITORIES} THEN 'example'
                         WHEN n = 1 AND m = 1 THEN 'live' ELSE 'shared' END AS verdict
  FROM spans s JOIN (SELECT v, count(DISTINCT owner) AS n, count(DISTINCT coalesce(repo, '')) AS m
                     FROM spans GROUP BY v) o USING (v)),
kept AS (
  SELECT * FROM judged j WHERE kind < 3 OR (verdict = 'live' AND NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.rid = j.rid AND b.kind < 3 AND b.start < j.stop AND b.stop > j.start))),
named AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS s FROM kept)
SELECT d.doc_id, count(kind) FILTER (kind = 0) AS n_assign, count(kind) FILTER (kind = 1) AS n_access,
       count(kind) FILTER (kind = 2) AS n_hex, count(kind) FILTER (kind = 3) AS n_owned,
       count(kind) FILTER (verdict = 'live') AS n_live, count(kind) FILTER (verdict = 'example') AS n_example,
       coalesce(max(n), 0)::BIGINT AS most_owners, coalesce(max(m), 0)::BIGINT AS most_repositories,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN named USING (rid) GROUP BY d.rid, d.doc_id
"""

_CONTROL = r"(\\*)(?:<</?SYS>>|\[/?INST\]|</?s>|\[ROLE:[^\]\s]*\]|\[/ROLE\])"
OP4 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(t) + coalesce(list_sum(list_transform(
           regexp_extract_all(t, {quoted(_CONTROL)}, 1), lambda b: length(b) + 1)), 0)
         + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
                ELSE length(role) + 16 END AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + count(*) - 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _canonical(x: str) -> str:
    out = rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    mark = (rf"regexp_matches({x}, '^[^\p{{L}}\p{{N}}(©]*(?i:copyright|\(c\)|©|all rights reserved)([^\p{{L}}]|$)')"
            rf" AND NOT regexp_matches({x}, '(?i)copyright (notice|holder|owner|licen[cs]e)')")
    return f"CASE WHEN {mark} THEN '' ELSE {out} END"


_KNOWN = ", ".join(f"({quoted(k)}, {quoted(t)})" for k in sorted({**TEXTS, **NOTICES})
                   for t in [*TEXTS.get(k, []), *NOTICES.get(k, [])])
_LINES = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_canonical('x')})," \
         " lambda x: x <> '')"
OP9 = f"""
WITH known AS (
  SELECT form, min(license) AS license FROM (
    SELECT license, array_to_string({_LINES}, ' ') AS form FROM (VALUES {_KNOWN}) k(license, text))
  WHERE form <> '' GROUP BY form),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_LINES} AS lines FROM documents),
w AS (SELECT rid, doc_id, lines, array_to_string(lines, ' ') AS form FROM d),
l AS (SELECT rid, license FROM (SELECT rid, unnest(lines) AS form FROM d) JOIN known USING (form)),
named AS (
  SELECT rid, license, 1 AS n FROM l
  UNION ALL SELECT rid, license, 0 FROM w JOIN known USING (form))
SELECT w.doc_id, sha256(w.form) AS canonical_sha256, k.license,
       coalesce(n.n, 0)::BIGINT AS n_license_lines, coalesce(n.licenses, '') AS licenses
FROM w LEFT JOIN known k USING (form)
LEFT JOIN (SELECT rid, sum(n) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
           FROM named GROUP BY rid) n USING (rid)
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS lot FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
-- sources by how soon they reach their limit; a level for each number of limited
-- ones, which rises up to the right number and falls beyond it
p AS (
  SELECT *, 3 * source_size AS cap,
         sum(3 * source_size) OVER o - 3 * source_size AS given, sum(w) OVER () - sum(w) OVER o + w AS rest
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT max(((SELECT sum(source_size) FROM s) - given)::BIGINT / rest::BIGINT) AS lam FROM p),
t AS (
  SELECT source, source_size,
         CASE WHEN cap < lam * w THEN cap::DOUBLE ELSE lam * w END AS target FROM p, level),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix' || coalesce('s' || source, 'n')), 1, 10))::HUGEINT AS shift FROM t),
k AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY substr(lot, 1, 1) >= '8',
           CASE WHEN substr(lot, 1, 1) >= '8' THEN -size ELSE size END, lot) - 1 AS k FROM d),
c AS (
  SELECT k.doc_id, k.size, r.source_size, r.target, k.k::HUGEINT AS k, floor(rate)::BIGINT AS whole,
         floor((rate - floor(rate)) * 1099511627776)::HUGEINT AS part, shift
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + ((k + 1) * part + shift) // 1099511627776
                - (k * part + shift) // 1099511627776))::BIGINT AS taken
FROM c
"""
