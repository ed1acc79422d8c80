"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Near duplicates: all pairs that share a shingle, exact similarities, reachability.
NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
g AS (SELECT id, min(root) AS component_id FROM c GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN g ON g.id = n.doc_id
"""

#: Quotations: lines with levels, passages, their units, the first writer of each unit, votes for the message answered, threads, places in reply order.
CHAT = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, regexp_split_to_array(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '\r?\n') AS raw,
  lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations),
l AS (SELECT conv_id, turn, role, previous, unnest(raw) AS x, unnest(range(len(raw))) AS i FROM m),
v AS (SELECT *, len(regexp_replace(regexp_extract(x, '^[ \t]*((>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(x, '^[ \t]*((>[ \t]?)+)', '') AS bare FROM l),
t AS (SELECT *, lead(level, 1, 0) OVER w AS after, CASE WHEN lag(level) OVER w = level AND trim(bare) <> '' AND trim(lag(bare) OVER w) <> '' THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY i) AS passage FROM t),
c AS (SELECT conv_id, turn, first(role) AS role, first(previous) AS previous,
  trim(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (after > 0 AND regexp_matches(x, '(^|[^\p{L}])(wrote|schrieb|a écrit|escribió)([^\p{L}].*)?:[ \t]*$'))), ''), ' ' || chr(9) || chr(10)) AS content,
  max(level)::INT AS quote_level FROM t GROUP BY 1, 2),
p AS (SELECT conv_id, turn, previous, passage, level, string_agg(bare, ' ' ORDER BY i) AS x FROM g GROUP BY ALL),
n AS (SELECT conv_id, turn, previous, passage, level, 0 AS kind, x FROM p
  UNION ALL SELECT conv_id, turn, previous, passage, level, 1, unnest(string_split(regexp_replace(x, '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1))) FROM p
  UNION ALL SELECT conv_id, turn, previous, passage, level, 2, bare FROM g),
u AS (SELECT *, len(string_split(plain, ' ')) AS words FROM (SELECT * EXCLUDE x, lower(trim(regexp_replace(x, '[\s!-/:-@\[-`{-~]+', ' ', 'g'))) AS plain FROM n) WHERE plain <> ''),
f AS (SELECT conv_id, plain, min(turn) AS original FROM u WHERE level = 0 GROUP BY 1, 2),
q AS (SELECT DISTINCT u.conv_id, u.turn, u.passage, u.level, u.kind, u.plain, u.words, f.original FROM u JOIN f ON f.conv_id = u.conv_id AND f.plain = u.plain AND f.original < u.turn WHERE u.level > 0),
b AS (SELECT conv_id, turn, arg_max(original, (-level, w, original)) AS original FROM (SELECT conv_id, turn, original, level, kind, sum(words) AS w FROM q GROUP BY ALL) GROUP BY 1, 2),
k AS (SELECT conv_id, turn, count(DISTINCT passage) AS n_found FROM q GROUP BY 1, 2),
h AS (SELECT conv_id, turn, count(DISTINCT passage) AS n_quoted FROM u WHERE level > 0 GROUP BY 1, 2),
j AS (SELECT c.*, b.original, coalesce(n_found, 0) AS n_found, coalesce(n_quoted, 0) AS n_quoted FROM c LEFT JOIN b USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn) LEFT JOIN h USING (conv_id, turn)),
s AS (SELECT *, coalesce(max(CASE WHEN original <> previous THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS section FROM j),
o AS (SELECT conv_id, turn AS start, original FROM s WHERE original <> previous),
e AS (SELECT conv_id, section, max(turn) AS tip FROM s GROUP BY 1, 2),
a AS (SELECT conv_id, start, original AS up FROM o WHERE (conv_id, original) IN (SELECT (conv_id, start) FROM o)
  UNION SELECT x.conv_id, x.start, e.section FROM (SELECT conv_id, original, min(start) AS start FROM o GROUP BY 1, 2) x JOIN e ON e.conv_id = x.conv_id AND e.tip = x.original),
d AS (SELECT conv_id, start, start AS root FROM o UNION SELECT d.conv_id, d.start, a.up FROM d JOIN a ON a.conv_id = d.conv_id AND a.start = d.root),
z AS (SELECT conv_id, start, min(root) AS root FROM d GROUP BY 1, 2),
y AS (SELECT s.*, coalesce(z.root, s.section) AS thread FROM s LEFT JOIN z ON z.conv_id = s.conv_id AND z.start = s.section)
SELECT conv_id, turn, role, content, coalesce(original, previous) AS reply_to, original IS NOT NULL AS linked, thread, quote_level, n_quoted, n_found,
  '<|' || role || '|>' || chr(10) || content AS formatted, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) - 1 AS position FROM y
"""

ORACLE = {"op1_near_dedup": NEAR_DEDUP, "op5_chat": CHAT}
