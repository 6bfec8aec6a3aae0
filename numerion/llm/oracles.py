"""DuckDB texts of queries whose operators work in ways that SQL can say plainly, if slowly."""

from __future__ import annotations

#: Every 100-byte window of every text as hex; all but the first of equal ones mark their bytes.
SUFFIX_DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM b WHERE len(x) >= 200) q),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) q WHERE k > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS starts FROM later),
numbered AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY doc_id, g),
told AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
pieces AS (SELECT t.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS z, sum(z - a) AS gone, count(*) AS n
  FROM told t JOIN b USING (doc_id) GROUP BY t.doc_id)
SELECT b.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(x, 2 * z + 1), x))) AS kept_sha256
FROM b LEFT JOIN pieces p USING (doc_id)
"""

#: All pairs of documents that share a shingle, counted; components by reachability.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM words) q
  UNION ALL SELECT doc_id, ws[1] FROM words WHERE len(ws) = 1) r),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM met JOIN size a ON a.doc_id = u JOIN size b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
sides AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM sides UNION SELECT r.u, b.v FROM reach r JOIN sides b ON b.u = r.v),
least AS (SELECT u AS doc_id, min(least(u, v)) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM (SELECT doc_id FROM documents) d LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: Lines with their quote levels, passages as islands of one level, and the newest earlier holder of each quoted text.
CHAT_QUOTES = r"""
WITH RECURSIVE split AS (
  SELECT conv_id, turn, role, generate_subscripts(ls, 1) AS n, unnest(ls) AS x FROM (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations) q),
marked AS (SELECT *, regexp_extract(x, '^[ \t]*((?:>[ \t]?)+)', 1) AS m, regexp_matches(x, '^(On .+ wrote|Am .+ schrieb.*|Le .+ a écrit ?|El .+ escribió):[ \t\r]*$') AS told FROM split),
levelled AS (SELECT *, CASE WHEN told THEN -1 ELSE length(m) - length(replace(m, '>', '')) END AS level FROM marked),
lines AS (SELECT conv_id, turn, n, level, CASE WHEN level > 0 THEN regexp_replace(x, '^[ \t]*((?:>[ \t]?)+)', '') ELSE x END AS body,
  n - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY n) AS g FROM levelled),
passages AS (SELECT conv_id, turn, level, min(n) AS q, string_agg(body, chr(10) ORDER BY n) AS t FROM lines GROUP BY conv_id, turn, level, g),
parts AS (SELECT conv_id, turn, level, q, true AS whole, t FROM passages UNION ALL
  SELECT conv_id, turn, level, q, false, unnest(string_split(t, chr(10))) FROM passages),
texts AS (SELECT conv_id, turn, level, q, whole, s FROM (
  SELECT *, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS s FROM parts) r WHERE s <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
found AS (SELECT a.conv_id, a.turn, a.q, a.level, a.whole, max(b.turn) AS found FROM texts a JOIN texts b ON a.conv_id = b.conv_id AND a.s = b.s AND b.turn < a.turn
  WHERE a.level > 0 AND b.level = 0 GROUP BY ALL),
best AS (SELECT conv_id, turn, q, found, level, whole, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, whole DESC, found DESC) AS k FROM found),
reply AS (SELECT conv_id, turn, found AS reply_to FROM best WHERE k = 1),
linked AS (SELECT conv_id, turn, count(DISTINCT q) AS n_linked FROM found GROUP BY conv_id, turn),
up(conv_id, turn, root, depth) AS (SELECT conv_id, turn, reply_to, 1::BIGINT FROM reply
  UNION ALL SELECT u.conv_id, u.turn, r.reply_to, depth + 1 FROM up u JOIN reply r ON r.conv_id = u.conv_id AND r.turn = u.root),
held AS (SELECT conv_id, turn, 1 + (SELECT count(*) FROM up u WHERE u.conv_id = r.conv_id AND u.root = r.turn) AS n FROM reply r),
steps AS (SELECT r.conv_id, r.turn, 1 + coalesce(sum(n) OVER (PARTITION BY r.conv_id, reply_to ORDER BY r.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM reply r JOIN held USING (conv_id, turn)),
placed AS (SELECT s.conv_id, s.turn, CAST(any_value(s.w) + coalesce(sum(a.w), 0) AS BIGINT) AS position FROM steps s LEFT JOIN up u ON u.conv_id = s.conv_id AND u.turn = s.turn
  LEFT JOIN steps a ON a.conv_id = u.conv_id AND a.turn = u.root GROUP BY s.conv_id, s.turn),
roots AS (SELECT conv_id, turn, max_by(root, depth) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn),
bodies AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quotes,
  regexp_replace(coalesce(string_agg(t, chr(10) ORDER BY q) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g') AS body FROM passages GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, reply_to, coalesce(root, c.turn) AS root, coalesce(depth, 0) AS depth, coalesce(position, 0) AS position, n_quotes, coalesce(n_linked, 0) AS n_linked, body
FROM conversations c JOIN bodies b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.turn IS NOT DISTINCT FROM c.turn
LEFT JOIN reply r ON r.conv_id = c.conv_id AND r.turn = c.turn LEFT JOIN roots o ON o.conv_id = c.conv_id AND o.turn = c.turn LEFT JOIN linked l ON l.conv_id = c.conv_id AND l.turn = c.turn
LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn
"""
