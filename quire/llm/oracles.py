"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_PATTERN = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_PATTERN}) AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
               unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS s
        FROM d WHERE len(w) >= 13),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN least USING (s), range(13) r(k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(g.pos)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN word x USING (doc_id) LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.pos = x.pos
GROUP BY d.doc_id, len(d.w)"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_PATTERN}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM d),
n AS (SELECT d.doc_id, count(sh.s) AS n FROM d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id
FROM n JOIN reach r USING (doc_id) GROUP BY n.doc_id, n.n"""

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::HUGEINT AS p
      FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + any_value(v))::HUGEINT AS q
      FROM c JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item,
           coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
                     WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term
QUALIFY rank <= 200"""

_BYTES = "list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

# States: e nothing kept yet, s, u, a the last role.  An edge is one row's letters.
TURNS = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, ({_CRC}) % 20 AS k FROM c),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM k, range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END) r(copy)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             left(role, 1) AS initial,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
f AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM n),
step(s, x, t) AS (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
reach(s, x, t, paid, ins) AS (SELECT s, x, t, 0, '' FROM step UNION ALL
  SELECT p.s, q.x, q.t, 3, 'I' FROM step p JOIN step q ON p.t = q.s WHERE p.x <> 's'),
edge AS (
  SELECT s, '' AS x, s AS t, 4 AS paid, 'D' AS letters, '' AS put, '' AS role FROM (VALUES ('e'), ('s'), ('u'), ('a')) v(s)
  UNION ALL SELECT s, x, t, paid, ins || 'K', CASE WHEN ins = '' THEN '' WHEN s = 'u' THEN 'assistant:' ELSE 'user:' END, '' FROM reach
  UNION ALL SELECT s, '', t, paid + 3, ins || 'R', CASE WHEN ins = '' THEN '' WHEN s = 'u' THEN 'assistant:' ELSE 'user:' END,
                   CASE WHEN x = 'u' THEN 'user' ELSE 'assistant' END FROM reach WHERE x <> 's'),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 'e' AS s, 0 AS cost, '' AS audit, [''] AS said FROM f
  UNION ALL
  SELECT conv_id, i, s, cost, audit, said FROM (
    SELECT b.conv_id, f.i, e.t AS s, b.cost + e.paid + CASE WHEN f.fault = 'truncated' AND letters <> 'D' THEN 3 ELSE 0 END AS cost, b.audit || letters AS audit,
           CASE WHEN letters = 'D' THEN b.said
                ELSE list_concat(b.said, CASE WHEN put = '' THEN [] ELSE [put] END, [CASE WHEN e.role = '' THEN f.role ELSE e.role END || ':' || f.text]) END AS said,
           row_number() OVER (PARTITION BY b.conv_id, e.t
             ORDER BY b.cost + e.paid + CASE WHEN f.fault = 'truncated' AND letters <> 'D' THEN 3 ELSE 0 END, b.audit || letters) AS choice
    FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
         JOIN edge e ON e.s = b.s AND (letters = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.role <> '' OR e.x = f.initial))))
  WHERE choice = 1),
last AS (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id),
fin AS (
  SELECT b.conv_id, b.cost + CASE s WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS total, b.audit || CASE s WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS whole,
         list_concat(b.said, CASE s WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END) AS said
  FROM best b JOIN last l ON b.conv_id IS NOT DISTINCT FROM l.conv_id AND b.i = l.i
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY total, whole) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(total, 0)::BIGINT AS cost,
       coalesce(whole, '') AS audit, sha256(coalesce(array_to_string(said[2:], chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM ids.conv_id"""
