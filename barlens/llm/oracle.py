"""DuckDB SQL for the numbered queries that SQL can state."""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""

HELD_OUT_PASSAGES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
k AS (SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS key FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM i)),
h AS (
  SELECT p.r, p.s, k.size, k.item
  FROM (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS key
        FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM k))) AS p
  JOIN k ON k.size = p.size AND k.key = p.key),
n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS place FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

#: crc32 by its bits; the text is digits, a colon, a minus or a space.
_DRAW = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(z, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20)"""

CONVERSATION_REPAIR = f"""
WITH RECURSIVE t AS (
  SELECT *, {_DRAW} AS draw
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS z FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE draw WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM t WHERE draw <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible
  FROM damaged),
marked AS (
  SELECT *, CASE WHEN visible = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS pair
  FROM ordered),
-- states: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row
inserts(p, via, ins) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')),
edits(via, q, letter, initial, price) AS (
  VALUES (0, 0, 'D', NULL, 4), (1, 1, 'D', NULL, 4), (2, 2, 'D', NULL, 4), (3, 3, 'D', NULL, 4), (0, 2, 'R', NULL, 3), (1, 2, 'R', NULL, 3), (3, 2, 'R', NULL, 3), (2, 3, 'R', NULL, 3),
         (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0)),
ways AS (SELECT p, q, ins || letter AS letters, letter, initial, price + 3 * len(ins) AS price FROM inserts JOIN edits USING (via)),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS state, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT m.conv_id, m.k, q, min(cost + price + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END),
         arg_min(audit || letters, (cost + price + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END, audit || letters))
  FROM walk JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.k = walk.k + 1 JOIN ways ON p = state
  WHERE (initial IS NULL OR initial = m.role[1]) AND (letter = 'D' OR coalesce(fault, '') NOT IN ('blank', 'duplicate'))
  GROUP BY m.conv_id, m.k, q),
ends AS (
  SELECT w.conv_id, arg_min((cost + 3 * len(tail), audit || tail), (cost + 3 * len(tail), audit || tail)) AS best
  FROM walk AS w JOIN (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) AS x(state, tail) USING (state)
  WHERE k = coalesce((SELECT max(n) FROM ordered AS o WHERE o.conv_id IS NOT DISTINCT FROM w.conv_id), 0) GROUP BY w.conv_id),
-- the repaired rows: every letter but D is one; the system row can only be the first
letters AS (SELECT conv_id, best[2] AS audit, unnest(range(1, len(best[2]) + 1)) AS j FROM ends),
numbered AS (
  SELECT conv_id, j, audit[j] AS letter, len(replace(audit[1:j], 'I', '')) AS k, len(replace(audit[1:j], 'D', '')) AS line FROM letters),
told AS (
  SELECT l.conv_id, line, letter, m.role, CASE WHEN letter = 'I' THEN '' ELSE m.text END AS text,
         max(CASE WHEN line = 1 AND letter = 'K' AND m.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM numbered AS l LEFT JOIN marked AS m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.k = l.k AND letter <> 'I' WHERE letter <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (line - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY line)) AS sha
  FROM told GROUP BY conv_id),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best[1]::BIGINT AS cost, best[2] AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ends AS e LEFT JOIN figures AS f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired AS r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""

SQL = {"op11_hard_negatives": HARD_NEGATIVES, "op12_held_out_passages": HELD_OUT_PASSAGES, "op13_conversation_repair": CONVERSATION_REPAIR}
