"""DuckDB SQL of the operators that SQL can express, over the driver's tables."""

SQL: dict[str, str] = {}

SQL["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS original,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY length(original) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY length(original) DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM d
"""

# Targets: the level is found by trying each number of full sources, in order of cap / weight.
SQL["op9_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM c),
l AS (
  SELECT a.k, (a.budget - coalesce((SELECT sum(b.cap) FROM r b WHERE b.k < a.k), 0))
              / (SELECT sum(b.weight) FROM r b WHERE b.k >= a.k) AS level, a.weight, a.cap
  FROM r a),
f AS (SELECT min_by(level, k) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM r),
q AS (
  SELECT d.*, source_size, target,
         sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT doc_id, source, size, epoch, upto + epoch * source_size AS upto, target
  FROM q, (VALUES (0), (1)) v(epoch)
  WHERE size > 0 AND (upto + epoch * source_size - size)::DOUBLE < target),
w AS (
  SELECT *, sum(size) OVER (ORDER BY upto::DOUBLE / target, source, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS total
  FROM e),
m AS (SELECT doc_id, count(*) AS copies FROM w WHERE total <= (SELECT sum(target) FROM t) + 1e-6 GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (coalesce(copies, 0) * q.size)::BIGINT AS taken
FROM q LEFT JOIN m ON q.doc_id = m.doc_id
"""

SQL["op10_archives"] = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS holder FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM g
"""

# Every phrase of one to five words is counted; a part's count is looked up by its text.
SQL["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
sized AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM places),
phrases AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM sized WHERE i + k - 1 <= len(ws)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE k >= 2 AND f >= 100),
inner_phrases AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(2, k)) AS m FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates)) WHERE i + m - 1 <= k),
holders AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
parts AS (
  SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS front, array_to_string(ws[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
cuts AS (
  SELECT p.lang, p.phrase, p.a, cut, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * p.a * n) // (l.f::HUGEINT * r.f) AS score
  FROM parts p JOIN counts l ON l.lang = p.lang AND l.phrase = p.front
       JOIN counts r ON r.lang = p.lang AND r.phrase = p.rest JOIN totals t ON t.lang = p.lang),
scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN holders h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE coalesce(longer, 0) < a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
