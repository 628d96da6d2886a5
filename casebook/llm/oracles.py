"""DuckDB twins of the operators that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.r = both_ways.x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r) AS component_id
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
"""

OP4 = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM src),
reach AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
          / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS reach FROM weighted
  WINDOW before AS (ORDER BY source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, CASE WHEN max(reach) OVER () * weight >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
         ELSE max(reach) OVER () * weight END AS target FROM reach),
placed AS (
  SELECT doc_id, source, size, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM sizes)
SELECT p.doc_id, p.size, a.source_size, a.target,
  CASE WHEN p.size = 0 THEN 0 ELSE CAST(p.size * (CAST(floor(a.target) AS BIGINT) // a.source_size)
     + greatest(0, least(p.size, CAST(floor(a.target) AS BIGINT) % a.source_size - p.at)) AS BIGINT) END AS taken
FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source
"""

OP6 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(13, len(ws)) AS size FROM items WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i+size-1], ' ') AS phrase
  FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM sized)),
spots AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i+size-1], ' ') AS phrase
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size)),
hits AS (SELECT doc_id, item_id, spots.size, i FROM spots JOIN windows USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""

ORACLES = {"op3_jaccard_join": OP3, "op4_source_mix": OP4, "op6_decontaminate": OP6}
