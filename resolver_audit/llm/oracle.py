"""DuckDB SQL for the rows of those queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op4_signature_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) = 0 THEN []
         WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (
  SELECT doc_id AS v, doc_id AS c FROM w
  UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM w JOIN r ON r.v = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op5_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS bigint) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m""",
    "op13_ranked_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
t AS (SELECT CAST(count(*) AS bigint) AS docs, CAST(sum(len(ws)) AS bigint) AS words FROM d WHERE len(ws) > 0),
p AS (
  SELECT doc_id, n, term, CAST(count(*) AS bigint) AS tf
  FROM (SELECT doc_id, CAST(len(ws) AS bigint) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(count(*) AS bigint) AS df FROM p GROUP BY term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS double) / CAST(2 * df + 1 AS double))) AS bigint) AS w
  FROM f, t),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT item_id, doc_id,
         CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS bigint) AS score
  FROM i JOIN w USING (term) JOIN p USING (term), t GROUP BY item_id, doc_id),
r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank,
         doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""",
}
