"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op3_source_mix": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '') || '-' || md5(coalesce(text, ''))) AS key
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS srank FROM totals
), weighed AS (
  SELECT *, CAST([3, 1, 2][(srank - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM ranked
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, srank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, srank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), aims AS (
  SELECT source, source_size, srank, least(cap, max(level) OVER () * w) AS target FROM levels
), queued AS (
  SELECT s.doc_id, s.size, a.source_size, a.srank, a.target,
         row_number() OVER (ORDER BY s.key, s.doc_id, s.size) AS id,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), passes AS (
  SELECT *, upto / target AS finish FROM queued WHERE size > 0 AND target > 0
  UNION ALL
  SELECT *, (upto + source_size) / target FROM queued WHERE size > 0 AND target > 0
), merged AS (
  SELECT id, size, CAST(sum(size) OVER (ORDER BY finish, srank ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM passes
), cut AS (
  SELECT id, sum(greatest(0, least(size, CAST(floor(1.5::DOUBLE * (SELECT sum(size) FROM sized)) AS BIGINT) - before))) AS taken FROM merged GROUP BY id
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN cut c ON q.id = c.id
""",
    "op5_warc_bundles": """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM hashed
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM kept
""",
    "op1_line_dedup": r"""
WITH texts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), each AS (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM texts
), counted AS (
  SELECT doc_id, i, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS w FROM each
), summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM counted
), windows AS (  -- of lines that just reach 50 words, from the first forwards or from the last backwards
  SELECT a.doc_id, a.i, b.i AS j FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.s - a.s + a.w >= 50 AND b.s - b.w - a.s + a.w < 50
  UNION
  SELECT a.doc_id, a.i, b.i FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.s - a.s + a.w >= 50 AND b.s - a.s < 50
), later AS (
  SELECT doc_id, i, j FROM (
    SELECT w.doc_id, w.i, w.j, row_number() OVER (PARTITION BY array_to_string(t.lines[w.i:w.j], chr(10)) ORDER BY w.doc_id, w.i) AS n
    FROM windows w JOIN texts t ON w.doc_id = t.doc_id
  ) WHERE n > 1
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, j + 1)) AS k FROM later) GROUP BY doc_id
)
SELECT t.doc_id, CAST(coalesce(len(t.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.ks), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN g.ks IS NULL THEN t.text ELSE coalesce(array_to_string(list_filter(t.lines, lambda x, k: NOT list_contains(g.ks, k)), chr(10)), '') END) AS text_sha256
FROM texts t LEFT JOIN gone g ON t.doc_id = g.doc_id
""",
    "op10_decontamination": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), items AS (
  SELECT item_id, w, least(5, len(w)) AS n
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
  WHERE len(w) > 0
), own AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), held AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
), totals AS (
  SELECT item_id, count(*) AS total FROM own GROUP BY item_id
)
SELECT h.doc_id, o.item_id, CAST(count(*) AS DOUBLE) / any_value(t.total) AS containment
FROM held h JOIN own o ON h.n = o.n AND h.gram = o.gram JOIN totals t ON o.item_id = t.item_id
GROUP BY h.doc_id, o.item_id
HAVING CAST(count(*) AS DOUBLE) / any_value(t.total) >= 0.8::DOUBLE
""",
}
