"""DuckDB SQL for queries whose contracts SQL can express."""

from __future__ import annotations

#: Op 9: links from counts of shared shingles, components by following least ids along links.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE unnest(list_transform(range(1, greatest(len(ws) - 1, 2)), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS s FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n u ON u.rid = x JOIN n v ON v.rid = y WHERE 100 * shared >= 90 * (u.n + v.n - shared)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT rid AS a, rid AS b FROM w UNION SELECT a, y FROM r JOIN e ON b = x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(z.doc_id) FROM r JOIN w z ON z.rid = r.b WHERE r.a = w.rid) AS component_id FROM w LEFT JOIN n USING (rid)"""

#: Op 3: every 200-byte string by its start, on the hexadecimal digits of the bytes; islands of marked starts; what is left.
SUFFIX_DEDUP = r"""
WITH h AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
p AS MATERIALIZED (SELECT rid, i, md5(substr(t, 2 * i + 1, 400)) AS k FROM (SELECT rid, t, unnest(range(0, length(t) // 2 - 199)) AS i FROM h)),
m AS MATERIALIZED (SELECT rid, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
o AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM m),
s AS MATERIALIZED (SELECT rid, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM o) GROUP BY rid, g),
c AS (SELECT rid, sum(e - s) AS n_removed, count(*) AS n_spans FROM s GROUP BY rid),
q AS (SELECT rid, s AS z, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS a FROM s UNION ALL SELECT h.rid, length(t) // 2, coalesce((SELECT max(e) FROM s WHERE s.rid = h.rid), 0) FROM h),
k AS (SELECT rid, string_agg(substr(t, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS left_over FROM q JOIN h USING (rid) GROUP BY rid)
SELECT doc_id, (length(t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM h JOIN k USING (rid) LEFT JOIN c USING (rid)"""
