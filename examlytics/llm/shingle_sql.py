"""DuckDB SQL of shingle similarity components: every pair that shares a shingle, counted; then what each document reaches."""

from __future__ import annotations

import string


def components_sql(percent: int, kept: bool) -> str:
    """doc_id, n_shingles, component_id (and kept) of ``documents`` linked at ``percent`` per cent or more."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT r, n, hash(x) AS x FROM (SELECT r, len(s) AS n, unnest(s) AS x FROM s)),
p AS (
  SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r AND a.n * 100 >= b.n * {percent} AND b.n * 100 >= a.n * {percent}
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
c AS (SELECT r, r AS t FROM s UNION SELECT c.r, p.b FROM c JOIN p ON p.a = c.t)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id{', s.doc_id = min(o.doc_id) AS kept' if kept else ''}
FROM s JOIN c ON c.r = s.r JOIN s o ON o.r = c.t GROUP BY s.r, s.doc_id
"""
