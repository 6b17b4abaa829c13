"""DuckDB SQL of the queries that SQL can express on whole tables."""

from . import mixing

_WORDS = "[^\\x20\\x09-\\x0D]+"

OP1 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, min(r) = n.doc_id AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""

OP8 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, x, CASE WHEN i + 12 <= n THEN list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM g WHERE s IS NOT NULL GROUP BY s),
t AS (SELECT g.doc_id, i, x, coalesce(first < g.doc_id, false) AS taken FROM g LEFT JOIN f ON g.s = f.s),
c AS (SELECT doc_id, i, x, bool_or(taken) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM t)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id) k USING (doc_id)
"""

ORACLE_SQL = {"op1_minhash": OP1, "op4_mixing": mixing.ORACLE, "op8_substring": OP8}
