"""SQL of the queries on similar programs: every pair that shares a run of three words is counted out."""

_SHINGLES = """
WITH RECURSIVE r AS (
  SELECT DISTINCT 'case' AS kind, case_id AS key, regexp_extract_all(coalesce(broken, ''), '[A-Za-z0-9_]+') AS w, lower(trim(split_hint)) AS hint, CAST(NULL AS VARCHAR) AS ast FROM cases WHERE case_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'problem', id, regexp_extract_all(coalesce(reference_source, ''), '[A-Za-z0-9_]+'), lower(trim(split_hint)), lower(normalized_ast_sha256) FROM problems WHERE id IS NOT NULL),
s AS (SELECT DISTINCT kind, key, g FROM (SELECT kind, key, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM r)),
n AS (SELECT kind, key, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.kind, a.key AS a, b.key AS b, count(*) AS i FROM s a JOIN s b ON a.kind = b.kind AND a.g = b.g AND a.key < b.key GROUP BY ALL),
l AS (SELECT p.kind, a, b FROM p JOIN n x ON x.kind = p.kind AND x.key = a JOIN n y ON y.kind = p.kind AND y.key = b WHERE 5 * i >= 3 * (x.n + y.n - i))
"""
P1_FOUND = _SHINGLES.rstrip() + """,
e AS (SELECT kind, a, b FROM l UNION ALL SELECT kind, b, a FROM l),
reach AS (SELECT DISTINCT kind, a AS node, a AS seen FROM e UNION SELECT reach.kind, node, e.b FROM reach JOIN e ON e.kind = reach.kind AND e.a = seen)
SELECT DISTINCT kind AS record_kind, node AS key_a, seen AS key_b FROM reach WHERE node < seen
"""
P5_FOUND = _SHINGLES.rstrip() + """,
d AS (SELECT DISTINCT r.kind, r.key, r.ast, h.split_name = 'train' AS train FROM r JOIN hint_splits h ON h.record_kind = r.kind AND h.split_hint = r.hint)
SELECT DISTINCT l.kind AS record_kind, a AS key_a, b AS key_b FROM l JOIN d x ON x.kind = l.kind AND x.key = a JOIN d y ON y.kind = l.kind AND y.key = b WHERE x.train <> y.train
UNION SELECT x.kind, x.key, y.key FROM d x JOIN d y ON x.kind = y.kind AND x.ast = y.ast AND x.key < y.key AND x.train <> y.train
"""
