"""SQL oracles (DuckDB) of the queries in ``core``."""

_EDGES = """
WITH once AS (SELECT DISTINCT id, from_node, to_node, rel, valid_from, valid_to, recorded_at, superseded_by FROM pg WHERE id IS NOT NULL),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS rn FROM once) WHERE rn = 1),
"""

_PERIODS = (
    _EDGES
    + """
iv AS (SELECT c.id, c.from_node, c.rel, epoch_ms(c.valid_from) AS s, coalesce(epoch_ms(c.valid_to), 9000000000000000) AS e
       FROM cur c JOIN rel_catalog r ON r.rel = c.rel AND r.cardinality = 'many'
       WHERE c.valid_from IS NOT NULL AND (c.valid_to IS NULL OR c.valid_to > c.valid_from)),
reach AS (SELECT *, max(e) OVER (PARTITION BY from_node, rel ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM iv),
numbered AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY from_node, rel ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS g FROM reach),
per AS (SELECT from_node, rel, g, min(s) AS s, max(e) AS e, count(*) AS n FROM numbered GROUP BY ALL),
nxt AS (SELECT *, lead(s) OVER (PARTITION BY from_node, rel ORDER BY s) AS ns FROM per)
"""
)

P2_FOUND = (
    _PERIODS
    + """
SELECT from_node, rel, 'period' AS kind, s AS start_ms, CASE WHEN e = 9000000000000000 THEN -1 ELSE e END AS end_ms FROM nxt WHERE n >= 2
UNION ALL SELECT from_node, rel, 'gap', e, ns FROM nxt WHERE ns IS NOT NULL
"""
)

P2_PERIODS = (
    _PERIODS
    + """
SELECT from_node, rel, 'period' AS kind, s AS start_ms, CASE WHEN e = 9000000000000000 THEN -1 ELSE e END AS end_ms, n FROM nxt
UNION ALL SELECT from_node, rel, 'gap', e, ns, 0 FROM nxt WHERE ns IS NOT NULL
"""
)

_VERSIONS = (
    _EDGES
    + """
val AS (SELECT c.* FROM cur c JOIN rel_catalog r ON r.rel = c.rel AND r.cardinality = 'one'
        WHERE c.valid_from IS NOT NULL AND (c.valid_to IS NULL OR c.valid_to > c.valid_from)),
one AS (SELECT from_node, rel, to_node, epoch_ms(valid_from) AS s, epoch_ms(valid_to) AS e FROM
        (SELECT *, row_number() OVER (PARTITION BY from_node, rel, valid_from ORDER BY recorded_at DESC, id DESC) AS k FROM val) WHERE k = 1),
cutoff AS (SELECT from_node, rel, to_node, s, least(coalesce(e, 9000000000000000), coalesce(lead(s) OVER (PARTITION BY from_node, rel ORDER BY s), 9000000000000000)) AS e FROM one),
flagged AS (SELECT *, CASE WHEN lag(to_node) OVER w IS NOT DISTINCT FROM to_node AND lag(e) OVER w = s THEN 0 ELSE 1 END AS f FROM cutoff WINDOW w AS (PARTITION BY from_node, rel ORDER BY s)),
grouped AS (SELECT *, sum(f) OVER (PARTITION BY from_node, rel ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM flagged),
ver AS (SELECT from_node, rel, to_node, g, min(s) AS s, max(e) AS e FROM grouped GROUP BY ALL)
"""
)

P4_FOUND = _VERSIONS + "SELECT from_node, rel, to_node, s AS from_ms, CASE WHEN e = 9000000000000000 THEN -1 ELSE e END AS to_ms FROM ver"

P4_SATELLITES = (
    _VERSIONS
    + """
, ended AS (SELECT *, lead(s) OVER (PARTITION BY from_node, rel ORDER BY s) AS ns FROM ver),
rows_ AS (SELECT from_node, rel, 1 AS v FROM ver UNION ALL SELECT from_node, rel, 0 FROM ended WHERE e < 9000000000000000 AND (ns IS NULL OR e < ns)),
per AS (SELECT rel, from_node, count(*) AS n FROM pg WHERE valid_from IS NOT NULL GROUP BY ALL),
rate AS (SELECT rel, sum(n) / count(*) AS rate, (SELECT sum(n) / count(*) FROM per) AS mean FROM per GROUP BY rel)
SELECT CASE WHEN rate >= mean THEN 'fast' ELSE 'slow' END AS satellite, rel, count(*) AS n_rows, CAST(sum(v) AS BIGINT) AS n_versions FROM rows_ JOIN rate USING (rel) GROUP BY rel, rate, mean
"""
)

P5_FOUND = (
    _EDGES
    + """
aonce AS (SELECT DISTINCT id, crosslinks, valid_to, indexed_at FROM atomic_index WHERE id IS NOT NULL),
acur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM aonce) WHERE rn = 1),
afirst AS (SELECT id, min(indexed_at) AS t FROM aonce GROUP BY id),
efirst AS (SELECT id, min(recorded_at) AS t FROM once GROUP BY id),
nodes AS (SELECT id, min(created_at) AS t, bool_or(deleted_at IS NOT NULL) AS gone FROM pg_node WHERE id IS NOT NULL GROUP BY id),
parents AS (SELECT 'node' AS k, id, t, gone FROM nodes UNION ALL SELECT 'edge', id, t, false FROM efirst
            UNION ALL SELECT 'atom', a.id, f.t, a.valid_to IS NOT NULL FROM acur a JOIN afirst f ON f.id = a.id),
links AS (SELECT id, indexed_at AS t, 'references' AS f, unnest(crosslinks['references']) AS target FROM acur
          UNION SELECT id, indexed_at, 'partially_superseded_by', unnest(crosslinks['partially_superseded_by']) FROM acur),
refs AS (SELECT 'pg' AS src_table, 'to_node' AS src_field, 'node' AS k, id AS src_id, to_node AS target, recorded_at AS t FROM cur
         UNION ALL SELECT 'pg', 'superseded_by', 'edge', id, superseded_by, recorded_at FROM cur
         UNION ALL SELECT 'atomic_index', 'crosslinks.' || f, 'atom', id, target, t FROM links),
met AS (SELECT r.*, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.t > r.t THEN 'late' END AS kind
        FROM refs r LEFT JOIN parents p ON p.k = r.k AND p.id = r.target WHERE r.target IS NOT NULL AND r.target <> ''),
orphan AS (SELECT src_table, src_field, src_id, target, kind, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period FROM met WHERE kind IS NOT NULL)
"""
)

P5_REPORT = P5_FOUND + "SELECT src_table, src_field, kind, period, count(*) AS n_refs, count(DISTINCT target) AS n_targets FROM orphan GROUP BY ALL"
P5_FOUND = P5_FOUND + "SELECT * FROM orphan"

ORACLES = {"p2_found": P2_FOUND, "p2_periods": P2_PERIODS, "p4_found": P4_FOUND, "p4_satellites": P4_SATELLITES, "p5_found": P5_FOUND, "p5_report": P5_REPORT}
