"""SQL oracles (DuckDB) of the queries in ``memory``."""

from memlake.functions.text import SECRETS

_CUR = """
pg1 AS (SELECT DISTINCT id, from_node, to_node, rel, valid_from, valid_to, recorded_at, superseded_by FROM pg WHERE id IS NOT NULL),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS rn FROM pg1) WHERE rn = 1),
at1 AS (SELECT DISTINCT id, phase, type, status, vault_id, path, title, tags, crosslinks, linked_symbols, geography, valid_to, indexed_at FROM atomic_index WHERE id IS NOT NULL),
atoms AS (SELECT *, CASE WHEN lower(trim(status)) IN ('approved', 'accepted') THEN 'stable' ELSE lower(trim(status)) END AS st FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM at1) WHERE rn = 1),
ve1 AS (SELECT DISTINCT id, store, source, text, vector, metadata, created_at FROM pgvector WHERE id IS NOT NULL),
vecs AS (SELECT id, store, source, text, vector::DOUBLE[] AS v, metadata->>'$.tenant_id' AS tenant_id, metadata->>'$.status' AS status, metadata->>'$.session_id' AS session_id, CAST(metadata->>'$.tokens' AS INT) AS tokens
         FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM ve1) WHERE rn = 1),
ids AS (SELECT id FROM vecs WHERE regexp_matches(id, '[0-9a-f]{10}$') AND CAST('0x' || right(id, 10) AS BIGINT) % 100 = 0),
asked AS (SELECT * FROM atoms WHERE regexp_matches(id, '[0-9a-f]{10}$') AND CAST('0x' || right(id, 10) AS BIGINT) % 100 = 0),
links AS (SELECT DISTINCT id, via, target FROM (SELECT id, via, unnest(crosslinks[via]) AS target FROM (SELECT id, crosslinks, unnest(map_keys(crosslinks)) AS via FROM atoms)) WHERE target IS NOT NULL AND target <> '')
"""
_WITH = "WITH " + _CUR
_REC = "WITH RECURSIVE " + _CUR

_SPACE = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}{_SPACE}]', ' ', 'g'), '[{_SPACE}]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({_normal(x)}, ' '), lambda w: length(w) > 1)"


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {x}[1:{n - 1}] || '…' END"


_COS = "round(list_cosine_similarity({a}, {b}), 12)"

_KNN = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
sim AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 12) AS s, q.label AS ql, d.label AS dl FROM e q JOIN e d ON q.vec_id % 100 = 0)
"""

_HITS = (
    _WITH
    + """,
usable AS (SELECT * FROM vecs WHERE len(v) = 64),
q AS (SELECT u.*, text AS query FROM usable u SEMI JOIN ids USING (id)),
sim AS (SELECT q.id AS query_id, d.id AS doc_id, d.store AS source, CASE WHEN list_sum(list_transform(q.v, lambda x: abs(x))) = 0 OR list_sum(list_transform(d.v, lambda x: abs(x))) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, d.v), 12) END AS s
        FROM q JOIN usable d ON {only} AND (q.tenant_id IS NULL OR q.tenant_id = d.tenant_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY s DESC, doc_id) AS r FROM sim WHERE s >= 0.1),
hits AS (SELECT t.query_id, t.doc_id, t.source, round(t.s, 9) AS score, u.source AS path, u.status, """
    + _cut("u.text", 240)
    + """ AS snippet, q.query FROM top t JOIN usable u ON u.id = t.doc_id JOIN q ON q.id = t.query_id WHERE r <= 5),
bestof AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(path, doc_id) ORDER BY score DESC, source, doc_id) AS r FROM hits),
boosted AS (SELECT * EXCLUDE (r, score), score + CASE WHEN status = 'stable' THEN 0.05 ELSE 0 END AS score FROM bestof WHERE r = 1),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, doc_id) AS rank FROM boosted) WHERE rank <= 10)
"""
)

_EPISODIC = _HITS.replace("{only}", "d.store = 'episodic'")
_HITS = _HITS.replace("{only}", "true")


def _bm25(rows: str) -> str:
    """Common table expressions ending in ``bm`` (query_id, doc_id, bm25) over ``rows``."""
    return f"""
cand AS (SELECT query_id, doc_id, {_words("query")} AS qw, {_words("snippet")} AS dw FROM {rows}),
stat AS (SELECT query_id, count(*) AS n, avg(len(dw)) AS av FROM cand GROUP BY query_id),
term AS (SELECT query_id, doc_id, len(dw) AS dl, dw, unnest(qw) AS t, generate_subscripts(qw, 1) AS p FROM cand),
freq AS (SELECT *, len(list_filter(dw, lambda w: w = t)) AS f FROM term),
dfs AS (SELECT query_id, p, count(*) FILTER (f > 0) AS df FROM freq GROUP BY ALL),
part AS (SELECT query_id, doc_id, sum(CASE WHEN f > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * (dl / greatest(1, av)))) ELSE 0 END) AS s FROM freq JOIN dfs USING (query_id, p) JOIN stat USING (query_id) GROUP BY ALL),
bm AS (SELECT c.query_id, c.doc_id, coalesce(s, 0) AS bm25 FROM cand c LEFT JOIN part USING (query_id, doc_id))
"""


_LETTERS = "regexp_replace(regexp_replace(upper(replace({x}, 'ß', 'ss')), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _title(x: str) -> str:
    first = rf"trim(regexp_replace(regexp_split_to_array({x}, '\r?\n')[1], '[{_SPACE}]+', ' ', 'g'))"
    return f"CASE WHEN {first} = '' THEN 'Untitled' ELSE array_to_string(string_split({first}, ' ')[1:8], ' ') END"


def _proposed(kind: str, x: str) -> str:
    slug = _LETTERS.replace("{x}", _title(x)) + "[1:40]"
    return f"upper(coalesce({kind}, 'fact')) || '--' || CASE WHEN {slug} = '' THEN 'UNTITLED' ELSE {slug} END"


def _turn(kind: str, x: str) -> str:
    quoted = rf"regexp_replace(replace({x}, chr(13), ''), '\n[{_SPACE}]*\[(USER|AGENT|TOOL|BRAIN|MEMORY|SYSTEM)\]', ' [\1-quoted]', 'gi')"
    return rf"'[' || upper({kind}) || '] ' || regexp_replace({quoted}, '\n+', ' ⏎ ', 'g')"


def _holds(haystack: str, needle: str) -> str:
    words = lambda x: f"list_distinct(list_filter(string_split({_normal(x)}, ' '), lambda w: length(w) > 2))"
    h, n = words(haystack), words(needle)
    alike = f"len(list_intersect({h}, {n})) / greatest(len(list_distinct(list_concat({h}, {n}))), 1) >= 0.6"
    return f"CASE WHEN {_normal(needle)} = '' THEN false ELSE contains({_normal(haystack)}, {_normal(needle)}) OR (len({n}) > 0 AND {alike}) END"


_RETAIN = (
    _WITH
    + rf""",
born AS (SELECT id, min(created_at) AS seen FROM pgvector WHERE id IS NOT NULL GROUP BY id),
old AS (SELECT v.id, epoch_us(seen) AS seq, text, v, tenant_id, status, seen AS valid_from, NULL AS policy, NULL AS inbound FROM vecs v JOIN born USING (id) WHERE len(v) = 64 AND seen IS NOT NULL),
fact AS (SELECT id || '+' AS id, seq + 100000000000000000 AS seq, text || ' (revised)' AS text, v, tenant_id, NULL AS status, valid_from + INTERVAL 3 DAY AS valid_from,
         CASE WHEN CAST('0x' || right(id, 10) AS BIGINT) // 100 % 3 = 0 THEN 'coexist' ELSE 'supersede' END AS policy, CASE WHEN CAST('0x' || right(id, 10) AS BIGINT) // 100 % 2 = 0 THEN 'fact' END AS inbound FROM old SEMI JOIN ids USING (id)),
every AS (SELECT * FROM old UNION ALL SELECT * FROM fact),
pairs AS (SELECT f.id AS n, f.seq, f.valid_from AS til, d.id AS o, CASE WHEN list_sum(list_transform(f.v, lambda x: abs(x))) = 0 OR list_sum(list_transform(d.v, lambda x: abs(x))) = 0 THEN 0 ELSE round(list_cosine_similarity(f.v, d.v), 12) END AS s
          FROM fact f JOIN every d ON d.seq < f.seq AND f.policy = 'supersede' AND d.status IS DISTINCT FROM 'invalid' AND (f.tenant_id IS NULL OR f.tenant_id = d.tenant_id)
          AND regexp_replace(f.text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') IS DISTINCT FROM regexp_replace(d.text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')),
closed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY seq, n) AS k FROM pairs WHERE s >= 0.3) WHERE k = 1),
kept AS (SELECT e.*, c.til AS valid_to, c.n AS superseded_by FROM every e LEFT JOIN closed c ON c.o = e.id)
"""
)

_WALK = (
    _REC
    + """,
we AS (SELECT * FROM edges WHERE valid_from <= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND (valid_to IS NULL OR valid_to > TIMESTAMPTZ '2026-01-01 00:00:00+00') AND from_node IS NOT NULL AND to_node IS NOT NULL),
seeds AS (SELECT DISTINCT id FROM pg_node WHERE regexp_matches(id, '[0-9a-f]{10}$') AND CAST('0x' || right(id, 10) AS BIGINT) % 100 = 0)
"""
)


def _bfs(steps: str) -> str:
    return (
        _WALK
        + f""",
steps AS ({steps}),
d1 AS (SELECT s.id AS seed, next AS node, min(e) AS path FROM seeds s JOIN steps t ON t.node = s.id WHERE next <> s.id GROUP BY ALL),
d2 AS (SELECT seed, next AS node, min(path || '>' || e) AS path FROM d1 JOIN steps t USING (node) WHERE next <> seed AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.seed = d1.seed AND x.node = t.next) GROUP BY ALL),
d3 AS (SELECT seed, next AS node, min(path || '>' || e) AS path FROM d2 JOIN steps t USING (node) WHERE next <> seed AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.seed = d2.seed AND x.node = t.next) AND NOT EXISTS (SELECT 1 FROM d2 x WHERE x.seed = d2.seed AND x.node = t.next) GROUP BY ALL)
SELECT seed, node, 1 AS depth, path FROM d1 UNION ALL SELECT seed, node, 2, path FROM d2 UNION ALL SELECT seed, node, 3, path FROM d3
"""
    )


_STEPS = r"""
WITH raw AS (SELECT session_id, created_at AS tm, doc_id AS doc, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS raw, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS line FROM documents),
steps AS (SELECT session_id, tm, doc, line, regexp_extract(raw, '^(user|agent|tool|brain|memory|system): (.*)$', 1) AS kind, regexp_extract(raw, '^(user|agent|tool|brain|memory|system): (.*)$', 2) AS content FROM raw WHERE regexp_matches(raw, '^(user|agent|tool|brain|memory|system): .*$'))
"""
_TOPICS = (
    _STEPS
    + r""",
said AS (SELECT session_id, tm, doc, line, w.term AS term, w.pos AS pos FROM (SELECT session_id, tm, doc, line, unnest(list_transform(regexp_extract_all(content, '\b([A-Za-z][A-Za-z\-]{3,})\b', 1), lambda x, i: {'term': x, 'pos': i - 1})) AS w FROM steps WHERE kind IN ('user', 'agent'))),
kept AS (SELECT * FROM said WHERE lower(term) NOT IN ('the','and','for','with','that','this','from','have','been','will','what','when','where','which','about','there','their')),
counted AS (SELECT session_id, term, count(*) AS n, min(ROW(tm, doc, line, pos)) AS first FROM kept GROUP BY ALL),
topics AS (SELECT * FROM (SELECT session_id, term, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first, term) AS rank FROM counted) WHERE rank <= 6)
"""
)

_DRIFT = (
    _WITH
    + """, cit AS (SELECT DISTINCT id, s.file AS file FROM (SELECT id, unnest(linked_symbols) AS s FROM atoms) WHERE s.file IS NOT NULL
UNION SELECT id, string_split(g, ':')[1] FROM (SELECT id, unnest(geography) AS g FROM atoms) WHERE g IS NOT NULL),
changed AS (SELECT DISTINCT file AS symbol FROM cit SEMI JOIN asked USING (id) UNION SELECT 'no/such/file.ts'),
ranked AS (SELECT id, CASE WHEN lower(type) IN ('adr', 'blueprint') THEN 3 WHEN lower(type) IN ('feat', 'concept', 'flow') THEN 2 ELSE 1 END AS r FROM atoms),
report AS (SELECT symbol, count(r.id) AS n_atoms, CAST(0 AS BIGINT) AS n_callers, ['NONE', 'LOW', 'MEDIUM', 'HIGH'][coalesce(max(r.r), 0) + 1] AS risk FROM changed LEFT JOIN (SELECT DISTINCT file, id FROM cit) c ON c.file = symbol LEFT JOIN ranked r ON r.id = c.id GROUP BY symbol)
"""
)


def _masked(x: str) -> str:
    """The patterns of secrets applied one after the other."""
    for pattern, instead in SECRETS:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        x = f"regexp_replace({x}, '{pattern.removeprefix('(?i)')}', '{instead.replace('$', chr(92))}', '{flags}')"
    return x


ORACLES = {
    "atoms_current": _WITH + "SELECT id, phase, type, st AS status, regexp_matches(id, '^[A-Z][A-Z0-9_]*--[A-Z0-9][A-Z0-9_-]*$') AS well_formed FROM atoms",
    "atoms_filtered": _WITH + "SELECT id, type, vault_id FROM atoms WHERE phase = 1 AND status = 'stable' AND list_contains(tags, 'memory')",
    "atoms_substring": _WITH + "SELECT id, title, CAST(1.0 AS DOUBLE) AS score FROM atoms WHERE contains(lower(id), 'anchor') OR contains(lower(title), 'anchor') OR len(list_filter(tags, lambda t: contains(lower(t), 'anchor'))) > 0 ORDER BY id LIMIT 20",
    "atoms_by_lookup": _WITH + "SELECT DISTINCT l.target AS asked, b.title, b.type FROM links l SEMI JOIN asked a ON a.id = l.id LEFT JOIN atoms b ON b.id = l.target",
    "metadata_filtered": _WITH + "SELECT store, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM vecs WHERE status = 'stable' AND tenant_id = 't1' AND tokens >= 20 GROUP BY store",
    "namespace_counts": _WITH + "SELECT tenant_id, store, count(*) AS n, count(*) FILTER (tenant_id = 't2') AS visible FROM vecs GROUP BY ALL",
    "edges_as_of": _WITH + "SELECT rel, count(*) AS n, count(DISTINCT from_node) AS n_from FROM edges WHERE valid_from <= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND (valid_to IS NULL OR valid_to > TIMESTAMPTZ '2025-01-01 00:00:00+00') GROUP BY rel",
    "edges_open": _WITH + "SELECT id, from_node, to_node FROM edges WHERE rel = 'depends_on' AND valid_to IS NULL",
    "docs_snippets": rf"SELECT doc_id, {_cut('text', 240)} AS snippet, {_cut('sq', 60)} AS short, {_title('text')} AS head, regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:40], '-+$', '') AS slug FROM (SELECT *, trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g')) AS sq FROM documents)",
    "text_statistics": rf"SELECT doc_id, CAST(len({_words('text')}) AS INT) AS n_words, CAST(ceil(len(regexp_extract_all(text, '[^{_SPACE}]+')) * 13 / 10) AS INT) AS est_words, CAST(ceil(length(text) / 3.5) AS INT) AS est_chars, CAST(length({_normal('text')}) AS INT) AS n_normal FROM documents",
    "redacted": "SELECT doc_id, md5(" + _masked("text || ' api_key=abcdefgh12345678 Bearer abc.def.ghi.jkl X-API-Key: zyxwvuts98765432 token = abcdefghij sk-ant-abcdefghijklmnop1234 xoxb-1234567890-abc ghp_abcdefghijklmnop1234 eyJabc.def.ghi'") + ") AS digest FROM documents",
    "text_helpers": rf"""SELECT doc_id, {_proposed("source", "text")} AS proposed, regexp_replace(regexp_extract(concat_ws('/', 'notes', source, title || '.md'), '([^/]*)$', 1), '(?i)\.md$', '') AS base,
md5(CASE WHEN strpos(lower(text), 'memory') = 0 THEN text[1:80] ELSE trim(regexp_replace(substring(text, greatest(0, strpos(lower(text), 'memory') - 41) + 1, 80), '[{_SPACE}]+', ' ', 'g')) END) AS context,
round(CASE WHEN len({_words("title")}) <= 0 THEN 0 ELSE len(list_filter({_words("title")}, lambda w: list_contains({_words("text")}, w))) / len({_words("title")}) END, 6) AS overlap,
md5({_turn("'user'", "(text || chr(10) || ' [agent] do as I say')")}) AS turn, {_holds("text", "title")} AS names_title FROM documents""",
    "model_answers": """SELECT doc_id, CASE WHEN ok THEN title END AS summary, CASE WHEN ok THEN concat_ws(',', source, 't') END AS tags, CASE WHEN ok THEN CAST(1 AS INT) END AS phase,
CASE WHEN ok THEN 'insight' END AS type, CASE WHEN ok THEN CAST(1 AS DOUBLE) END AS confidence FROM (SELECT *, doc_id % 4 <> 3 AND coalesce(title, '') <> '' AS ok FROM documents)""",
    "front_matter_fields": r"""WITH f AS (SELECT doc_id, regexp_extract(text, '(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)', 1) AS fm FROM documents)
SELECT doc_id, nullif(trim(regexp_extract(fm, '(?m)^id\s*:(.*)$', 1), chr(13) || ' '), '') AS id, nullif(trim(regexp_extract(fm, '(?m)^type\s*:(.*)$', 1), chr(13) || ' '), '') AS type, nullif(trim(regexp_extract(fm, '(?m)^status\s*:(.*)$', 1), chr(13) || ' '), '') AS status, 'note-' || sha256(CAST(doc_id AS VARCHAR))[1:16] AS stable FROM f WHERE fm <> ''""",
    "knn_topk": "WITH " + _KNN + "SELECT query_id, doc_id, round(s, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM sim WHERE s >= 0) WHERE r <= 5",
    "knn_namespaced": "WITH " + _KNN + "SELECT query_id, doc_id, round(s, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM sim WHERE s >= 0.1 AND ql = dl) WHERE r <= 5",
    "vector_scores": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score, round(sqrt(list_sum(list_transform(e.v, lambda x: x * x))), 6) AS norm FROM e LEFT JOIN e q ON q.vec_id = e.vec_id - e.vec_id % 100",
    "hash_embeddings": """WITH h AS (SELECT doc_id, sha256(lower(trim(text)) || '::0') AS a, sha256(lower(trim(text)) || '::1') AS b FROM documents),
n AS (SELECT doc_id, list_transform(range(0, 32), lambda i: CAST('0x' || (a || b)[i * 4 + 1 : i * 4 + 4] AS INT) / 65535.0 * 2 - 1) AS v FROM h),
l AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM n)
SELECT doc_id, round(v[1] / len, 6) AS v0, round(v[32] / len, 6) AS v31, round(sqrt(list_sum(list_transform(v, lambda x: (x / len) * (x / len)))), 6) AS norm FROM l""",
    "recall_fused": _HITS + "SELECT query_id, doc_id, source, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM fused",
    "recall_episodic": _EPISODIC + "SELECT query_id, doc_id, source, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM fused",
    "token_savings": _HITS
    + """, n AS (SELECT count(*) AS n FROM q), c AS (SELECT CAST(sum(ceil(length(text) / 3.5)) AS BIGINT) AS c FROM usable), r AS (SELECT coalesce(sum(ceil(length(snippet) / 3.5)), 0) / (SELECT n FROM n) AS r FROM fused)
SELECT CAST(n AS INT) AS n_queries, c AS corpus_tokens, floor(r * 100 + 0.5) / 100 AS per_query, floor(greatest(0, 1 - r / c) * 100 * 100 + 0.5) / 100 AS savings_pct FROM n, c, r""",
    "recall_reranked": _HITS
    + ", head AS (SELECT * FROM fused WHERE rank <= 6),"
    + _bm25("head")
    + """, scaled AS (SELECT *, max(bm25) OVER w AS hi, min(bm25) OVER w AS lo FROM bm WINDOW w AS (PARTITION BY query_id)),
mixed AS (SELECT h.query_id, h.doc_id, 0 AS band, h.rank, 0.4 * h.score + 0.6 * CASE WHEN hi = lo THEN 0.5 ELSE (bm25 - lo) / (hi - lo) END AS score FROM head h JOIN scaled USING (query_id, doc_id)
          UNION ALL SELECT query_id, doc_id, 1, rank, score FROM fused WHERE rank > 6)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY band, CASE WHEN band = 0 THEN -score ELSE 0 END, rank) AS INT) AS rank FROM mixed""",
    "bm25_scores": _HITS + "," + _bm25("fused") + "SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM bm",
    "recall_metrics": _WITH
    + """, u AS (SELECT * FROM vecs WHERE len(v) = 64),
q AS (SELECT u.* FROM u SEMI JOIN ids USING (id)),
sim AS (SELECT q.id AS qid, d.id AS did, CASE WHEN list_sum(list_transform(q.v, lambda x: abs(x))) = 0 OR list_sum(list_transform(d.v, lambda x: abs(x))) = 0 THEN 0 ELSE round(list_cosine_similarity(q.v, d.v), 12) END AS s FROM q, u d),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS r FROM sim WHERE s >= 0),
oth AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY r) AS r FROM top WHERE r <= 6 AND qid <> did),
gold AS (SELECT q.id AS qid, d.id AS did, q.store FROM q JOIN u d ON d.source = q.source AND d.id <> q.id),
per AS (SELECT g.qid, g.store, coalesce(bool_or(o.r = 1), false) AS a, bool_or(o.r IS NOT NULL) AS k FROM gold g LEFT JOIN oth o ON o.qid = g.qid AND o.did = g.did AND o.r <= 5 GROUP BY ALL)
SELECT store, count(*) AS n_queries, floor(count(*) FILTER (a) / count(*) * 10000 + 0.5) / 100 AS hit_at_1, floor(count(*) FILTER (k) / count(*) * 10000 + 0.5) / 100 AS hit_at_k FROM per GROUP BY GROUPING SETS ((store), ())""",
    "retain_conflicts": _RETAIN + "SELECT o AS old_id, epoch_ms(til) AS valid_to_ms, n AS superseded_by FROM closed",
    "retain_pointers": _RETAIN
    + f""", back AS (SELECT n, first(o ORDER BY s DESC, o) AS supersedes FROM closed GROUP BY n)
SELECT f.id, f.policy, b.supersedes, CASE WHEN f.inbound IS NOT NULL THEN {_proposed("f.inbound", "f.text")} END AS proposed_id FROM fact f LEFT JOIN back b ON b.n = f.id""",
    "docs_as_of": _RETAIN + "SELECT tenant_id, count(*) AS n, count(superseded_by) AS n_closed_later FROM kept WHERE valid_from <= TIMESTAMPTZ '2025-09-01 00:00:00+00' AND (valid_to IS NULL OR valid_to > TIMESTAMPTZ '2025-09-01 00:00:00+00') GROUP BY tenant_id",
    "docs_open": _RETAIN + "SELECT tenant_id, count(*) AS n FROM kept WHERE valid_to IS NULL AND status IS DISTINCT FROM 'invalid' GROUP BY tenant_id",
    "edge_supersede": _WITH
    + "SELECT id, CASE WHEN sup THEN coalesce(epoch_ms(lead(valid_from) OVER w), -1) ELSE -1 END AS closed_ms, CASE WHEN sup THEN lead(id) OVER w END AS closed_by FROM (SELECT *, rel IN ('has_status', 'owned_by', 'assigned_to') AS sup FROM edges WHERE recorded_at IS NOT NULL) WINDOW w AS (PARTITION BY from_node, rel ORDER BY recorded_at, id)",
    "edge_supersede_mixed": _WITH
    + """, e AS (SELECT *, CASE WHEN right(id, 1) < '8' THEN {'i': id, 'f': valid_from} END AS closer FROM edges WHERE recorded_at IS NOT NULL),
c AS (SELECT id, first_value(closer IGNORE NULLS) OVER (PARTITION BY from_node, rel ORDER BY recorded_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x FROM e)
SELECT id, coalesce(epoch_ms(x.f), -1) AS closed_ms, x.i AS closed_by FROM c""",
    "edge_first_closure": "WITH l AS (SELECT DISTINCT id, valid_to, superseded_by, recorded_at FROM pg WHERE valid_to IS NOT NULL AND id IS NOT NULL AND recorded_at IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at) AS k FROM l) SELECT id, epoch_ms(valid_to) AS closed_ms, superseded_by AS closed_by FROM r WHERE k = 1",
    "edge_patches": "WITH l AS (SELECT DISTINCT id, to_node, superseded_by, recorded_at FROM pg WHERE id IS NOT NULL AND recorded_at IS NOT NULL) SELECT id, arg_max(to_node, recorded_at) AS to_node, arg_max(superseded_by, recorded_at) AS superseded_by FROM l GROUP BY id",
    "nodes_folded": """WITH l AS (SELECT DISTINCT id, created_at, unnest(labels) AS label FROM pg_node WHERE id IS NOT NULL), lab AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l WHERE label IS NOT NULL GROUP BY id),
p AS (SELECT id, arg_max(props->>'$.name', created_at) AS name, arg_max(props->>'$.line', created_at) AS line FROM pg_node GROUP BY id)
SELECT n.id, coalesce(labels, '') AS labels, name, line FROM (SELECT DISTINCT id FROM pg_node WHERE id IS NOT NULL) n LEFT JOIN lab USING (id) LEFT JOIN p USING (id)""",
    "graph_neighbors": _bfs("SELECT from_node AS node, to_node AS next, min(id) AS e FROM we GROUP BY ALL"),
    "graph_neighbors_in": _bfs("SELECT to_node AS node, from_node AS next, min(id) AS e FROM we WHERE from_node IN (SELECT id FROM pg_node WHERE deleted_at IS NULL) GROUP BY ALL"),
    "graph_neighbors_both": _bfs("SELECT node, next, min(id) AS e FROM (SELECT from_node AS node, to_node AS next, id FROM we UNION ALL SELECT to_node, from_node, id FROM we) GROUP BY node, next"),
    "graph_paths": _WALK
    + """, walk AS (SELECT s.id AS seed, s.id AS node, 0 AS depth, CAST([] AS VARCHAR[]) AS path, [s.id] AS seen FROM seeds s
UNION ALL SELECT w.seed, e.to_node, w.depth + 1, list_append(w.path, e.id), list_append(w.seen, e.to_node) FROM walk w JOIN we e ON e.from_node = w.node WHERE w.depth < 2 AND NOT list_contains(w.seen, e.to_node))
SELECT seed, node, depth, array_to_string(path, '>') AS path FROM walk WHERE depth > 0""",
    "edges_without_nodes": _WITH + "SELECT id, endpoint, node FROM (SELECT id, 'from' AS endpoint, from_node AS node FROM edges UNION ALL SELECT id, 'to', to_node FROM edges) WHERE node IS NOT NULL AND node NOT IN (SELECT id FROM pg_node WHERE id IS NOT NULL)",
    "atoms_citing": _WITH
    + """, cit AS (SELECT DISTINCT id, s.file AS file, s.fn AS fn, s.line AS line FROM (SELECT id, unnest(linked_symbols) AS s FROM atoms) WHERE s.file IS NOT NULL
UNION SELECT id, string_split(g, ':')[1], NULL, NULL FROM (SELECT id, unnest(geography) AS g FROM atoms) WHERE g IS NOT NULL),
q AS (SELECT DISTINCT file, nullif(fn, '') AS fn, CASE WHEN line > 0 THEN line END AS line, file || CASE WHEN fn IS NOT NULL THEN ':' || fn WHEN line IS NOT NULL THEN ':' ELSE '' END || CASE WHEN line IS NOT NULL THEN ':' || line ELSE '' END AS symbol FROM cit SEMI JOIN asked USING (id))
SELECT DISTINCT q.symbol, c.id FROM q JOIN cit c ON c.file = q.file AND (c.fn IS NULL OR q.fn IS NULL OR (c.fn = q.fn AND (q.line IS NULL OR c.line IS NULL OR q.line = c.line)))""",
    "atoms_drift": _DRIFT + "SELECT symbol, n_atoms, n_callers, risk FROM report",
    "atoms_drift_summary": _DRIFT + "SELECT r AS risk, count(symbol) AS n FROM (VALUES ('NONE'), ('LOW'), ('MEDIUM'), ('HIGH')) t(r) LEFT JOIN report ON risk = r GROUP BY r",
    "atoms_tagged": _WITH + "SELECT tag, id, round(1.0 / row_number() OVER (PARTITION BY tag ORDER BY id), 6) AS score FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM atoms) WHERE tag IS NOT NULL AND tag <> ''",
    "atoms_broken_links": _WITH + "SELECT id, via, target FROM links WHERE target NOT IN (SELECT id FROM atoms)",
    "atoms_backlinks": _WITH + "SELECT target, id, round(1.0 / row_number() OVER (PARTITION BY target ORDER BY id), 6) AS score FROM (SELECT DISTINCT target, id FROM links)",
    "atoms_resolved": _WITH
    + """, t AS (SELECT DISTINCT link FROM (SELECT target AS link FROM links UNION SELECT upper(title) FROM asked) WHERE link IS NOT NULL)
SELECT link, coalesce((SELECT a.id FROM atoms a WHERE a.id = link), (SELECT min(a.id) FROM atoms a WHERE lower(a.title) = lower(link))) AS id FROM t""",
    "atoms_chains": _REC
    + """, ch AS (SELECT * FROM links WHERE via IN ('references', 'implements', 'parent_blueprint', 'resolves')),
seen AS (SELECT id AS start, id FROM asked UNION SELECT s.start, c.target FROM seen s JOIN ch c ON c.id = s.id WHERE c.target IN (SELECT id FROM atoms))
SELECT start, s.id, 'not_approved' AS kind, NULL::VARCHAR AS via, NULL::VARCHAR AS target FROM seen s JOIN atoms a ON a.id = s.id WHERE st IS DISTINCT FROM 'stable'
UNION ALL SELECT start, s.id, 'broken_crosslink', via, target FROM seen s JOIN ch c ON c.id = s.id WHERE target NOT IN (SELECT id FROM atoms)""",
    "session_stats": _STEPS
    + """SELECT session_id, count(*) FILTER (kind = 'user') AS n_user, count(*) FILTER (kind = 'agent') AS n_agent, count(*) FILTER (kind = 'tool') AS n_tool,
floor((epoch_us(max(tm)) - epoch_us(min(tm))) / 60000000 * 10 + 0.5) / 10 AS minutes, count(*) FILTER (kind IN ('user', 'agent')) >= 30 AND (epoch_us(max(tm)) - epoch_us(min(tm))) / 60000000 >= 60 AS due FROM steps GROUP BY session_id""",
    "session_topics": _TOPICS + "SELECT session_id, term, n, CAST(rank AS INT) AS rank FROM topics",
    "session_proposals": _TOPICS
    + """, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank) AS k FROM topics WHERE n >= 2 AND regexp_matches(term, '^[A-Z]')) WHERE k <= 5),
prop AS (SELECT *, 'INSIGHT--' || regexp_replace(regexp_replace(upper(term), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS pid FROM cand),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm, doc, line) AS i, count(*) OVER (PARTITION BY session_id) AS size FROM steps),
refs AS (SELECT p.session_id, p.term, count(*) AS refs, max(i) AS last FROM prop p JOIN placed s ON s.session_id IS NOT DISTINCT FROM p.session_id AND (contains(content, pid) OR contains(content, term)) GROUP BY ALL),
sized AS (SELECT DISTINCT session_id, size FROM placed),
sc AS (SELECT p.session_id, p.pid AS proposed_id, p.term AS title, p.n, 0.4 * least(1, 0.3 + p.n * 0.1) + 0.3 * least(1, coalesce(refs, 0) / 5) + 0.3 * coalesce(last / size, 0) AS score FROM prop p LEFT JOIN refs r ON r.session_id IS NOT DISTINCT FROM p.session_id AND r.term = p.term JOIN sized s ON s.session_id IS NOT DISTINCT FROM p.session_id)
SELECT session_id, proposed_id, title, n, round(score, 6) AS score FROM sc WHERE score >= 0.2""",
    "session_summaries": _TOPICS
    + """, ends AS (SELECT session_id, count(*) FILTER (kind = 'user') AS u, count(*) FILTER (kind = 'agent') AS a, count(*) FILTER (kind = 'tool') AS t,
first(content ORDER BY tm, doc, line) FILTER (kind = 'user') AS f, last(content ORDER BY tm, doc, line) FILTER (kind = 'agent') AS l FROM steps GROUP BY session_id),
tg AS (SELECT session_id, string_agg(regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ',' ORDER BY rank) AS tags FROM topics WHERE rank <= 5 GROUP BY session_id)
SELECT e.session_id, md5('Session ' || coalesce(e.session_id, '') || ': ' || u || ' user turns, ' || a || ' agent turns, ' || t || ' tool calls. Asked first: "' || """
    + _cut("coalesce(f, '')", 140).replace("[1:139]", "[1:139]")
    + """ || '". Answered last: "' || """
    + _cut("coalesce(l, '')", 200)
    + """ || '".') AS digest, coalesce(tags, '') AS tags FROM ends e LEFT JOIN tg ON tg.session_id IS NOT DISTINCT FROM e.session_id""",
    "session_last_steps": _STEPS
    + f""", b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm DESC NULLS LAST, doc DESC, line DESC) AS b FROM steps), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY b DESC) AS n FROM b WHERE b <= 10)
SELECT session_id, CAST(n AS INT) AS n, doc, CAST(line AS INT) AS line, md5({_turn("kind", "content")}) AS digest FROM k""",
    "sessions_reflected": _STEPS
    + """, ends AS (SELECT session_id, count(*) FILTER (kind = 'user') AS u, count(*) FILTER (kind = 'agent') AS a, count(*) FILTER (kind = 'tool') AS t, (epoch_us(max(tm)) - epoch_us(min(tm))) / 60000000 AS m,
first(content ORDER BY tm, doc, line) FILTER (kind = 'user') AS f, last(content ORDER BY tm, doc, line) FILTER (kind = 'agent') AS l FROM steps GROUP BY session_id)
SELECT session_id, u AS n_user, a AS n_agent, t AS n_tool, floor(m * 10 + 0.5) / 10 AS minutes, md5('Session ' || coalesce(session_id, '') || ': ' || u || ' user turns, ' || a || ' agent turns, ' || t || ' tool calls. Asked first: "' || """
    + _cut("coalesce(f, '')", 140)
    + """ || '". Answered last: "' || """
    + _cut("coalesce(l, '')", 200)
    + """ || '".') AS digest FROM ends WHERE u + a >= 4 AND m >= 1""",
    "session_cascade": """WITH d AS (SELECT session_id, coalesce(epoch_us(created_at), 0) AS tm, doc_id, length(text) AS size FROM documents),
p AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY tm, doc_id) - 1) // 5 AS fold FROM d)
SELECT session_id, fold, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS size, min(tm) AS first, max(tm) AS last FROM p GROUP BY ALL""",
    "strongest_titles": _WITH + "SELECT lower(title) AS key, first(id ORDER BY phase DESC, indexed_at, id) AS id, max(phase) AS phase FROM atoms WHERE title IS NOT NULL AND phase IS NOT NULL AND indexed_at IS NOT NULL GROUP BY lower(title)",
    "usage_by_type": "SELECT coalesce(event_type, '') AS event_type, grouping(event_type) > 0 AS grand, count(*) AS calls, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM events GROUP BY ROLLUP (event_type)",
    "value_percentiles": """WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM e)
SELECT event_type, CAST(p AS DOUBLE) AS percent, c AS value FROM r, (VALUES (50), (90), (95), (99)) t(p) WHERE i = floor(p / 100 * (n - 1))""",
    "events_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL",
    "status_zero_filled": _WITH + "SELECT s AS status, count(a.id) AS n FROM (VALUES ('raw'), ('draft'), ('stable'), ('deprecated'), ('invalid')) t(s) LEFT JOIN atoms a ON a.st = s GROUP BY s",
    "value_histogram": "SELECT floor(value / 5) * 5.0 AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL",
    "manifest_diff": """WITH l AS (SELECT id, created_at, sha256(coalesce(text, '')) AS h FROM pgvector WHERE id IS NOT NULL AND created_at IS NOT NULL),
o AS (SELECT id, arg_max(h, created_at) AS h FROM l WHERE created_at <= TIMESTAMPTZ '2025-01-01 00:00:00+00' GROUP BY id), w AS (SELECT id, arg_max(h, created_at) AS h FROM l WHERE created_at <= TIMESTAMPTZ '2026-12-31 00:00:00+00' GROUP BY id)
SELECT CASE WHEN o.h IS NULL THEN 'added' WHEN w.h IS NULL THEN 'deleted' WHEN o.h = w.h THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM o FULL JOIN w USING (id) GROUP BY ALL""",
    "markdown_sections": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}[{_SPACE}]+[^{_SPACE}]') THEN length(regexp_extract(line, '^(#+)', 1)) END AS lv FROM l),
s AS (SELECT *, count(lv) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
filled AS (SELECT DISTINCT doc_id, sec FROM s WHERE lv IS NULL AND regexp_matches(line, '[^{_SPACE}]')),
heads AS (SELECT doc_id, sec, lv FROM s WHERE lv IS NOT NULL),
open AS (SELECT f.doc_id, f.sec, g.sec AS gsec, g.lv, min(x.lv) AS least FROM filled f JOIN heads g ON g.doc_id = f.doc_id AND g.sec <= f.sec LEFT JOIN heads x ON x.doc_id = f.doc_id AND x.sec > g.sec AND x.sec <= f.sec GROUP BY ALL),
deep AS (SELECT doc_id, sec, count(*) FILTER (least IS NULL OR least > lv) AS d FROM open GROUP BY ALL)
SELECT f.doc_id, count(*) AS n_sections, CAST(max(coalesce(d, 0)) AS INT) AS deepest FROM filled f LEFT JOIN deep USING (doc_id, sec) GROUP BY f.doc_id""",
    "index_skips": r"""WITH f AS (SELECT doc_id, regexp_extract(text, '(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)', 1) AS fm FROM documents),
g AS (SELECT doc_id, fm, nullif(trim(regexp_extract(fm, '(?m)^id\s*:(.*)$', 1), chr(13) || ' '), '') AS id, TRY_CAST(coalesce(nullif(trim(regexp_extract(fm, '(?m)^phase\s*:(.*)$', 1), chr(13) || ' '), ''), '0') AS INT) AS ph FROM f)
SELECT doc_id AS path, id, CASE WHEN fm = '' OR NOT regexp_matches(fm, '(?m)^[A-Za-z_][\w-]*\s*:') THEN 'no front matter' WHEN id IS NULL THEN 'no id' WHEN NOT regexp_matches(id, '^[A-Z][A-Z0-9_]*--[A-Z0-9][A-Z0-9_-]*$') THEN 'bad id' WHEN ph IS NULL OR ph NOT BETWEEN 0 AND 5 THEN 'bad phase' END AS skip FROM g""",
    "index_rebuilt": r"""WITH f AS (SELECT doc_id, regexp_extract(text, '(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)', 1) AS fm FROM documents),
g AS (SELECT doc_id, nullif(trim(regexp_extract(fm, '(?m)^id\s*:(.*)$', 1), chr(13) || ' '), '') AS id, nullif(trim(regexp_extract(fm, '(?m)^type\s*:(.*)$', 1), chr(13) || ' '), '') AS type, TRY_CAST(coalesce(nullif(trim(regexp_extract(fm, '(?m)^phase\s*:(.*)$', 1), chr(13) || ' '), ''), '0') AS INT) AS phase FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS k FROM g WHERE regexp_matches(id, '^[A-Z][A-Z0-9_]*--[A-Z0-9][A-Z0-9_-]*$') AND phase BETWEEN 0 AND 5)
SELECT id, doc_id AS path, phase, type FROM r WHERE k = 1""",
}
