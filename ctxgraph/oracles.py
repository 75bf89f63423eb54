"""The registered queries in ANSI SQL over the same tables.

Written from the operators' definitions, not from their plans; the views they
name are put before each as common table expressions.
"""

from __future__ import annotations

from .functions.text import BLAST_WORDS, CODE_STOP_WORDS, DEBUG_WORDS, MODIFY_WORDS, STOP_WORDS  # noqa: F401
from .sources.views import with_views

NOW = "2024-03-01 00:00:00"
WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def words(*columns: str) -> str:
    return " || ".join(WORDS.format(c) for c in columns)


def _bm25(docs: str, fields: tuple[str, ...], groups: tuple[tuple[str, ...], ...], key: str = "id", sized: tuple[str, ...] | None = None) -> str:
    """CTEs that end in hits(key, bm25); lengths are those of the fields ``sized``."""
    terms = list(dict.fromkeys(t for g in groups for t in g))
    listed = ", ".join(f"('{t}')" for t in terms)
    members = ", ".join(f"({i}, '{t}', {len(g)})" for i, g in enumerate(groups) for t in g)
    return f"""
doc_words AS (SELECT {key} AS id, {words(*fields)} AS ws, len({words(*(sized or fields))}) AS dl FROM {docs}),
corpus AS (SELECT count(*) AS big_n, avg(dl) AS avg_len FROM doc_words),
terms(w) AS (VALUES {listed}), grp(g, w, size) AS (VALUES {members}),
tf AS (SELECT id, dl, w, len(list_filter(ws, lambda x: x = w)) AS tf FROM doc_words, terms WHERE list_contains(ws, w)),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
gs AS (SELECT tf.id, g, size, count(*) AS n, sum(greatest(CASE WHEN ln((big_n - df + 0.5) / (df + 0.5)) > 0 THEN ln((big_n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_len))) AS s
  FROM tf JOIN df USING (w) JOIN grp USING (w), corpus GROUP BY tf.id, g, size),
hits AS (SELECT id, sum(s) AS bm25 FROM gs WHERE n = size GROUP BY id)"""


def _count(column: str, listed: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower({column}), '{w}') AS INT)" for w in listed)


CAMEL = r"""trim(regexp_replace(regexp_replace(regexp_replace({0}, {1}, ' ', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'))"""


def _pagerank(steps: int) -> str:
    out = """
n AS (SELECT count(*) AS n FROM v_nodes), deg AS (SELECT source_node_id AS id, count(*) AS d FROM v_edges GROUP BY 1),
r0 AS MATERIALIZED (SELECT id, 1.0 / n AS rank FROM v_nodes, n)"""
    for i in range(steps):
        out += f""",
r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + l.lost / n) AS rank FROM v_nodes v CROSS JOIN n
  CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT id FROM deg)) l
  LEFT JOIN (SELECT e.target_node_id AS id, sum(r.rank / d) AS got FROM v_edges e JOIN r{i} r ON r.id = e.source_node_id JOIN deg ON deg.id = e.source_node_id GROUP BY 1) g ON g.id = v.id)"""
    return out


def _pagerank_converged(most: int = 100) -> str:
    """CTEs that end in ranks(id, rank): the first step that moves no rank by 1e-6."""
    every = " UNION ALL ".join(f"SELECT {i} AS i, id, rank FROM r{i}" for i in range(1, most + 1))
    return _pagerank(most) + f""",
every AS MATERIALIZED ({every}), still AS (SELECT i FROM (SELECT i, max(moved) AS moved FROM (SELECT i, abs(rank - lag(rank, 1, 1.0 / n) OVER (PARTITION BY id ORDER BY i)) AS moved FROM every, n) GROUP BY i) WHERE moved < 1e-6),
ranks AS (SELECT id, rank FROM every WHERE i = coalesce((SELECT min(i) FROM still), {most}))"""


def _joined(c: str) -> str:
    """The parts of an identifier joined by spaces, in lower case."""
    cut = f"regexp_replace({c}, '[:.\\-/_]+', chr(1), 'g')"
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})"):
        cut = f"regexp_replace({cut}, '{pattern}', '\\1' || chr(1) || '\\2', 'g')"
    return f"lower(replace(trim({cut}, chr(1)), chr(1), ' '))"


def _tokens(c: str) -> str:
    j = _joined(c)
    return f"CASE WHEN {j} = '' THEN lower({c}) WHEN contains({j}, lower({c})) THEN {j} ELSE {j} || ' ' || lower({c}) END"


NODE_DOCS = f"""
nd AS (SELECT n.*, f.path, {_tokens('n.name')} AS tn, {_tokens('n.qualified_name')} AS tq FROM v_nodes n JOIN v_files f ON f.id = n.file_id)"""
NODE_FIELDS = ("name", "qualified_name", "tn", "tq", "signature", "path")


def _overlap(terms: list[str], name: str, signature: str) -> str:
    n, s = words(CAMEL.format(name, r"'[^\p{L}\p{N}]+'")), words(CAMEL.format(f"coalesce({signature}, '')", r"'[^\p{L}\p{N}]+'"))
    hits = " + ".join(f"2 * CAST(list_contains({n}, '{t}') AS INT) + CAST(list_contains({s}, '{t}') AS INT)" for t in terms)
    return f"least(({hits}) / {3.0 * len(terms)}, 1.0)"


def _bonus(terms: list[str], path: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({path}), '{t}') AS INT)" for t in terms) + f") / {float(len(terms))}"


_ALLOWED = "coalesce(is_export, FALSE) OR coalesce(visibility IN ('pub', 'public'), FALSE)"
_TRI = "CASE WHEN len({0}) < 3 THEN [lower({0})] ELSE list_distinct([substr(lower({0}), i, 3) FOR i IN range(1, len({0}) - 1)]) END"

RAW: dict[str, str] = {
    "bm25_topk": f"WITH {_bm25('v_files', ('content',), (('anshe',), ('theaea',), ('re', 'eroundth')))} SELECT h.id, f.path, round(bm25, 6) AS bm25 FROM hits h JOIN v_files f ON f.id = h.id ORDER BY h.bm25 DESC, h.id LIMIT 20",
    "bm25_filtered": f"""WITH {NODE_DOCS}, {_bm25('nd', NODE_FIELDS[:4] + ('path',), (('steel',), ('supplier',), ('widget',), ('src1',)), sized=NODE_FIELDS)}
SELECT h.id, nd.name, nd.path, round(h.bm25, 6) AS bm25 FROM hits h JOIN nd USING (id) WHERE nd.kind = 'function' AND nd.path ILIKE '%src1%' ORDER BY h.bm25 DESC, h.id LIMIT 50""",
    "bm25_cascade": f"WITH {_bm25('v_files', ('content',), (('theaea', 're', 'anshe'),)).replace('hits AS', 'hits_and AS')}, {_bm25('v_files', ('content',), (('theaea', 're'), ('anshe',))).replace('doc_words', 'doc_words2').replace('corpus', 'corpus2').replace('terms', 'terms2').replace('grp', 'grp2').replace('gs', 'gs2').replace('tf AS (', 'tf2 AS (').replace('FROM tf ', 'FROM tf2 ').replace('df AS (', 'df2 AS (').replace('FROM tf2 JOIN df ', 'FROM tf2 JOIN df2 ').replace('tf.id', 'tf2.id')}, "
    "a AS (SELECT * FROM hits_and ORDER BY bm25 DESC, id LIMIT 40), o AS (SELECT * FROM hits ORDER BY bm25 DESC, id LIMIT 40), "
    "c AS (SELECT count(*) AS n FROM a) SELECT id, round(bm25, 6) AS bm25 FROM a, c WHERE n >= 5 UNION ALL SELECT id, round(bm25, 6) FROM o, c WHERE n < 5",
    "like_fallback": f"WITH {NODE_DOCS} SELECT id, name, path, CAST(1.0 AS DOUBLE) AS bm25 FROM nd WHERE " + " OR ".join(f"{c} ILIKE '%{w}%'" for w in ("arge-x", "upplie", "0001") for c in ("name", "qualified_name", "signature", "path")) + " ORDER BY id LIMIT 40",
    "hybrid_score": f"""WITH {NODE_DOCS}, {_pagerank_converged()}, {_bm25('nd', NODE_FIELDS, (('supplier',), ('europe',))).replace('hits AS', 'hits_or AS').replace('gs AS', 'gs0 AS').replace('FROM gs ', 'FROM gs0 ')},
allhit AS (SELECT id, sum(s) AS bm25 FROM gs0 GROUP BY id HAVING count(*) = 2),
na AS (SELECT count(*) AS n FROM (SELECT * FROM allhit LIMIT 30)),
c AS (SELECT id, bm25 FROM hits_or ORDER BY bm25 DESC, id LIMIT 30),
a AS (SELECT id, bm25 FROM allhit ORDER BY bm25 DESC, id LIMIT 30),
pick AS (SELECT * FROM a WHERE (SELECT n FROM na) >= 5 UNION ALL SELECT * FROM c WHERE (SELECT n FROM na) < 5),
conf AS (SELECT node_id, avg(confidence) AS ac FROM (SELECT source_node_id AS node_id, confidence FROM v_edges UNION ALL SELECT target_node_id, confidence FROM v_edges) GROUP BY 1),
s AS (SELECT nd.id, nd.name, nd.path, 0.30 * bm25 / max(bm25) OVER () + 0.30 * {_overlap(['supplier', 'europe', 'module'], 'nd.name', 'nd.signature')} + 0.25 * least(rank * 1000, 1.0) + 0.15 * coalesce(ac, 0.5)
  + 0.15 * {_bonus(['supplier', 'europe'], 'nd.path')} AS score FROM pick JOIN nd USING (id) JOIN ranks USING (id) LEFT JOIN conf ON conf.node_id = nd.id),
t AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM s ORDER BY score DESC, id LIMIT 15)
SELECT id, name, path, round(score, 6) AS score, CASE WHEN count(*) OVER (PARTITION BY dir) > 2 THEN dir END AS cluster_id FROM t""",
    "external_merge": f"""WITH nd AS (SELECT item_id AS id, substr(text, 1, 20) AS name, text AS qualified_name, CAST(NULL AS VARCHAR) AS signature, 'bench/items.txt' AS path FROM benchmark),
nt AS (SELECT *, {_tokens('name')} AS tn, {_tokens('qualified_name')} AS tq FROM nd), {_bm25('nt', NODE_FIELDS, (('anshe',), ('items',)))},
best AS (SELECT id, bm25 FROM hits ORDER BY bm25 DESC, id LIMIT 10)
SELECT id, 'bench' AS workspace, round((0.30 * bm25 / max(bm25) OVER () + 0.30 * {_overlap(['anshe', 'items'], 'name', 'signature')} + 0.15 * {_bonus(['anshe', 'items'], 'path')}) * 0.85, 6) AS score FROM best JOIN nd USING (id)""",
    "cluster_labels": "WITH d AS (SELECT id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM v_files) SELECT id, path, CASE WHEN count(*) OVER (PARTITION BY dir) > 2 THEN dir END AS cluster_id FROM d",
    "detect_intent": f"""WITH t AS (SELECT id, headline || ' ' || content AS q FROM v_obs), s AS (SELECT id, {_count('q', DEBUG_WORDS)} AS d, {_count('q', BLAST_WORDS)} AS b, {_count('q', MODIFY_WORDS)} AS m FROM t),
i AS (SELECT id, CASE WHEN greatest(d, b, m) = 0 THEN 'explore' WHEN m = greatest(d, b, m) THEN 'modify' WHEN d = greatest(d, b, m) THEN 'debug' ELSE 'blast_radius' END AS intent FROM s)
SELECT id, intent, CASE intent WHEN 'debug' THEN CAST(0.45 AS DOUBLE) WHEN 'blast_radius' THEN 0.15 ELSE 0.30 END AS bm25_weight FROM i""",
    "token_estimate": "SELECT id, CAST(ceil(strlen(content) / 3.0) AS BIGINT) AS tokens, CAST(floor(strlen(content) / 4.0) AS BIGINT) AS tokens_fallback FROM v_files",
    "tokenize_identifier": f"""WITH t AS (SELECT id, {_tokens('qualified_name')} AS tokens, {words(CAMEL.format("coalesce(signature, '')", "'[^\\p{L}\\p{N}]+'"))} AS ws FROM v_nodes)
SELECT id, tokens, array_to_string(list_filter(ws, lambda w: strlen(w) > 1), ' ') AS words FROM t""",
    "query_nodes_filter": "SELECT n.id, n.name, f.path, n.line_start FROM v_nodes n JOIN v_files f ON f.id = n.file_id WHERE n.kind = 'function' AND f.path ILIKE '%src1%' AND (n.name ILIKE '%al%' OR n.qualified_name ILIKE '%al%' OR n.signature ILIKE '%al%' OR f.path ILIKE '%al%') ORDER BY f.path, n.line_start, n.id LIMIT 50",
    "query_nodes_exported": f"SELECT n.id, n.kind, f.path, ({_ALLOWED}) AS exported FROM v_nodes n JOIN v_files f ON f.id = n.file_id WHERE visibility = 'pub' AND is_export ORDER BY f.path, n.line_start, n.id LIMIT 1000",
    "query_edges_filter": """SELECT e.source_node_id, s.name AS source_name, fs.path AS source_path, e.target_node_id, t.name AS target_name, ft.path AS target_path, e.kind, round(e.confidence, 6) AS confidence, e.context
FROM v_edges e JOIN v_nodes s ON s.id = e.source_node_id JOIN v_nodes t ON t.id = e.target_node_id JOIN v_files fs ON fs.id = s.file_id JOIN v_files ft ON ft.id = t.file_id
WHERE e.confidence >= 0.87 AND (s.name = 'Supplier#000000007' OR t.name = 'Supplier#000000007') ORDER BY e.confidence DESC, 1, 4, 7, 9 NULLS FIRST LIMIT 50""",
    "unresolved_refs": "SELECT r.id, n.name AS source_name, f.path, r.target_name, r.edge_kind, r.import_path FROM v_refs r JOIN v_nodes n ON n.id = r.source_node_id JOIN v_files f ON f.id = n.file_id WHERE f.path ILIKE '%src3%' ORDER BY f.path, r.target_name, r.id LIMIT 100",
    "list_files": "SELECT id, path, language, content_hash, size_bytes FROM v_files WHERE language = 'en' ORDER BY size_bytes DESC, path LIMIT 100",
    "index_status": "SELECT 'files' AS metric, count(*) AS value FROM v_files UNION ALL SELECT 'nodes', count(*) FROM v_nodes UNION ALL SELECT 'edges', count(*) FROM v_edges UNION ALL SELECT 'unresolved_refs', count(*) FROM v_refs UNION ALL SELECT 'language:' || language, count(*) FROM v_files GROUP BY language",
    "node_counts": "SELECT file_id, count(*) AS node_count FROM v_nodes GROUP BY file_id",
    "avg_confidence": "SELECT node_id, round(avg(confidence), 6) AS avg_confidence FROM (SELECT source_node_id AS node_id, confidence FROM v_edges UNION ALL SELECT target_node_id, confidence FROM v_edges) GROUP BY node_id",
    "sessions_with_counts": "SELECT s.id, epoch_us(s.updated_at) AS updated_us, count(o.id) AS observation_count FROM v_sessions s LEFT JOIN v_obs o ON o.session_id = s.id GROUP BY s.id, s.updated_at ORDER BY s.updated_at DESC, s.id LIMIT 1000",
    "env_var_readers": "SELECT n.name, count(DISTINCT e.source_node_id) AS reader_count FROM v_nodes n LEFT JOIN v_edges e ON e.target_node_id = n.id AND e.kind = 'calls' WHERE n.kind = 'function' GROUP BY n.name",
    "import_pairs": "SELECT DISTINCT s.file_id AS source_file_id, t.file_id AS target_file_id FROM v_edges e JOIN v_nodes s ON s.id = e.source_node_id JOIN v_nodes t ON t.id = e.target_node_id WHERE e.kind = 'imports'",
    "edges_touching": "WITH ids AS (SELECT id FROM v_nodes WHERE (kind = 'struct' AND visibility = 'private') OR (kind = 'class' AND file_id = 4)) SELECT source_node_id, target_node_id, kind, round(confidence, 6) AS confidence FROM v_edges WHERE source_node_id IN (SELECT id FROM ids) OR target_node_id IN (SELECT id FROM ids)",
    "enclosing_node": "WITH p AS (SELECT id, id % 50 AS file_id, id % 60 * 7 AS line FROM v_refs) SELECT p.id, p.file_id, p.line, n.id AS node_id FROM p JOIN v_nodes n ON n.file_id = p.file_id AND p.line BETWEEN n.line_start AND n.line_end QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY n.line_end - n.line_start, n.id) = 1",
    "edge_kind_counts": "SELECT kind, count(*) AS n FROM v_edges GROUP BY kind",
    "degrees": "SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT source_node_id AS id, 1 AS o, 0 AS i FROM v_edges UNION ALL SELECT target_node_id, 0, 1 FROM v_edges) GROUP BY id",
    "pagerank_k": f"WITH {_pagerank(10)} SELECT id, round(rank, 10) AS rank FROM r10",
    "top_pagerank": f"WITH {_pagerank_converged()} SELECT v.id, v.kind, v.name, round(r.rank, 10) AS rank FROM ranks r JOIN v_nodes v USING (id) WHERE v.kind = 'class' ORDER BY r.rank DESC, v.id LIMIT 20",
    "impact_bfs": """WITH RECURSIVE st AS (SELECT id FROM v_nodes WHERE name = 'ASIA' OR qualified_name = 'ASIA' ORDER BY id LIMIT 1),
up AS (SELECT id, -1 AS d FROM st UNION SELECT e.source_node_id, d + 1 FROM up JOIN v_edges e ON e.target_node_id = up.id WHERE d < 2),
down AS (SELECT id, -1 AS d FROM st UNION SELECT e.target_node_id, d + 1 FROM down JOIN v_edges e ON e.source_node_id = down.id WHERE d < 2)
SELECT 'callers' AS direction, min(d) AS depth, id FROM up GROUP BY id HAVING min(d) >= 0 UNION ALL SELECT 'callees', min(d), id FROM down GROUP BY id HAVING min(d) >= 0""",
    "simple_paths": """WITH RECURSIVE s AS MATERIALIZED (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM v_edges), goal AS (SELECT id FROM v_nodes WHERE name = 'ASIA'),
far AS (SELECT id, 0 AS d FROM goal UNION SELECT s.a, d + 1 FROM far JOIN s ON s.b = far.id WHERE d < 6), near AS MATERIALIZED (SELECT id, min(d) AS d FROM far GROUP BY id),
p AS (SELECT [id] AS path, id AS here, 0 AS hops FROM v_nodes WHERE name = 'Supplier#000000007' UNION ALL
  SELECT list_append(path, b), b, hops + 1 FROM p JOIN s ON s.a = p.here JOIN near ON near.id = s.b WHERE hops + 1 + near.d <= 6 AND NOT list_contains(path, b) AND here NOT IN (SELECT id FROM goal))
SELECT hops, array_to_string(path, '>') AS path FROM p WHERE here IN (SELECT id FROM goal) ORDER BY hops, p.path LIMIT 10""",
    "bridges": "WITH piv AS (SELECT id FROM v_nodes WHERE kind = 'struct'), e AS (SELECT * FROM v_edges WHERE kind IN ('calls', 'imports', 'implements', 'extends')) SELECT DISTINCT id FROM (SELECT target_node_id AS id FROM e WHERE source_node_id IN (SELECT id FROM piv) UNION SELECT source_node_id FROM e WHERE target_node_id IN (SELECT id FROM piv)) WHERE id NOT IN (SELECT id FROM piv)",
    "resolve_refs": rf"""WITH xn AS (SELECT id, file_id, kind, name, qualified_name, visibility, is_export OR id % 3 = 0 AS is_export FROM v_nodes), pub AS (SELECT n.*, f.path FROM xn n LEFT JOIN v_files f ON f.id = n.file_id WHERE {_ALLOWED}),
imp AS (SELECT DISTINCT s.file_id AS a, t.file_id AS b FROM v_edges e JOIN v_nodes s ON s.id = e.source_node_id JOIN v_nodes t ON t.id = e.target_node_id WHERE e.kind = 'imports'),
c AS (SELECT r.id AS ref_id, r.source_node_id, pub.id AS target_node_id, r.edge_kind, pub.kind AS nk, imp.a IS NOT NULL AS i,
  coalesce(regexp_replace(r.import_path, '^(\./)+', '') <> '' AND ends_with(regexp_replace(pub.path, '\.[^./]*$', ''), regexp_replace(r.import_path, '^(\./)+', '')), FALSE) AS p, count(*) OVER (PARTITION BY r.id) AS n
  FROM v_refs r JOIN v_nodes s ON s.id = r.source_node_id JOIN pub ON pub.name = r.target_name AND pub.file_id <> s.file_id LEFT JOIN imp ON imp.a = s.file_id AND imp.b = pub.file_id),
b AS (SELECT *, CASE WHEN i THEN CAST(0.85 AS DOUBLE) WHEN p THEN 0.80 WHEN n > 1 THEN 0.30 ELSE 0.50 END AS base FROM c),
k AS (SELECT *, round(CASE WHEN (edge_kind = 'calls' AND nk IN ('function', 'method')) OR (edge_kind = 'type_ref' AND nk IN ('struct', 'class', 'trait', 'interface', 'type_alias', 'enum')) THEN least(base + 0.05, 0.99) ELSE base END, 6) AS confidence FROM b)
SELECT ref_id, source_node_id, target_node_id, edge_kind AS kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY confidence DESC, target_node_id) AS nth FROM k) WHERE nth = 1 AND confidence > 0.30""",
    "cross_workspace": f"WITH xn AS (SELECT id, file_id, kind, name, qualified_name, visibility, is_export OR id % 3 = 0 AS is_export FROM v_nodes), m AS (SELECT name, arg_min(coalesce(qualified_name, name), id) AS q FROM xn WHERE kind = 'function' AND ({_ALLOWED}) GROUP BY name) SELECT r.id AS ref_id, r.source_node_id, 'parts' AS target_workspace, m.q AS target_qualified_name, r.edge_kind AS kind, CAST(0.7 AS DOUBLE) AS confidence FROM v_refs r JOIN m ON m.name = r.target_name",
    "shared_types": "SELECT t.id, t.name, count(DISTINCT s.file_id) AS file_count FROM v_edges e JOIN v_nodes t ON t.id = e.target_node_id JOIN v_nodes s ON s.id = e.source_node_id WHERE t.kind IN ('struct', 'class', 'interface', 'enum', 'trait', 'type_alias') GROUP BY t.id, t.name HAVING count(DISTINCT s.file_id) >= 2",
    "structural_diff": """WITH o0 AS (SELECT file_id, kind, name, signature, line_start, id FROM v_nodes WHERE kind = 'function'),
n0 AS (SELECT file_id, kind, CASE WHEN id % 11 = 0 THEN name || ' new' ELSE name END AS name, CASE WHEN id % 5 = 0 THEN signature || ' -> i64' ELSE signature END AS signature, line_start + id % 3 AS line_start FROM o0 WHERE id % 7 <> 0),
o AS (SELECT * FROM o0 QUALIFY row_number() OVER (PARTITION BY file_id, kind, name ORDER BY line_start, signature NULLS FIRST) = 1),
n AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY file_id, kind, name ORDER BY line_start, signature NULLS FIRST) = 1),
gone AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.file_id = o.file_id AND n.kind = o.kind AND n.name = o.name)),
come AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.file_id = o.file_id AND n.kind = o.kind AND n.name = o.name)),
pr AS (SELECT c.file_id, c.kind, c.name, g.name AS old_name, row_number() OVER (PARTITION BY c.file_id, c.kind, c.name ORDER BY abs(c.line_start - g.line_start), g.name) AS a, row_number() OVER (PARTITION BY c.file_id, c.kind, g.name ORDER BY abs(c.line_start - g.line_start), c.name) AS b
  FROM come c JOIN gone g ON c.file_id = g.file_id AND c.kind = g.kind AND abs(c.line_start - g.line_start) <= 5),
ren AS (SELECT * FROM pr WHERE a = 1 AND b = 1),
d AS (SELECT o.file_id, 'modified' AS change FROM o JOIN n ON o.file_id = n.file_id AND o.kind = n.kind AND o.name = n.name WHERE o.signature IS DISTINCT FROM n.signature
UNION ALL SELECT file_id, 'renamed' FROM ren
UNION ALL SELECT c.file_id, 'added' FROM come c WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_id = c.file_id AND r.kind = c.kind AND r.name = c.name)
UNION ALL SELECT g.file_id, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.file_id = g.file_id AND r.kind = g.kind AND r.old_name = g.name))
SELECT change, count(*) AS n, CAST(sum(file_id) AS BIGINT) AS files FROM d GROUP BY change""",
    "submit_edges": "WITH q AS (SELECT qualified_name, min(id) AS id FROM v_nodes WHERE qualified_name IS NOT NULL GROUP BY 1), g AS (SELECT 'supplier::' || s_name AS source, 'region::' || CASE s_suppkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'NOWHERE' END AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'imports' ELSE 'calls' END AS kind FROM supplier) SELECT a.id AS source_node_id, b.id AS target_node_id, g.kind, CAST(0.95 AS DOUBLE) AS confidence FROM g JOIN q a ON a.qualified_name = g.source JOIN q b ON b.qualified_name = g.target",
    "range_merge": """WITH p AS (SELECT file_id, greatest(line_start - 5, 1) AS a, least(line_end + 5, 300) AS b FROM v_nodes WHERE greatest(line_start - 5, 1) <= least(line_end + 5, 300)),
m AS (SELECT *, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY file_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) + 1 THEN 1 ELSE 0 END AS new FROM p),
i AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file_id, min(a) AS line_start, max(b) AS line_end, count(*) AS n FROM i GROUP BY file_id, island""",
    "excerpt_choice": """WITH l AS (SELECT id AS file_id, content, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS total_lines FROM v_files),
m AS (SELECT file_id, count(*) AS matched FROM v_nodes WHERE kind = 'function' GROUP BY 1), c AS (SELECT file_id, count(*) AS node_count FROM v_nodes GROUP BY 1)
SELECT l.file_id, CAST(total_lines AS BIGINT) AS total_lines, matched, (total_lines < 50 OR (node_count > 0 AND matched * 2 >= node_count)) AS "full", md5(array_to_string(string_split(content, chr(10))[2:4], chr(10))) AS lines_md5
FROM l JOIN m USING (file_id) LEFT JOIN c USING (file_id)""",
    "budget_split": """WITH b AS (SELECT o_orderkey AS id, o_orderkey % 9000 AS budget FROM orders), c AS (SELECT *, budget * 10 // 100 AS memory FROM b), u AS (SELECT *, budget - memory AS code, (budget - memory) * 90 // 100 AS usable FROM c)
SELECT id, budget, memory, code, usable, usable * 60 // 100 AS pivot, usable * 10 // 100 AS bridge, usable - usable * 60 // 100 - usable * 10 // 100 AS skeleton FROM u""",
    "memory_search": f"""WITH {_bm25('v_obs', ('content', 'headline'), (('anshe',), ('theaea',), ('user',)))}, t AS (SELECT id, bm25 FROM hits ORDER BY bm25 DESC, id LIMIT 60)
SELECT id, session_id, round((0.4 * bm25 / mx + 0.3 * pow(2.0, -(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0 / 7.0) + 0.1 + CASE WHEN session_id = 7 THEN 0.2 ELSE 0.0 END) * CASE WHEN is_stale THEN 0.4 ELSE 1.0 END, 6) AS score
FROM t JOIN v_obs USING (id), (SELECT max(bm25) AS mx FROM t) ORDER BY (0.4 * bm25 / mx + 0.3 * pow(2.0, -(epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0 / 7.0) + 0.1 + CASE WHEN session_id = 7 THEN 0.2 ELSE 0.0 END) * CASE WHEN is_stale THEN 0.4 ELSE 1.0 END DESC, id LIMIT 20""",
    "consolidate": f"""WITH n AS (SELECT * FROM v_obs WHERE id = 702), c AS ((SELECT v.* FROM v_obs v, n WHERE v.id <> 702 AND NOT v.is_stale AND v.session_id = n.session_id ORDER BY v.created_at DESC, v.id LIMIT 20) UNION ALL (SELECT v.* FROM v_obs v, n WHERE v.id <> 702 AND NOT v.is_stale AND v.session_id <> n.session_id ORDER BY v.created_at DESC, v.id LIMIT 10)),
g AS (SELECT c.id, n.id AS new_id, {_TRI.format('c.content')} AS a, {_TRI.format('n.content')} AS b FROM c, n), s AS (SELECT id, new_id, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS similarity FROM g)
SELECT *, similarity >= 0.7 AS consolidated FROM s""",
    "trigram_similarity": f"""WITH p AS (SELECT a.id, a.content AS a, b.content AS b FROM v_obs a JOIN v_obs b ON b.id = a.id + 1), g AS (SELECT id, a AS t, {_TRI.format('a')} AS x, {_TRI.format('b')} AS y, string_split(a, chr(10))[1] AS l FROM p)
SELECT id, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS similarity, CASE WHEN len(l) <= 80 THEN l ELSE substr(l, 1, 77) || '...' END AS headline FROM g""",
    "anti_patterns": """WITH o AS (SELECT observation_id AS id, session_id, CAST(floor(epoch(created_at)) AS BIGINT) AS sec, file_id FROM v_activity),
f AS (SELECT id, count(*) OVER (PARTITION BY session_id, file_id) AS n FROM o), s AS (SELECT id, count(*) OVER (PARTITION BY session_id, file_id % 40) AS n FROM o),
r AS (SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY sec RANGE BETWEEN 599 PRECEDING AND 599 FOLLOWING) AS n FROM o),
t AS (SELECT id, 1 AS k FROM f WHERE n > 3 UNION ALL SELECT id, 2 FROM s WHERE n > 3 UNION ALL SELECT id, 3 FROM r WHERE n > 5)
SELECT o.id, o.session_id, CASE min(k) WHEN 1 THEN 'file_thrashing' WHEN 2 THEN 'circular_investigation' ELSE 'rapid_churn' END AS anti_pattern FROM t JOIN o USING (id) GROUP BY o.id, o.session_id""",
    "session_summary": f"""WITH RECURSIVE h AS (SELECT session_id, content AS h, min(created_at) AS first_at, arg_min(id, created_at) AS first_id FROM v_obs WHERE session_id IN (SELECT id FROM v_sessions WHERE epoch_us(updated_at) < epoch_us(TIMESTAMP '{NOW}') - 7200000000) GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_at, first_id) AS i FROM h),
f AS (SELECT session_id, 0 AS i, CAST([] AS VARCHAR[]) AS parts, CAST(0 AS BIGINT) AS size FROM (SELECT DISTINCT session_id FROM q) UNION ALL
  SELECT q.session_id, CAST(q.i AS INT), CASE WHEN size + strlen(h) + 2 <= 500 THEN list_append(parts, h) ELSE parts END, CASE WHEN size + strlen(h) + 2 <= 500 THEN size + strlen(h) + 2 ELSE size END FROM f JOIN q ON q.session_id = f.session_id AND q.i = f.i + 1)
SELECT session_id AS id, array_to_string(arg_max(parts, i), '; ') AS summary FROM f GROUP BY session_id""",
    "session_context": """WITH ranked AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS nth FROM v_sessions), o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS nth FROM v_obs)
SELECT CASE WHEN r.nth = 1 THEN 'current' ELSE 'previous' END AS section, o.session_id, o.nth, o.id, o.headline, o.is_stale FROM o JOIN ranked r ON r.id = o.session_id WHERE r.nth = 1 OR (r.nth <= 4 AND o.nth <= 5)""",
    "detect_staleness": "SELECT DISTINCT o.id FROM v_obs o JOIN v_files f ON f.id = o.id % 200 WHERE f.id % 4 = 0 AND f.content_hash <> 'old'",
    "ttl_cleanup": f"SELECT id, session_id FROM v_obs WHERE epoch_us(created_at) >= epoch_us(TIMESTAMP '{NOW}') - CAST(58 AS BIGINT) * 86400000000",
    "upsert_snapshot": "WITH d AS (SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 10000000 END AS id, path, 'new' AS content_hash FROM v_files WHERE id % 5 = 0) SELECT id, path, content_hash FROM v_files WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT * FROM d",
    "cascade_delete": """WITH g AS (SELECT id FROM v_files WHERE id % 4 = 1), n AS (SELECT id FROM v_nodes WHERE file_id IN (SELECT id FROM g))
SELECT 'files' AS name, count(*) AS n FROM v_files WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'nodes', count(*) FROM v_nodes WHERE file_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'edges', count(*) FROM v_edges WHERE source_node_id NOT IN (SELECT id FROM n) AND target_node_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'refs', count(*) FROM v_refs WHERE source_node_id NOT IN (SELECT id FROM n)""",
    "html_extract": r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<style[^>]*>')) AS BIGINT) AS styles, CAST(len(regexp_extract_all(html, '<script[^>]*\ssrc=')) + len(regexp_extract_all(html, '<link[^>]*\shref=')) AS BIGINT) AS imports FROM pages""",
    "env_scan": "SELECT upper(regexp_replace(p_name, '[^A-Za-z]+', '_', 'g')) AS name, count(*) AS files, count(*) AS readers FROM part GROUP BY 1",
    "api_scan": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'GET /' ELSE 'POST /' END || p_name AS name, count(*) AS files FROM part WHERE p_partkey % 4 IN (0, 1) GROUP BY 1",
    "change_stream_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
ORACLE_SQL = {k: with_views(v) for k, v in RAW.items()}
