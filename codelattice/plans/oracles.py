"""SQL that an independent engine runs over the same tables.

Each oracle states an operator's result from the views of ``fixtures``; joins
are written as they are defined (a match of names is a theta join here) and
not as the engine runs them.
"""

from __future__ import annotations

import re

from ..fixtures import LOG, oracle_views

#: Named table expressions on top of the views; an oracle lists what it needs, in order.
PARTS = {
    "deg": """SELECT s.symbol_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM fx_symbols s
LEFT JOIN (SELECT dst, count(*) AS n FROM fx_edges GROUP BY dst) i ON i.dst = s.symbol_id
LEFT JOIN (SELECT src, count(*) AS n FROM fx_edges GROUP BY src) o ON o.src = s.symbol_id""",
    "mod_edges": "SELECT DISTINCT a.module_id AS src, b.module_id AS dst FROM fx_edges e JOIN fx_symbols a ON a.symbol_id = e.src JOIN fx_symbols b ON b.symbol_id = e.dst",
    "parsed": r"""SELECT src, call_ord, raw, receiver,
       coalesce(nullif(regexp_extract(tail, '^([A-Za-z_][A-Za-z0-9_]*)', 1), ''), tail) AS call_name,
       CASE WHEN receiver IS NULL THEN 'function' ELSE 'member' END AS kind,
       nullif(regexp_extract(regexp_replace(receiver, '[:\s]+$', ''), '([A-Za-z_][A-Za-z0-9_]*)$', 1), '') AS receiver_tail
FROM (SELECT *, CASE WHEN contains(raw, '::') THEN regexp_extract(raw, '^(.*)::(.*)$', 1) WHEN contains(raw, ':') THEN regexp_extract(raw, '^(.*):(.*)$', 1)
                     WHEN contains(raw, '.') THEN regexp_extract(raw, '^(.*)\.(.*)$', 1) END AS receiver,
             CASE WHEN contains(raw, '::') THEN regexp_extract(raw, '^(.*)::(.*)$', 2) WHEN contains(raw, ':') THEN regexp_extract(raw, '^(.*):(.*)$', 2)
                  WHEN contains(raw, '.') THEN regexp_extract(raw, '^(.*)\.(.*)$', 2) ELSE raw END AS tail
      FROM fx_calls) y""",
    "sites": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, CASE WHEN receiver IS NULL THEN raw ELSE concat(receiver, '->', call_name) END ORDER BY call_ord) AS n FROM parsed) z WHERE n = 1",
    "aliases": "SELECT symbol_id, name AS alias FROM fx_symbols UNION SELECT symbol_id, short_name FROM fx_symbols",
    "matches": """SELECT c.call_name, a.alias, c.call_name = a.alias AS exact FROM (SELECT DISTINCT call_name FROM sites) c, (SELECT DISTINCT alias FROM aliases) a
WHERE c.call_name = a.alias OR ends_with(a.alias, concat('.', c.call_name)) OR ends_with(a.alias, concat(':', c.call_name))
   OR ends_with(c.call_name, concat('.', a.alias)) OR ends_with(c.call_name, concat(':', a.alias))""",
    "scored": """SELECT c.src, c.call_ord, c.call_name, c.raw, c.kind, c.receiver, d.symbol_id AS cand_id, d.name AS cand_name, d.relpath AS cand_path, d.container AS cand_container,
   m.exact, s.relpath = d.relpath AS same_file, c.kind = 'member' AS member, t.type AS rt, c.receiver_tail, s.container AS src_container
FROM sites c JOIN fx_symbols s ON s.symbol_id = c.src JOIN matches m ON m.call_name = c.call_name JOIN aliases a ON a.alias = m.alias
JOIN fx_symbols d ON d.symbol_id = a.symbol_id AND d.symbol_id <> c.src
LEFT JOIN fx_types t ON t.symbol_id = c.src AND t.var = c.receiver_tail""",
    "rated": """SELECT *, CASE WHEN exact THEN 100 ELSE 60 END + CASE WHEN same_file THEN 30 ELSE 10 END
  + CASE WHEN member AND cand_container IS NOT NULL THEN 15 ELSE 0 END
  + CASE WHEN NOT member THEN 0
         WHEN rt IS NOT NULL AND cand_container IS NOT NULL THEN CASE WHEN rt = cand_container THEN 130 WHEN rt IN ('self', 'cls') AND src_container = cand_container THEN 120 ELSE -35 END
         WHEN receiver_tail = cand_container THEN 90 WHEN receiver_tail = 'this' AND src_container = cand_container THEN 110 ELSE 0 END AS score FROM scored""",
    "cands": """SELECT * EXCLUDE (rn), CASE WHEN score >= 170 THEN 'high' WHEN score >= 110 THEN 'medium' ELSE 'low' END AS confidence, 'index' AS source
FROM (SELECT *, row_number() OVER (PARTITION BY src, call_ord, cand_id ORDER BY score DESC) AS rn FROM rated) q WHERE rn = 1""",
    "pool": "SELECT * FROM (SELECT *, bool_or(cand_container IS NOT NULL) OVER (PARTITION BY src, call_ord) AS boxed FROM {cands}) q WHERE kind <> 'member' OR NOT boxed OR cand_container IS NOT NULL",
    "chosen": """SELECT * EXCLUDE (rank, best), row_number() OVER (PARTITION BY src, call_ord ORDER BY score DESC, cand_path, cand_name, cand_id NULLS LAST) AS target_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY src, call_ord ORDER BY score DESC, cand_path, cand_name, cand_id NULLS LAST) AS rank,
         max(score) OVER (PARTITION BY src, call_ord) AS best FROM pool) q
WHERE rank = 1 OR (score >= best - 25 AND confidence IN ('medium', 'high'))
QUALIFY target_ord <= 3""",
    "resolved": """SELECT s.src, s.call_ord, s.call_name, s.kind, s.receiver, t.best_id, coalesce(t.n, 0) AS n_targets, coalesce(t.n, 0) > 1 AS polymorphic, t.best_id IS NULL AS unresolved
FROM sites s LEFT JOIN (SELECT src, call_ord, count(*) AS n, arg_min(cand_id, target_ord) FILTER (target_ord = 1) AS best_id FROM chosen GROUP BY src, call_ord) t ON t.src = s.src AND t.call_ord = s.call_ord""",
    "res_edges": "SELECT DISTINCT src, cand_id AS dst FROM chosen WHERE cand_id IS NOT NULL",
    "outside": """SELECT x.src, d.symbol_id AS cand_id, coalesce(d.name, x.name) AS cand_name, x.path AS cand_path, d.container AS cand_container,
   CASE WHEN d.symbol_id IS NULL THEN 'lsp' ELSE 'mixed(index+lsp)' END AS source,
   CASE WHEN d.symbol_id IS NULL THEN 140 + CASE WHEN s.relpath = x.path THEN 10 ELSE 0 END ELSE 165 + CASE WHEN s.relpath = x.path THEN 20 ELSE 0 END END AS score
FROM fx_external x JOIN fx_symbols s ON s.symbol_id = x.src
LEFT JOIN fx_symbols d ON d.relpath = x.path AND (d.name = x.name OR d.short_name = x.name OR ends_with(d.name, concat('.', x.name)) OR ends_with(x.name, concat('.', d.name)))""",
    "merged_rows": """SELECT src, call_ord, call_name, raw, kind, receiver, cand_id, cand_name, cand_path, cand_container, source, score, 0 AS turn FROM cands
UNION ALL SELECT c.src, c.call_ord, c.call_name, c.raw, c.kind, c.receiver, o.cand_id, o.cand_name, o.cand_path, o.cand_container, o.source, o.score, 1 FROM outside o JOIN sites c ON c.src = o.src
  AND (c.call_name = o.cand_name OR ends_with(o.cand_name, concat('.', c.call_name)) OR ends_with(c.call_name, concat('.', o.cand_name)))""",
    "merged": """SELECT src, call_ord, call_name, raw, kind, receiver, cand_id, cand_name, cand_path, arg_max(cand_container, score) AS cand_container,
   CASE WHEN min(turn) <> max(turn) THEN 'mixed(index+lsp)' ELSE min(source) END AS source, max(score) AS score,
   CASE WHEN max(score) >= 170 THEN 'high' WHEN max(score) >= 110 THEN 'medium' ELSE 'low' END AS confidence
FROM merged_rows GROUP BY src, call_ord, call_name, raw, kind, receiver, cand_id, cand_name, cand_path""",
    "root_out": "SELECT src AS root FROM {edges} GROUP BY src ORDER BY count(*) DESC, src LIMIT 1",
    "root_in": "SELECT dst AS root FROM fx_edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1",
    "walk": "SELECT root AS id, 0 AS depth FROM root_out UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.id WHERE w.depth < {depth}",
    "drawn": "SELECT v.symbol_id, v.depth, row_number() OVER (ORDER BY v.symbol_id) AS n, row_number() OVER (PARTITION BY v.depth ORDER BY v.symbol_id) AS i, count(*) OVER (PARTITION BY v.depth) AS c, s.name, s.relpath, s.sr, s.sc, s.er, s.ec FROM nodes v JOIN fx_symbols s ON s.symbol_id = v.symbol_id",
    "drawn_edges": "SELECT m.src, m.dst, x.n AS a, y.n AS b, k.k FROM multi m JOIN drawn x ON x.symbol_id = m.src JOIN drawn y ON y.symbol_id = m.dst, LATERAL (SELECT unnest(generate_series(1, m.multiplicity)) AS k) k",
    "chain_rows": """SELECT w.root, w.pos - 1 AS pos, w.symbol_id, h.score, w.bottleneck FROM (
  SELECT r.root, r.pos, r.symbol_id, min(coalesce(h.score, 0)) OVER (PARTITION BY r.root) AS bottleneck FROM (
    SELECT root, unnest(path) AS symbol_id, generate_subscripts(path, 1) AS pos FROM (SELECT root, arg_max(path, len(path)) AS path FROM chain GROUP BY root) l) r LEFT JOIN hot h ON h.symbol_id = r.symbol_id) w JOIN hot h ON h.symbol_id = w.symbol_id""",
    "inner_edges": "SELECT e.src, e.dst FROM fx_edges e JOIN fx_symbols s ON s.symbol_id = e.dst WHERE starts_with(s.relpath, 'ui/') OR starts_with(s.relpath, 'service/')",
    "wander": "SELECT root AS id, 0 AS depth FROM root_out UNION SELECT e.dst, w.depth + 1 FROM wander w JOIN inner_edges e ON e.src = w.id WHERE w.depth < 3",
    "nodes": "SELECT id AS symbol_id, min(depth) AS depth FROM walk GROUP BY id",
    "multi": "SELECT e.src, e.dst, w.n AS multiplicity FROM {edges} e JOIN (SELECT id, count(*) AS n FROM walk WHERE depth < {depth} GROUP BY id) w ON w.id = e.src",
    "notes": """SELECT t.src, t.cand_id AS dst, count(*) AS n_calls, string_agg(t.call_name, ',' ORDER BY t.call_ord) AS calls
FROM (SELECT *, count(*) OVER (PARTITION BY src, call_ord) AS n FROM chosen) t
WHERE n > 1 AND t.src IN (SELECT symbol_id FROM nodes) AND t.cand_id IN (SELECT symbol_id FROM nodes) GROUP BY t.src, t.cand_id""",
    "up": "SELECT root AS id, 0 AS depth FROM root_in UNION SELECT e.src, u.depth + 1 FROM up u JOIN fx_edges e ON e.dst = u.id WHERE u.depth < 8",
    "callers": "SELECT id AS symbol_id, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY id",
    "ahead": "SELECT symbol_id AS root, symbol_id AS id, 0 AS depth FROM fx_symbols UNION SELECT a.root, e.dst, a.depth + 1 FROM ahead a JOIN fx_edges e ON e.src = a.id WHERE a.depth < 4",
    "back": "SELECT symbol_id AS root, symbol_id AS id, 0 AS depth FROM fx_symbols UNION SELECT a.root, e.src, a.depth + 1 FROM back a JOIN fx_edges e ON e.dst = a.id WHERE a.depth < 4",
    "reach": """SELECT s.symbol_id, coalesce(o.n, 0) AS out_reach, coalesce(i.n, 0) AS in_reach FROM fx_symbols s
LEFT JOIN (SELECT root, count(DISTINCT id) AS n FROM ahead WHERE id <> root GROUP BY root) o ON o.root = s.symbol_id
LEFT JOIN (SELECT root, count(DISTINCT id) AS n FROM back WHERE id <> root GROUP BY root) i ON i.root = s.symbol_id""",
    "recent": "SELECT * FROM fx_commits WHERE NOT is_merge ORDER BY date DESC, hash DESC LIMIT {commits}",
    "recent_files": "SELECT f.* FROM fx_files f WHERE f.hash IN (SELECT hash FROM recent)",
    "churn": "SELECT path, CAST(sum(added + deleted) AS BIGINT) AS churn, count(*) AS touches FROM recent_files GROUP BY path",
    "touched": "SELECT DISTINCT f.hash, s.symbol_id FROM recent_files f JOIN fx_symbols s ON s.relpath = f.path",
    "hot": """SELECT s.symbol_id, s.label, s.name, s.relpath, d.in_degree, d.out_degree, least(d.in_degree, d.out_degree) AS balance, r.out_reach, r.in_reach, r.out_reach + r.in_reach AS reach, coalesce(c.churn, 0) AS churn,
   round(d.in_degree * 2.2::DOUBLE + d.out_degree * 1.6::DOUBLE + least(d.in_degree, d.out_degree) * 2.4::DOUBLE + (r.out_reach + r.in_reach) * 1.1::DOUBLE + coalesce(c.churn, 0) * 0.15::DOUBLE, 9) AS score
FROM fx_symbols s JOIN deg d USING (symbol_id) JOIN reach r USING (symbol_id) LEFT JOIN churn c ON c.path = s.relpath WHERE NOT s.is_test""",
    "hot_top": "SELECT *, row_number() OVER (ORDER BY score DESC, reach DESC, label, symbol_id) AS rank FROM hot QUALIFY rank <= 10",
    "chain": """SELECT symbol_id AS root, symbol_id AS at, [symbol_id] AS path FROM hot_top WHERE rank <= 5
UNION ALL SELECT root, next, list_append(path, next) FROM (
  SELECT c.root, e.dst AS next, c.path, row_number() OVER (PARTITION BY c.root ORDER BY coalesce(h.score, 0) DESC, e.dst) AS rn
  FROM chain c JOIN fx_edges e ON e.src = c.at LEFT JOIN hot h ON h.symbol_id = e.dst WHERE len(c.path) < 5 AND NOT list_contains(c.path, e.dst)) q WHERE rn = 1""",
    "calm": "SELECT * FROM fx_symbols WHERE NOT is_test",
    "calm_edges": "SELECT e.src, e.dst FROM fx_edges e WHERE e.src IN (SELECT symbol_id FROM calm) AND e.dst IN (SELECT symbol_id FROM calm)",
    "closure": "SELECT src, dst FROM calm_edges UNION SELECT c.src, e.dst FROM closure c JOIN calm_edges e ON e.src = c.dst",
    "comp": """SELECT s.symbol_id, least(s.symbol_id, coalesce(min(m.dst), s.symbol_id)) AS scc_id FROM calm s
LEFT JOIN (SELECT a.src, a.dst FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src) m ON m.src = s.symbol_id GROUP BY s.symbol_id""",
    "comps": """SELECT c.scc_id, count(*) AS size, coalesce(any_value(e.n), 0) AS edge_count, coalesce(any_value(e.n), 0) / greatest(1, count(*) * (count(*) - 1))::DOUBLE AS density, count(*) > 1 AS has_cycle
FROM comp c LEFT JOIN (SELECT a.scc_id, count(*) AS n FROM calm_edges e JOIN comp a ON a.symbol_id = e.src JOIN comp b ON b.symbol_id = e.dst WHERE a.scc_id = b.scc_id GROUP BY a.scc_id) e ON e.scc_id = c.scc_id GROUP BY c.scc_id""",
    "cx": """SELECT s.symbol_id, s.label, s.name, d.in_degree, d.out_degree, least(d.in_degree, d.out_degree) AS bridge, k.scc_id, k.size AS scc_size, k.has_cycle AS in_cycle,
   round(CASE WHEN k.has_cycle THEN 12.0::DOUBLE ELSE 0 END + (d.in_degree + d.out_degree) + least(d.in_degree, d.out_degree) * 1.5::DOUBLE + (k.size - 1) * 0.7::DOUBLE, 9) AS score
FROM calm s JOIN deg d USING (symbol_id) JOIN comp c USING (symbol_id) JOIN comps k ON k.scc_id = c.scc_id""",
    "cx_top": "SELECT *, row_number() OVER (ORDER BY score DESC, label, symbol_id) AS rank, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 45 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS severity FROM cx QUALIFY rank <= 15",
    "clusters": """SELECT s.module_id, count(*) AS symbols, coalesce(any_value(e.n), 0) AS edges, coalesce(any_value(e.n), 0) / greatest(1, count(*) * (count(*) - 1))::DOUBLE AS density
FROM calm s LEFT JOIN (SELECT a.module_id, count(*) AS n FROM calm_edges e JOIN calm a ON a.symbol_id = e.src GROUP BY a.module_id) e ON e.module_id = s.module_id GROUP BY s.module_id""",
    "structure": """SELECT a.average, c.cyclic_sccs, c.largest_cycle, m.max_density, a.average + 0.8::DOUBLE * c.cyclic_sccs + 12 * m.max_density AS structural_score
FROM (SELECT avg(score) AS average FROM cx) a, (SELECT count(*) FILTER (has_cycle) AS cyclic_sccs, max(size) FILTER (has_cycle) AS largest_cycle FROM comps) c, (SELECT max(density) AS max_density FROM clusters) m""",
    "placed_all": """SELECT symbol_id, sym_ord, relpath, CASE
   WHEN split_part(relpath, '/', 1) IN ('tests', 'test', 'spec') THEN 'test' WHEN split_part(relpath, '/', 1) = 'lua' THEN 'core' WHEN split_part(relpath, '/', 1) = 'playground' THEN 'application'
   WHEN regexp_matches(lower(module_id), '[.]tests?[.]') OR regexp_matches(lower(module_id), '[.]spec[.]') THEN 'test'
   WHEN list_has_any(w, ['ui', 'view', 'views', 'controller', 'controllers', 'handler', 'handlers', 'api', 'cli', 'window', 'render']) THEN 'interface'
   WHEN list_has_any(w, ['app', 'application', 'service', 'services', 'usecase', 'usecases', 'workflow', 'orchestrator']) THEN 'application'
   WHEN list_has_any(w, ['domain', 'model', 'models', 'entity', 'entities', 'core', 'graph', 'analysis', 'knowledge']) THEN 'domain'
   WHEN list_has_any(w, ['infra', 'infrastructure', 'repo', 'repository', 'gateway', 'adapter', 'adapters', 'storage', 'db', 'client', 'lsp']) THEN 'infrastructure' ELSE 'core' END AS layer,
   split_part(lower(relpath), '/', 2) AS domain
FROM (SELECT *, regexp_extract_all(lower(concat(module_id, ' ', relpath)), '[a-z0-9_-]+') AS w FROM fx_symbols) q""",
    "placed": "SELECT *, concat(layer, ':', domain) AS group_id FROM placed_all WHERE layer <> 'test'",
    "group_pairs": """SELECT a.group_id AS source_group, b.group_id AS target_group, a.layer AS source_layer, b.layer AS target_layer, e.src, e.dst,
   row_number() OVER (PARTITION BY a.group_id, b.group_id ORDER BY e.src, e.dst) AS n FROM fx_edges e JOIN placed a ON a.symbol_id = e.src JOIN placed b ON b.symbol_id = e.dst""",
    "group_edges": "SELECT source_group, target_group, source_layer, target_layer, count(*) AS count FROM group_pairs GROUP BY ALL",
    "rules": """SELECT * FROM (VALUES ('interface', 'interface'), ('interface', 'application'), ('interface', 'domain'), ('interface', 'shared'), ('application', 'application'), ('application', 'domain'), ('application', 'shared'),
  ('domain', 'domain'), ('domain', 'shared'), ('infrastructure', 'infrastructure'), ('infrastructure', 'domain'), ('infrastructure', 'shared'), ('core', 'core'), ('core', 'interface'), ('core', 'application'), ('core', 'domain'), ('core', 'infrastructure'), ('core', 'shared')) r(a, b)""",
    "heights": "SELECT * FROM (VALUES ('interface', 5), ('application', 4), ('core', 4), ('domain', 3), ('infrastructure', 2), ('test', 1)) h(layer, height)",
    "bad": """SELECT *, CASE WHEN severity_score >= 90 THEN 'critical' WHEN severity_score >= 70 THEN 'high' WHEN severity_score >= 55 THEN 'medium' ELSE 'low' END AS severity FROM (
  SELECT g.*, CAST(35 + 14 * abs(x.height - y.height) + 2 * least(25, g.count) + CASE WHEN x.height > y.height THEN 12 ELSE 0 END AS DOUBLE) AS severity_score
  FROM group_edges g JOIN heights x ON x.layer = g.source_layer JOIN heights y ON y.layer = g.target_layer
  WHERE g.source_layer <> g.target_layer AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.a = g.source_layer AND r.b = g.target_layer)) q""",
    "hits": """SELECT id, count(*) AS n FROM (SELECT unnest([p.src, p.dst]) AS id FROM group_pairs p JOIN bad b ON b.source_group = p.source_group AND b.target_group = p.target_group WHERE p.n <= 8) q GROUP BY id""",
    "risk": """SELECT s.symbol_id, s.label, s.name, s.relpath, s.module_id, s.package_id, h.score AS hot_score, c.score AS complexity_score, coalesce(a.n, 0) AS architecture_hits, coalesce(u.churn, 0) AS churn,
   round(CASE WHEN m.hot > 0 THEN h.score / m.hot ELSE 0 END * 1.3::DOUBLE + CASE WHEN m.cx > 0 THEN c.score / m.cx ELSE 0 END * 1.1::DOUBLE + coalesce(a.n, 0) * 1.6::DOUBLE + CASE WHEN m.churn > 0 THEN coalesce(u.churn, 0) / m.churn::DOUBLE ELSE 0 END * 0.35::DOUBLE, 9) AS score
FROM calm s JOIN hot h USING (symbol_id) JOIN cx c USING (symbol_id) LEFT JOIN hits a ON a.id = s.symbol_id LEFT JOIN churn u ON u.path = s.relpath,
  (SELECT (SELECT max(score) FROM hot) AS hot, (SELECT max(score) FROM cx) AS cx, (SELECT max(churn) FROM churn WHERE path IN (SELECT relpath FROM fx_symbols)) AS churn) m""",
    "risk_top": "SELECT *, row_number() OVER (ORDER BY score DESC, label, symbol_id) AS rank, CASE WHEN score >= 2.2 THEN 'critical' WHEN score >= 1.4 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS severity FROM risk QUALIFY rank <= 20",
    "tok": """SELECT DISTINCT relpath, unnest(list_concat(regexp_extract_all(content, 'require[ \\t]*\\([ \\t]*["'']([^"'']+)["''][ \\t]*\\)', 1), regexp_extract_all(content, 'require[ \\t]+["'']([^"'']+)["'']', 1))) AS token FROM fx_sources""",
    "tok_files": """SELECT relpath AS src, coalesce(min(CASE WHEN pos = 1 THEN target END), min(CASE WHEN pos = 2 THEN target END)) AS dst FROM (
  SELECT t.relpath, t.token, c.pos, trim(regexp_replace(c.target, '/+', '/', 'g'), '/') AS target FROM tok t, LATERAL (SELECT 1 AS pos, concat(replace(t.token, '.', '/'), '.lua') AS target UNION ALL SELECT 2, concat(replace(t.token, '.', '/'), '/init.lua')) c WHERE NOT starts_with(t.token, '.')) q
WHERE target IN (SELECT relpath FROM fx_sources) GROUP BY relpath, token""",
    "imp": "SELECT DISTINCT src, dst FROM tok_files",
    "lookup": """SELECT t.src, t.cand_id AS dst, arg_max(t.source, t.call_ord) AS source_backend, arg_max(t.confidence, t.call_ord) AS confidence, arg_max(r.polymorphic, t.call_ord) AS polymorphic, arg_max(t.call_name, t.call_ord) AS call
FROM chosen t JOIN resolved r ON r.src = t.src AND r.call_ord = t.call_ord WHERE t.cand_id IS NOT NULL GROUP BY t.src, t.cand_id""",
    "kg_records": """SELECT 'defines' AS type, concat('file:', relpath) AS source, concat('fn:', symbol_id) AS target FROM fx_symbols
UNION ALL SELECT 'belongs_to_module', concat('fn:', symbol_id), concat('module:', module_id) FROM fx_symbols
UNION ALL SELECT 'belongs_to_package', concat('fn:', symbol_id), concat('package:', package_id) FROM fx_symbols
UNION ALL SELECT 'contains_module', concat('package:', package_id), concat('module:', module_id) FROM fx_symbols
UNION ALL SELECT 'defines_type', concat('file:', relpath), concat('type:', relpath, ':', container) FROM fx_symbols WHERE container IS NOT NULL
UNION ALL SELECT 'belongs_to_type', concat('fn:', symbol_id), concat('type:', relpath, ':', container) FROM fx_symbols WHERE container IS NOT NULL
UNION ALL SELECT 'test_covers', concat('test:', symbol_id), concat('fn:', symbol_id) FROM fx_symbols WHERE is_test
UNION ALL SELECT CASE WHEN s.is_test THEN 'tests' ELSE 'calls' END, concat('fn:', e.src), concat('fn:', e.dst) FROM res_edges e JOIN fx_symbols s ON s.symbol_id = e.src
UNION ALL SELECT DISTINCT 'calls_external', concat('fn:', src), concat('fn_external:', cand_path, ':', cand_name) FROM merged WHERE cand_id IS NULL
UNION ALL SELECT 'imports', concat('file:', src), concat('file:', dst) FROM imp""",
    "kg_node_rows": """SELECT concat('fn:', symbol_id) AS id, 'function' AS type, name AS label, relpath, module_id, package_id, CAST(NULL AS BOOLEAN) AS external FROM fx_symbols
UNION SELECT concat('file:', relpath), 'file', relpath, relpath, NULL, NULL, NULL FROM fx_symbols
UNION SELECT concat('module:', module_id), 'module', module_id, NULL, NULL, NULL, NULL FROM fx_symbols
UNION SELECT concat('package:', package_id), 'package', package_id, NULL, NULL, NULL, NULL FROM fx_symbols
UNION SELECT concat('type:', relpath, ':', container), 'type', container, relpath, module_id, package_id, NULL FROM fx_symbols WHERE container IS NOT NULL
UNION SELECT concat('test:', symbol_id), 'test', name, relpath, NULL, NULL, NULL FROM fx_symbols WHERE is_test
UNION SELECT concat('fn_external:', cand_path, ':', cand_name), 'function', cand_name, cand_path, NULL, NULL, true FROM merged WHERE cand_id IS NULL
UNION SELECT concat('file:', f), 'file', f, NULL, NULL, NULL, NULL FROM (SELECT src AS f FROM imp UNION SELECT dst FROM imp) q WHERE f NOT IN (SELECT relpath FROM fx_symbols)""",
}

PARTS["kg_edge_rows"] = """SELECT DISTINCT r.type, r.source, r.target,
  CASE WHEN r.type IN ('calls', 'tests') THEN coalesce(l.source_backend, 'index') WHEN r.type = 'imports' THEN 'index' ELSE o.source END AS source_backend,
  CASE WHEN r.type IN ('calls', 'tests') THEN coalesce(l.confidence, 'unknown') WHEN r.type = 'imports' THEN 'high' ELSE o.confidence END AS confidence,
  CASE WHEN r.type IN ('calls', 'tests') THEN coalesce(l.polymorphic, false) END AS dynamic, CASE WHEN r.type IN ('calls', 'tests') THEN coalesce(l.polymorphic, false) END AS polymorphic, coalesce(l.call, o.call) AS call, CASE WHEN r.type = 'calls_external' THEN TRUE END AS external
FROM kg_records r LEFT JOIN lookup l ON r.type IN ('calls', 'tests') AND r.source = concat('fn:', l.src) AND r.target = concat('fn:', l.dst)
LEFT JOIN (SELECT src, cand_path, cand_name, arg_min(source, call_ord) AS source, arg_min(confidence, call_ord) AS confidence, arg_min(call_name, call_ord) AS call FROM merged WHERE cand_id IS NULL GROUP BY ALL) o
  ON r.type = 'calls_external' AND r.source = concat('fn:', o.src) AND r.target = concat('fn_external:', o.cand_path, ':', o.cand_name)"""
RESOLVE = ["parsed", "sites", "aliases", "matches", "scored", "rated", "cands", "pool", "chosen", "resolved", "res_edges"]
MERGE = ["parsed", "sites", "aliases", "matches", "scored", "rated", "cands", "outside", "merged_rows", "merged", "pool", "chosen", "resolved", "res_edges"]
HOT = ["deg", "ahead", "back", "reach", "recent", "recent_files", "churn", "hot", "hot_top"]
CX = ["deg", "calm", "calm_edges", "closure", "comp", "comps", "cx", "cx_top"]
ARCH = ["placed_all", "placed", "group_pairs", "group_edges", "rules", "heights", "bad"]
RISK = [*HOT, *CX[1:], *ARCH, "hits", "risk", "risk_top"]
KG = [*MERGE, "lookup", "tok", "tok_files", "imp", "kg_records", "kg_node_rows"]
_SEV = "CASE WHEN {0} >= 70 THEN 'critical' WHEN {0} >= 45 THEN 'high' WHEN {0} >= 25 THEN 'medium' ELSE 'low' END"


_BY = "SELECT row_number() OVER (ORDER BY round(a, 9) DESC, round(t, 9) DESC, id) AS rank, id, round(t, 6) AS score, count, round(a, 6) AS avg_score FROM (SELECT {} AS id, sum(score) AS t, count(*) AS count, avg(score) AS a FROM risk GROUP BY id) q"
#: Queries through the facade, and the queries whose results they must have.
SAME = {
    "api_build": "extract_functions", "api_run": "resolved_call_edges", "api_project_graph": "edge_annotations", "api_module_graph": "module_edges", "api_package_graph": "package_edges",
    "api_import_graph": "import_edges", "api_dead_code": "dead_code", "api_impact": "impact_transitive", "api_hot_path": "hot_path_report", "api_complexity": "complexity_report",
    "api_architecture": "arch_violations", "api_evolution": "evolution_totals", "api_risk_map": "risk_map", "api_viewer": "viewer_query",
}


def _json_parts(select: str) -> str:
    """``json_part(name, value)`` written out: a member of an object, nothing for a null."""
    return re.sub(r"json_part\('(\w+)', ([^()]+)\)", r"""CASE WHEN \2 IS NOT NULL THEN concat(',"\1":"', \2, '"') END""", select)


def _sql(parts: list[str], select: str, **values) -> str:
    select = _json_parts(select)
    values = {"edges": "fx_edges", "cands": "cands", "depth": 2, "commits": 60} | values
    tables = "".join(f",\n{p} AS ({PARTS[p].format(**values) if '{' in PARTS[p] else PARTS[p]})" for p in parts)
    return f"WITH RECURSIVE {oracle_views()}{tables}\n{select}"


def build() -> dict[str, str]:
    log = "(" + LOG.format(fx_commits="fx_commits", fx_files="fx_files") + ")"
    reached = "SELECT root AS id FROM root_out UNION SELECT m.dst FROM alive a JOIN kept m ON m.src = a.id"
    keep = "SELECT symbol_id FROM nodes WHERE symbol_id IN (SELECT symbol_id FROM fx_symbols WHERE {where}) UNION SELECT root FROM root_out"
    PARTS["keep_fn"] = keep.format(where="lower(symbol_kind) = 'function'")
    PARTS["keep_view"] = keep.format(where="lower(symbol_kind) = 'function' AND contains(lower(concat(name, ' ', relpath)), 'brand')")
    PARTS["kept_fn"] = "SELECT * FROM multi WHERE src IN (SELECT symbol_id FROM keep_fn) AND dst IN (SELECT symbol_id FROM keep_fn)"
    PARTS["kept_view"] = "SELECT * FROM multi WHERE src IN (SELECT symbol_id FROM keep_view) AND dst IN (SELECT symbol_id FROM keep_view)"
    PARTS["alive_fn"] = reached.replace("alive", "alive_fn").replace("kept", "kept_fn")
    PARTS["alive_view"] = reached.replace("alive", "alive_view").replace("kept", "kept_view")
    around = ["root_out", "walk", "nodes", "multi"]
    out = {
        "module_package_ids": _sql([], "SELECT symbol_id, module_id, package_id FROM fx_symbols"),
        "test_symbol_flags": _sql([], "SELECT symbol_id, is_test FROM fx_symbols"),
        "entrypoint_flags": _sql([], "SELECT symbol_id, lower(short_name) IN ('main', 'init', 'setup', 'run', 'm.run') AS is_entrypoint, concat(sr + 1, ':', sc + 1, '-', er + 1, ':', ec) AS range_label, label, 'lua' AS lang FROM fx_symbols"),
        "call_parse": _sql(["parsed"], "SELECT src, call_ord, raw, receiver, call_name, kind, receiver_tail FROM parsed"),
        "symbol_at": _sql([], """SELECT relpath, "row", col, symbol_id FROM (
  SELECT p.relpath, p."row", p.col, s.symbol_id, row_number() OVER (PARTITION BY p.relpath, p."row", p.col ORDER BY (s.er - s.sr) * 10000 + s.ec - s.sc, s.sym_ord) AS n
  FROM (SELECT DISTINCT relpath, sr + 3 AS "row", 0 AS col FROM fx_symbols) p JOIN fx_symbols s ON s.relpath = p.relpath
   AND (p."row" > s.sr OR (p."row" = s.sr AND p.col >= s.sc)) AND (p."row" < s.er OR (p."row" = s.er AND p.col < s.ec))) q WHERE n = 1"""),
        "local_graph": _sql(["parsed", "sites"], """SELECT DISTINCT relpath, src_name, dst_name FROM (
  SELECT s.relpath, s.name AS src_name, s.symbol_id, c.call_name, arg_min(d.name, d.sym_ord) AS dst_name FROM sites c JOIN fx_symbols s ON s.symbol_id = c.src
  JOIN fx_symbols d ON d.relpath = s.relpath AND (d.name = c.call_name OR d.short_name = c.call_name) GROUP BY ALL) q"""),
        "degree_hotspots": _sql(["deg"], "SELECT row_number() OVER (ORDER BY score DESC, symbol_id) AS rank, * FROM (SELECT symbol_id, in_degree, out_degree, round(in_degree * 2.2::DOUBLE + out_degree * 1.6::DOUBLE + least(in_degree, out_degree) * 2.4::DOUBLE, 6) AS score FROM deg) q ORDER BY score DESC, symbol_id LIMIT 10"),
        "reverse_edges": _sql([], "SELECT dst AS src, src AS dst FROM fx_edges"),
        "dead_code": _sql([], "SELECT row_number() OVER (ORDER BY relpath, name, symbol_id) AS rank, symbol_id, relpath, name FROM fx_symbols WHERE NOT is_test AND NOT is_entry AND symbol_id NOT IN (SELECT dst FROM fx_edges)"),
        "module_edges": _sql(["mod_edges"], "SELECT src, dst FROM mod_edges"),
        "package_edges": _sql([], "SELECT DISTINCT a.package_id AS src, b.package_id AS dst FROM fx_edges e JOIN fx_symbols a ON a.symbol_id = e.src JOIN fx_symbols b ON b.symbol_id = e.dst"),
        "module_edge_summary": _sql(["mod_edges"], """SELECT s.module_id, arg_min(s.symbol_id, s.sym_ord) AS target, count(*) AS symbols, coalesce(any_value(o.n), 0) AS n_out, coalesce(any_value(i.n), 0) AS n_in
FROM fx_symbols s LEFT JOIN (SELECT src, count(*) AS n FROM mod_edges GROUP BY src) o ON o.src = s.module_id LEFT JOIN (SELECT dst, count(*) AS n FROM mod_edges GROUP BY dst) i ON i.dst = s.module_id GROUP BY s.module_id"""),
        "resolve_candidates": _sql(RESOLVE[:7], """SELECT src, call_ord, cand_id, score, confidence, concat_ws(',', CASE WHEN exact THEN 'exact' ELSE 'suffix' END, CASE WHEN same_file THEN 'same_file' ELSE 'cross_file' END,
  CASE WHEN member AND cand_container IS NOT NULL THEN 'member_target' END,
  CASE WHEN NOT member THEN NULL WHEN rt IS NOT NULL AND cand_container IS NOT NULL THEN CASE WHEN rt = cand_container THEN 'receiver_type_match' ELSE 'receiver_type_mismatch' END WHEN receiver_tail = cand_container THEN 'receiver_name_match' END) AS reasons FROM cands"""),
        "resolve_targets": _sql(RESOLVE[:9], "SELECT src, call_ord, target_ord, cand_id, score, confidence FROM chosen"),
        "call_resolutions": _sql(RESOLVE, "SELECT src, call_ord, call_name, kind, receiver, best_id, n_targets, polymorphic, polymorphic AS dynamic, unresolved FROM resolved"),
        "polymorphic_calls": _sql(RESOLVE, "SELECT src, call_ord, call_name, n_targets FROM resolved WHERE polymorphic"),
        "unresolved_calls": _sql(RESOLVE, "SELECT count(*) FILTER (unresolved) AS unresolved_count, count(*) AS call_sites FROM resolved"),
        "resolved_call_edges": _sql(RESOLVE, "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o, t) AS edge_ord FROM (SELECT src, cand_id AS dst, min(call_ord) AS o, arg_min(target_ord, call_ord) AS t FROM chosen WHERE cand_id IS NOT NULL GROUP BY src, cand_id) q"),
        "external_merge": _sql(MERGE, "SELECT src, call_ord, target_ord, cand_id, cand_name, cand_path, source, score, confidence FROM chosen", cands="merged"),
        "subgraph_nodes": _sql(around, "SELECT symbol_id, depth FROM nodes"),
        "subgraph_edges_multiset": _sql(around, "SELECT src, dst, multiplicity FROM multi", depth=4),
        "edge_annotations": _sql([*RESOLVE, *around, "notes"], "SELECT src, dst, n_calls, calls FROM notes", edges="res_edges"),
        "dep_subgraph": _sql(["mod_edges", *around], "SELECT m.src, m.dst, m.multiplicity, n.depth AS src_depth FROM multi m JOIN nodes n ON n.symbol_id = m.src", edges="mod_edges"),
        "filtered_subgraph": _sql([*around, "keep_fn", "kept_fn", "alive_fn"], "SELECT src, dst, multiplicity FROM kept_fn WHERE src IN (SELECT id FROM alive_fn)", depth=3),
        "dynamic_only_subgraph": _sql([*RESOLVE, *around, "notes"], "SELECT m.src, m.dst, m.multiplicity FROM multi m JOIN notes n ON n.src = m.src AND n.dst = m.dst", edges="res_edges"),
        "call_hierarchy": _sql(["root_out", "inner_edges", "wander"], "SELECT e.src, e.dst, w.depth AS src_depth FROM inner_edges e JOIN (SELECT id, min(depth) AS depth FROM wander GROUP BY id) w ON w.id = e.src WHERE w.depth < 3"),
        "viewer_query": _sql([*around, "keep_view", "kept_view", "alive_view"], "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM alive_view) AS hidden_nodes", depth=4),
        "impact_transitive": _sql(["root_in", "up", "callers"], "SELECT symbol_id, depth FROM callers"),
        "impact_direct": _sql(["root_in", "up", "callers"], "SELECT row_number() OVER (ORDER BY s.name, s.relpath, symbol_id) AS rank, symbol_id, s.name, s.relpath FROM callers c JOIN fx_symbols s USING (symbol_id) WHERE c.depth = 1"),
        "impact_modules": _sql(["root_in", "up", "callers"], "SELECT s.module_id, s.package_id, count(*) AS symbols FROM callers c JOIN fx_symbols s USING (symbol_id) GROUP BY ALL"),
        "impact_tests": _sql(["root_in", "up", "callers"], "SELECT row_number() OVER (ORDER BY name, relpath, symbol_id) AS rank, * FROM (SELECT symbol_id, s.name, replace(s.relpath, 'm3.lua', 'm3_test.lua') AS relpath FROM callers c JOIN fx_symbols s USING (symbol_id) WHERE s.is_test OR ends_with(s.relpath, 'm3.lua')) q"),
        "reach_counts": _sql(["ahead", "back", "reach"], "SELECT symbol_id, out_reach, in_reach FROM reach"),
        "file_churn": _sql(["recent", "recent_files", "churn"], "SELECT path, churn, touches FROM churn"),
        "file_hotspots": _sql(["recent", "recent_files", "churn"], "SELECT path, churn, touches, row_number() OVER (ORDER BY churn DESC, touches DESC, path) AS rank FROM churn QUALIFY rank <= 10"),
        "commit_timeline": _sql(["recent", "recent_files", "touched"], """SELECT row_number() OVER (ORDER BY c.date, c.hash) AS rank, c.hash, substr(CAST(c.hash AS VARCHAR), 1, 8) AS short_hash, c.date, coalesce(f.n, 0) AS files_count, coalesce(f.a, 0) AS insertions, coalesce(f.d, 0) AS deletions, coalesce(f.a, 0) + coalesce(f.d, 0) AS churn,
  coalesce(t.n, 0) AS touched_symbols, coalesce(e.n, 0) AS touched_edges, f.paths AS changed_files FROM recent c
LEFT JOIN (SELECT hash, count(*) AS n, CAST(sum(added) AS BIGINT) AS a, CAST(sum(deleted) AS BIGINT) AS d, string_agg(path, ',' ORDER BY path) AS paths FROM recent_files GROUP BY hash) f ON f.hash = c.hash
LEFT JOIN (SELECT hash, count(*) AS n FROM touched GROUP BY hash) t ON t.hash = c.hash
LEFT JOIN (SELECT hash, count(*) AS n FROM (SELECT DISTINCT t.hash, e.src, e.dst FROM touched t JOIN fx_edges e ON e.src = t.symbol_id OR e.dst = t.symbol_id) q GROUP BY hash) e ON e.hash = c.hash""", commits=30),
        "symbol_hotspots": _sql(["recent", "recent_files", "touched"], """SELECT q.symbol_id, touches, churn, s.name, s.relpath, row_number() OVER (ORDER BY touches DESC, churn DESC, s.name, q.symbol_id) AS rank FROM (
  SELECT t.symbol_id, count(*) AS touches, CAST(sum(w.c) AS BIGINT) AS churn FROM touched t JOIN (SELECT hash, sum(added + deleted) AS c FROM recent_files GROUP BY hash) w ON w.hash = t.hash GROUP BY t.symbol_id) q
JOIN fx_symbols s ON s.symbol_id = q.symbol_id QUALIFY rank <= 10""", commits=30),
        "evolution_totals": _sql(["recent", "recent_files"], "SELECT (SELECT count(*) FROM recent) AS commits, CAST(sum(added) AS BIGINT) AS insertions, CAST(sum(deleted) AS BIGINT) AS deletions, CAST(sum(added) + sum(deleted) AS BIGINT) AS churn FROM recent_files", commits=30),
        "numstat_parse": _sql([], f"""SELECT CAST(c.hash AS VARCHAR) AS hash, c.date, CAST(c.author AS VARCHAR) AS author, concat('change ', c.hash) AS subject, coalesce(f.n, 0) AS files_count, coalesce(f.a, 0) AS insertions, coalesce(f.d, 0) AS deletions
FROM fx_commits c LEFT JOIN (SELECT hash, count(*) AS n, CAST(sum(added) AS BIGINT) AS a, CAST(sum(deleted) AS BIGINT) AS d FROM fx_files GROUP BY hash) f ON f.hash = c.hash WHERE (SELECT count(*) FROM {log} l) > 0"""),
        "numstat_files": _sql([], "SELECT CAST(f.hash AS VARCHAR) AS hash, f.path, f.added, f.deleted FROM fx_files f JOIN fx_commits c ON c.hash = f.hash"),
        "hot_path_report": _sql(HOT, "SELECT rank, symbol_id, label, round(score, 6) AS score, in_degree, out_degree, balance, reach, out_reach, in_reach, churn, concat('fan-in=', in_degree, ' fan-out=', out_degree, ' reach=', reach, ' balance=', balance, ' churn=', churn) AS rationale FROM hot_top"),
        "hot_paths": _sql([*HOT, "chain"], """SELECT w.root, w.pos - 1 AS pos, w.symbol_id, round(h.score, 6) AS score, round(w.bottleneck, 6) AS bottleneck FROM (
  SELECT r.root, r.pos, r.symbol_id, min(coalesce(h.score, 0)) OVER (PARTITION BY r.root) AS bottleneck FROM (
    SELECT root, unnest(path) AS symbol_id, generate_subscripts(path, 1) AS pos FROM (SELECT root, arg_max(path, len(path)) AS path FROM chain GROUP BY root) l) r LEFT JOIN hot h ON h.symbol_id = r.symbol_id) w JOIN hot h ON h.symbol_id = w.symbol_id"""),
        "strong_components": _sql(CX[1:5], "SELECT symbol_id, scc_id FROM comp"),
        "scc_stats": _sql(CX[1:6], """SELECT t.rank, t.scc_id, t.size, t.edge_count, round(t.density, 6) AS density, t.has_cycle, p.preview FROM (SELECT *, row_number() OVER (ORDER BY size DESC, density DESC, scc_id) AS rank FROM comps QUALIFY rank <= 10) t
JOIN (SELECT scc_id, string_agg(name, ', ' ORDER BY symbol_id) AS preview FROM (SELECT c.scc_id, s.symbol_id, s.name, row_number() OVER (PARTITION BY c.scc_id ORDER BY s.symbol_id) AS n FROM comp c JOIN fx_symbols s USING (symbol_id)) q WHERE n <= 4 GROUP BY scc_id) p ON p.scc_id = t.scc_id"""),
        "complexity_report": _sql(CX, "SELECT rank, symbol_id, round(score, 6) AS score, severity, in_degree, out_degree, bridge, scc_size, in_cycle FROM cx_top"),
        "module_clusters": _sql(["calm", "calm_edges", "clusters"], "SELECT row_number() OVER (ORDER BY density DESC, symbols DESC, module_id) AS rank, module_id, symbols, edges, round(density, 6) AS density FROM clusters"),
        "complexity_severity_counts": _sql(CX, "SELECT s.severity, count(b.severity) AS count FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN cx_top b ON b.severity = s.severity GROUP BY s.severity"),
        "structural_score": _sql([*CX, "clusters", "structure"], f"SELECT round(average, 6) AS average, cyclic_sccs, largest_cycle, round(max_density, 6) AS max_density, round(structural_score, 6) AS structural_score, {_SEV.format('structural_score')} AS severity FROM structure"),
        "complexity_suggestions": _sql([*CX, "clusters", "structure"], """SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS ord, suggestion FROM (
  SELECT 1 AS k, CASE WHEN largest_cycle >= 6 THEN printf('Cycle of %d symbols: extract boundaries to break it.', largest_cycle) ELSE 'Small cycles exist: untangle their entry points first.' END AS suggestion FROM structure WHERE cyclic_sccs > 0
  UNION ALL SELECT 2, printf('Dense module (max %.3f): split it or tighten its layering.', max_density) FROM structure WHERE max_density >= 0.35
  UNION ALL SELECT 3, printf('%d hotspot(s) are bridges: add regression tests before changing them.', n) FROM (SELECT count(*) AS n FROM cx_top WHERE bridge >= 6) b WHERE n > 0) q"""),
        "layer_domain": _sql(["placed_all"], "SELECT symbol_id, layer, domain FROM placed_all"),
        "arch_groups": _sql(ARCH[:2], "SELECT group_id, layer, domain, count(*) AS symbol_count, arg_min(symbol_id, sym_ord) AS target FROM placed GROUP BY ALL"),
        "arch_edges": _sql(ARCH[:3], "SELECT source_group, target_group, count(*) AS count, string_agg(CASE WHEN n <= 3 THEN concat(src, '>', dst) END, ',' ORDER BY src, dst) AS examples FROM group_pairs GROUP BY source_group, target_group"),
        "arch_violations": _sql(ARCH, "SELECT row_number() OVER (ORDER BY severity_score DESC, count DESC, source_group, target_group) AS rank, source_group, target_group, source_layer, target_layer, count, severity_score, severity FROM bad"),
        "arch_severity_counts": _sql(ARCH, "SELECT s.severity, count(b.severity) AS count FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN bad b ON b.severity = s.severity GROUP BY s.severity"),
        "risk_map": _sql(RISK, "SELECT rank, symbol_id, round(score, 6) AS score, severity, round(hot_score, 6) AS hot_score, round(complexity_score, 6) AS complexity_score, architecture_hits, churn FROM risk_top"),
        "module_risk": _sql(RISK[:-1], _BY.format("module_id")),
        "package_risk": _sql(RISK[:-1], _BY.format("package_id")),
        "risk_severity_counts": _sql(RISK, "SELECT s.severity, count(b.severity) AS count FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) s(severity) LEFT JOIN risk_top b ON b.severity = s.severity GROUP BY s.severity"),
        "risk_trend": _sql(RISK, """SELECT round(n.avg - o.avg, 6) AS avg_top_score_delta, round(n.top - o.top, 6) AS top1_score_delta, o.n AS top_overlap_count, round(o.n / n.n::DOUBLE, 6) AS top_overlap_ratio
FROM (SELECT avg(score) AS avg, max(score) AS top, count(*) AS n FROM risk_top) n, (SELECT coalesce(avg(score * 0.9::DOUBLE), 0) AS avg, coalesce(max(score * 0.9::DOUBLE), 0) AS top, count(*) AS n FROM risk_top WHERE symbol_id % 2 = 0) o"""),
        "risk_suggestions": _sql(RISK, """SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS ord, suggestion FROM (
  SELECT 1 AS k, printf('%d architecture violation(s): resolve them first.', n) AS suggestion FROM (SELECT count(*) AS n FROM bad) v WHERE n > 0
  UNION ALL SELECT 2, printf('%d top hotspot(s) change often: review them strictly.', n) FROM (SELECT count(*) AS n FROM risk_top WHERE churn >= 400) v WHERE n > 0
  UNION ALL SELECT 3, printf('%d top hotspot(s) take part in violations: clean boundaries first.', n) FROM (SELECT count(*) AS n FROM risk_top WHERE architecture_hits > 0) v WHERE n > 0) q"""),
        "kg_nodes": _sql(KG, "SELECT id, type, label, relpath, module_id, package_id, external FROM kg_node_rows", cands="merged"),
        "kg_edges": _sql([*KG, "kg_edge_rows"], "SELECT * FROM kg_edge_rows", cands="merged"),
        "kg_lines": _sql([*KG, "kg_edge_rows"], """SELECT 0 AS part, '{"record": "meta", "schema_version": "knowledge_graph.v1"}' AS value
UNION ALL SELECT 1, concat('{"record":"node"', json_part('id', k.id), json_part('type', k.type), json_part('label', k.label), json_part('path', k.relpath), json_part('relpath', k.relpath),
  CASE WHEN s.symbol_id IS NOT NULL THEN json_part('lang', 'lua') END, json_part('symbol_kind', s.symbol_kind), json_part('module_id', k.module_id), json_part('package_id', k.package_id), CASE WHEN k.external THEN ',"external":true' END, '}')
  FROM kg_node_rows k LEFT JOIN fx_symbols s ON k.id = concat('fn:', s.symbol_id)
UNION ALL SELECT 2, concat('{"record":"edge"', json_part('type', type), json_part('source', source), json_part('target', target), json_part('source_backend', source_backend), json_part('confidence', confidence),
  CASE WHEN dynamic IS NOT NULL THEN concat(',"dynamic":', dynamic, ',"polymorphic":', polymorphic) END, json_part('call', call), CASE WHEN external THEN ',"external":true' END, '}') FROM kg_edge_rows""", cands="merged"),
        "kg_edge_type_counts": _sql(KG, "SELECT type, count(*) AS attempts, count(DISTINCT concat(source, '|', target)) AS n FROM kg_records GROUP BY type", cands="merged"),
        "kg_counts": _sql(KG, "SELECT concat(type, '_nodes') AS name, count(*) AS n FROM kg_node_rows GROUP BY type UNION ALL SELECT 'total_nodes', count(*) FROM kg_node_rows UNION ALL SELECT 'total_edges', count(*) FROM (SELECT DISTINCT type, source, target FROM kg_records) q", cands="merged"),
        "kg_validation": _sql(KG, "SELECT 'unsupported_schema_version' AS problem, 'knowledge_graph.v0' AS id UNION ALL SELECT 'dangling_source' AS problem, source AS id FROM (SELECT DISTINCT type, source, target FROM kg_records) q WHERE type = 'contains_module' UNION ALL SELECT 'dangling_target', target FROM (SELECT DISTINCT type, source, target FROM kg_records) q WHERE type = 'belongs_to_package'", cands="merged"),
        "import_tokens": _sql(["tok"], "SELECT relpath, token FROM tok"),
        "import_edges": _sql(["tok", "tok_files", "imp"], "SELECT src, dst FROM imp"),
        "import_reverse": _sql(["tok", "tok_files", "imp"], "SELECT dst AS file, count(*) AS importers FROM imp GROUP BY dst"),
        "extract_functions": _sql([], """SELECT relpath, name, short_name, container, 'Function' AS symbol_kind, CAST((n - 1) * 4 AS INTEGER) AS sr, 0 AS sc, CAST((n - 1) * 4 + 3 AS INTEGER) AS er, 3 AS ec
FROM (SELECT *, row_number() OVER (PARTITION BY relpath ORDER BY sym_ord) AS n FROM fx_symbols) q"""),
        "extract_calls": _sql([], "SELECT concat('other.', short_name) AS raw, count(*) AS n FROM fx_symbols GROUP BY short_name"),
        "export_mermaid": _sql(around, """SELECT CAST(row_number() OVER (ORDER BY part, a, b, k) - 1 AS INTEGER) AS line_no, text FROM (
  SELECT 0 AS part, 0 AS a, 0 AS b, 0 AS k, 'flowchart LR' AS text UNION ALL SELECT 1, 0, 0, 0, '%% layout: hierarchical'
  UNION ALL SELECT 2, v.n, 0, 0, concat('  n', v.n, '["', s.name, '<br/>', s.relpath, '"]') FROM (SELECT symbol_id, row_number() OVER (ORDER BY symbol_id) AS n FROM nodes) v JOIN fx_symbols s ON s.symbol_id = v.symbol_id
  UNION ALL SELECT 3, x.n, y.n, k.k, concat('  n', x.n, ' --> n', y.n) FROM multi m JOIN (SELECT symbol_id, row_number() OVER (ORDER BY symbol_id) AS n FROM nodes) x ON x.symbol_id = m.src JOIN (SELECT symbol_id, row_number() OVER (ORDER BY symbol_id) AS n FROM nodes) y ON y.symbol_id = m.dst, LATERAL (SELECT unnest(generate_series(1, m.multiplicity)) AS k) k) q"""),
        "layout_hierarchical": _sql(around, "SELECT symbol_id, depth, CAST(i AS INTEGER) AS layer_index, CAST(depth * 220 AS DOUBLE) AS x, CAST((i - 1) * 90 - (n - 1) * 45 AS DOUBLE) AS y FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY symbol_id) AS i, count(*) OVER (PARTITION BY depth) AS n FROM nodes) q", depth=3),
    }
    out |= {
        "export_dot": _sql([*around, "drawn", "drawn_edges"], r"""SELECT CAST(row_number() OVER (ORDER BY part, a, b, k) - 1 AS INTEGER) AS line_no, text FROM (
  SELECT 0 AS part, 0 AS a, 0 AS b, 0 AS k, 'digraph CodeGraph {' AS text UNION ALL SELECT 1, 0, 0, 0, '  // layout: hierarchical' UNION ALL SELECT 2, 0, 0, 0, '  rankdir=LR;' UNION ALL SELECT 3, 0, 0, 0, '  node [shape=box];'
  UNION ALL SELECT 4, n, 0, 0, concat('  n', n, ' [label="', name, '\\n', relpath, '"];') FROM drawn
  UNION ALL SELECT 5, depth, 0, 0, concat('  { rank=same; ', string_agg(concat('n', n), '; ' ORDER BY i), '; }') FROM drawn GROUP BY depth HAVING count(*) > 1
  UNION ALL SELECT 6, a, b, k, concat('  n', a, ' -> n', b, ';') FROM drawn_edges UNION ALL SELECT 7, 0, 0, 0, '}') q"""),
        "export_json": _sql([*around, "drawn", "drawn_edges"], r"""SELECT CAST(0 AS INTEGER) AS line_no, concat('{"meta":{"direction":"outgoing","depth_limit":2,"root_id":', (SELECT root FROM root_out), ',"layout_algorithm":"hierarchical"},"nodes":[',
  (SELECT string_agg(concat('{"id":', symbol_id, ',"name":"', name, '","label":"', name, '\\n', relpath, '","path":"', relpath, '","relpath":"', relpath, '","lang":"lua","range":[', sr, ',', sc, ',', er, ',', ec, '],"layout":{"x":', printf('%.1f', depth * 220.0), ',"y":', printf('%.1f', (i - 1) * 90.0 - (c - 1) * 45.0), ',"depth":', depth, ',"layer_index":', i, '}}'), ',' ORDER BY n) FROM drawn), '],"edges":[',
  (SELECT string_agg(concat('{"source":', src, ',"target":', dst, ',"dynamic":false,"polymorphic":false,"calls":[]}'), ',' ORDER BY a, b, k) FROM drawn_edges), ']}') AS text"""),
        "render_hot_path": _sql([*HOT, "chain", "chain_rows"], """SELECT CAST(row_number() OVER (ORDER BY part, a, b) - 1 AS INTEGER) AS line_no, text FROM (
  SELECT 0 AS part, 0 AS a, 0 AS b, 'Hot paths' AS text UNION ALL SELECT 1, 0, 0, '---------'
  UNION ALL SELECT 2, rank, 0, concat('  rank=', rank, '  label=', label, '  score=', printf('%.3f', score), '  rationale=fan-in=', in_degree, ' fan-out=', out_degree, ' reach=', reach, ' balance=', balance, ' churn=', churn) FROM hot_top
  UNION ALL SELECT 3, 0, 0, '' UNION ALL SELECT 4, 0, 0, 'Chains' UNION ALL SELECT 5, 0, 0, '------'
  UNION ALL SELECT 6, root, pos, concat('  root=', root, '  pos=', pos, '  symbol_id=', symbol_id, '  score=', printf('%.3f', score), '  bottleneck=', printf('%.3f', bottleneck)) FROM chain_rows) q"""),
        "render_architecture": _sql(ARCH, """SELECT CAST(row_number() OVER (ORDER BY part, n) - 1 AS INTEGER) AS line_no, text FROM (
  SELECT 0 AS part, 0 AS n, 'Groups' AS text UNION ALL SELECT 1, 0, '------'
  UNION ALL SELECT 2, n, concat('  group_id=', group_id, '  symbol_count=', c) FROM (SELECT group_id, count(*) AS c, row_number() OVER (ORDER BY group_id) AS n FROM placed GROUP BY group_id) g WHERE n <= 50
  UNION ALL SELECT 3, 0, '' UNION ALL SELECT 4, 0, 'Dependencies' UNION ALL SELECT 5, 0, '------------'
  UNION ALL SELECT 6, n, concat('  source_group=', source_group, '  target_group=', target_group, '  count=', count) FROM (SELECT *, row_number() OVER (ORDER BY source_group, target_group) AS n FROM group_edges) g WHERE n <= 50
  UNION ALL SELECT 7, 0, '' UNION ALL SELECT 8, 0, 'Violations' UNION ALL SELECT 9, 0, '----------'
  UNION ALL SELECT 10, n, concat('  severity=', severity, '  severity_score=', printf('%.3f', severity_score), '  count=', count, '  source_group=', source_group, '  target_group=', target_group)
    FROM (SELECT *, row_number() OVER (ORDER BY severity_score DESC, count DESC, source_group, target_group) AS n FROM bad) g WHERE n <= 50) q"""),
    }
    return out | {name: out[same] for name, same in SAME.items()}
