"""Every operator as a query over the bound tables, with SQL that says the same to another engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import expr
from .operators import algo, answers, callers, diff, features, incremental, intervals, modules, notes, postings, reports, routes, search, traverse, usage
from .plans.binding import CTES, bind, table
from .plans.stages import met, scratch, stage
from .schema import Graph
from .sources import js_code, python_code, readers, tree
from .streaming import rings, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FUNC = "('function', 'method')"
SYM = "('function', 'method', 'class')"


def _add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def _graph(name: str, fn: Callable[[Graph], DataFrame], sql: str | None = None, ctes: str = "") -> None:
    """A query over the bound graph; sql goes on after the graph's and its own table expressions."""
    _add(name, lambda s, d: fn(bind(s, d)), f"{CTES}{ctes}\n{sql}" if sql else None)


def _roots(g: Graph) -> DataFrame:
    return g.nodes.where(F.col("type").isin("function", "method")).select("id")


ROOTS = f"roots AS (SELECT id FROM sym WHERE type IN {FUNC})"

# callers and callees
PAIRS = f""",
pairs AS (SELECT e.target_id AS t_id, s.id AS s_id, s.qname AS s_qname, s.path AS s_path, s.start_line AS s_start_line,
  s.is_test AS s_is_test, bool_or(e.confidence <> 'ambiguous') AS confident
  FROM cg_edges e JOIN sym s ON e.source_id = s.id WHERE e.relation = 'calls' AND e.source_id <> e.target_id AND s.type IN {FUNC}
  GROUP BY ALL),
supp AS (SELECT DISTINCT p.t_id, p.s_id FROM pairs p JOIN cg_nodes t ON t.id = p.t_id JOIN cg_edges e ON e.source_id = p.s_id
  AND e.relation = 'calls' AND e.confidence <> 'ambiguous' JOIN cg_nodes o ON o.id = e.target_id AND o.name = t.name AND o.id <> p.t_id
  WHERE NOT p.confident),
split AS (SELECT t_id, s_id, s_qname, s_path, s_start_line,
  CASE WHEN NOT confident THEN 'ambiguous' WHEN s_is_test THEN 'test_callers' ELSE 'callers' END AS bucket
  FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM supp x WHERE x.t_id = p.t_id AND x.s_id = p.s_id))"""
_graph("callers_split", callers.callers_split, "SELECT * FROM split", PAIRS)
_graph("ambiguous_suppressed", lambda g: callers.suppressed(g, callers.caller_pairs(g)), "SELECT * FROM supp", PAIRS)
METHODS = """,
cm AS (SELECT c.id AS class_id, m.id AS method_id FROM cg_nodes c JOIN cg_nodes m ON c.file_id = m.file_id
  WHERE c.type = 'class' AND m.type = 'method' AND m.start_line > c.start_line AND m.start_line <= c.end_line)"""
_graph("class_methods", callers.class_methods, "SELECT * FROM cm", METHODS)
_graph("callers_of_class", callers.callers_of_classes, """
SELECT class_id, s_id, s_qname, s_path, s_start_line,
  CASE min(CASE bucket WHEN 'callers' THEN 0 WHEN 'test_callers' THEN 1 ELSE 2 END) WHEN 0 THEN 'callers' WHEN 1 THEN 'test_callers' ELSE 'ambiguous' END AS bucket
FROM split JOIN (SELECT id AS class_id, id AS t FROM cg_nodes WHERE type = 'class' UNION ALL SELECT class_id, method_id FROM cm) w ON t = t_id
WHERE NOT EXISTS (SELECT 1 FROM cm x WHERE x.class_id = w.class_id AND x.method_id = s_id) AND s_id <> w.class_id
GROUP BY ALL""", PAIRS + METHODS)
_graph("callees", callers.callees, f"""
SELECT s_id, t_id, t_qname, t_path, t_start_line FROM (
  SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY t_path, t_start_line, t_id) AS k FROM (
    SELECT DISTINCT s.id AS s_id, t.id AS t_id, t.qname AS t_qname, t.path AS t_path, t.start_line AS t_start_line
    FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
    WHERE relation = 'calls' AND confidence <> 'ambiguous' AND s.id <> t.id AND t.type IN {SYM} AND (s.is_test OR NOT t.is_test))) WHERE k <= 50""")
COUNTED = f"""FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
WHERE relation = 'calls' AND confidence <> 'ambiguous' AND s.id <> t.id AND s.type IN {FUNC} AND NOT s.is_test"""
_graph("caller_counts", callers.caller_counts, f"SELECT t.id AS t_id, count(DISTINCT s.id) AS callers {COUNTED} GROUP BY t.id")
_graph("named_callers", callers.named_callers,
       f"SELECT t.path AS t_path, t.name AS t_name, t.type AS t_type, count(DISTINCT s.id) AS callers {COUNTED} GROUP BY ALL")
_graph("hotspots", callers.hotspots, f"""
SELECT t.id, t.qname, t.path, t.start_line AS line, count(DISTINCT s.id) AS used_by
FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
WHERE relation IN ('calls', 'imports') AND confidence <> 'ambiguous' AND s.id <> t.id AND t.type IN {FUNC}
  AND s.type IN ('function', 'method', 'module') AND NOT s.is_test AND NOT t.is_test
GROUP BY ALL ORDER BY used_by DESC, t.id LIMIT 20""")
_graph("find_symbol_rank", callers.ranked_definitions, f"""
SELECT name, CAST(rank AS INT) AS rank, id, path, start_line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY is_test, qname <> name, length(path), start_line, id) AS rank
FROM sym WHERE type IN {SYM}) WHERE rank <= 10""")
_graph("central_definition", callers.central_definition, f"""
SELECT name, id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, start_line, id) AS k FROM (
  SELECT s.*, (SELECT count(*) FROM cg_edges e WHERE e.target_id = s.id AND relation IN ('calls', 'imports', 'implements')) AS score
  FROM sym s WHERE type IN {SYM} AND NOT path ILIKE '%/tests/%' AND NOT path ILIKE '%/test_%' AND NOT path ILIKE '%.spec.%' AND NOT path ILIKE '%.test.%')) WHERE k = 1""")
_graph("references", callers.references, """
SELECT DISTINCT t.name, relation, s.id AS s_id, s.path || ':' || CAST(s.start_line AS STRING) AS location
FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN cg_nodes t ON t.id = e.target_id""")
VISIBLE = "NOT name ILIKE 'test_%' AND name NOT IN ('__init__', '<module>')"
_graph("function_count", callers.function_count, f"SELECT count(*) AS functions FROM sym WHERE type IN {FUNC} AND {VISIBLE}")
REPRESENTATIVE = f"""SELECT path, id, name, start_line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, id) AS k FROM sym
WHERE type IN {FUNC} AND {VISIBLE}) WHERE k = 1 ORDER BY path LIMIT 30"""
_graph("representative_per_file", callers.representative_per_file, REPRESENTATIVE)
_graph("inherited_classes", callers.inherited_classes,
       "SELECT DISTINCT n.name FROM cg_edges e JOIN cg_nodes n ON n.id = e.target_id WHERE relation = 'inherits'")

# intervals and prefixes


def _points(g: Graph) -> DataFrame:
    return g.nodes.select("file_id", (F.col("start_line") + 7).alias("line"))


_graph("enclosing_innermost", lambda g: intervals.innermost(g, _points(g)), f"""
SELECT DISTINCT p.file_id, CAST(p.line AS INT) AS line, coalesce(
  (SELECT arg_min(d.id, (d.end_line - d.start_line) * 1000000 - d.start_line) FROM cg_nodes d WHERE d.type IN {FUNC} AND d.file_id = p.file_id
     AND p.line BETWEEN d.start_line AND d.end_line),
  (SELECT arg_min(m.id, m.start_line) FROM cg_nodes m WHERE m.type = 'module' AND m.file_id = p.file_id)) AS node_id
FROM (SELECT file_id, start_line + 7 AS line FROM cg_nodes) p""")
_graph("enclosing_class", intervals.enclosing_class, """
SELECT m.id AS method_id, arg_min(c.id, (c.end_line - c.start_line) * 1000000 + c.id) AS class_id FROM cg_nodes m JOIN cg_nodes c ON m.file_id = c.file_id
WHERE m.type = 'method' AND c.type = 'class' AND m.start_line BETWEEN c.start_line AND c.end_line GROUP BY m.id""")

DIFF = """--- a/promo/b11.js
+++ b/promo/b11.js
@@ -10,3 +12,5 @@
 context
+one
+two
-gone
+three
--- a/small/b
+++ /dev/null
@@ -1,2 +40,9 @@
+forty
\\ No newline at end of file
index 123
+forty-two
--- x
+++ ECONOMY/B2
+zero
@@ -1 +33 @@ def f():
+thirty-three"""
_add("diff_lines", lambda s, d: diff.changed_lines(s.createDataFrame([(1, DIFF)], "diff_id int, diff string")).select("path", "line"), """
SELECT * FROM (VALUES ('promo/b11.js', 13), ('promo/b11.js', 14), ('promo/b11.js', 15), ('small/b', 40), ('small/b', 42), ('ECONOMY/B2', 43), ('ECONOMY/B2', 33)) t(path, line)""")
_graph("diff_overlap", lambda g: intervals.diff_overlap(
    g, diff.changed_lines(g.files.sparkSession.createDataFrame([(1, DIFF)], "diff_id int, diff string"))), f"""
, ch(path, line) AS (VALUES ('promo/b11.js', 13), ('promo/b11.js', 14), ('promo/b11.js', 15), ('small/b', 40), ('small/b', 42), ('ECONOMY/B2', 43), ('ECONOMY/B2', 33))
SELECT s.id, qname, s.path, count(DISTINCT (ch.path, line)) AS changed_lines FROM sym s JOIN ch ON s.path ILIKE '%' || ch.path || '%' AND line BETWEEN start_line AND end_line
WHERE type IN {SYM} GROUP BY ALL""")


def _modules(g: Graph) -> DataFrame:
    some = g.files.select(F.substring_index("path", "/", 1).alias("module"))
    return some.union(g.files.where("path LIKE '%/tests/%'").select(F.concat(F.substring_index("path", "/", 1), F.lit("/tests")))).where(
        "module <> 'medium'").distinct()


_graph("belongs_to_module", lambda g: intervals.belongs_to(g.files, _modules(g)), """
, m AS (SELECT DISTINCT module FROM (SELECT split_part(path, '/', 1) AS module FROM cg_files UNION ALL SELECT split_part(path, '/', 1) || '/tests' FROM cg_files WHERE path LIKE '%/tests/%') WHERE module <> 'medium')
SELECT f.id, f.path, arg_max(m.module, length(m.module)) AS module FROM cg_files f LEFT JOIN m ON starts_with(f.path, m.module || '/') GROUP BY f.id, f.path""")

# traversals
WALK_UP = f""", {ROOTS},
step AS (SELECT DISTINCT e.target_id AS a, e.source_id AS b FROM cg_edges e JOIN sym s ON s.id = e.source_id
  WHERE relation = 'calls' AND confidence <> 'ambiguous' AND s.type IN {FUNC} AND NOT s.is_test),
walk AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, b, depth + 1 FROM walk JOIN step ON a = walk.id WHERE depth < 3),
best AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id)"""
WALK_DOWN = f""", {ROOTS},
step AS (SELECT DISTINCT e.source_id AS a, e.target_id AS b FROM cg_edges e JOIN sym t ON t.id = e.target_id
  WHERE relation = 'calls' AND confidence <> 'ambiguous' AND t.type IN {FUNC} AND NOT t.is_test),
walk AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, b, depth + 1 FROM walk JOIN step ON a = walk.id WHERE depth < 2),
best AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id)"""
_graph("indirect_callers", lambda g: traverse.indirect_callers(g, _roots(g)), "SELECT * FROM best WHERE depth > 1", WALK_UP)
_graph("deep_callers", lambda g: traverse.deep_callers(g, _roots(g)), "SELECT * FROM best WHERE depth > 0", WALK_UP)
_graph("caller_tree", lambda g: traverse.caller_tree(g, _roots(g)), """
SELECT b.root, b.id, b.depth, min(n.id) AS parent FROM best b JOIN step ON step.b = b.id JOIN best n ON n.root = b.root AND n.id = step.a AND n.depth = b.depth - 1
WHERE b.depth > 0 GROUP BY ALL""", WALK_UP)
_graph("downstream_edges", lambda g: traverse.downstream_edges(g, _roots(g)),
       "SELECT root, depth + 1 AS depth, a AS s_id, b AS t_id FROM best JOIN step ON a = best.id", WALK_DOWN)
_graph("call_graph_both", lambda g: traverse.call_graph(g, _roots(g)), f"""
, {ROOTS}, up AS (SELECT DISTINCT e.target_id AS a, e.source_id AS b FROM cg_edges e JOIN sym s ON s.id = e.source_id WHERE relation = 'calls' AND s.type IN {FUNC} AND NOT s.is_test),
dn AS (SELECT DISTINCT e.source_id AS a, e.target_id AS b FROM cg_edges e JOIN sym t ON t.id = e.target_id WHERE relation = 'calls' AND t.type IN {FUNC} AND NOT t.is_test),
wu AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, b, depth + 1 FROM wu JOIN up ON a = wu.id WHERE depth < 2),
wd AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, b, depth + 1 FROM wd JOIN dn ON a = wd.id WHERE depth < 2)
SELECT root, 'callers' AS direction, id, min(depth) AS depth FROM wu GROUP BY root, id HAVING min(depth) > 0
UNION ALL SELECT root, 'callees', id, min(depth) FROM wd GROUP BY root, id HAVING min(depth) > 0""")
FILE_EDGES = """, fe AS (SELECT s.file_id AS from_file, t.file_id AS to_file, count(DISTINCT t.id) AS symbols
FROM cg_edges e JOIN cg_nodes s ON s.id = e.source_id JOIN cg_nodes t ON t.id = e.target_id
WHERE relation IN ('calls', 'imports') AND confidence <> 'ambiguous' AND s.file_id <> t.file_id GROUP BY ALL)"""
_graph("file_dependencies", traverse.file_edges, "SELECT * FROM fe", FILE_EDGES)
_graph("file_dependents", lambda g: traverse.file_dependents(g, g.files.select("id")), """
, wf AS (SELECT id AS root, id, 0 AS depth FROM cg_files UNION SELECT root, from_file, depth + 1 FROM wf JOIN fe ON to_file = wf.id WHERE depth < 2)
SELECT root, id, min(depth) AS depth FROM wf GROUP BY root, id HAVING min(depth) > 0""", FILE_EDGES)

# modules
_graph("list_modules", modules.list_modules, f"""
SELECT split_part(f.path, '/', 1) AS module, count(DISTINCT f.id) AS files, count(*) FILTER (n.type IN {FUNC}) AS functions, count(*) FILTER (n.type = 'class') AS classes,
  count(*) FILTER (n.type NOT IN {SYM}) AS other, count(n.id) AS symbols FROM cg_files f LEFT JOIN cg_nodes n ON n.file_id = f.id GROUP BY 1""")
BOUNDARY = """, bm AS (SELECT split_part(s.path, '/', 1) AS from_module, split_part(t.path, '/', 1) AS to_module, count(*) AS imports
FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id WHERE relation = 'imports' AND confidence <> 'ambiguous'
GROUP BY 1, 2 HAVING split_part(any_value(s.path), '/', 1) <> split_part(any_value(t.path), '/', 1))"""
_graph("boundary_map", modules.boundary_map, "SELECT * FROM bm ORDER BY imports DESC, from_module, to_module LIMIT 150", BOUNDARY)
_graph("module_overview", lambda g: modules.overview(g, "promo", 5, 8), f"""
, fs AS (SELECT DISTINCT path FROM sym WHERE type IN {SYM} AND path ILIKE 'promo/%' ORDER BY path LIMIT 5)
SELECT path, CAST(k AS INT) AS k, start_line AS line, type, qname FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, id) AS k
FROM sym WHERE type IN {SYM} AND path IN (SELECT path FROM fs)) WHERE k <= 8""")
_graph("module_overview_substring", lambda g: modules.overview(g, "OMO/b1", 50, 3), f"""
SELECT path, CAST(k AS INT) AS k, start_line AS line, type, qname FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, id) AS k
FROM sym WHERE type IN {SYM} AND path ILIKE '%OMO/b1%') WHERE k <= 3""")
_graph("module_outgoing", lambda g: modules.outgoing(g, "promo"), """
SELECT t.path, relation, count(*) AS edges FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
WHERE relation IN ('calls', 'imports') AND confidence <> 'ambiguous' AND s.path ILIKE 'promo/%' AND NOT t.path ILIKE 'promo/%'
GROUP BY ALL ORDER BY edges DESC, t.path, relation LIMIT 30""")


def _two(g: Graph) -> tuple[DataFrame, DataFrame]:
    return modules.files_named(g.files, "PROMO/b"), modules.files_named(g.files, "o/b2")


TRACE = """, te AS (SELECT DISTINCT s.path AS s_path, s.name AS s_name, relation, t.path AS t_path, t.name AS t_name,
  contains(lower(s.path), 'promo/b') AS so, contains(lower(t.path), 'promo/b') AS tao, contains(lower(s.path), 'o/b2') AS st, contains(lower(t.path), 'o/b2') AS tt
FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
WHERE relation IN ('calls', 'imports') AND confidence <> 'ambiguous' AND s.path <> t.path),
tl AS (SELECT CASE WHEN so AND tt THEN 'direct' WHEN so AND NOT tao AND NOT tt THEN 'outbound' WHEN tt AND NOT so AND NOT st THEN 'inbound' END AS leg, s_path, s_name, relation, t_path, t_name FROM te)"""
_graph("trace_all", lambda g: modules.trace(g, *_two(g)), "SELECT * FROM tl WHERE leg IS NOT NULL", TRACE)
for _leg in ("direct", "outbound", "inbound"):
    _graph(f"trace_{_leg}", lambda g, leg=_leg: modules.trace_capped(g, *_two(g)).where(F.col("leg") == leg),
           f"SELECT * FROM tl WHERE leg = '{_leg}' ORDER BY s_path, s_name, relation, t_path, t_name LIMIT {20 if _leg == 'direct' else 10}", TRACE)
_graph("shared_files", lambda g: modules.shared_files(*_two(g)),
       "SELECT path FROM cg_files WHERE contains(lower(path), 'promo/b') AND contains(lower(path), 'o/b2') ORDER BY path LIMIT 10")
DRAWN = BOUNDARY + f""", dn AS (SELECT 'f' || CAST(id AS STRING) AS node, type, qname AS label, split_part(path, '/', 1) AS module FROM sym WHERE type IN {FUNC} AND {VISIBLE}),
nd AS (SELECT node, type, label FROM dn UNION ALL SELECT DISTINCT 'm:' || split_part(path, '/', 1), 'module', split_part(path, '/', 1) FROM cg_files),
lk AS (SELECT node AS source, 'm:' || module AS target, 'belongs_to' AS type FROM dn UNION ALL SELECT 'm:' || from_module, 'm:' || to_module, 'depends_on' FROM bm)"""
_graph("full_graph_nodes", lambda g: modules.full_graph(g)[0], "SELECT * FROM nd", DRAWN)
_graph("full_graph_links", lambda g: modules.full_graph(g)[1], "SELECT * FROM lk", DRAWN)
_graph("simplified_graph", modules.simplified_graph, f"""
SELECT * FROM lk WHERE type = 'depends_on' UNION ALL SELECT 'f' || CAST(id AS STRING), 'm:' || split_part(path, '/', 1), 'belongs_to' FROM ({REPRESENTATIVE})""", DRAWN)
_graph("graph_stats", lambda g: modules.graph_stats(g, 1000), """
SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM nd WHERE type <> 'module') AS functions, (SELECT count(*) FROM nd WHERE type = 'module') AS modules,
  (SELECT count(*) FROM lk) AS links, CASE WHEN (SELECT count(*) FROM nd) > 1000 THEN 'simplified' ELSE 'full' END AS view_mode""", DRAWN)
_graph("impact_graph", lambda g: modules.impact_graph(g, _roots(g)), f"""
SELECT root, id, CASE min(k) WHEN 0 THEN 'caller' WHEN 1 THEN 'indirect' ELSE 'same_file' END AS grp FROM (
  SELECT root, id, CASE WHEN depth = 1 THEN 0 ELSE 1 END AS k FROM best WHERE depth > 0
  UNION ALL SELECT r.id, n.id, 2 FROM roots r JOIN cg_nodes o ON o.id = r.id JOIN cg_nodes n ON n.file_id = o.file_id AND n.id <> r.id AND n.type IN {FUNC}) GROUP BY root, id""", WALK_UP)

# whole-graph algorithms
SCC = """, im AS (SELECT DISTINCT source_id AS s, target_id AS t FROM cg_edges WHERE relation = 'imports' AND source_id <> target_id),
reach AS (SELECT s, t FROM im UNION SELECT r.s, im.t FROM reach r JOIN im ON im.s = r.t),
mutual AS (SELECT a.s AS id, a.t AS other FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s),
scc AS (SELECT id, min(other) AS component, count(DISTINCT other) AS size FROM mutual GROUP BY id HAVING count(DISTINCT other) > 1)"""
_graph("import_cycles", lambda g: algo.components(algo.node_imports(g)), "SELECT * FROM scc", SCC)
_graph("shortest_loops", lambda g: algo.shortest_loops(algo.node_imports(g), algo.components(algo.node_imports(g))), """
, lp AS (SELECT DISTINCT component AS root, component AS id, 0 AS depth FROM scc UNION SELECT root, im.t, depth + 1 FROM lp JOIN im ON im.s = lp.id JOIN scc ON scc.id = im.t AND scc.component = root WHERE depth < 12)
SELECT root AS component, min(depth) AS loop FROM lp WHERE id = root AND depth > 0 GROUP BY root""", SCC)
_graph("tour_levels", lambda g: algo.reading_order(algo.node_imports(g)), """
, ids AS (SELECT id, coalesce(component, id) AS c, component IS NOT NULL AS in_cycle FROM (SELECT s AS id FROM im UNION SELECT t FROM im) LEFT JOIN scc USING (id)),
ce AS (SELECT DISTINCT a.c AS a, b.c AS b FROM im JOIN ids a ON a.id = im.s JOIN ids b ON b.id = im.t WHERE a.c <> b.c),
lv AS (SELECT DISTINCT c, 0 AS level FROM ids UNION SELECT ce.a, level + 1 FROM lv JOIN ce ON ce.b = lv.c)
SELECT id, max(level) AS level, in_cycle FROM ids JOIN lv USING (c) GROUP BY id, in_cycle""", SCC)
#: Paths are counted forward a level at a time, shares flow back the same way.
BETWEEN = f"""
, ce AS MATERIALIZED (SELECT DISTINCT s.id AS s, t.id AS t FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
  WHERE relation = 'calls' AND confidence <> 'ambiguous' AND s.type IN {FUNC} AND t.type IN {FUNC} AND s.id <> t.id),
n AS (SELECT s AS id FROM ce UNION SELECT t FROM ce),
w(s, t, d, sigma) USING KEY (s, t) AS (SELECT id, id, 0, CAST(1 AS DOUBLE) FROM n
  UNION SELECT w.s, ce.t, w.d + 1, sum(w.sigma) FROM w JOIN ce ON ce.s = w.t WHERE NOT EXISTS (SELECT 1 FROM recurring.w x WHERE x.s = w.s AND x.t = ce.t) GROUP BY w.s, ce.t, w.d),
m AS MATERIALIZED (SELECT * FROM w),
bk(s, t, d, sigma, delta) AS (SELECT s, t, d, sigma, CAST(0 AS DOUBLE) FROM m WHERE d = (SELECT max(d) FROM m)
  UNION ALL SELECT m.s, m.t, m.d, m.sigma, coalesce(g.gain, 0) FROM m LEFT JOIN (SELECT y.s, y.t, sum(y.sigma / b.sigma * (1 + b.delta)) AS gain
     FROM bk b JOIN ce ON ce.t = b.t JOIN m y ON y.s = b.s AND y.t = ce.s AND y.d = b.d - 1 GROUP BY y.s, y.t) g ON g.s = m.s AND g.t = m.t
   WHERE m.d = (SELECT max(d) FROM bk) - 1),
bt AS (SELECT n.id, round(coalesce(sum(delta) FILTER (bk.s <> bk.t), 0), 4) AS betweenness FROM n LEFT JOIN bk ON bk.t = n.id GROUP BY n.id)"""
_graph("betweenness", lambda g: algo.betweenness(traverse.call_edges(g).select(F.col("s_id").alias("s"), F.col("t_id").alias("t"))).select(
    "id", F.round("betweenness", 4).alias("betweenness")), "SELECT * FROM bt", BETWEEN)
_graph("dead_code", algo.dead_code, f"""
SELECT CASE WHEN EXISTS (SELECT 1 FROM cg_edges e WHERE e.source_id = s.id AND e.target_id <> s.id) THEN 'unused' ELSE 'orphan' END AS kind, id, qname, path,
  CAST(end_line - start_line + 1 AS INT) AS lines FROM sym s WHERE type IN {FUNC} AND NOT is_test
  AND NOT EXISTS (SELECT 1 FROM cg_edges e WHERE e.target_id = s.id AND e.source_id <> s.id)""")
SURPRISING = """
SELECT s_id, t_id, CAST(doubt + CAST(across AS INT) + CAST(bridge AS INT) AS INT) AS score,
  concat_ws(',', CASE doubt WHEN 2 THEN 'ambiguous' WHEN 1 THEN 'inferred' END, CASE WHEN across THEN 'crosses_modules' END, CASE WHEN bridge THEN 'sole_bridge' END) AS why
FROM (SELECT *, split_part(s_path, '/', 1) <> split_part(t_path, '/', 1) AS across, s_path <> t_path AND count(*) OVER (PARTITION BY s_path, t_path) = 1 AS bridge FROM (
  SELECT s.id AS s_id, t.id AS t_id, s.path AS s_path, t.path AS t_path, max(CASE confidence WHEN 'ambiguous' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END) AS doubt
  FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
  WHERE relation IN ('calls', 'references') AND s.id <> t.id AND NOT s.is_test AND NOT t.is_test GROUP BY ALL)) ORDER BY score DESC, s_id, t_id LIMIT 20"""
_graph("surprising", algo.surprising, SURPRISING)

# features
FEATURES = """, fp(feature, ordinal, regex) AS (VALUES ('Promotions', 0, '(^|/)promo/.*(/.*)?$'), ('Small', 1, '(^|/)small/b1[^/][.]py(/.*)?$'),
  ('Economy tests', 2, '(^|/)economy/tests/[^/]*(/.*)?$'), ('Standard', 3, '(^|/)standard(/.*)?$'), ('Standard', 3, '(^|/)small/b11[.]js(/.*)?$'),
  ('Everything odd', 4, '(^|/)(.*/)?b[^/]1[.]js(/.*)?$'), ('Everything odd', 4, '(^|/)(.*/)?b[^/]3[.]js(/.*)?$'), ('Nowhere', 6, '(^|/)missing/.*(/.*)?$')),
ff AS (SELECT DISTINCT feature, ordinal, id, path FROM cg_files JOIN fp ON regexp_matches(path, regex)),
owner AS (SELECT f.id, f.path, (SELECT arg_min(feature, ordinal) FROM ff WHERE ff.id = f.id) AS feature FROM cg_files f)"""


def _spec(g: Graph) -> DataFrame:
    return features.example_features(g.files.sparkSession)


_graph("feature_files", lambda g: features.feature_files(_spec(g), g.files), "SELECT CAST(ordinal AS INT) AS ordinal, feature, id, path FROM ff", FEATURES)
_graph("file_owner", lambda g: features.file_owner(_spec(g), g.files), "SELECT * FROM owner", FEATURES)
_graph("feature_functions", lambda g: features.feature_functions(g, _spec(g)),
       f"SELECT feature, count(*) AS functions FROM ff JOIN cg_nodes n ON n.file_id = ff.id WHERE type IN {FUNC} AND {VISIBLE} GROUP BY feature", FEATURES)
_graph("feature_hot_functions", lambda g: features.hot_functions(g, _spec(g)), f"""
, cc AS (SELECT t.id AS id, t.type, t.file_id, count(DISTINCT s.id) AS callers {COUNTED} GROUP BY ALL)
SELECT feature, id, callers FROM (SELECT ff.feature, cc.id, callers, row_number() OVER (PARTITION BY feature ORDER BY callers DESC, cc.id) AS k
FROM ff JOIN cc ON cc.file_id = ff.id WHERE cc.type IN {FUNC}) WHERE k <= 10""", FEATURES)
_graph("impact_by_feature", lambda g: features.impact_by_feature(g, _spec(g), _roots(g)), """
SELECT root, coalesce(feature, 'unassigned') AS feature, count(*) AS functions, bool_or(depth = 0) AS has_root
FROM best JOIN cg_nodes n ON n.id = best.id JOIN owner ON owner.id = n.file_id GROUP BY 1, 2""", WALK_UP + FEATURES)
RISKS = """, used AS (SELECT t_id AS root, s_id AS id, s_path, bucket, count(*) FILTER (bucket = 'callers') OVER (PARTITION BY t_id) AS sure FROM split JOIN roots ON roots.id = t_id),
act AS (SELECT * FROM used WHERE (sure > 0 AND bucket = 'callers') OR (sure = 0 AND bucket = 'ambiguous')),
around AS (SELECT root, id FROM act UNION ALL SELECT id, id FROM roots UNION ALL SELECT root, id FROM best WHERE depth > 1),
rk AS (SELECT r.id AS root, (SELECT count(*) FROM act WHERE act.root = r.id) AS callers, (SELECT count(DISTINCT s_path) FROM act WHERE act.root = r.id) AS files,
  (SELECT count(DISTINCT feature) FROM around a JOIN cg_nodes n ON n.id = a.id JOIN owner o ON o.id = n.file_id WHERE a.root = r.id) AS features,
  coalesce((SELECT max(sure) FROM used WHERE used.root = r.id), 0) = 0 AS none_sure FROM roots r),
risks AS (SELECT root, callers, files, features, CASE WHEN callers = 0 THEN 'LOW' WHEN callers > 20 OR features > 3 OR files > 10 THEN 'HIGH'
  WHEN callers > 5 OR features > 1 OR files > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, none_sure AND callers > 0 AS guessed FROM rk)"""
_graph("risk_level", lambda g: features.risk_levels(g, _spec(g), _roots(g)), "SELECT * FROM risks", PAIRS + WALK_UP + FEATURES + RISKS)
_graph("overall_risk", lambda g: features.overall_risk(features.risk_levels(g, _spec(g), _roots(g))), """
SELECT CASE max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk, CAST(sum(callers) AS BIGINT) AS downstream FROM risks""",
       PAIRS + WALK_UP + FEATURES + RISKS)
_graph("spec_alignment", lambda g: features.alignment(g, _spec(g)), f"""
, sp(feature, decisions, constraints, patterns) AS (VALUES ('Promotions', 1, 1, 1), ('Small', 1, 0, 1), ('Economy tests', 0, 1, 1), ('Standard', 2, 0, 2), ('Everything odd', 0, 0, 2), ('No patterns', 0, 0, 0), ('Nowhere', 0, 0, 1)),
al AS (SELECT sp.*, (SELECT count(*) FROM ff WHERE ff.feature = sp.feature) AS files,
  (SELECT count(*) FROM ff JOIN cg_nodes n ON n.file_id = ff.id WHERE ff.feature = sp.feature AND n.type IN {SYM}) AS functions FROM sp),
iss AS (SELECT *, concat_ws(',', CASE WHEN patterns = 0 THEN 'no_patterns' END, CASE WHEN patterns > 0 AND files = 0 THEN 'no_files' END, CASE WHEN decisions = 0 THEN 'no_decisions' END) AS issues FROM al)
SELECT feature, files, functions, CAST(decisions AS INT) AS decisions, CAST(constraints AS INT) AS constraints, issues, issues = '' AS fully_aligned FROM iss""", FEATURES)
_graph("unmapped_files", lambda g: features.unmapped_files(g, _spec(g)), "SELECT id, path FROM cg_files WHERE id NOT IN (SELECT id FROM ff)", FEATURES)
_add("affected_decisions", lambda s, d: features.affected_decisions(features.example_features(s)),
     "SELECT * FROM (VALUES ('Promotions', 'DEC-001'), ('Standard', 'DEC-003')) t(feature, decision)")

# notes
NOTES_CTE = "WITH nt AS (" + notes.EXAMPLE_SQL.format(nation="nation", region="region") + ")"


def _notes(s: SparkSession, d: str) -> DataFrame:
    return notes.example(s, table(s, d, "nation"), table(s, d, "region"))


NOTE_LINKS = NOTES_CTE + r""",
lk AS (SELECT id, unnest(range(len(x))) AS pos, trim(unnest(x)) AS target FROM (SELECT id, regexp_extract_all(content, '\[\[([^\]]+)\]\]', 1) AS x FROM nt)),
slugged AS (SELECT *, trim(regexp_replace(lower(target), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM lk),
al AS (SELECT alias, arg_min(note, rank * 1000 + ord) AS note FROM (
  SELECT note, ord, unnest([0, 1, 2, 2, 3, 3]) AS rank, unnest([note, lower(note), lower(title), trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), lower(rest),
    trim(regexp_replace(lower(rest), '[^a-z0-9]+', '-', 'g'), '-')]) AS alias FROM (
    SELECT id AS note, title, regexp_extract(title, '(?i)^(?:feature:|decision:|note:|func:)\s*(.*)$', 1) AS rest, row_number() OVER (ORDER BY id) AS ord FROM nt)) WHERE alias <> '' GROUP BY alias),
res AS (SELECT s.id, CAST(s.pos AS INT) AS pos, s.target, coalesce((SELECT note FROM al WHERE alias = target), (SELECT note FROM al WHERE alias = lower(target)), (SELECT note FROM al WHERE alias = slug),
  (SELECT arg_min(note, alias) FROM al WHERE length(slug) >= 3 AND length(alias) >= 3 AND (ends_with(alias, '-' || slug) OR ends_with(slug, '-' || alias)))) AS note FROM slugged s)"""
_add("note_links", lambda s, d: notes.resolved(_notes(s, d)), NOTE_LINKS + " SELECT * FROM res")
_add("note_backlinks", lambda s, d: notes.backlinks(_notes(s, d)), NOTE_LINKS + " SELECT DISTINCT note AS id, id AS source FROM res WHERE note IS NOT NULL AND note <> id")
_add("note_related", lambda s, d: notes.related(_notes(s, d)), NOTE_LINKS + """
, both_ways AS (SELECT id, note AS other, min(pos) AS o FROM res WHERE note IS NOT NULL AND note <> id GROUP BY ALL UNION ALL SELECT DISTINCT note, id, 1000 FROM res WHERE note IS NOT NULL AND note <> id)
SELECT id, CAST(k AS INT) AS k, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY min(o), other) AS k FROM both_ways GROUP BY id, other) WHERE k <= 10""")


def _note_symbols(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").where("n_nationkey % 2 = 0").select(
        F.concat(F.lit("C"), (F.col("n_nationkey") % 60).cast("string"), F.lit("."), "n_name").alias("name"))


_add("note_unresolved", lambda s, d: notes.unresolved(_notes(s, d), _note_symbols(s, d)), NOTE_LINKS + r"""
SELECT DISTINCT 'link' AS kind, id, target FROM res WHERE note IS NULL
UNION ALL SELECT 'mention', id, m FROM (SELECT DISTINCT id, unnest(list_concat(regexp_extract_all(content, '@([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)', 1), regexp_extract_all(content, '@([\w./-]+\.[A-Za-z0-9]+)', 1))) AS m FROM nt)
WHERE (contains(m, '.') OR contains(m, '_') OR length(regexp_replace(m, '[^A-Z]', '', 'g')) >= 2)
  AND m NOT IN (SELECT 'C' || CAST(n_nationkey % 60 AS STRING) || '.' || n_name FROM nation WHERE n_nationkey % 2 = 0)""")
_add("note_search", lambda s, d: notes.search(_notes(s, d), "AN", "feature").select("id", "title"), NOTES_CTE + """
SELECT id, title FROM nt WHERE (contains(lower(title), 'an') OR contains(lower(content), 'an') OR contains(lower(tag_list), 'an')) AND list_contains(string_split(tag_list, ','), 'feature')""")
_add("tags_count", lambda s, d: notes.tag_counts(_notes(s, d)), NOTES_CTE + " SELECT tag, count(*) AS notes FROM (SELECT unnest(string_split(tag_list, ',')) AS tag FROM nt) GROUP BY tag")
_add("note_types", lambda s, d: _notes(s, d).select("id", notes.drawn_type(F.col("tags"), F.col("is_code_note")).alias("type")), NOTES_CTE + """
SELECT id, CASE WHEN list_contains(string_split(tag_list, ','), 'feature') THEN 'feature' WHEN is_code_note THEN 'code_note' ELSE 'note' END AS type FROM nt""")

# telemetry


def _calls(s: SparkSession, d: str) -> DataFrame:
    return usage.from_events(table(s, d, "events"))


_add("usage_by_tool", lambda s, d: usage.by_tool(_calls(s, d)).withColumn("total_ms", F.round("total_ms", 2)), """
SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, min(ts) AS first_at, max(ts) AS last_at, round(sum(value), 2) AS total_ms FROM events GROUP BY 1""")
_add("usage_errors", lambda s, d: usage.by_tool(_calls(s, d)).where("errors > 0").select("tool", "errors"),
     "SELECT event_type AS tool, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
_add("usage_ring", lambda s, d: usage.ring(_calls(s, d)),
     "SELECT event_id AS call_id, event_type AS tool, user_id AS project_id, event_type <> 'error' AS ok, value AS duration_ms, ts AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
_add("usage_totals", lambda s, d: usage.totals(_calls(s, d)), """
SELECT count(*) AS total_calls, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS tools, min(ts) AS first_at, max(ts) AS last_at FROM events""")
_add("job_states", lambda s, d: usage.latest_state(table(s, d, "events").select(
    F.col("user_id").alias("project_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "view", "cancelled").otherwise(F.col("event_type")).alias("state"))), """
SELECT user_id AS project_id, CASE WHEN last = 'cancelled' THEN 'failed' ELSE last END AS state FROM (
  SELECT user_id, arg_max(state, (ts, state)) AS last FROM (SELECT user_id, ts, CASE WHEN event_type = 'view' THEN 'cancelled' ELSE event_type END AS state FROM events) GROUP BY user_id)""")
_add("props_json", lambda s, d: table(s, d, "events").select(
    "event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(-1)).alias("k")), "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k FROM events")

# upkeep
_graph("index_fingerprint", incremental.fingerprint, """
SELECT (SELECT count(*) FROM cg_files) AS files, (SELECT max(id) FROM cg_files) AS last_file, (SELECT count(*) FROM cg_nodes) AS nodes,
  (SELECT max(id) FROM cg_nodes) AS last_node, (SELECT count(*) FROM cg_edges) AS edges, CAST(0 AS BIGINT) AS owned_edges,
  (SELECT CAST(source_id AS STRING) || '-' || CAST(target_id AS STRING) FROM cg_edges ORDER BY source_id DESC, target_id DESC LIMIT 1) AS last_edge""")
_graph("index_snapshot", incremental.snapshot, "SELECT path, (SELECT max(id) FROM cg_nodes n WHERE n.file_id = f.id) AS last_node FROM cg_files f")
_graph("index_digests", incremental.digests, """
SELECT split_part(path, '.', -1) AS language, count(*) AS files,
  CAST(sum(CAST('0x' || substr(md5(path || '|' || CAST(coalesce((SELECT max(id) FROM cg_nodes n WHERE n.file_id = f.id), 0) AS STRING)), 1, 12) AS BIGINT)) AS STRING) AS digest
FROM cg_files f GROUP BY 1""")


def _diff(g: Graph) -> tuple[DataFrame, DataFrame]:
    tag = F.concat(F.lit('{"caller":'), F.col("source_id").cast("string"), F.lit("}"))
    e = g.edges.where("relation = 'calls'").withColumn("metadata", tag)
    return incremental.edge_diff(e.where("target_id % 7 <> 1"), e.where("target_id % 7 <> 2"), g.edges.where("target_id % 5 = 0"))


EDGE_DIFF = """, e AS (SELECT DISTINCT source_id, target_id, relation, '{"caller":' || CAST(source_id AS STRING) || '}' AS metadata FROM cg_edges WHERE relation = 'calls'),
want AS (SELECT * FROM e WHERE target_id % 7 <> 2 AND NOT EXISTS (SELECT 1 FROM cg_edges u WHERE u.target_id % 5 = 0 AND u.confidence <> 'ambiguous' AND u.source_id = e.source_id AND u.target_id = e.target_id)),
have AS (SELECT * FROM e WHERE target_id % 7 <> 1)"""
_graph("edge_diff_added", lambda g: _diff(g)[0], "SELECT * FROM want EXCEPT SELECT * FROM have", EDGE_DIFF)
_graph("edge_diff_removed", lambda g: _diff(g)[1], "SELECT * FROM have EXCEPT SELECT * FROM want", EDGE_DIFF)
_graph("cascade_delete", lambda g: incremental.without_files(g, g.files.where("id % 4 = 1").select("path")).edges.select("source_id", "target_id", "relation", "confidence"), """
SELECT source_id, target_id, relation, confidence FROM cg_edges JOIN cg_nodes s ON s.id = source_id JOIN cg_nodes t ON t.id = target_id WHERE s.file_id % 4 <> 1 AND t.file_id % 4 <> 1""")

# search
_indexed: dict[tuple[str, str, str], str] = {}


def _texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _postings(s: SparkSession, d: str) -> str:
    """The folder of the index of the documents, built once a session."""
    key = (s.sparkContext.applicationId, s.conf.get("spark.checkpoint.dir", ""), d)
    if key not in _indexed:
        folder = scratch(s)
        postings.upsert(_texts(s, d), folder)
        _indexed[key[0], s.conf.get("spark.checkpoint.dir", ""), d] = folder
    return _indexed[key[0], s.conf.get("spark.checkpoint.dir", ""), d]


def _bm25_sql(docs: str) -> str:
    return r"""

WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ts FROM (SELECT doc_id, text FROM """ + docs + r""")),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
h AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM t) WHERE term IN ('the', 'onesen', 'whou', 'and') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM h JOIN df USING (term), st GROUP BY id ORDER BY score DESC, id LIMIT 20"""


_add("search_bm25", lambda s, d: postings.search(s, _postings(s, d), "the onesen whou and"), _bm25_sql("documents"))
_add("search_scanned", lambda s, d: search.bm25(_texts(s, d), "the onesen whou and"), _bm25_sql("documents"))


def _searched_after_upkeep(s: SparkSession, d: str) -> DataFrame:
    """Documents of one language replaced by their last words, those of another removed, then searched."""
    folder, docs = scratch(s), table(s, d, "documents")
    postings.upsert(_texts(s, d), folder)
    changed = F.when(F.col("lang") == "fr", F.concat(F.lit("whou the "), F.substring("text", -200, 200)))
    postings.upsert(docs.where("lang IN ('fr', 'es')").select(F.col("doc_id").alias("id"), changed.alias("text")), folder)
    return postings.search(s, folder, "the onesen whou and")


_add("search_upkeep", _searched_after_upkeep, _bm25_sql("""(SELECT doc_id, CASE WHEN lang = 'fr' THEN 'whou the ' || substr(text, -200) ELSE text END AS text FROM documents
  WHERE lang <> 'es' OR lang IS NULL) documents"""))
_graph("symbol_search", lambda g: search.symbol_search(g.symbols, "Blue", "function"),
       "SELECT id, name, type, path, start_line FROM sym WHERE type = 'function' AND contains(lower(name), 'blue') ORDER BY lower(name) = 'blue' DESC, length(name), id LIMIT 20")
_graph("symbol_lines", lambda g: g.symbols.select("id", expr.symbol_line(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("type"), F.col("qname")).alias("line")), """
SELECT id, path || ':' || CAST(start_line AS STRING) || CASE WHEN end_line <> start_line THEN '-' || CAST(end_line AS STRING) ELSE '' END || ' ' || type || ' ' || qname AS line FROM sym""")
_graph("test_paths", lambda g: g.files.select("path", expr.is_test_path(F.col("path")).alias("is_test")), "SELECT path, CAST(contains(path, '/tests/') AS BOOLEAN) AS is_test FROM cg_files")
_add("slugs", lambda s, d: table(s, d, "customer").select("c_custkey", expr.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug")),
     "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
_add("within_budget", lambda s, d: table(s, d, "part").select("p_partkey", expr.within_budget(F.to_json(F.struct("p_name", "p_brand")), 45).alias("response")), """
SELECT p_partkey, CASE WHEN length(j) > 45 THEN '{"error":"response_too_large","chars":' || CAST(length(j) AS STRING) || ',"limit":45}' ELSE j END AS response
FROM (SELECT p_partkey, '{"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}' AS j FROM part)""")

# composed answers
_graph("analyze_impact", lambda g: reports.analyze_impact(g, _spec(g), _roots(g)), """
SELECT r.root, (SELECT count(*) FROM split WHERE t_id = r.root AND bucket = 'callers') AS callers, (SELECT count(*) FROM split WHERE t_id = r.root AND bucket = 'test_callers') AS test_callers,
  (SELECT count(*) FROM split WHERE t_id = r.root AND bucket = 'ambiguous') AS ambiguous, (SELECT count(*) FROM best WHERE best.root = r.root AND depth > 1) AS indirect, risk FROM risks r""",
       PAIRS + WALK_UP + FEATURES + RISKS)
_graph("get_function", reports.function_info, f"""
, ce AS (SELECT DISTINCT s.id AS s, t.qname FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
  WHERE relation = 'calls' AND confidence <> 'ambiguous' AND s.id <> t.id AND t.type IN {SYM} AND (s.is_test OR NOT t.is_test))
SELECT f.id, coalesce((SELECT array_to_string(list_sort(list(DISTINCT s_qname))[1:15], ';') FROM split WHERE t_id = f.id AND bucket = 'callers'), '') AS callers,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT qname))[1:30], ';') FROM ce WHERE ce.s = f.id), '') AS callees,
  (SELECT count(*) - 1 FROM cg_nodes o WHERE o.name = f.name AND o.type IN {SYM}) AS others FROM cg_nodes f WHERE f.type IN {FUNC}""", PAIRS)
_graph("feature_info", lambda g: reports.feature_info(g, _spec(g)), f"""
, sp(feature, decisions, affected) AS (VALUES ('Promotions', 1, 1), ('Small', 1, 0), ('Economy tests', 0, 0), ('Standard', 2, 1), ('Everything odd', 0, 0), ('No patterns', 0, 0), ('Nowhere', 0, 0))
SELECT feature, (SELECT count(*) FROM ff WHERE ff.feature = sp.feature) AS files,
  (SELECT count(*) FROM ff JOIN cg_nodes n ON n.file_id = ff.id WHERE ff.feature = sp.feature AND type IN {FUNC} AND {VISIBLE}) AS functions,
  CAST(decisions AS INT) AS decisions, CAST(affected AS BIGINT) AS affected FROM sp""", FEATURES)
_graph("project_health", reports.project_health, f"""
SELECT 'chokepoint' AS kind, CAST(id AS STRING) AS subject, betweenness AS value FROM (SELECT * FROM bt WHERE betweenness > 0 ORDER BY betweenness DESC, id LIMIT 10)
UNION ALL SELECT DISTINCT 'import_cycle', CAST(component AS STRING), CAST(size AS DOUBLE) FROM scc
UNION ALL SELECT 'surprising', CAST(s_id AS STRING) || '->' || CAST(t_id AS STRING), CAST(score AS DOUBLE) FROM ({SURPRISING})""",
       BETWEEN.replace("AND s.id <> t.id)", "AND s.id <> t.id AND NOT s.is_test AND NOT t.is_test)", 1) + SCC)
TOUCHED = f"""hit AS (SELECT s.id, qname, count(DISTINCT (ch.path, line)) AS changed_lines FROM sym s
  JOIN (VALUES ('promo/b11.js', 13), ('promo/b11.js', 14), ('promo/b11.js', 15), ('small/b', 40), ('small/b', 42), ('ECONOMY/B2', 43), ('ECONOMY/B2', 33)) ch(path, line)
  ON s.path ILIKE '%' || ch.path || '%' AND line BETWEEN start_line AND end_line WHERE type IN {SYM} GROUP BY s.id, qname ORDER BY changed_lines DESC, s.id LIMIT 25),
roots AS (SELECT id FROM hit)"""
_graph("analyze_diff", lambda g: reports.analyze_diff(g, _spec(g), diff.changed_lines(g.files.sparkSession.createDataFrame([(1, DIFF)], "diff_id int, diff string"))),
       "SELECT hit.id, qname, changed_lines, callers, risk FROM hit JOIN risks ON root = hit.id", PAIRS + WALK_UP.replace(ROOTS, TOUCHED) + FEATURES + RISKS)
_graph("module_entries", modules.module_entries, f"""
SELECT split_part(f.path, '/', 1) AS module, count(DISTINCT f.id) AS files, count(*) FILTER (n.type IN {FUNC}) AS functions, count(*) FILTER (n.type = 'class') AS classes,
  count(*) FILTER (n.type NOT IN {SYM}) AS other, count(n.id) AS symbols, array_to_string(list_sort(list(DISTINCT split_part(f.path, '.', -1))), ', ') AS languages
FROM cg_files f LEFT JOIN cg_nodes n ON n.file_id = f.id GROUP BY 1""")
_graph("used_modules", lambda g: modules.used_modules(g)[0].select("module"), "SELECT DISTINCT split_part(f.path, '/', 1) AS module FROM cg_files f JOIN cg_nodes n ON n.file_id = f.id")
_graph("legacy_js_edges", incremental.legacy_js_edges, """
SELECT source_id, target_id FROM cg_edges JOIN sym s ON s.id = source_id JOIN sym t ON t.id = target_id
WHERE relation = 'calls' AND confidence = 'extracted' AND s.path LIKE '%.js' AND s.path <> t.path""")
_add("note_stats", lambda s, d: notes.stats(_notes(s, d), _note_symbols(s, d)).select("notes", "links"), NOTE_LINKS + """
SELECT (SELECT count(*) FROM nt) AS notes, (SELECT count(*) FROM (SELECT DISTINCT id, note FROM res WHERE note IS NOT NULL AND note <> id)) AS links""")
EMPTY_NOTE = "<!-- generated -->\n\nNote on **No patterns**, made from the specification; change it there.\n\nnothing yet"
_add("feature_notes", lambda s, d: notes.feature_notes(features.example_features(s), s.createDataFrame(
    [("feature-small", "by hand"), ("feature-standard", "x <!-- generated -->"), ("feature-no-patterns", EMPTY_NOTE)], "id string, content string")), """
WITH n(id, outcome, name, rest) AS (VALUES
  ('feature-promotions', 'created', 'Promotions', 'promoted parts|## Decisions|- DEC-001: decision DEC-001~  - Constraint: API contract stays stable|## Files|- `promo/**`'), ('feature-small', 'skipped', NULL, NULL),
  ('feature-economy-tests', 'created', 'Economy tests', 'tests|## Files|- `economy/tests/*`'),
  ('feature-standard', 'refreshed', 'Standard', 'standard parts|## Decisions|- DEC-003: decision DEC-003~  - Constraint: performance under 1 s~  - Constraint: auth required~- DEC-004: decision DEC-004~  - Constraint: none|## Files|- `standard/`~- `./small/b11.js`'),
  ('feature-everything-odd', 'created', 'Everything odd', 'odd brands|## Files|- `**/b?1.js`~- `**/b?3.js`|## Dependencies|- [[feature-small]]'),
  ('feature-no-patterns', 'unchanged', 'No patterns', 'nothing yet'), ('feature-nowhere', 'created', 'Nowhere', 'matches nothing|## Files|- `missing/**`'))
SELECT id, outcome, CASE WHEN name IS NULL THEN 'by hand' ELSE replace(replace('<!-- generated -->|Note on **' || name || '**, made from the specification; change it there.|' || rest, '|', chr(10) || chr(10)), '~', chr(10)) || chr(10) END AS content FROM n""")

# event time (an addition to the operators above)
_add("event_windows", lambda s, d: telemetry.tumbling(_calls(s, d), "1 day").select("start", "tool", "calls"),
     "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type AS tool, count(*) AS calls FROM events GROUP BY 1, 2")
_add("event_sessions", lambda s, d: telemetry.sessions(_calls(s, d), "6 hours").select("project_id", "start", "calls"), """
SELECT user_id AS project_id, min(ts) AS start, count(*) AS calls FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, k""")

# sources in small
PYTHON = (
    ("app/pay.py", "def pay(x):\n    return x\n"),
    ("app/pack/__init__.py", "from pack.impl import shown\n"),
    ("app/pack/impl.py", "def shown():\n    return 1\n\nclass Root:\n    def keep(self):\n        return shown()\n"),
    ("app/main.py", "from pay import pay as settle\nfrom pack import shown\nimport pack.impl\n\nclass Leaf(pack.impl.Root):\n    def go(self):\n        settle(1)\n"
                    "        return self.keep()\n\ndef top(pay):\n    pay(2)\n    shown()\n    Leaf.go()\n"),
)
_add("python_calls", lambda s, d: python_code.call_edges(s.createDataFrame(list(PYTHON), "path string, text string"), ("", "app/")), """
SELECT * FROM (VALUES ('app/pack/impl.py', 5, 'app/pack/impl.py', 1), ('app/main.py', 6, 'app/pay.py', 1), ('app/main.py', 6, 'app/pack/impl.py', 5),
  ('app/main.py', 10, 'app/pack/impl.py', 1), ('app/main.py', 10, 'app/main.py', 6)) t(s_path, s_line, t_path, t_line)""")


def _python_files(g: Graph) -> DataFrame:
    """(path, text): Python sources with the bound graph's functions and calls, f7 for node 7, imported in three ways."""
    fn = g.symbols.where(F.col("type").isin("function", "method") & F.col("path").like("%.py")).select("id", "path")
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    e = met(g.edges.where("relation = 'calls' AND source_id <> target_id").select("source_id", "target_id").distinct(),
            fn.select(F.col("id").alias("source_id"), F.col("path").alias("s_path")), "source_id")
    e = met(e, fn.select(F.col("id").alias("target_id"), F.col("path").alias("t_path")), "target_id")
    module, short = expr.module_path(F.col("t_path")), F.concat(F.lit("m"), F.crc32("t_path").cast("string"))
    way = F.when(F.col("s_path") == F.col("t_path"), 3).otherwise(F.col("target_id") % 3)
    e = e.select("*", F.when(way == 0, F.concat(F.lit("from "), module, F.lit(" import "), name("target_id")))
                 .when(way == 1, F.concat(F.lit("import "), module, F.lit(" as "), short)).when(way == 2, F.concat(F.lit("import "), module)).alias("head"),
                 F.concat(F.lit("    "), F.when(way == 1, F.concat(short, F.lit("."))).when(way == 2, F.concat(module, F.lit("."))).otherwise(""),
                          name("target_id"), F.lit("(x)\n")).alias("line"))
    lines = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "\n")
    heads = e.groupBy(F.col("s_path").alias("path")).agg(lines("head").alias("head"))
    body = e.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("body"))
    defs = met(fn, body, "id", "left").select("path", F.concat(F.lit("def "), name("id"), F.lit("(x):\n"), F.coalesce("body", F.lit("")), F.lit("    return x\n")).alias("def"))
    defs = defs.groupBy("path").agg(lines("def").alias("defs"))
    return defs.join(heads, "path", "left").select("path", F.concat_ws("\n\n", "head", "defs").alias("text"))


def _python_calls(g: Graph) -> DataFrame:
    files = stage(_python_files(g))
    known = stage(python_code.parse(files))
    at = known.where("kind = 'function'").select("path", "line", "name")
    calls = met(python_code.call_edges(files, known=known), at.toDF("s_path", "s_line", "caller"), ["s_path", "s_line"])
    return met(calls, at.toDF("t_path", "t_line", "callee"), ["t_path", "t_line"]).select("caller", "callee")


_graph("python_calls_of_files", _python_calls, f"""
SELECT DISTINCT 'f' || CAST(s.id AS STRING) AS caller, 'f' || CAST(t.id AS STRING) AS callee FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
WHERE relation = 'calls' AND s.id <> t.id AND s.type IN {FUNC} AND t.type IN {FUNC} AND s.path LIKE '%.py' AND t.path LIKE '%.py'""")

# answers with their lists


def _joined(df: DataFrame, *plain: str) -> DataFrame:
    """Lists as one text each, so that any engine compares them."""
    return df.select(*[F.array_join(c, ";").alias(c) if k.startswith("array") else F.col(c) for c, k in df.dtypes if not plain or c in plain or k.startswith("array")])


PLACES = f"""
, pl AS (SELECT id, name, file_id, path || ':' || CAST(start_line AS STRING) || ' ' || qname AS p, path || ':' || qname AS d FROM sym),
defs AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY is_test, qname <> name, length(path), start_line, id) AS k FROM sym WHERE type IN {SYM})"""
OTHERS = "coalesce((SELECT array_to_string(list(o.d ORDER BY x.k)[1:9], ';') FROM defs x JOIN pl o ON o.id = x.id WHERE x.name = s.name AND x.id <> s.id AND x.k <= 10), '') AS other_definitions"
IMPACT = f"""{PLACES},
far AS (SELECT root, id, depth, k, n > 200 AS more FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, id) AS k, count(*) OVER (PARTITION BY root) AS n FROM best WHERE depth > 1) WHERE k <= 200),
cl AS (SELECT t_id AS root, s_id, s_path, bucket, s_path || ':' || CAST(s_start_line AS STRING) || ' ' || s_qname AS p FROM split JOIN roots ON roots.id = t_id),
ck AS (SELECT root, bucket, count(*) AS n, count(DISTINCT s_path) AS files, list(p ORDER BY s_path, CAST(split_part(split_part(p, ' ', 1), ':', 2) AS INT), s_id) AS ps FROM cl GROUP BY ALL),
aff AS (SELECT root, s_id AS id FROM cl WHERE bucket = 'callers' UNION SELECT root, id FROM far),
fc AS (SELECT root, feature, count(*) AS n FROM (SELECT * FROM aff UNION SELECT id, id FROM roots) a JOIN cg_nodes n ON n.id = a.id JOIN owner o ON o.id = n.file_id GROUP BY ALL),
ad(feature, decision) AS (VALUES ('Promotions', 'DEC-001'), ('Standard', 'DEC-003')),
report AS (SELECT r.root, s.d AS symbol, risk AS risk_level, guessed, {OTHERS},
  coalesce(array_to_string(c.ps[1:50], ';'), '') AS callers, coalesce(c.n, 0) AS caller_count, coalesce(c.n, 0) > 50 AS callers_truncated, coalesce(c.files, 0) AS affected_files,
  coalesce(array_to_string(t.ps[1:10], ';'), '') AS test_callers, coalesce(t.n, 0) AS test_caller_count, coalesce(t.n, 0) > 10 AS test_callers_truncated,
  coalesce(array_to_string(a.ps[1:10], ';'), '') AS ambiguous_callers, coalesce(a.n, 0) AS ambiguous_caller_count, coalesce(a.n, 0) > 10 AS ambiguous_callers_truncated,
  coalesce((SELECT string_agg('depth ' || CAST(depth AS STRING) || ': ' || o.p, ';' ORDER BY k) FROM far JOIN pl o ON o.id = far.id WHERE far.root = r.root AND k <= 50), '') AS indirect_callers,
  (SELECT count(*) FROM far WHERE far.root = r.root) AS indirect_caller_count, (SELECT count(*) FROM far WHERE far.root = r.root) > 50 AS indirect_callers_truncated,
  coalesce((SELECT any_value(more) FROM far WHERE far.root = r.root), false) AS indirect_more, (SELECT count(*) FROM aff WHERE aff.root = r.root) AS affected_functions,
  coalesce((SELECT n FROM fc WHERE fc.root = r.root AND feature IS NULL), 0) AS unmapped_functions,
  coalesce((SELECT string_agg(feature || ':' || CAST(n AS STRING), ';' ORDER BY feature || ':' || CAST(n AS STRING)) FROM fc WHERE fc.root = r.root AND feature IS NOT NULL), '') AS features,
  coalesce((SELECT string_agg(DISTINCT decision, ';' ORDER BY decision) FROM fc JOIN ad USING (feature) WHERE fc.root = r.root), '') AS decisions
  FROM risks r JOIN pl s ON s.id = r.root LEFT JOIN ck c ON c.root = r.root AND c.bucket = 'callers' LEFT JOIN ck t ON t.root = r.root AND t.bucket = 'test_callers'
  LEFT JOIN ck a ON a.root = r.root AND a.bucket = 'ambiguous')"""
_graph("impact_report", lambda g: _joined(answers.impact(g, _spec(g), _roots(g))), "SELECT * FROM report", PAIRS + WALK_UP + FEATURES + RISKS + IMPACT)
_graph("indirect_capped", lambda g: answers.indirect_capped(g, _roots(g), 3, 40), """
SELECT root, CAST(k AS INT) AS k, depth, b.id, s.qname, s.path, s.start_line AS line, n > 40 AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, id) AS k, count(*) OVER (PARTITION BY root) AS n FROM best WHERE depth > 1) b JOIN sym s ON s.id = b.id WHERE k <= 40""", WALK_UP)
_graph("downstream_capped", lambda g: answers.downstream_capped(g, _roots(g)), """
SELECT root, CAST(k AS INT) AS k, depth, s.path || ':' || s.qname AS "from", "to", line, n > 60 AS more FROM (
  SELECT root, depth + 1 AS depth, a, t.path || ':' || t.qname AS "to", t.start_line AS line, count(*) OVER (PARTITION BY root) AS n,
    row_number() OVER (PARTITION BY root ORDER BY depth, a, t.path, t.start_line, b) AS k FROM best JOIN step ON a = best.id JOIN sym t ON t.id = b) e JOIN sym s ON s.id = a WHERE k <= 60""", WALK_DOWN)
_graph("impact_totals", lambda g: answers.impact_totals(g, _spec(g), _roots(g)), """
SELECT r.root, risk, count(*) FILTER (depth = 1) AS direct, count(depth) AS total, count(DISTINCT n.file_id) AS files
FROM risks r LEFT JOIN best b ON b.root = r.root AND depth > 0 LEFT JOIN cg_nodes n ON n.id = b.id GROUP BY r.root, risk""", PAIRS + WALK_UP + FEATURES + RISKS)
_graph("function_details", lambda g: _joined(answers.function_details(g)), f"""
, ce AS (SELECT DISTINCT s.id AS s, t.id AS t, t.path, t.start_line FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
  WHERE relation = 'calls' AND confidence <> 'ambiguous' AND s.id <> t.id AND t.type IN {SYM} AND (s.is_test OR NOT t.is_test)),
cd AS (SELECT s, count(*) AS n, list(pl.p ORDER BY path, start_line, t) AS ps FROM ce JOIN pl ON pl.id = t GROUP BY s),
cr AS (SELECT t_id, count(*) AS n, list(pl.p ORDER BY s_path, s_start_line, s_id) AS ps FROM split JOIN pl ON pl.id = s_id WHERE bucket = 'callers' GROUP BY t_id)
SELECT s.id, s.d AS symbol, coalesce(cr.n, 0) AS caller_count, coalesce(array_to_string(cr.ps[1:15], ';'), '') AS callers, coalesce(array_to_string(cd.ps[1:30], ';'), '') AS callees,
  {OTHERS}, coalesce(cd.n > 30, false) AS callees_truncated FROM pl s JOIN cg_nodes f ON f.id = s.id AND f.type IN {FUNC} LEFT JOIN cr ON cr.t_id = s.id LEFT JOIN cd ON cd.s = s.id""", PAIRS + PLACES)
_graph("feature_details", lambda g: _joined(answers.feature_details(g, _spec(g))), f"""
, sp(feature, decisions, affected_decisions, dependencies) AS (VALUES ('Promotions', 'DEC-001', 'DEC-001', ''), ('Small', 'DEC-002', '', 'Promotions'), ('Economy tests', '', '', ''),
  ('Standard', 'DEC-003;DEC-004', 'DEC-003', ''), ('Everything odd', '', '', 'Small'), ('No patterns', '', '', ''), ('Nowhere', '', '', '')),
f1 AS (SELECT feature, count(*) AS n, list(path ORDER BY path) AS l FROM ff GROUP BY feature),
f2 AS (SELECT feature, count(*) AS n, list(s.path || ':' || CAST(s.start_line AS STRING) || ' ' || s.qname ORDER BY s.path, s.start_line, s.id) AS l FROM ff JOIN sym s ON s.file_id = ff.id
  WHERE s.type IN {FUNC} AND {VISIBLE} GROUP BY feature)
SELECT sp.*, coalesce(array_to_string(f1.l[1:50], ';'), '') AS files, coalesce(f1.n > 50, false) AS files_truncated, coalesce(array_to_string(f2.l[1:50], ';'), '') AS functions,
  coalesce(f2.n > 50, false) AS functions_truncated FROM sp LEFT JOIN f1 USING (feature) LEFT JOIN f2 USING (feature)""", FEATURES)
_graph("alignment_details", lambda g: _joined(answers.alignment_details(g, _spec(g)), "feature", "issues", "fully_aligned", "covered_files_truncated", "function_names_truncated"), f"""
, sp(feature, decision_ids, constraint_texts, patterns) AS (VALUES ('Promotions', 'DEC-001', 'must not block', 1), ('Small', 'DEC-002', '', 1), ('Economy tests', '', 'must not call network', 1),
  ('Standard', 'DEC-003;DEC-004', '', 2), ('Everything odd', '', '', 2), ('No patterns', '', '', 0), ('Nowhere', '', '', 1)),
f1 AS (SELECT feature, count(*) AS n, list(path ORDER BY path) AS l FROM ff GROUP BY feature),
f2 AS (SELECT feature, count(*) AS n, list(s.qname ORDER BY s.path, s.start_line, s.id) AS l FROM ff JOIN sym s ON s.file_id = ff.id WHERE s.type IN {SYM} GROUP BY feature),
iss AS (SELECT sp.*, f1.l AS fl, f1.n AS fn, f2.l AS nl, f2.n AS nn, concat_ws(',', CASE WHEN patterns = 0 THEN 'no_patterns' END, CASE WHEN patterns > 0 AND f1.n IS NULL THEN 'no_files' END,
  CASE WHEN decision_ids = '' THEN 'no_decisions' END) AS issues FROM sp LEFT JOIN f1 USING (feature) LEFT JOIN f2 USING (feature))
SELECT feature, issues, issues = '' AS fully_aligned, coalesce(array_to_string(fl[1:50], ';'), '') AS covered_files, coalesce(fn > 50, false) AS covered_files_truncated,
  coalesce(array_to_string(nl[1:50], ';'), '') AS function_names, coalesce(nn > 50, false) AS function_names_truncated, decision_ids, constraint_texts FROM iss""", FEATURES)
_graph("diff_details", lambda g: _joined(answers.diff_details(g, _spec(g), diff.changed_lines(g.files.sparkSession.createDataFrame([(1, DIFF)], "diff_id int, diff string")), 50, 3),
                                         "id", "symbol", "changed_lines", "files_truncated", "symbols_truncated", "caller_count", "risk_level").drop("indirect_callers", "other_definitions"), """
SELECT hit.id, symbol, changed_lines, false AS files_truncated, (SELECT count(*) FROM everyhit) > 3 AS symbols_truncated, caller_count, risk_level, callers, test_callers, ambiguous_callers, features, decisions
FROM hit JOIN report ON root = hit.id""", PAIRS + WALK_UP.replace(ROOTS, TOUCHED.replace("LIMIT 25", "LIMIT 3").replace("hit AS (", "everyhit AS (").replace(
    "ORDER BY changed_lines DESC, s.id LIMIT 3)", "), hit AS (SELECT * FROM everyhit ORDER BY changed_lines DESC, id LIMIT 3)")).replace("depth < 3", "depth < 1") + FEATURES + RISKS + IMPACT)
_graph("trace_report", lambda g: _joined(answers.trace_report(g, *_two(g)), "leg", "truncated"), """
SELECT leg, array_to_string(list(s_path || ':' || s_name || ' -> ' || t_path || ':' || t_name || ' (' || relation || ')' ORDER BY s_path, s_name, relation, t_path, t_name)[1:(CASE leg WHEN 'direct' THEN 20 ELSE 10 END)], ';') AS edges,
  count(*) > CASE leg WHEN 'direct' THEN 20 ELSE 10 END AS truncated FROM tl WHERE leg IS NOT NULL GROUP BY leg""", TRACE)
_graph("import_loops", lambda g: answers.loops(algo.node_imports(g), algo.components(algo.node_imports(g))).select(
    "component", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle")), """
, bk AS (SELECT im.s, im.t, a.component FROM im JOIN scc a ON a.id = im.s JOIN scc b ON b.id = im.t AND b.component = a.component),
lp AS (SELECT DISTINCT component AS root, component AS id, 0 AS depth FROM scc UNION SELECT root, bk.t, depth + 1 FROM lp JOIN bk ON bk.s = lp.id WHERE depth < 12),
ds AS (SELECT root, id, min(depth) AS depth FROM lp GROUP BY ALL),
la AS (SELECT root, arg_min(ds.id, (ds.depth, ds.id)) AS id, min(depth) AS depth FROM ds JOIN bk ON bk.s = ds.id AND bk.t = root GROUP BY root),
pr AS (SELECT d.root, d.id, min(bk.s) AS p FROM ds d JOIN bk ON bk.t = d.id JOIN ds n ON n.root = d.root AND n.id = bk.s AND n.depth = d.depth - 1 GROUP BY d.root, d.id),
ch AS (SELECT root, id, depth, CAST(id AS STRING) AS cycle FROM la UNION ALL SELECT ch.root, p, depth - 1, CAST(p AS STRING) || '>' || cycle FROM ch JOIN pr ON pr.root = ch.root AND pr.id = ch.id WHERE depth > 0)
SELECT root AS component, cycle FROM ch WHERE depth = 0""", SCC)
_graph("tour", lambda g: _joined(answers.tour(g), "path", "level", "role", "in_cycle"), f"""
, im AS (SELECT DISTINCT s.file_id AS s, t.file_id AS t FROM cg_edges e JOIN cg_nodes s ON s.id = e.source_id JOIN cg_nodes t ON t.id = e.target_id WHERE relation = 'imports' AND s.file_id <> t.file_id),
{SCC[SCC.index("reach AS"):]},
ids AS (SELECT id, coalesce(component, id) AS c, component IS NOT NULL AS in_cycle FROM (SELECT s AS id FROM im UNION SELECT t FROM im) LEFT JOIN scc USING (id)),
ce AS (SELECT DISTINCT a.c AS a, b.c AS b FROM im JOIN ids a ON a.id = im.s JOIN ids b ON b.id = im.t WHERE a.c <> b.c),
lv AS (SELECT DISTINCT c, 0 AS level FROM ids UNION SELECT ce.a, level + 1 FROM lv JOIN ce ON ce.b = lv.c),
up AS (SELECT s AS id, array_to_string(list(path ORDER BY path)[1:10], ';') AS l FROM im JOIN cg_files f ON f.id = t GROUP BY s),
dn AS (SELECT t AS id, array_to_string(list(path ORDER BY path)[1:10], ';') AS l FROM im JOIN cg_files f ON f.id = s GROUP BY t),
cc AS (SELECT t.id AS id, t.file_id, t.qname, count(DISTINCT s.id) AS callers {COUNTED} GROUP BY ALL),
ks AS (SELECT file_id AS id, array_to_string(list(qname ORDER BY callers DESC, id)[1:3], ';') AS l FROM cc GROUP BY file_id),
o AS (SELECT id, max(level) AS level, in_cycle FROM ids JOIN lv USING (c) GROUP BY id, in_cycle)
SELECT path, level, CASE WHEN level = 0 THEN 'foundational' WHEN dn.l IS NULL THEN 'entry' ELSE 'core' END AS role, in_cycle, coalesce(up.l, '') AS depends_on, coalesce(dn.l, '') AS depended_on_by, coalesce(ks.l, '') AS key_symbols
FROM o JOIN cg_files f ON f.id = o.id LEFT JOIN up ON up.id = o.id LEFT JOIN dn ON dn.id = o.id LEFT JOIN ks ON ks.id = o.id""")
_add("note_report", lambda s, d: _joined(notes.stats(_notes(s, d), _note_symbols(s, d)), "notes", "links", "mentions"), NOTE_LINKS + r""",
said AS (SELECT DISTINCT id, m FROM (SELECT id, unnest(list_concat(regexp_extract_all(content, '@([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)', 1), regexp_extract_all(content, '@([\w./-]+\.[A-Za-z0-9]+)', 1))) AS m FROM nt)
  WHERE contains(m, '.') OR contains(m, '_') OR length(regexp_replace(m, '[^A-Z]', '', 'g')) >= 2),
known AS (SELECT 'C' || CAST(n_nationkey % 60 AS STRING) || '.' || n_name AS m FROM nation WHERE n_nationkey % 2 = 0)
SELECT (SELECT count(*) FROM nt) AS notes, (SELECT count(*) FROM (SELECT DISTINCT id, note FROM res WHERE note IS NOT NULL AND note <> id)) AS links, (SELECT count(*) FROM said WHERE m IN (SELECT m FROM known)) AS mentions,
  coalesce((SELECT string_agg(DISTINCT target, ';' ORDER BY target) FROM res WHERE note IS NULL), '') AS unresolved_links, coalesce((SELECT string_agg(DISTINCT m, ';' ORDER BY m) FROM said WHERE m NOT IN (SELECT m FROM known)), '') AS unresolved_mentions""")

# upkeep of notes, edges and files


def _divergence(g: Graph) -> DataFrame:
    own = features.file_owner(_spec(g), g.files).select(F.col("id").alias("file_id"), "feature")
    code = F.concat(F.lit("def "), "name", F.when(F.col("id") % 3 == 0, "(): Call NETWORK").when(F.col("id") % 3 == 1, "(): block()").otherwise("(): pass"))
    return features.divergence(_spec(g), g.nodes.join(own, "file_id").select("id", "feature", code.alias("code")))


_graph("divergence", _divergence, """
SELECT n.id, feature, c AS "constraint" FROM cg_nodes n JOIN owner ON owner.id = n.file_id JOIN (VALUES ('Promotions', 'must not block', 1), ('Economy tests', 'must not call network', 0)) v(f, c, r) ON f = feature AND n.id % 3 = r""", FEATURES)
_add("feature_search", lambda s, d: features.search_features(features.example_features(s), "PART"),
     "SELECT * FROM (VALUES ('Promotions', 0), ('Small', 1), ('Standard', 3)) t(name, ordinal)")
_graph("search_named_first", lambda g: search.named_first(g.symbols.select("id", F.col("qname").alias("name"), F.row_number().over(Window.orderBy("id")).alias("rank")).where("rank <= 200"), "Blue_Widget", 5), """
SELECT id, qname AS name, CAST(rank AS INT) AS rank FROM (SELECT id, qname, row_number() OVER (ORDER BY id) AS rank FROM sym) WHERE rank <= 30
ORDER BY lower(qname) = 'blue_widget' OR lower(split_part(qname, '.', -1)) = 'blue_widget' DESC, rank LIMIT 5""")
_add("search_code", lambda s, d: search.typed(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("def f(a: "), "p_brand", F.lit(", b: int) -> "), "p_type").alias("signature")),
                                              returns="promo", params=["BRAND#12"]), """
SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_type), 'promo') AND contains(lower(p_brand), 'brand#12') ORDER BY length(p_name), p_partkey LIMIT 20""")
_add("sync_guidance", lambda s, d: table(s, d, "events").select("event_id", usage.sync_guidance(
    F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("done"), F.col("user_id") % 2 == 0, F.col("event_id") % 100).alias("said")), """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'Sync running for ' || CAST(event_id % 100 AS STRING) || ' s; call again later.' WHEN event_type = 'error' THEN 'The last sync failed; start it again.'
  WHEN user_id % 2 = 0 THEN 'The index is ready.' ELSE 'No index yet; start a sync.' END AS said FROM events""")
_add("sanitized_ids", lambda s, d: table(s, d, "customer").select("c_custkey", expr.sanitized_id(F.concat(F.lit("  "), "c_name", F.lit(" / "), "c_mktsegment")).alias("project")),
     "SELECT c_custkey, regexp_replace(lower(trim('  ' || c_name || ' / ' || c_mktsegment)), '[^a-z0-9_-]+', '-', 'g') AS project FROM customer")
_graph("described_symbols", lambda g: g.symbols.select("id", expr.described(F.col("path"), F.col("qname")).alias("d")), "SELECT id, path || ':' || qname AS d FROM sym")


def _versions(g: Graph) -> tuple[DataFrame, DataFrame]:
    before = g.files.where("id % 5 <> 1").select("path", F.concat("path", F.lit("|"), (F.col("id") % 3).cast("string")).alias("hash"))
    return before, g.files.where("id % 7 <> 2").select("path", F.concat("path", F.lit("|"), F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("id") % 3).cast("string")).alias("hash"))


_graph("changed_files", lambda g: incremental.changed_files(*_versions(g)), """
SELECT path, CASE WHEN id % 5 = 1 THEN 'new' WHEN id % 7 = 2 THEN 'gone' ELSE 'changed' END AS change FROM cg_files
WHERE (id % 5 = 1 AND id % 7 <> 2) OR (id % 5 <> 1 AND id % 7 = 2) OR (id % 5 <> 1 AND id % 7 <> 2 AND id % 4 = 0)""")
_graph("replace_owned", lambda g: incremental.replace_owned(
    g.edges.withColumn("metadata", F.when(F.col("target_id") % 3 == 0, '{"caller":1}')).select("source_id", "target_id", "relation", "metadata", "confidence"), '{"caller"',
    g.edges.where("relation = 'calls' AND source_id % 2 = 0").withColumn("metadata", F.lit('{"caller":2}')).withColumn("confidence", F.lit("extracted"))).groupBy(
        "relation", "metadata", "confidence").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("source_id") * 7 + F.col("target_id")).alias("digest")), """
, rest AS (SELECT source_id, target_id, relation, NULL AS metadata, confidence FROM cg_edges WHERE target_id % 3 <> 0),
want AS (SELECT DISTINCT source_id, target_id, relation, '{"caller":2}' AS metadata, 'extracted' AS confidence FROM cg_edges w WHERE relation = 'calls' AND source_id % 2 = 0
  AND NOT EXISTS (SELECT 1 FROM rest r WHERE r.confidence <> 'ambiguous' AND r.source_id = w.source_id AND r.target_id = w.target_id AND r.relation = w.relation))
SELECT relation, metadata, confidence, count(*) AS edges, CAST(sum(source_id * 7 + target_id) AS BIGINT) AS digest FROM (SELECT * FROM rest UNION ALL SELECT * FROM want) GROUP BY ALL""")
_add("relink_due", lambda s, d: incremental.relink_due(
    s.createDataFrame([("py", "1"), ("js", "1"), ("ts", "1")], "language string, digest string"), s.createDataFrame([("py", "2"), ("js", "1"), ("ts", "2"), ("go", "1")], "language string, digest string"),
    s.createDataFrame([("ts", "2024-01-01 00:00:30"), ("go", "2024-01-01 00:00:00"), ("py", "2023-12-31 00:00:00")], "language string, failed_at string").withColumn("failed_at", F.to_timestamp("failed_at")),
    F.lit("2024-01-01 00:01:00").cast("timestamp")), "SELECT * FROM (VALUES ('py'), ('go')) t(language)")


def _note_changes(s: SparkSession, d: str) -> DataFrame:
    kept = "id string, title string, content string, tags array<string>, created_at string, updated_at string, is_code_note boolean"
    changes = s.createDataFrame([("nation-nation_3", None, "changed", None, "2030-01-01", "2030-01-01", None), ("note-new", "New\nnote", "text", ["x"], "2030-01-01", "2030-01-01", False)], kept)
    return notes.delete(notes.upsert(_notes(s, d), changes), s.createDataFrame([("region-asia",)], "id string"))


_add("note_upkeep", lambda s, d: _joined(_note_changes(s, d)), NOTES_CTE + """
SELECT id, title, CASE WHEN id = 'nation-nation_3' THEN 'changed' ELSE content END AS content, replace(tag_list, ',', ';') AS tags, '2024-01-01' AS created_at,
  CASE WHEN id = 'nation-nation_3' THEN '2030-01-01' ELSE '2024-01-01' END AS updated_at, is_code_note FROM nt WHERE id <> 'region-asia'
UNION ALL SELECT 'note-new', 'New note', 'text', 'x', '2030-01-01', '2030-01-01', false""")


def _node_edges(g: Graph) -> DataFrame:
    files = stage(_python_files(g))
    known = stage(python_code.parse(files))
    at = known.where("kind = 'function'").select("path", F.col("line").alias("start_line"), F.regexp_extract("name", "f(.*)", 1).cast("bigint").alias("id"))
    nodes = at.join(g.files.select("path", F.col("id").alias("file_id")), "path").drop("path").join(g.nodes.select("id", "type", "name", "qualified_name"), "id")
    return python_code.node_edges(python_code.call_edges(files, known=known), nodes, g.files)


_graph("edges_of_files", _node_edges, f"""
SELECT DISTINCT s.id AS source_id, t.id AS target_id, 'calls' AS relation, '{{"caller":"' || s.qname || '"}}' AS metadata, 'extracted' AS confidence FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
WHERE relation = 'calls' AND s.id <> t.id AND s.type IN {FUNC} AND t.type IN {FUNC} AND s.path LIKE '%.py' AND t.path LIKE '%.py'""")
URLS = (
    ("web/urls.py", "from django.urls import include, path\nfrom web import views\nurlpatterns = [path('api/', include('web.api')), path('u/<int:pk>/', views.User.as_view())]\n"),
    ("web/api.py", "from web import views\nfrom rest_framework.routers import DefaultRouter\nr = DefaultRouter()\nr.register('orders', views.Orders)\n"
                   "urlpatterns = [path('ping/', views.ping)] + r.urls\nurlpatterns += [path('', include(r.urls))]\n"),
    ("web/views.py", "from rest_framework import viewsets\n\n@api_view(['GET', 'HEAD'])\ndef ping(request):\n    return answer(1)\n\nclass User:\n    def get(self):\n        pass\n\n"
                     "class Orders(viewsets.ReadOnlyModelViewSet):\n    def retrieve(self):\n        return self.one()\n\n    @action(detail=True, methods=['post'], url_path='cancel')\n"
                     "    def cancel_order(self):\n        return self.one()\n\n    @action(detail=False)\n    def recent(self):\n        pass\n\n    def one(self):\n        return answer(2)\n\n"
                     "def answer(x):\n    return deeper(x)\n\ndef deeper(x):\n    return x\n"),
)


def _served(s: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    src = s.createDataFrame(list(URLS), "path string, text string")
    mods, known = python_code.module_index(src), python_code.parse(src)
    found = routes.patterns(src)
    return routes.expand(found, mods, routes.root_files(src, found, mods), known), known, mods


_add("route_match", lambda s, d: routes.match(_served(s)[0], s.createDataFrame(
    [("GET /api/ping/",), ("GET api/orders/7/",), ("POST /api/orders/7/cancel/?x=1",), ("/api/orders/recent/",), ("DELETE /api/orders/7/",), ("/u/12/",), ("/u/abc/",), ("/none",)],
    "request string")).select("request", "display", "method", "loose"), """
SELECT * FROM (VALUES ('GET /api/ping/', 'api/ping/', 'ANY', false), ('GET api/orders/7/', 'api/orders/<pk>/', 'GET', false), ('POST /api/orders/7/cancel/?x=1', 'api/orders/<pk>/cancel/', 'POST', false),
  ('/api/orders/recent/', 'api/orders/<pk>/', 'GET', false), ('DELETE /api/orders/7/', 'api/orders/<pk>/', 'GET', false), ('/u/12/', 'u/<pk>/', 'ANY', false),
  ('/u/abc/', 'u/<pk>/', 'ANY', true)) t(request, display, method, loose)""")
_add("route_handlers", lambda s, d: routes.handlers(*_served(s)).select("display", "method", "handler", "line", "inherited").distinct(), """
SELECT * FROM (VALUES ('api/ping/', 'GET', 'ping', 3, false), ('api/ping/', 'HEAD', 'ping', 3, false), ('u/<pk>/', 'GET', 'User.get', 8, false), ('api/orders/<pk>/', 'GET', 'Orders.retrieve', 12, false),
  ('api/orders/', 'GET', 'Orders.list', 11, true), ('api/orders/<pk>/cancel/', 'POST', 'Orders.cancel_order', 15, false), ('api/orders/recent/', 'GET', 'Orders.recent', 19, false)) t(display, method, handler, line, inherited)""")


def _route_chains(s: SparkSession) -> DataFrame:
    found, known, mods = _served(s)
    served = routes.handlers(found, known, mods)
    calls = python_code.call_edges(s.createDataFrame(list(URLS), "path string, text string"))
    return routes.chains(served, calls).join(served.select("ordinal", "method", "display").distinct(), ["ordinal", "method"]).select(
        "display", "method", "depth", "s_line", "t_line").distinct()


_add("route_chains", lambda s, d: _route_chains(s), """
SELECT * FROM (VALUES ('api/ping/', 'GET', 1, 3, 26), ('api/ping/', 'HEAD', 1, 3, 26), ('api/ping/', 'GET', 2, 26, 29), ('api/ping/', 'HEAD', 2, 26, 29),
  ('api/orders/<pk>/', 'GET', 1, 12, 23), ('api/orders/<pk>/', 'GET', 2, 23, 26), ('api/orders/<pk>/', 'GET', 3, 26, 29),
  ('api/orders/<pk>/cancel/', 'POST', 1, 15, 23), ('api/orders/<pk>/cancel/', 'POST', 2, 23, 26), ('api/orders/<pk>/cancel/', 'POST', 3, 26, 29)) t(display, method, depth, s_line, t_line)""")
JS = (("src/a.js", "import Loader from './lib/loader';\nthis.x = new Loader();\nthis.x.run();\nbus.execute('load');\n"), ("src/lib/loader.js", "export class Loader {}\nbus.register('load', onLoad);\n"),
      ("old/loader.js", "class Loader {}\n"))
_add("js_classes", lambda s, d: js_code.created_classes(js_code.facts(s.createDataFrame(list(JS), "path string, text string"))),
     "SELECT 'src/a.js' AS path, 2 AS line, 'Loader' AS name, 'src/lib/loader.js' AS class_path")
_add("js_commands", lambda s, d: js_code.command_edges(js_code.facts(s.createDataFrame(list(JS), "path string, text string"))),
     "SELECT 'src/a.js' AS path, 4 AS line, 'load' AS command, 'onLoad' AS handler, 'src/lib/loader.js' AS handler_path")
_add("js_property_calls", lambda s, d: js_code.property_calls(js_code.facts(s.createDataFrame(list(JS), "path string, text string"))),
     "SELECT 'src/a.js' AS path, 3 AS line, 'Loader' AS class_name, 'run' AS method")


def _js_files(g: Graph) -> DataFrame:
    """(path, text): JavaScript sources in which each file's class keeps an object of the class of every file that its nodes call."""
    files = g.files.where("path LIKE '%.js'").select("id", "path")
    js = g.symbols.select("id", "file_id", "path").where("path LIKE '%.js'")
    e = g.edges.where("relation = 'calls'").join(js.toDF("source_id", "s_file", "s_path"), "source_id").join(js.toDF("target_id", "t_file", "t_path"), "target_id").where(
        "s_file <> t_file").select("s_file", "s_path", "t_file", "t_path").distinct()
    c, stem = F.concat(F.lit("C"), F.col("t_file").cast("string")), F.regexp_replace("t_path", "[.]js$", "")
    back = F.repeat(F.lit("../"), F.size(F.split("s_path", "/")) - 1)
    e = e.select("s_file", F.concat(F.lit("import "), c, F.lit(" from '"), F.when(F.col("t_file") % 2 == 0, F.concat(back, stem)).otherwise(F.concat(F.lit("@/"), stem, F.lit(".js"))), F.lit("';")).alias("head"),
                 F.concat(F.lit("    this.p"), F.col("t_file").cast("string"), F.lit(" = new "), c, F.lit("();")).alias("make"),
                 F.concat(F.lit("    this.p"), F.col("t_file").cast("string"), F.lit(".go();")).alias("use"))
    lines = lambda x: F.array_join(F.sort_array(F.collect_list(x)), "\n")
    e = e.groupBy(F.col("s_file").alias("id")).agg(*[lines(x).alias(x) for x in ("head", "make", "use")])
    name = F.concat(F.lit("C"), F.col("id").cast("string"))
    text = F.concat(F.coalesce("head", F.lit("")), F.lit("\n// not new Ghost()\nexport default class "), name, F.lit(" {\n  constructor() {\n    const rx = /new [{'\"]/;\n"), F.coalesce("make", F.lit("")),
                    F.lit("\n  }\n  go() { return `new ${this.x}`; }\n  run() {\n    this.go();\n"), F.coalesce("use", F.lit("")), F.lit("\n  }\n}\n"))
    return files.join(e, "id", "left").select("path", text.alias("text"))


def _js_links(g: Graph) -> DataFrame:
    files = stage(_js_files(g))
    found = stage(js_code.facts(files))
    made = js_code.created_classes(found, files).select("path", "class_path", F.lit("create").alias("kind"))
    classes, imports = found.where("kind = 'class'"), js_code.imported(found, files)
    used = js_code.class_of(js_code.property_calls(found).where("method = 'go'").withColumnRenamed("class_name", "name"), classes, imports)
    own = found.where("kind = 'own_call' AND name = 'go'").select("path", F.col("path").alias("class_path"), F.lit("own").alias("kind"))
    return made.unionByName(used.select("path", "class_path", F.lit("property").alias("kind"))).unionByName(own).distinct()


_graph("js_links_of_files", _js_links, """
, e AS (SELECT DISTINCT s.path AS path, t.path AS class_path FROM cg_edges e JOIN sym s ON s.id = e.source_id JOIN sym t ON t.id = e.target_id
  WHERE relation = 'calls' AND s.path LIKE '%.js' AND t.path LIKE '%.js' AND s.file_id <> t.file_id)
SELECT path, class_path, unnest(['create', 'property']) AS kind FROM e UNION ALL SELECT path, path, 'own' FROM cg_files WHERE path LIKE '%.js'""")
_add("spec_decisions", lambda s, d: readers.spec(s.createDataFrame([("## Feature: A\nText\n### Decisions\n- DEC-1: x (because: y)\n- z\n## Other\n## Feature: B\n- **Decisions**: w\n",)], "text string")).selectExpr(
    "name", "explode(decisions) AS d").selectExpr("name", "d.id", "d.description", "d.rationale"), """
SELECT * FROM (VALUES ('A', 'DEC-1', 'x', 'y'), ('A', 'GEN-001', 'z', ''), ('B', 'GEN-002', 'w', '')) t(name, id, description, rationale)""")
_add("report_references", lambda s, d: readers.report_lines(s.createDataFrame([(1, "References:\n  calls C.m (a/b.py:12)\n  imports x (c.py:3-9)\nend")], "report_id int, text string"), "reference").drop("report_id"), """
SELECT * FROM (VALUES (1, 'calls', 'C.m', 'a/b.py:12'), (2, 'imports', 'x', 'c.py:3-9')) t(pos, relation, name, location)""")
REPORT = """Impact: C.m — Risk: HIGH
3 direct, 7 callers total, 2 files, 1 routes
  run (function) a/b.py:12
    go (method) c.py:3
  ← called by: work (a/b.py:7) [extracted]
  [calls] C.m (a/b.py:12)
Modules:
src (3 files, 10 symbols, Python)
lib (1 file, 0 symbols)
Depends on:
  x/y.js (4 symbols)
Depended by:
  z.ts (depth 2)
Dependencies:
  src → lib (5 imports)
  function: a, b (2×)
fn C.m  a/b.py:9-21  (x, y) -> z
error: no such file
{"x": 1}"""
FORMS = ("impact_head", "impact_counts", "impact_caller", "called_by", "tagged_reference", "module_map", "module_imports", "names_by_kind", "symbol")


def _forms(s: SparkSession) -> DataFrame:
    r = s.createDataFrame([(1, REPORT)], "report_id int, text string")
    rows = [readers.report_lines(r, shape).select(F.lit(shape).alias("shape"), "pos", F.concat_ws("|", *[F.trim(n) for n in readers.LINES[shape][1]]).alias("fields")) for shape in FORMS]
    rows += [readers.under(r, shape, ["Depends on", "Depended by", "Dependencies"]).select(F.lit(shape).alias("shape"), "pos", F.concat_ws("|", "heading", *readers.LINES[shape][1]).alias("fields"))
             for shape in ("file_symbols", "file_depth")]
    rows.append(readers.said(r).select(F.lit("said").alias("shape"), F.lit(-1).alias("pos"), F.col("message").alias("fields")))
    tour = s.createDataFrame([(2, '{"reading_order": [{"path": "a.py", "role": "entry"}, {"path": "b.py", "in_cycle": true}]}'), (3, "error"), (4, '{"reading_order": 7}')], "report_id int, text string")
    rows.append(readers.enveloped(tour, "reading_order", "path string, role string, in_cycle boolean").select(
        F.lit("tour").alias("shape"), "pos", F.concat_ws("|", "path", F.coalesce("role", F.lit("-")), F.coalesce(F.col("in_cycle").cast("string"), F.lit("-"))).alias("fields")))
    return reduce(DataFrame.unionByName, rows)


_add("report_forms", lambda s, d: _forms(s), """
SELECT * FROM (VALUES ('impact_head', 0, 'C.m|HIGH'), ('impact_counts', 1, '3|7|2|1'), ('impact_caller', 2, '|run|function|a/b.py:12'), ('impact_caller', 3, '|go|method|c.py:3'),
  ('called_by', 4, 'work|a/b.py:7|extracted'), ('tagged_reference', 5, 'calls|C.m|a/b.py:12'), ('module_map', 7, 'src|3|10|Python'), ('module_map', 8, 'lib|1|0|'), ('file_symbols', 10, 'Depends on|x/y.js|4'),
  ('file_depth', 12, 'Depended by|z.ts|2'), ('module_imports', 14, 'src|lib|5'), ('names_by_kind', 15, 'function|a, b|2'), ('symbol', 16, 'fn|C.m|a/b.py:9-21|(x, y) -> z'), ('said', -1, 'no such file'),
  ('tour', 0, 'a.py|entry|-'), ('tour', 1, 'b.py|-|true')) t(shape, pos, fields)""")


# sources, streams and specifications made of the tables


def _followed_tree(s: SparkSession, d: str) -> DataFrame:
    """Functions of a tree of a file per user and a function per event, after a first state, edits, and files that vanish."""
    folder, facts = scratch(s), scratch(s)
    e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    path = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit("/m"), F.col("user_id").cast("string"), F.lit(".py"))
    line = F.concat(F.lit("def e"), F.col("event_id").cast("string"), F.lit("():\n    pass\n"))
    body = lambda rows: rows.groupBy(path.alias("path")).agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("text"))
    tree.write_files(body(e.where("ts < '2024-01-10'")), folder)
    tree.refresh(s, folder, facts, python_code.parse, python_code.FACTS)
    ends = e.groupBy(path.alias("path")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    tree.write_files(body(e).join(ends, "path").select("path", F.when(F.col("last") != "error", F.col("text")).alias("text")), folder)
    return tree.fresh(s, folder, facts, python_code.parse, python_code.FACTS).where("kind = 'function'").select("path", "name")


_add("followed_tree", _followed_tree, """
SELECT 'u' || CAST(user_id % 10 AS STRING) || '/m' || CAST(user_id AS STRING) || '.py' AS path, 'e' || CAST(event_id AS STRING) AS name FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error')""")


def _streamed_ring(s: SparkSession, d: str) -> DataFrame:
    """The ring after the calls came in five batches, in no order of time."""
    inbox, held, checkpoint = scratch(s), scratch(s), scratch(s)
    calls = _calls(s, d)
    for k in range(5):
        calls.where(F.pmod(F.xxhash64("call_id"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(inbox)
    rings.follow_rings(telemetry.read_calls(s, inbox, files_per_trigger=1), held, checkpoint).awaitTermination()
    return rings.last_calls(s, held).select("call_id", "tool", "project_id", "ok", "duration_ms", "at")


_add("usage_ring_streamed", _streamed_ring, ORACLES["usage_ring"])


def _specifications(s: SparkSession, d: str) -> DataFrame:
    """(text): a specification per region, a feature per nation; its customers' segments are decisions, its suppliers files."""
    segments = table(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
    because = F.concat(F.lit("- "), "c_mktsegment", F.lit(" first (because: sold there)\n  - Constraint: keep "), F.lower("c_mktsegment"))
    decided = segments.groupBy("n_nationkey").agg(F.array_join(F.sort_array(F.collect_list(because)), "\n").alias("decided"))
    files = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda k: F.concat(F.lit("`s/"), k.cast("string"), F.lit(".py`"))), ", ").alias("files"))
    n = table(s, d, "nation").join(decided, "n_nationkey", "left").join(files, "n_nationkey", "left")
    text = F.concat(F.lit("## Feature: **"), "n_name", F.lit("**\nSells in "), "n_name", F.lit(".\n- **Files**: "), F.coalesce("files", F.lit("")), F.lit("\n### Decisions\n- D-"),
                    F.col("n_nationkey").cast("string"), F.lit(": open\n"), F.coalesce("decided", F.lit("")), F.lit("\n### Dependencies\n- Feature: R"), F.col("n_regionkey").cast("string"), F.lit("\n"))
    return n.groupBy("n_regionkey").agg(F.concat(F.lit("# All\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", text.alias("t")))), lambda x: x["t"]), "\n## Notes\n- none\n")).alias("text"))


_add("spec_features", lambda s, d: readers.spec(_specifications(s, d)).select(
    "name", "ordinal", "description", F.array_join(F.transform("decisions", lambda x: F.concat_ws("|", x["id"], x["description"], x["rationale"], F.array_join(x["constraints"], ","))), ";").alias("decisions"),
    F.array_join("file_patterns", ",").alias("files"), F.array_join("dependencies", ",").alias("dependencies")), """
WITH s AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS m FROM customer),
o AS (SELECT n_regionkey, k, m, row_number() OVER (PARTITION BY n_regionkey ORDER BY k, m) AS g FROM s JOIN nation ON n_nationkey = k),
dec AS (SELECT k, string_agg('GEN-' || lpad(CAST(g AS STRING), 3, '0') || '|' || m || ' first|sold there|keep ' || lower(m), ';' ORDER BY m) AS d FROM o GROUP BY k),
f AS (SELECT s_nationkey AS k, string_agg('s/' || CAST(s_suppkey AS STRING) || '.py', ',' ORDER BY s_suppkey) AS f FROM supplier GROUP BY s_nationkey)
SELECT n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS ordinal, 'Sells in ' || n_name || '.' AS description,
  'D-' || CAST(n_nationkey AS STRING) || '|open||' || coalesce(';' || d, '') AS decisions, coalesce(f, '') AS files, 'R' || CAST(n_regionkey AS STRING) AS dependencies
FROM nation LEFT JOIN dec ON dec.k = n_nationkey LEFT JOIN f ON f.k = n_nationkey""")


def _url_tree(s: SparkSession, d: str) -> DataFrame:
    """(path, text): a site with an app per part type, which has a route per brand: typed, by pattern, or by a router; and views."""
    p = table(s, d, "part").select(F.lower("p_type").alias("app"), F.substring("p_brand", 7, 9).cast("int").alias("b")).distinct()
    b = F.col("b").cast("string")
    route = (F.when(F.col("b") % 3 == 0, F.concat(F.lit("path('b"), b, F.lit("/<int:pk>/', views.show"), b, F.lit("),")))
             .when(F.col("b") % 3 == 1, F.concat(F.lit("re_path(r'^b"), b, F.lit("/(?P<pk>[0-9]+)/$', views.show"), b, F.lit("),")))
             .otherwise(F.concat(F.lit("path('b"), b, F.lit("/', include([path('<int:pk>/', views.show"), b, F.lit(")])),"))))
    urls = p.groupBy("app").agg(F.concat(F.lit("from django.urls import include, path, re_path\nfrom "), "app", F.lit(" import views\nurlpatterns: list = [\n"),
                                         F.array_join(F.sort_array(F.collect_list(route)), "\n"), F.when(F.col("app") < "n", F.lit("\npath('<path:rest>', views.other),")).otherwise(""), F.lit("\n]\n")).alias("text"))
    views = p.groupBy("app").agg(F.concat(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("def show"), b, F.lit("(r, pk): pass\n")))), ""), F.lit("def other(r, rest): pass\n")).alias("text"))
    site = p.select("app").distinct().agg(F.concat(F.lit("from django.urls import include, path\nROOT_URLCONF = 'site.urls'\nurlpatterns = [\n"), F.array_join(F.sort_array(F.collect_list(
        F.concat(F.lit("path('"), "app", F.lit("/', include('"), "app", F.lit(".urls')),")))), "\n"), F.lit("\n]\n")).alias("text"))
    return site.select(F.lit("site/urls.py").alias("path"), "text").unionByName(urls.select(F.concat("app", F.lit("/urls.py")).alias("path"), "text")).unionByName(
        views.select(F.concat("app", F.lit("/views.py")).alias("path"), "text"))


def _routed_parts(s: SparkSession, d: str) -> DataFrame:
    src = stage(_url_tree(s, d))
    mods = python_code.module_index(src)
    found = stage(routes.patterns(src))
    table_of = routes.expand(found, mods, routes.root_files(src, found, mods))
    p = table(s, d, "part")
    number = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    asked = p.select(F.concat(F.lit("GET /"), F.lower("p_type"), F.lit("/b"), F.substring("p_brand", 7, 9), F.lit("/"), number, F.lit("/"), F.when(F.col("p_partkey") % 7 == 0, "more/").otherwise("")).alias("request"))
    return routes.match(stage(table_of), asked).select("request", "display", "target", "loose")


_add("routed_parts", _routed_parts, """
SELECT 'GET /' || app || '/b' || b || '/' || n || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'more/' ELSE '' END AS request, app || CASE WHEN other THEN '/<rest>' ELSE '/b' || b || '/<pk>/' END AS display,
  app || '.views.' || CASE WHEN other THEN 'other' ELSE 'show' || b END AS target, NOT other AND p_partkey % 5 = 0 AS loose
FROM (SELECT p_partkey, lower(p_type) AS app, substr(p_brand, 7) AS b, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END || CAST(p_partkey AS STRING) AS n,
  lower(p_type) < 'n' AND (p_partkey % 7 = 0 OR p_partkey % 5 = 0) AS other FROM part) WHERE other OR p_partkey % 7 <> 0""")


def _warnings(g: Graph) -> DataFrame:
    code = F.concat(F.lit("def "), "name", F.when(F.col("id") % 3 == 0, "(): Call NETWORK").when(F.col("id") % 3 == 1, "(): block()").otherwise("(): pass"))
    old = F.when(F.col("name").isin("Small", "Everything odd"), "deprecated").otherwise(F.col("status"))
    return features.warnings(g, _spec(g).withColumn("status", old), _roots(g), g.nodes.select("id", code.alias("code")))


_graph("impact_warnings", _warnings, f"""
, own AS (SELECT n.id, feature FROM cg_nodes n JOIN owner ON owner.id = n.file_id WHERE type IN {FUNC})
SELECT id AS root, 'unmapped' AS kind, '' AS said FROM own WHERE feature IS NULL
UNION ALL SELECT id, 'constraint', c FROM own JOIN (VALUES ('Promotions', 'must not block', 1), ('Economy tests', 'must not call network', 0)) v(f, c, r) ON f = feature AND id % 3 = r
UNION ALL SELECT id, 'deprecated', feature FROM own WHERE feature IN ('Small', 'Everything odd')""", FEATURES)
_graph("health_chokepoints", reports.chokepoints, f"""
, nc AS (SELECT t.path, t.name, t.type, count(DISTINCT s.id) AS callers {COUNTED} GROUP BY ALL), nn AS (SELECT count(*) AS n FROM bt)
SELECT b.id, s.path, s.name, s.type, round(exact / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END, 6) AS normalized, coalesce(nc.callers, 0) AS callers
FROM (SELECT n.id, coalesce(sum(delta) FILTER (bk.s <> bk.t), 0) AS exact FROM n LEFT JOIN bk ON bk.t = n.id GROUP BY n.id HAVING coalesce(sum(delta) FILTER (bk.s <> bk.t), 0) > 0 ORDER BY round(exact, 4) DESC, n.id LIMIT 10) b,
  nn JOIN sym s ON s.id = b.id LEFT JOIN nc ON nc.path = s.path AND nc.name = s.name AND nc.type = s.type""", BETWEEN.replace("AND s.id <> t.id)", "AND s.id <> t.id AND NOT s.is_test AND NOT t.is_test)", 1))
