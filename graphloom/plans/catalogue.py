"""The registered queries over the code graph, each beside its DuckDB counterpart."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions.session import checkpoint, table
from graphloom.operators import catalog as K
from graphloom.operators import lenses as L
from graphloom.operators import modes as M
from graphloom.operators import modules as P
from graphloom.operators import traces as X
from graphloom.operators import traverse as T
from graphloom.operators import resolve as R
from graphloom.plans.driver_graph import TERA, duckdb_ctes, load, settled
from graphloom.streaming.diagnostics import replay

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def graph_query(name: str, sql: str | None, run) -> None:
    """Register run(graph) with SQL that can use nodes, edges, diagnostics and checks."""
    QUERIES[name] = lambda spark, sf_dir: run(load(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = duckdb_ctes() + sql


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in (names.split() if isinstance(names, str) else names))


def pair(g):
    return g.nodes, g.edges


def both(nodes, edges):
    return nodes.select(F.lit("node").alias("part"), "id", "type").union(edges.select(F.lit("edge"), "id", "type"))


DEGREE = """, deg AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT edge, id FROM (SELECT id AS edge, source AS id FROM edges UNION ALL SELECT id, target FROM edges)) GROUP BY id),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS connections FROM nodes LEFT JOIN deg ON nodes.id = deg.id)"""


def mode_sql(mode: str) -> str:
    more = "OR (type IN ('Function', 'Method', 'Handler') AND (visibility IN ('pub', 'pub(crate)') OR signature IS NOT NULL OR connections >= 2))" if mode == "meso" else ""
    out = DEGREE + f""", n0 AS MATERIALIZED (SELECT * FROM full_nodes WHERE (type IN ({quoted(M.TYPES[mode])}) {more}) AND reachability IS DISTINCT FROM 'Detached'),
ends AS MATERIALIZED (SELECT e.* FROM edges e SEMI JOIN n0 s ON e.source = s.id SEMI JOIN n0 t ON e.target = t.id),
e0 AS (SELECT * FROM ends WHERE type IN ({quoted(M.EDGE_TYPES[mode])}))"""
    if mode == "callflow":
        out += ", e1 AS (SELECT * FROM e0 UNION ALL SELECT * FROM ends WHERE type = 'Contains' AND NOT EXISTS (SELECT 1 FROM e0))"
    else:
        out += ", e1 AS (SELECT * FROM e0)"
    if mode in M.SEMANTIC:
        out += f""", t AS MATERIALIZED (SELECT source AS id FROM e1 WHERE type IN ({quoted(M.SEMANTIC[mode])}) UNION SELECT target FROM e1 WHERE type IN ({quoted(M.SEMANTIC[mode])})),
k AS MATERIALIZED (SELECT count(*) AS k FROM t),
n1 AS (SELECT n0.* FROM n0 CROSS JOIN k LEFT JOIN t ON n0.id = t.id WHERE t.id IS NOT NULL OR k = 0),
e2 AS (SELECT e1.* FROM e1 CROSS JOIN k LEFT JOIN t s ON e1.source = s.id LEFT JOIN t g ON e1.target = g.id WHERE (s.id IS NOT NULL AND g.id IS NOT NULL) OR k = 0)"""
    else:
        out += ", n1 AS (SELECT * FROM n0), e2 AS (SELECT * FROM e1)"
    return out + " SELECT 'node' AS part, id, type FROM n1 UNION ALL SELECT 'edge', id, type FROM e2"


for _mode in M.TYPES:
    graph_query(f"mode_{_mode}", mode_sql(_mode), lambda g, m=_mode: both(*M.filter_snapshot(*pair(settled(g)), m)))

graph_query("degree", DEGREE + " SELECT id, connections FROM full_nodes", lambda g: M.degree(g.nodes, g.edges).select("id", "connections"))

ESSENTIAL = "type IN ('Contains', 'EndpointHandler', 'ApiCall', 'Renders') OR (type = 'Calls' AND confidence IN ('Exact', 'Semantic'))"
for _level, _cond in {"all": "true", "semantic": f"{ESSENTIAL} OR type IN ('Calls', 'Imports', 'Uses', 'DataFlow', 'TypeReference')", "essential": ESSENTIAL}.items():
    graph_query(f"edge_visibility_{_level}", f" SELECT id, type, confidence FROM edges WHERE {_cond}", lambda g, v=_level: M.edge_visibility(g.edges, v).select("id", "type", "confidence"))

# Parallel edges only come from merging: symbols' edges seen from their files.
LIFTED = """, up AS (SELECT e.seq, e.id, s.file AS source, e.target, e.type, e.confidence, e.label, e.kind FROM edges e JOIN nodes s ON e.source = s.id WHERE s.type <> 'File' AND s.file IS NOT NULL)"""


def lifted(g):
    owner = g.nodes.where("type <> 'File' AND file IS NOT NULL").select(F.col("id").alias("source"), "file")
    return g.edges.join(owner, "source").withColumn("source", F.col("file")).drop("file")


graph_query(
    "bundle_edges",
    LIFTED + """ SELECT CASE WHEN count(*) = 1 THEN min_by(id, seq) ELSE concat(type, ':', source, '->', target, ':bundle:', count(*)) END AS id, source, target, type, min_by(confidence, seq) AS confidence,
 count(*) AS bundled, list(id ORDER BY seq, id) AS edge_ids FROM up GROUP BY source, target, type, CASE WHEN type = 'DataFlow' THEN concat(coalesce(kind, 'Unknown'), ':', coalesce(label, '')) END""",
    lambda g: M.bundle(lifted(g)),
)
RANK = "CASE confidence WHEN 'Exact' THEN 3 WHEN 'Semantic' THEN 2 WHEN 'SyntaxFallback' THEN 1 ELSE 0 END"
graph_query("edge_confidence_merge", LIFTED + f" SELECT source, type, min_by(id, seq) AS id, max_by(confidence, {RANK}) AS confidence, count(*) AS n FROM up GROUP BY source, type", lambda g: K.merge_edges(lifted(g), ["source", "type"]))
graph_query("dedupe_first", " SELECT label, type, min_by(id, seq) AS id FROM nodes GROUP BY label, type", lambda g: T.first_by_seq(g.nodes, "label", "type").select("label", "type", "id"))

CENTRE = f"SELECT id FROM nodes WHERE seq = 3 * {TERA} + 1"


def centre(g):
    return g.nodes.where(F.col("seq") == 3 * TERA + 1).select("id")


BOTH_WAYS = ", pairs AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)"


def reach_sql(depth: int | None, pairs: str = BOTH_WAYS) -> str:
    if depth is None:
        return pairs + f", r AS ({CENTRE} UNION SELECT b FROM r JOIN pairs ON r.id = pairs.a) SELECT id FROM r"
    return pairs + f", r AS (SELECT id, 0 AS hop FROM ({CENTRE}) UNION SELECT b, hop + 1 FROM r JOIN pairs ON r.id = pairs.a WHERE hop < {depth}) SELECT id, min(hop) AS hop FROM r GROUP BY id"


for _d in (1, 2, 3):
    graph_query(f"focus_d{_d}", reach_sql(_d), lambda g, d=_d: T.focus(g.nodes, g.edges, centre(g), d)[0])
graph_query("focus_full", reach_sql(None), lambda g: T.focus(g.nodes, g.edges, centre(g), None)[0].select("id"))
MICRO = ", inner_nodes AS (SELECT id FROM nodes WHERE type NOT IN ('Module', 'ExternalCrate')), pairs AS (SELECT source AS a, target AS b FROM edges WHERE source IN (SELECT id FROM inner_nodes) AND target IN (SELECT id FROM inner_nodes) UNION SELECT target, source FROM edges WHERE source IN (SELECT id FROM inner_nodes) AND target IN (SELECT id FROM inner_nodes))"
graph_query("neighborhood_micro", reach_sql(2, MICRO), lambda g: T.neighbourhood(g.nodes.where("type NOT IN ('Module', 'ExternalCrate')"), g.edges, centre(g), 2))

LEVELS = DEGREE + """, st AS (SELECT source, target FROM edges WHERE type IN ('Contains', 'ModDeclaration', 'ExternalDependency') AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
lv AS (SELECT id, 0 AS level FROM nodes WHERE id NOT IN (SELECT target FROM st) UNION SELECT target, level + 1 FROM lv JOIN st ON lv.id = st.source WHERE level < 50),
least AS (SELECT id, min(level) AS level FROM lv GROUP BY id),
d AS (SELECT f.id, f.type, level, CASE WHEN f.type = 'ExternalCrate' OR (f.type = 'Module' AND file IS NULL) THEN 1 WHEN f.type IN ('Module', 'File') THEN 2
 WHEN f.type IN ('Endpoint', 'Struct', 'Class', 'Object', 'Enum', 'Trait', 'Impl', 'Component', 'Hook', 'Interface', 'TypeAlias') THEN 3
 WHEN f.type IN ('Function', 'Method', 'Handler') AND (visibility IN ('pub', 'pub(crate)') OR coalesce(signature, '') <> '' OR connections >= 2) THEN 3 ELSE 4 END AS depth
 FROM full_nodes f LEFT JOIN least ON f.id = least.id)"""


def layered(g, depth):
    g = settled(replace(g, nodes=g.nodes.select("seq", "id", "type", "file", "visibility", "signature"), edges=g.edges.select("source", "target", "type")))
    return T.hierarchy(M.degree(g.nodes, g.edges), g.edges, depth)


for _d in (1, 2, 3):
    graph_query(f"hierarchy_d{_d}", LEVELS + f" SELECT id, type, level FROM d WHERE depth <= {_d} AND (level IS NULL OR level <= {_d + 1})", lambda g, d=_d: layered(g, d))

OWN = """, grp AS (SELECT id AS owner, seq AS position FROM nodes WHERE type = 'Module'),
cl AS (SELECT owner, position, e.target AS id FROM grp JOIN edges e ON e.source = owner AND e.type = 'Contains' UNION SELECT owner, position, e.target FROM cl JOIN edges e ON e.source = cl.id AND e.type = 'Contains'),
own AS (SELECT id, min_by(owner, position) AS owner FROM cl WHERE id <> owner GROUP BY id)"""


def groups(g):
    return g.nodes.where("type = 'Module'").select("id", F.col("seq").alias("position"))


graph_query(
    "collapse_groups",
    OWN + """, mv AS (SELECT e.id, e.type, coalesce(s.owner, source) AS ns, coalesce(t.owner, target) AS nt, s.owner IS NULL AND t.owner IS NULL AS same FROM edges e LEFT JOIN own s ON source = s.id LEFT JOIN own t ON target = t.id),
lf AS (SELECT id, type FROM nodes WHERE id NOT IN (SELECT id FROM own))
SELECT 'node' AS part, id, type FROM lf UNION ALL SELECT 'edge', CASE WHEN same THEN id ELSE concat(type, ':', ns, '->', nt, ':', id) END, type FROM mv WHERE ns <> nt AND ns IN (SELECT id FROM lf) AND nt IN (SELECT id FROM lf)""",
    lambda g: both(*T.collapse(g.nodes, g.edges, groups(g))),
)
graph_query("collapse_stats", OWN + " SELECT owner, count(*) AS hidden FROM own GROUP BY owner", lambda g: T.owners(g.edges, groups(g)).groupBy("owner").agg(F.count("*").alias("hidden")))
graph_query(
    "api_propagation",
    " SELECT DISTINCT c.source, a.target FROM edges c JOIN edges a ON c.target = a.source AND c.type = 'Calls' AND a.type = 'ApiCall' WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.type = 'ApiCall' AND x.source = c.source AND x.target = a.target)",
    lambda g: T.api_propagation(g.edges),
)

FIELDS = "[lower(coalesce(label, '')), lower(coalesce(file, '')), lower(coalesce(module, '')), lower(coalesce(crate, '')), lower(type)]"
for _name, _q in {"exact": "fn_7", "prefix": "fn_1", "substr": "building", "empty": ""}.items():
    _score = "3" if not _q else f"CASE WHEN len(list_filter({FIELDS}, lambda f: f = '{_q}')) > 0 THEN 0 WHEN len(list_filter({FIELDS}, lambda f: starts_with(f, '{_q}'))) > 0 THEN 1 WHEN len(list_filter({FIELDS}, lambda f: contains(f, '{_q}'))) > 0 THEN 2 END"
    graph_query(f"search_{_name}", f" SELECT id, label, score FROM (SELECT *, {_score} AS score FROM nodes) WHERE score IS NOT NULL ORDER BY score, label, seq LIMIT 30", lambda g, q=_q: K.search(g.nodes, q))

for _name, _in in {"node_callers": True, "node_callees": False}.items():
    _h, _t = ("target", "source") if _in else ("source", "target")
    graph_query(_name, f" SELECT {_h} AS id, {_t} AS other, n.label AS other_label, e.type FROM edges e JOIN nodes n ON e.{_t} = n.id WHERE e.type IN ('Calls', 'EndpointHandler')", lambda g, i=_in: K.neighbours(g.nodes, g.edges, i))
graph_query(
    "related_types",
    """, ab AS (SELECT source, target FROM edges WHERE type IN ('TypeReference', 'Implements')), pr AS (SELECT source AS id, source AS related FROM ab UNION SELECT source, target FROM ab UNION SELECT target, source FROM ab UNION SELECT target, target FROM ab)
SELECT id, related FROM pr WHERE related IN (SELECT id FROM nodes WHERE type IN ('Struct', 'Enum', 'Trait', 'Impl', 'Interface', 'TypeAlias'))""",
    lambda g: K.related_types(g.nodes, g.edges),
)
graph_query(
    "references",
    " SELECT DISTINCT target AS id, n.file, coalesce(n.line, 0) AS line, source AS from_id FROM edges e JOIN nodes n ON source = n.id WHERE e.type IN ('Calls', 'EndpointHandler', 'TypeReference', 'Uses', 'DataFlow') AND n.file IS NOT NULL",
    lambda g: K.references(g.nodes, g.edges),
)
graph_query(
    "endpoint_details",
    " SELECT n.id, n.label AS route, coalesce(h, []) AS handlers FROM nodes n LEFT JOIN (SELECT source, list(DISTINCT target ORDER BY target) AS h FROM edges WHERE type = 'EndpointHandler' AND target IN (SELECT id FROM nodes) GROUP BY source) x ON n.id = source WHERE n.type = 'Endpoint'",
    lambda g: K.endpoint_details(g.nodes, g.edges),
)
graph_query(
    "endpoint_choice",
    """, ep AS (SELECT * FROM nodes WHERE type = 'Endpoint' AND reachability IS DISTINCT FROM 'Detached'),
lo AS (SELECT DISTINCT ep.id FROM ep JOIN edges e ON e.source = ep.id AND e.type = 'EndpointHandler' JOIN nodes h ON e.target = h.id WHERE h.file IS NOT DISTINCT FROM ep.file OR (h.crate IS NOT DISTINCT FROM ep.crate AND h.module IS NOT DISTINCT FROM ep.module)),
sc AS (SELECT label AS route, id, CAST(100 + CASE WHEN id IN (SELECT id FROM lo) THEN 80 ELSE 0 END AS INTEGER) AS score FROM ep)
SELECT route, id, score FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, id) AS p FROM sc) WHERE p = 1""",
    lambda g: K.endpoint_choice(g.nodes, g.edges),
)
graph_query("ambiguous_routes", " SELECT label AS route, count(*) AS n FROM nodes WHERE type = 'Endpoint' AND reachability = 'Active' GROUP BY label HAVING count(*) > 1", lambda g: K.ambiguous_routes(g.nodes))
graph_query(
    "trace_edge",
    f""", ch AS (SELECT * FROM edges WHERE type IN ('ApiCall', 'EndpointHandler')),
rk AS (SELECT *, {RANK} + 1 + CASE type WHEN 'ApiCall' THEN 4 WHEN 'EndpointHandler' THEN 4 WHEN 'DataFlow' THEN 3 WHEN 'Calls' THEN 2 ELSE 1 END + CASE WHEN evidence IS NULL THEN 0 ELSE 1 END AS r FROM edges),
tc AS (SELECT id, r, source AS e FROM rk UNION SELECT id, r, target FROM rk),
st AS (SELECT id AS trace, 0 AS stage, source AS ref, 'Source' AS kind, 0 AS r FROM ch UNION ALL SELECT id, 1, id, 'Edge', 0 FROM ch UNION ALL SELECT id, 2, target, 'Target', 0 FROM ch
 UNION ALL SELECT DISTINCT ch.id, 3, tc.id, 'Related', tc.r FROM ch JOIN tc ON tc.e IN (ch.source, ch.target) WHERE tc.id <> ch.id)
SELECT trace, CAST(p AS INTEGER) AS step_no, kind, ref FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY stage, r DESC, ref) AS p FROM st) WHERE p <= 20""",
    lambda g: K.edge_trace(g.nodes, g.edges, g.edges.where("type IN ('ApiCall', 'EndpointHandler')").select("id")),
)
graph_query(
    "file_rollup",
    DEGREE + """ SELECT f.file AS path, coalesce(c, 0) AS functions, f.connections AS links, CASE WHEN coalesce(c, 0) <= 5 THEN 'low' WHEN c <= 14 THEN 'medium' ELSE 'high' END AS complexity
 FROM full_nodes f LEFT JOIN (SELECT file, count(*) AS c FROM nodes WHERE type IN ('Function', 'Method', 'Component', 'Hook', 'Endpoint') GROUP BY file) x ON f.file = x.file WHERE f.type = 'File'""",
    lambda g: K.file_rollup(g.nodes, g.edges),
)
graph_query(
    "complexity_hist",
    """ SELECT complexity, count(*) AS files FROM (SELECT CASE WHEN coalesce(c, 0) <= 5 THEN 'low' WHEN c <= 14 THEN 'medium' ELSE 'high' END AS complexity FROM nodes f
 LEFT JOIN (SELECT file, count(*) AS c FROM nodes WHERE type IN ('Function', 'Method', 'Component', 'Hook', 'Endpoint') GROUP BY file) x ON f.file = x.file WHERE f.type = 'File') GROUP BY 1""",
    lambda g: K.file_rollup(g.nodes, g.edges).groupBy("complexity").agg(F.count("*").alias("files")),
)
graph_query("files_by_package", " SELECT crate, count(*) AS n, list(file ORDER BY file) AS files FROM nodes WHERE type = 'File' GROUP BY crate", lambda g: g.nodes.where("type = 'File'").groupBy("crate").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("file")).alias("files")))
graph_query("language_counts", " SELECT language, type, count(*) AS n FROM nodes GROUP BY ALL", lambda g: g.nodes.groupBy("language", "type").agg(F.count("*").alias("n")))
graph_query(
    "project_tree",
    " SELECT crate, module, count(*) AS files, min(seq) AS first_seen FROM nodes WHERE type = 'File' GROUP BY crate, module",
    lambda g: g.nodes.where("type = 'File'").groupBy("crate", "module").agg(F.count("*").alias("files"), F.min("seq").alias("first_seen")),
)
graph_query(
    "hotspots",
    DEGREE + " SELECT id, connections FROM full_nodes WHERE type <> 'ExternalCrate' AND connections > 0 ORDER BY connections DESC, seq LIMIT 10",
    lambda g: M.degree(g.nodes, g.edges).where("type <> 'ExternalCrate' AND connections > 0").orderBy(F.desc("connections"), "seq").limit(10).select("id", "connections"),
)
graph_query(
    "detached_files",
    " SELECT id, file, count(*) OVER () AS total FROM nodes WHERE type = 'File' AND language = 'rust' AND reachability = 'Detached' ORDER BY file, label LIMIT 200",
    lambda g: K.detached_files(g.nodes),
)
graph_query(
    "diag_severity",
    """ SELECT file, count(*) FILTER (WHERE severity = 'Error') AS errors, count(*) FILTER (WHERE severity = 'Warning') AS warnings, count(*) FILTER (WHERE severity = 'Information') AS infos, count(*) FILTER (WHERE severity = 'Hint') AS hints,
 CASE min(CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Information' THEN 2 ELSE 3 END) WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Information' ELSE 'Hint' END AS worst FROM diagnostics GROUP BY file""",
    lambda g: K.diagnostics_by_file(g.diagnostics),
)
graph_query("diag_by_file", " SELECT file, count(*) AS n, min(line) AS first_line FROM diagnostics GROUP BY file", lambda g: g.diagnostics.groupBy("file").agg(F.count("*").alias("n"), F.min("line").alias("first_line")))
graph_query(
    "diag_top",
    " SELECT id, file, severity, language FROM diagnostics WHERE severity = 'Error' AND language = 'python' ORDER BY file, id LIMIT 100",
    lambda g: K.top_diagnostics(g.diagnostics, "Error", "PY"),
)
# Ranges of the projection: symbols from their line to their end, diagnostics up to two lines on.
SPANS = """, sy AS (SELECT id, seq, file, line AS start_line, CAST(seq % 8 AS INT) AS start_char, end_line, CAST(20 + seq % 30 AS INT) AS end_char FROM nodes WHERE file IS NOT NULL AND end_line IS NOT NULL),
dg AS (SELECT id AS probe, file, line AS start_line, CAST(seq % 50 AS INT) AS start_char, CAST(line + seq % 3 AS INT) AS end_line, 10 AS end_char FROM diagnostics)"""
AFTER = "{a}_line * 100000 + {a}_char <= {b}_line * 100000 + {b}_char"
OVERLAP = f" SELECT probe AS id, sy.id AS node_id FROM dg JOIN sy ON dg.file = sy.file AND {AFTER.format(a='dg.start', b='sy.end')} AND {AFTER.format(a='sy.start', b='dg.end')}"


def symbol_ranges(g):
    return g.nodes.where("file IS NOT NULL AND end_line IS NOT NULL").selectExpr("id", "seq", "file", "line AS start_line", "CAST(seq % 8 AS INT) AS start_char", "end_line", "CAST(20 + seq % 30 AS INT) AS end_char")


def diagnostic_ranges(g):
    return g.diagnostics.selectExpr("id AS probe", "file", "line AS start_line", "CAST(seq % 50 AS INT) AS start_char", "CAST(line + seq % 3 AS INT) AS end_line", "10 AS end_char")


def at_symbols(g):
    return R.overlapping(diagnostic_ranges(g), symbol_ranges(g)).select(F.col("probe").alias("id"), F.col("id").alias("node_id"))


graph_query("diag_overlap", SPANS + OVERLAP, at_symbols)
graph_query("diag_by_node", SPANS + f" SELECT node_id, count(*) AS n FROM ({OVERLAP}) GROUP BY node_id", lambda g: at_symbols(g).groupBy("node_id").agg(F.count("*").alias("n")))
HELD = f"SELECT probe, sy.id, greatest(sy.end_line - sy.start_line, 0) * 10000 + greatest(sy.end_char - sy.start_char, 0) AS span, seq FROM dg JOIN sy ON dg.file = sy.file AND {AFTER.format(a='sy.start', b='dg.start')} AND {AFTER.format(a='dg.start', b='sy.end')}"
graph_query(
    "enclosing_symbol",
    SPANS + f", b AS (SELECT probe, id FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY span, seq) AS p FROM ({HELD})) WHERE p = 1) SELECT d.id, coalesce(b.id, f.id) AS node_id FROM diagnostics d LEFT JOIN b ON d.id = b.probe LEFT JOIN nodes f ON f.type = 'File' AND f.file = d.file",
    lambda g: R.smallest_at(
        diagnostic_ranges(g).select("probe", "file", F.col("start_line").alias("line"), F.col("start_char").alias("char")), symbol_ranges(g), g.nodes.where("type = 'File'").select("file", F.col("id").alias("file_id"))
    ).select(F.col("probe").alias("id"), F.col("id").alias("node_id")),
)
# Half of the customers' debts are diagnostics of their nation's project, so some projects have none, and some nations have no checks.
PROJECTS = "SELECT n_nationkey AS project FROM {nation}"
OPEN = "SELECT c_nationkey AS project FROM {customer} WHERE c_acctbal < -980"


def project_checks(spark, sf_dir):
    read = lambda sql, name: spark.sql(sql, **{name: table(spark, sf_dir, name)})
    checks = load(spark, sf_dir).checks.where("project % 4 <> 3")
    return K.check_status(read(PROJECTS, "nation"), checks, read(OPEN, "customer"))


QUERIES["check_status"] = project_checks
ORACLE_SQL["check_status"] = duckdb_ctes() + f""", c AS (SELECT project, count(*) AS n, count(*) FILTER (WHERE NOT skipped) AS run, count(*) FILTER (WHERE success) AS passed, count(*) FILTER (WHERE NOT success AND NOT skipped) AS failed, count(*) FILTER (WHERE skipped) AS skipped,
 count(*) FILTER (WHERE timed_out) AS timed_out FROM checks WHERE project % 4 <> 3 GROUP BY project), d AS (SELECT project, count(*) AS k FROM ({OPEN.format(customer="customer")}) GROUP BY 1),
j AS (SELECT p.project, coalesce(n, 0) AS n, coalesce(run, 0) AS run, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, coalesce(timed_out, 0) AS timed_out, coalesce(k, 0) AS diagnostics
 FROM ({PROJECTS.format(nation="nation")}) p LEFT JOIN c ON p.project = c.project LEFT JOIN d ON p.project = d.project),
s AS (SELECT *, n > 0 AND skipped + failed + timed_out = 0 AS complete FROM j)
SELECT * EXCLUDE (n), complete AND diagnostics = 0 AS clean, CASE WHEN n = 0 THEN 'Stale' WHEN failed + timed_out > 0 THEN 'Error' WHEN skipped > 0 THEN 'Fallback' ELSE 'Ready' END AS status,
 CASE WHEN complete AND diagnostics = 0 THEN 'All requested project checks passed and no diagnostics were reported.' WHEN n = 0 THEN 'Checks not run.'
 ELSE format('{{}}/{{}} check(s) passed, {{}} failed, {{}} skipped, {{}} timed out, {{}} diagnostic(s).', passed, n, failed, skipped, timed_out, diagnostics) END AS message,
 list_filter([CASE WHEN n = 0 THEN 'Project checks have not been run; empty diagnostics do not prove the project is clean.' END, CASE WHEN skipped > 0 THEN format('{{}} project check(s) were skipped; do not claim full project cleanliness.', skipped) END,
 CASE WHEN timed_out > 0 THEN format('{{}} project check(s) timed out; diagnostics may be incomplete.', timed_out) END, CASE WHEN failed > 0 THEN format('{{}} project check(s) failed; inspect check results and diagnostics.', failed) END], lambda x: x IS NOT NULL) AS warnings FROM s"""

# A later snapshot: every seventh symbol is gone, every fifth has another label, and parts are copied.
NEW = "SELECT seq, id, CASE WHEN seq % 5 = 0 THEN concat(label, '!') ELSE label END AS label, type, file FROM nodes WHERE NOT (type IN ('Function', 'Hook') AND seq % 7 = 0) UNION ALL SELECT seq + 10, concat(id, ':new'), label, type, file FROM nodes WHERE type = 'Trait'"


def later(g):
    label = F.when(F.col("seq") % 5 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")).alias("label")
    kept = g.nodes.where(~(F.col("type").isin("Function", "Hook") & (F.col("seq") % 7 == 0))).select("seq", "id", label, "type", "file")
    return kept.union(g.nodes.where("type = 'Trait'").select(F.col("seq") + 10, F.concat("id", F.lit(":new")), "label", "type", "file"))


graph_query(
    "snapshot_diff",
    f", nw AS ({NEW}) SELECT * FROM (SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN (o.label, o.type, o.file) IS DISTINCT FROM (n.label, n.type, n.file) THEN 'updated' END AS op, coalesce(o.id, n.id) AS id FROM nodes o FULL JOIN nw n ON o.id = n.id) WHERE op IS NOT NULL",
    lambda g: K.diff(g.nodes, later(g), ["label", "type", "file"]),
)


def patched(g):
    old, new = g.nodes.select("seq", "id", "label", "type", "file"), later(g)
    ops = K.diff(old, new, ["label", "type", "file"])
    some = lambda op: new.join(ops.where(F.col("op") == op), "id", "left_semi")
    return K.apply_patch(old, g.edges, some("added"), some("updated"), ops.where("op = 'removed'").select("id"))


graph_query("apply_patch_nodes", f" SELECT id, label, type FROM ({NEW})", lambda g: patched(g)[0].select("id", "label", "type"))
graph_query(
    "apply_patch_edges",
    f", nw AS ({NEW}), gone AS (SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM nw)) SELECT id, type FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)",
    lambda g: patched(g)[1].select("id", "type"),
)
graph_query(
    "dataflow_ids",
    """, df AS (SELECT source, target, kind, concat(trim(regexp_replace(coalesce(label, ''), '\\s+', ' ', 'g')), chr(10), trim(regexp_replace(coalesce(evidence, ''), '\\s+', ' ', 'g'))) AS t FROM edges WHERE type = 'DataFlow')
SELECT concat('DataFlow:', source, '->', target, ':', kind, ':', CASE WHEN t = chr(10) THEN 'flow' ELSE lower(lpad(hex(CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(CAST(length(hex(encode(t))) / 2 AS BIGINT)), lambda i: ('0x' || substr(hex(encode(t)), CAST(2 * i + 1 AS BIGINT), 2))::HUGEINT)),
 lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0')) END) AS id FROM df""",
    lambda g: g.edges.where("type = 'DataFlow'").select(F.concat(F.lit("DataFlow:"), "source", F.lit("->"), "target", F.lit(":"), "kind", F.lit(":"), C.flow_identity(F.col("label"), F.col("evidence"))).alias("id")),
)
graph_query(
    "route_bridge",
    """, cl AS (SELECT id AS call, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN 'get' ELSE 'post' END AS verb, concat('/api/orders/', CAST(seq % 60 AS STRING), '/') AS path FROM nodes WHERE type = 'Hook'),
ep AS (SELECT id AS endpoint, label, substr(label, strpos(label, ' ') + 1) AS api FROM nodes WHERE type = 'Endpoint' AND reachability = 'Active'),
su AS (SELECT call, endpoint FROM cl JOIN ep ON concat(upper(verb), ' ', rtrim(path, '/')) = label AND verb IS NOT NULL)
SELECT call, endpoint, 'Semantic' AS confidence FROM su UNION ALL SELECT call, endpoint, 'Heuristic' FROM cl JOIN ep ON rtrim(path, '/') = api WHERE call NOT IN (SELECT call FROM su)""",
    lambda g: K.route_bridge(
        g.nodes.where("type = 'Hook'").select(F.col("id").alias("call"), F.expr("CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN 'get' ELSE 'post' END").alias("verb"), F.expr("concat('/api/orders/', CAST(seq % 60 AS STRING), '/')").alias("path")),
        g.nodes.where("type = 'Endpoint' AND reachability = 'Active'").select(F.col("id").alias("endpoint"), "label"),
    ),
)


def page_routes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", C.route_key(F.lit(" get "), path).alias("route"), C.api_path(F.concat(F.lit("/api"), path)).alias("api"))


QUERIES["route_keys"] = page_routes
ORACLE_SQL["route_keys"] = """
WITH p AS (SELECT page_id, rtrim(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/') AS b FROM pages)
SELECT page_id, concat('GET ', CASE WHEN b = '' THEN '/' WHEN starts_with(b, '/') THEN b ELSE '/' || b END) AS route, CASE WHEN starts_with('/api' || b, '/api/') THEN '/api' || b END AS api FROM p"""


def text_lines(spark, sf_dir, name, key):
    return table(spark, sf_dir, name).select(*key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


QUERIES["brace_delta"] = lambda spark, d: text_lines(spark, d, "documents", ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(C.brace_delta(F.col("line"))).cast("bigint").alias("delta"))
ORACLE_SQL["brace_delta"] = """
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, CAST(length(replace(text, '}', '')) - length(replace(text, '{', '')) AS BIGINT) AS delta FROM documents WHERE text IS NOT NULL"""

QUERIES["stream_latest"] = lambda spark, d: replay(spark, d)
ORACLE_SQL["stream_latest"] = """
SELECT user_id, event_id, event_type, updates FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p, count(*) OVER (PARTITION BY user_id) AS updates FROM events) WHERE p = 1"""


STEP_KIND = "CASE type WHEN 'ApiCall' THEN 'ApiRequest' WHEN 'EndpointHandler' THEN 'EndpointHandler' WHEN 'Calls' THEN 'ServiceCall' WHEN 'DataFlow' THEN CASE WHEN kind IN ('ReturnValue', 'ModelUse') THEN kind ELSE 'Unknown' END END"
RANKED = f""", ok AS (SELECT id, reachability IS DISTINCT FROM 'Detached' AS ok FROM nodes),
rk AS (SELECT e.*, {RANK} + 1 + CASE type WHEN 'ApiCall' THEN 4 WHEN 'EndpointHandler' THEN 4 WHEN 'DataFlow' THEN 3 WHEN 'Calls' THEN 2 ELSE 1 END + CASE WHEN evidence IS NULL THEN 0 ELSE 1 END AS r,
 coalesce(s.ok, true) AS so, coalesce(t.ok, true) AS tk, s.id IS NOT NULL AS sn, t.id IS NOT NULL AS tn FROM edges e LEFT JOIN ok s ON e.source = s.id LEFT JOIN ok t ON e.target = t.id)"""
NUMBERED = """, ft AS (SELECT *, row_number() OVER (PARTITION BY trace, kind, ref ORDER BY stage, orank DESC, oid, inn, r DESC, ref) AS f FROM st)
SELECT trace, CAST(p AS INTEGER) AS step_no, kind, ref FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY stage, orank DESC, oid, inn, r DESC, ref) AS p FROM ft WHERE f = 1) WHERE p <= 20"""
graph_query(
    "trace_node",
    RANKED + f""", ro AS (SELECT * FROM nodes WHERE type <> 'Endpoint'), lk AS (SELECT *, {STEP_KIND} AS sk FROM rk WHERE type IN ('DataFlow', 'Calls', 'ApiCall', 'EndpointHandler')),
st AS (SELECT id AS trace, 0 AS stage, 0 AS orank, '' AS oid, 0 AS inn, 0 AS r, id AS ref, CASE WHEN reachability = 'Detached' THEN 'DetachedSource' WHEN reachability = 'External' OR type = 'ExternalCrate' THEN 'ExternalDependency' ELSE 'Unknown' END AS kind FROM ro
UNION ALL SELECT ro.id, 1, 0, '', 0, r, lk.id, sk FROM ro JOIN lk ON ro.id = lk.source WHERE tk
UNION ALL SELECT ro.id, 1, 0, '', 0, r, lk.id, sk FROM ro JOIN lk ON ro.id = lk.target AND lk.source <> lk.target WHERE so)""" + NUMBERED,
    lambda g: X.node_traces(g.nodes, g.edges).drop("word"),
)
graph_query(
    "trace_route",
    RANKED + f""", ep AS (SELECT * FROM nodes WHERE type = 'Endpoint'), ap AS (SELECT rk.* FROM rk JOIN ep ON rk.target = ep.id WHERE rk.type = 'ApiCall'),
hd AS (SELECT rk.* FROM rk JOIN ep ON rk.source = ep.id WHERE rk.type = 'EndpointHandler'),
rs AS (SELECT *, {STEP_KIND} AS sk FROM rk WHERE type = 'DataFlow' AND kind IN ('ReturnValue', 'ModelUse', 'ApiResponse')),
st AS (SELECT id AS trace, 0 AS stage, 0 AS orank, '' AS oid, 0 AS inn, 0 AS r, id AS ref, 'DetachedSource' AS kind FROM ep WHERE reachability = 'Detached'
UNION ALL SELECT target, 1, r, id, 0, 0, source, 'Caller' FROM ap WHERE so AND sn
UNION ALL SELECT target, 1, r, id, 1, 0, id, 'ApiRequest' FROM ap WHERE so
UNION ALL SELECT id, 3, 0, '', 0, 0, id, 'Endpoint' FROM ep
UNION ALL SELECT source, 4, r, id, 0, 0, id, 'EndpointHandler' FROM hd WHERE tk OR target = source
UNION ALL SELECT source, 4, r, id, 1, 0, target, 'BackendHandler' FROM hd WHERE tn AND (tk OR target = source)
UNION ALL SELECT hd.source, 4, hd.r, hd.id, 2, c.r, c.id, 'ServiceCall' FROM hd JOIN rk c ON c.source = hd.target AND c.type = 'Calls' WHERE hd.tn AND (c.so OR c.source = hd.source) AND (c.tk OR c.target = hd.source)
UNION ALL SELECT hd.source, 4, hd.r, hd.id, 3, c.r, c.id, c.sk FROM hd JOIN rs c ON c.source = hd.target OR c.target = hd.target OR c.target = hd.source WHERE hd.tn AND (c.so OR c.source = hd.source) AND (c.tk OR c.target = hd.source))""" + NUMBERED,
    lambda g: X.route_traces(g.nodes, g.edges).drop("word"),
)
SEEDS = """, ac AS (SELECT * FROM edges WHERE type = 'ApiCall' AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
en AS (SELECT * FROM nodes WHERE id IN (SELECT source FROM ac UNION SELECT target FROM ac)),
sd AS (SELECT id FROM en UNION SELECT id FROM nodes WHERE type = 'File' AND file IN (SELECT file FROM en) UNION SELECT id FROM nodes WHERE type = 'Module' AND crate IN (SELECT crate FROM en))"""


def lens_sql(kind: str) -> str:
    if kind == "architecture":
        keep = ", kp AS (SELECT id FROM sd UNION SELECT id FROM nodes WHERE type IN ('Module', 'File', 'Endpoint'))"
    else:
        keep = """, wy AS (SELECT target AS a, source AS b FROM edges WHERE type = 'Contains' UNION SELECT source, target FROM edges WHERE type = 'EndpointHandler' UNION SELECT source, target FROM edges WHERE type = 'Calls' AND target IN (SELECT id FROM nodes WHERE type = 'Endpoint')),
kp AS (SELECT id FROM sd UNION SELECT b FROM kp JOIN wy ON kp.id = wy.a)"""
    return SEEDS + keep + f""", kn AS (SELECT id, type FROM nodes WHERE id IN (SELECT id FROM kp))
SELECT 'node' AS part, id, type FROM kn UNION ALL SELECT 'edge', id, type FROM edges WHERE type IN ({quoted(L.SHOWN[kind])}) AND source IN (SELECT id FROM kn) AND target IN (SELECT id FROM kn)"""


for _kind in L.SHOWN:
    graph_query(f"lens_{_kind}", lens_sql(_kind), lambda g, k=_kind: both(*L.lens(checkpoint(g.nodes), checkpoint(g.edges), k)))
graph_query(
    "route_flow",
    """, lo AS (SELECT id FROM nodes WHERE reachability = 'Detached'), ac AS (SELECT * FROM edges WHERE type = 'ApiCall' AND source NOT IN (SELECT id FROM lo) AND target NOT IN (SELECT id FROM lo)),
hd AS (SELECT * FROM edges WHERE type = 'EndpointHandler' AND target NOT IN (SELECT id FROM lo) AND source IN (SELECT target FROM ac)), cl AS (SELECT * FROM edges WHERE type = 'Calls' AND source IN (SELECT target FROM hd)),
fl AS (SELECT * FROM edges WHERE type = 'DataFlow'), wy AS (SELECT source AS a, target AS b FROM fl UNION SELECT target, source FROM fl),
rc AS (SELECT source AS id FROM ac UNION SELECT target FROM ac UNION SELECT target FROM hd UNION SELECT target FROM cl UNION SELECT b FROM rc JOIN wy ON rc.id = wy.a),
ee AS (SELECT id, source, target, type FROM edges WHERE id IN (SELECT id FROM ac UNION SELECT id FROM hd UNION SELECT id FROM cl UNION SELECT id FROM fl WHERE source IN (SELECT id FROM rc)))
SELECT 'node' AS part, id, type FROM nodes WHERE id NOT IN (SELECT id FROM lo) AND (id IN (SELECT id FROM rc) OR (type = 'Endpoint' AND id IN (SELECT source FROM edges WHERE type = 'ApiCall' UNION SELECT target FROM edges WHERE type = 'ApiCall')))
UNION ALL SELECT 'edge', id, type FROM ee WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)""",
    lambda g: both(*L.route_flow(checkpoint(g.nodes), checkpoint(g.edges))),
)
graph_query(
    "reachability_roots",
    """, rt AS (SELECT id AS root, id FROM nodes WHERE module = 'crate root' UNION SELECT root, target FROM rt JOIN edges ON rt.id = source WHERE type IN ('Contains', 'ExternalDependency'))
SELECT id, list(root ORDER BY root) AS roots FROM rt GROUP BY id""",
    lambda g: T.reachable_from(g.edges.where("type IN ('Contains', 'ExternalDependency')").select(F.col("source").alias("a"), F.col("target").alias("b")), g.nodes.where("module = 'crate root'").select("id")),
)
graph_query(
    "collapse_links",
    OWN + """, bt AS (SELECT source, target, type, s.owner AS s, t.owner AS t FROM edges LEFT JOIN own s ON source = s.id LEFT JOIN own t ON target = t.id),
cx AS (SELECT s AS owner, NULL AS incoming, type AS outgoing FROM bt WHERE s IS DISTINCT FROM t AND s IS NOT NULL AND target <> s UNION SELECT t, type, NULL FROM bt WHERE s IS DISTINCT FROM t AND t IS NOT NULL AND source <> t)
SELECT owner, list_sort(coalesce(list(DISTINCT incoming) FILTER (WHERE incoming IS NOT NULL), [])) AS incoming, list_sort(coalesce(list(DISTINCT outgoing) FILTER (WHERE outgoing IS NOT NULL), [])) AS outgoing FROM cx GROUP BY owner""",
    lambda g: T.group_links(g.edges, checkpoint(T.owners(g.edges, groups(g)))),
)


def document_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    found = P.snippets(docs.select(path, "text"), docs.select(path, (F.col("doc_id") % 40 + 1).cast("int").alias("line")))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "start_line", "end_line", "code")


QUERIES["snippets"] = document_snippets
ORACLE_SQL["snippets"] = f"""
WITH d AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS l FROM documents WHERE text <> '' AND strpos(text, chr(0)) = 0),
c AS (SELECT *, len(l) AS n, least(doc_id % 40 + 1, len(l)) AS k FROM d), s AS (SELECT doc_id, CAST(greatest(k - 6, 1) AS INTEGER) AS start_line, CAST(least(k + 8, n) AS INTEGER) AS end_line, l FROM c),
t AS (SELECT doc_id, start_line, end_line, array_to_string(l[start_line:end_line], chr(10)) AS code FROM s)
SELECT doc_id, start_line, end_line, CASE WHEN strlen(code) <= {P.SNIPPET_BYTES} THEN code ELSE coalesce({", ".join(f"TRY(decode(encode(code)[1:{k}]))" for k in range(P.SNIPPET_BYTES, P.SNIPPET_BYTES - 4, -1))}) END AS code FROM t"""


def file_imports(g):
    files = g.nodes.where("type = 'File' AND language IN ('typescript', 'python')").withColumn("name", F.expr(f"concat('Customer#', lpad(CAST(seq - 3 * {TERA} + 4 AS STRING), 9, '0'))"))
    specifier = F.explode(F.when(F.col("language") == "python", F.array("name")).otherwise(F.array(F.concat(F.lit("./"), "name"), F.concat(F.lit("../building/./"), "name", F.lit(".tsx")))))
    asked = files.select(F.col("file").alias("path"), "language", specifier.alias("specifier"), F.lit(1).alias("level"))
    return P.resolve_imports(asked, g.nodes.where("type = 'File'").select(F.col("file").alias("path"))).select("path", "specifier", "target")


graph_query(
    "import_targets",
    f""", fs AS (SELECT file AS path, language, regexp_replace(file, '/[^/]*$', '') AS dir, concat('Customer#', lpad(CAST(seq - 3 * {TERA} + 4 AS VARCHAR), 9, '0')) AS name FROM nodes WHERE type = 'File' AND language IN ('typescript', 'python')),
sp AS (SELECT path, './' || name AS specifier, dir || '/' || name AS base FROM fs WHERE language = 'typescript' UNION ALL SELECT path, '../building/./' || name || '.tsx', 'src/building/' || name || '.tsx' FROM fs WHERE language = 'typescript'
UNION ALL SELECT path, name, dir || '/' || name FROM fs WHERE language = 'python'),
en(place, ending, python) AS (VALUES {", ".join(f"({n}, '{e}', {py})" for py, known in ((False, P.TYPESCRIPT_ENDINGS), (True, P.PYTHON_ENDINGS)) for n, e in enumerate(known))})
SELECT sp.path, specifier, min_by(base || ending, place) AS target FROM sp JOIN fs ON sp.path = fs.path JOIN en ON en.python = (fs.language = 'python') JOIN (SELECT DISTINCT file FROM nodes WHERE type = 'File') f ON f.file = base || ending GROUP BY sp.path, specifier""",
    file_imports,
)
