"""More registered queries over the code graph, each beside its DuckDB counterpart: names, resolution, views, patches, context."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import names as N
from graphloom.functions.session import checkpoint, table
from graphloom.operators import catalog as K
from graphloom.operators import resolve as R
from graphloom.operators.modes import bundle
from graphloom.operators import traces as X
from graphloom.operators import traverse as T
from graphloom.operators import views as V
from graphloom.plans.catalogue import AFTER, DEGREE, ESSENTIAL, LIFTED, NUMBERED, ORACLE_SQL, OWN, QUERIES, RANK, RANKED, SPANS, STEP_KIND, both, graph_query, groups, later, lifted, quoted, symbol_ranges
from graphloom.plans.driver_graph import TERA, settled

LANG = "CASE lower(trim({x})) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python' ELSE lower(trim({x})) END"
EXT = "CASE regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'qml' THEN 'qml' END"
CLIENT = """CASE WHEN type = 'Endpoint' THEN 'endpoints' WHEN type = 'ExternalCrate' OR crate = 'external' THEN 'external' WHEN language IS NOT NULL THEN language ELSE 'unknown' END"""

graph_query(
    "node_languages",
    f""" SELECT id, {LANG.format(x="' TSX '")} AS named, coalesce({EXT}, CASE WHEN module = 'python' OR crate = 'python' THEN 'python' WHEN module = 'qml' OR crate = 'qml' THEN 'qml' WHEN contains(module, 'typescript') OR crate = 'frontend' OR type IN ('Component', 'Hook', 'Interface', 'TypeAlias') THEN 'typescript'
 WHEN type = 'ExternalCrate' OR crate <> 'frontend' THEN 'rust' END) AS inferred, {CLIENT} AS client, CASE {CLIENT} WHEN 'javascript' THEN 'typescript' WHEN 'unknown' THEN NULL ELSE {CLIENT} END AS switch FROM nodes""",
    lambda g: g.nodes.select(
        "id",
        N.language_of_name(F.lit(" TSX ")).alias("named"),
        N.node_language(*(F.col(c) for c in ("type", "file", "module", "crate"))).alias("inferred"),
        N.client_language(*(F.col(c) for c in ("type", "crate", "file", "language", "id", "label"))).alias("client"),
        N.language_filter(N.client_language(*(F.col(c) for c in ("type", "crate", "file", "language", "id", "label")))).alias("switch"),
    ),
)
graph_query(
    "module_paths",
    r""" SELECT id, CASE language WHEN 'rust' THEN array_to_string(string_split(regexp_replace(file, '^src/|\.rs$', '', 'g'), '/'), '::') WHEN 'typescript' THEN array_to_string(string_split(regexp_replace(file, '^src/|\.tsx$', '', 'g'), '/'), '::') ELSE array_to_string(string_split(regexp_replace(file, '\.(py|qml)$', ''), '/'), '::') END AS module_path,
 substr(file, 5) AS below FROM nodes WHERE type = 'File'""",
    lambda g: g.nodes.where("type = 'File'").select("id", N.module_path(F.col("file"), F.col("language")).alias("module_path"), N.relative_to(F.lit("src/"), F.col("file")).alias("below")),
)
graph_query(
    "default_confidence",
    " SELECT id, concat(type, ':', source, '->', target) AS made, CASE WHEN type IN ('Contains', 'EndpointHandler', 'ExternalDependency') THEN 'Exact' WHEN type IN ('ApiCall', 'Imports', 'ModDeclaration') THEN 'Semantic' WHEN type = 'Uses' THEN 'Heuristic' ELSE 'SyntaxFallback' END AS confidence FROM edges",
    lambda g: g.edges.select("id", N.edge_id(F.col("type"), F.col("source"), F.col("target")).alias("made"), C.lookup(F.col("type"), N.DEFAULT_CONFIDENCE, None).alias("confidence")),
)
graph_query(
    "symbol_kinds",
    " SELECT id, CASE type WHEN 'Module' THEN 'Module' WHEN 'Method' THEN 'Method' ELSE type END AS kind, CASE WHEN starts_with(signature, 'pub(crate)') THEN 'pub(crate)' WHEN starts_with(signature, 'pub ') THEN 'pub' ELSE 'private' END AS seen FROM nodes WHERE signature IS NOT NULL",
    lambda g: g.nodes.where("signature IS NOT NULL").select("id", N.node_kind(F.when(F.col("type") == "Module", "Namespace").when(F.col("type") == "Method", "Constructor").otherwise(F.col("type")), F.col("label")).alias("kind"), N.visibility(F.col("signature")).alias("seen")),
)
graph_query(
    "endpoint_ids",
    " SELECT id, concat('endpoint:', file, '::get:', replace(ltrim(split_part(label, ' ', 2), '/'), '/', '_'), '@', CAST(line AS VARCHAR)) AS made FROM nodes WHERE type = 'Endpoint'",
    lambda g: g.nodes.where("type = 'Endpoint'").select("id", N.endpoint_id(F.col("file"), F.lit("get"), F.substring_index("label", " ", -1), F.col("line")).alias("made")),
)


def script_lines(spark, sf_dir):
    """A line of script for every page, with a request to the page's path."""
    path = F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1)
    call = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("const r = await fetch(\"/api"), path, F.lit("?q=1\", { method: 'post' })"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("axios.get(/api"), path, F.lit(")")))
    call = call.when(F.col("page_id") % 4 == 2, F.concat(F.lit("request('DELETE', `/api"), path, F.lit("`)"))).otherwise(F.concat(F.lit("fetch(`/api"), path, F.lit("/:id`)")))
    return table(spark, sf_dir, "pages").select("page_id", call.alias("line"))


def api_calls(spark, sf_dir):
    from graphloom.operators.extract import api_calls as found

    return found(script_lines(spark, sf_dir), "page_id").select("page_id", "verb", "path")


QUERIES["api_calls"] = api_calls
ORACLE_SQL["api_calls"] = r"""
WITH p AS (SELECT page_id, page_id % 4 AS k, rtrim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS b, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS raw FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' WHEN 2 THEN 'DELETE' ELSE 'GET' END AS verb, CASE WHEN k = 3 THEN '/api' || raw || '/:param' ELSE '/api' || b END AS path FROM p WHERE raw <> ''"""


def script_strings(spark, sf_dir):
    lines = script_lines(spark, sf_dir)
    return lines.select("page_id", N.first_string(F.col("line")).alias("quoted"), N.receiver(F.col("line"), "get").alias("receiver"), N.short_evidence(F.concat("line", F.lit("   "), "line"), 40).alias("short"))


QUERIES["script_strings"] = script_strings
ORACLE_SQL["script_strings"] = r"""
WITH p AS (SELECT page_id, page_id % 4 AS k, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS b FROM pages),
l AS (SELECT page_id, k, b, CASE k WHEN 0 THEN 'const r = await fetch("/api' || b || '?q=1", { method: ''post'' })' WHEN 1 THEN 'axios.get(/api' || b || ')' WHEN 2 THEN 'request(''DELETE'', `/api' || b || '`)' ELSE 'fetch(`/api' || b || '/:id`)' END AS line FROM p),
s AS (SELECT *, line || ' ' || line AS flat FROM l)
SELECT page_id, CASE k WHEN 0 THEN '/api' || b || '?q=1' WHEN 2 THEN 'DELETE' WHEN 3 THEN '/api' || b || '/:id' END AS quoted, CASE WHEN k = 1 THEN 'axios' END AS receiver, CASE WHEN length(flat) > 40 THEN substr(flat, 1, 37) || '...' ELSE flat END AS short FROM s"""

MENTIONS = f", mt AS (SELECT id AS source, concat('fn_', CAST((seq - 4 * {TERA}) * 7 % 500 AS VARCHAR)) AS callee FROM nodes WHERE type IN ('Function', 'Method')), cn AS (SELECT label, crate, count(*) AS n FROM nodes GROUP BY 1, 2)"
graph_query(
    "call_resolution",
    MENTIONS + """ SELECT DISTINCT mt.source, t.id AS target FROM mt JOIN nodes s ON s.id = mt.source JOIN nodes t ON t.label = callee AND t.type IN ('Function', 'Component', 'Hook') JOIN cn ON cn.label = callee AND cn.crate IS NOT DISTINCT FROM s.crate
 WHERE t.file IS NOT DISTINCT FROM s.file OR (t.crate IS NOT DISTINCT FROM s.crate AND (t.module IS NOT DISTINCT FROM s.module OR n = 1)) UNION
 SELECT mt.source, t.id FROM mt JOIN nodes s ON s.id = mt.source JOIN nodes t ON t.label = callee AND t.type IN ('Function', 'Component', 'Hook') WHERE t.file IS NOT DISTINCT FROM s.file""",
    lambda g: R.function_calls(g.nodes.where("type IN ('Function', 'Method')").select(F.col("id").alias("source"), F.expr(f"concat('fn_', CAST((seq - 4 * {TERA}) * 7 % 500 AS STRING))").alias("callee")), g.nodes, ["Function", "Component", "Hook"]).select("source", "target"),
)
OWNED = "CASE WHEN type = 'Method' THEN concat(module, '::m', CAST(line % 20 AS {s})) WHEN type = 'Trait' THEN 'building' ELSE label END"


def owned_nodes(g):
    return g.nodes.withColumn("label", F.expr(OWNED.format(s="STRING")))


graph_query(
    "method_resolution",
    f""", ow AS (SELECT id, seq, type, file, {OWNED.format(s='VARCHAR')} AS label FROM nodes), mt AS (SELECT id AS source, concat('m', CAST(seq % 20 AS VARCHAR)) AS method, CASE seq % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'Machinery' WHEN 2 THEN 'item' END AS receiver, CASE WHEN seq % 4 = 3 THEN concat('furniture::m', CAST(seq % 20 AS VARCHAR)) END AS qualified, file, CASE WHEN type = 'Method' THEN split_part(label, '::', 1) END AS own FROM ow WHERE type IN ('Function', 'Method')),
tg AS (SELECT id, file, label, split_part(label, '::', 1) AS owner, split_part(label, '::', 2) AS m FROM ow WHERE type = 'Method')
SELECT DISTINCT source, tg.id AS target FROM mt JOIN tg ON m = method WHERE tg.label = qualified OR (owner <> 'building' AND CASE WHEN receiver = 'self' THEN own = owner WHEN receiver = 'Machinery' THEN owner = 'Machinery' ELSE receiver IS NOT NULL AND tg.file = mt.file END)""",
    lambda g: R.method_calls(
        owned_nodes(g).where("type IN ('Function', 'Method')").selectExpr("id AS source", "concat('m', CAST(seq % 20 AS STRING)) AS method", "CASE seq % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'Machinery' WHEN 2 THEN 'item' END AS receiver", "CASE WHEN seq % 4 = 3 THEN concat('furniture::m', CAST(seq % 20 AS STRING)) END AS qualified"),
        owned_nodes(g),
    ),
)
graph_query(
    "impl_resolution",
    """, im AS (SELECT i.id, t.label AS tr, s.label AS ty FROM nodes i LEFT JOIN nodes t ON t.seq = i.seq - 1 JOIN nodes s ON s.seq = i.seq - 3 + i.seq % 2 WHERE i.type = 'Impl'), tn AS (SELECT label, min_by(id, seq) AS id FROM nodes WHERE type = 'Trait' GROUP BY 1),
sn AS (SELECT label, min_by(id, CASE type WHEN 'Struct' THEN seq ELSE seq + 1e15 END) AS id FROM nodes WHERE type IN ('Struct', 'Enum') GROUP BY 1)
SELECT im.id AS source, tn.id AS target, 'Implements' AS type FROM im JOIN tn ON tn.label = tr UNION ALL SELECT im.id, sn.id, 'TypeReference' FROM im JOIN sn ON sn.label = ty""",
    lambda g: R.impl_edges(
        g.nodes.where("type = 'Impl'").select("id", (F.col("seq") - 1).alias("a"), (F.col("seq") - 3 + F.col("seq") % 2).alias("b"))
        .join(g.nodes.select(F.col("seq").alias("a"), F.col("label").alias("tr")), "a", "left").join(g.nodes.select(F.col("seq").alias("b"), F.col("label").alias("ty")), "b")
        .select("id", F.when(F.col("tr").isNull(), F.col("ty")).otherwise(F.concat("tr", F.lit(" for "), "ty", F.lit(" {"))).alias("head")),
        g.nodes,
    ),
)
graph_query(
    "route_handlers",
    """, rt AS (SELECT id AS route, concat('fn_', CAST(seq % 500 AS VARCHAR)) AS handler, file, crate, module FROM nodes WHERE type = 'Endpoint')
SELECT route, handler, id AS target FROM (SELECT rt.route, rt.handler, n.id, row_number() OVER (PARTITION BY route, handler ORDER BY CASE WHEN n.file = rt.file THEN 100 ELSE 0 END + CASE WHEN n.crate = rt.crate THEN 30 ELSE 0 END + CASE WHEN n.module = rt.module THEN 20 ELSE 0 END DESC, n.id) AS p FROM rt JOIN nodes n ON n.label = handler AND n.type IN ('Function', 'Method')) WHERE p = 1""",
    lambda g: R.best_handlers(g.nodes.where("type = 'Endpoint'").select(F.col("id").alias("route"), F.expr("concat('fn_', CAST(seq % 500 AS STRING))").alias("handler"), "file", "crate", "module"), g.nodes),
)
PROBES = "SELECT id AS probe, CASE WHEN seq % 3 = 0 THEN concat('/work/tree/', file) WHEN seq % 3 = 1 THEN file ELSE regexp_replace(file, '^src/', '') END AS uri, line, CAST(seq % 40 AS INT) AS {c} FROM diagnostics"
HELD = f"SELECT probe, sy.id, greatest(sy.end_line - sy.start_line, 0) * 10000 + greatest(sy.end_char - sy.start_char, 0) AS span, seq FROM pr JOIN sy ON (pr.uri = sy.file OR ends_with(pr.uri, '/' || sy.file) OR ends_with(sy.file, '/' || pr.uri)) AND sy.start_line * 100000 + sy.start_char <= pr.line * 100000 + pr.ch AND pr.line * 100000 + pr.ch <= sy.end_line * 100000 + sy.end_char"


def outside(g):
    return g.diagnostics.selectExpr("id AS probe", "CASE WHEN seq % 3 = 0 THEN concat('/work/tree/', file) WHEN seq % 3 = 1 THEN file ELSE regexp_replace(file, '^src/', '') END AS uri", "line", "CAST(seq % 40 AS INT) AS char")


graph_query(
    "outside_locations",
    SPANS + f", pr AS (SELECT p.*, d.file FROM ({PROBES.format(c='ch')}) p JOIN diagnostics d ON d.id = p.probe), b AS (SELECT probe, id FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY span, seq) AS p FROM ({HELD.replace('ON (', 'ON pr.file = sy.file AND (')})) WHERE p = 1) SELECT pr.probe, b.id FROM pr LEFT JOIN b ON pr.probe = b.probe",
    lambda g: R.locations(outside(g), symbol_ranges(g)),
)
graph_query(
    "fact_enrichment",
    """, fc AS (SELECT seq, file, language, label AS name, line + 1 AS line, concat(label, '()') AS signature FROM nodes WHERE type = 'Hook'),
ht AS (SELECT fc.seq AS fact, fc.line, fc.signature, arg_min(n.id, n.seq) AS id FROM fc JOIN nodes n ON n.file = fc.file AND n.language = fc.language AND (n.label = fc.name OR ends_with(n.label, '::' || fc.name)) GROUP BY 1, 2, 3),
nw AS (SELECT id, arg_max(line, fact) AS line, arg_max(signature, fact) AS signature FROM ht GROUP BY id)
SELECT n.id, coalesce(nw.line, n.line) AS line, coalesce(nw.signature, n.signature) AS signature FROM nodes n LEFT JOIN nw ON n.id = nw.id WHERE n.file IS NOT NULL""",
    lambda g: R.enrich(g.nodes, g.nodes.where("type = 'Hook'").select("seq", "file", "language", F.col("label").alias("name"), (F.col("line") + 1).alias("line"), F.concat("label", F.lit("()")).alias("signature")), ["line", "signature"]).where("file IS NOT NULL").select("id", "line", "signature"),
)
graph_query(
    "stored_positions",
    " SELECT id, CASE WHEN seq % 3 = 0 THEN CAST(seq % 100 AS DOUBLE) ELSE 0 END AS x, CAST(CASE WHEN seq % 3 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS y, CASE WHEN seq % 6 = 0 THEN false ELSE true END AS pinned FROM nodes",
    lambda g: R.placed(
        g.nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("pinned")),
        g.nodes.where("seq % 3 = 0").select("id", (F.col("seq") % 100).cast("double").alias("x"), F.lit(1.5).alias("y"), F.when(F.col("seq") % 6 == 0, False).alias("pinned")),
    ).select("id", "x", "y", "pinned"),
)


def package_rows(g):
    names = g.nodes.where("type = 'Module' AND module <> 'crate root'").select(F.col("label").alias("name"), "seq")
    used = g.edges.where("type = 'ExternalDependency'").select(F.expr("substring(source, 8)").alias("name"), F.expr("substring(target, 10)").alias("dependency"))
    return used.union(names.where("seq % 2 = 0").select("name", F.lit("NATION_7"))).union(names.select("name", F.lit(None).cast("string")))


PACKAGES = f", pk AS (SELECT substr(source, 8) AS name, substr(target, 10) AS dependency FROM edges WHERE type = 'ExternalDependency' UNION ALL SELECT label, 'NATION_7' FROM nodes WHERE type = 'Module' AND module <> 'crate root' AND seq % 2 = 0)"
graph_query(
    "dependency_split",
    PACKAGES + " SELECT DISTINCT concat('crate:', name) AS source, CASE WHEN dependency = 'NATION_7' THEN 'crate:NATION_7' ELSE concat('external:', dependency) END AS target, CASE WHEN dependency = 'NATION_7' THEN 'Uses' ELSE 'ExternalDependency' END AS type FROM pk",
    lambda g: R.dependencies(package_rows(g))[1],
)

SHOWN = f", ln AS (SELECT *, {CLIENT} AS client FROM nodes), kp AS (SELECT id, type FROM ln WHERE client IN ('rust', 'python', 'endpoints', 'unknown') AND reachability = 'Active')"
graph_query(
    "client_filter",
    SHOWN + f" SELECT 'node' AS part, id, type FROM kp UNION ALL SELECT 'edge', id, type FROM edges WHERE ({ESSENTIAL}) AND source IN (SELECT id FROM kp) AND target IN (SELECT id FROM kp)",
    lambda g: both(*V.client_filter(*(lambda s: (s.nodes, s.edges))(settled(g)), ["rust", "python", "endpoints"], ["Active"], "essential")),
)
graph_query(
    "type_filter",
    f", kp AS (SELECT id, type FROM nodes WHERE type IN ('File', 'Function', 'Endpoint') AND reachability = 'Active') SELECT 'node' AS part, id, type FROM kp UNION ALL SELECT 'edge', id, type FROM edges WHERE type IN ('Contains', 'Calls') AND source IN (SELECT id FROM kp) AND target IN (SELECT id FROM kp)",
    lambda g: both(*V.client_filter(*(lambda s: (s.nodes, s.edges))(settled(g)), [*N.CLIENT_LANGUAGES], ["Active"], "all", ["File", "Function", "Endpoint"], ["Contains", "Calls"])),
)
RANGED = "CASE WHEN end_line IS NULL THEN NULL ELSE named_struct('start_line', line - 1, 'start_char', CAST(seq % 8 AS INT), 'end_line', end_line, 'end_char', 4) END"
graph_query(
    "symbol_records",
    """ SELECT id, coalesce(nullif(language, 'rust'), 'rust') AS language, type, CASE type WHEN 'Method' THEN concat('Shop::', label) ELSE label END AS name, file, line, CAST(seq % 8 AS INT) AS character FROM nodes WHERE file IS NOT NULL AND end_line IS NOT NULL""",
    lambda g: V.symbols_of(g.nodes.selectExpr("id", "seq", "nullif(language, 'rust') AS language", "type", "CASE type WHEN 'Method' THEN concat('Shop::', label) ELSE label END AS label", "file", "CASE WHEN seq % 3 > 0 THEN line END AS line", f"{RANGED} AS range", f"{RANGED} AS selection_range")).drop("label", "range", "selection_range"),
)



TIMED = "SELECT id, severity, file, message, CASE WHEN seq % 5 > 0 THEN line END AS line, CASE WHEN seq % 3 > 0 THEN CAST(seq % 50 AS INT) END AS char, CASE WHEN seq % 2 = 0 THEN language END AS source FROM {d}"


def event_timeline(spark, sf_dir):
    from graphloom.plans.driver_graph import load

    events = table(spark, sf_dir, "events").selectExpr("concat('event:', event_id) AS id", "event_type AS kind", "CAST(NULL AS STRING) AS file", "props AS message", "CAST(value AS STRING) AS at").withColumn("at", F.lit("now"))
    return V.timeline(events, spark.sql(TIMED, d=load(spark, sf_dir).diagnostics), ["error", "warning", "click"])


QUERIES["timeline"] = event_timeline
graph_query(
    "timeline_",
    f", t AS ({TIMED.format(d='diagnostics')}) SELECT concat('event:', event_id) AS id, event_type AS kind, NULL AS file, props AS message, 'now' AS at FROM events WHERE event_type IN ('error', 'warning', 'click') UNION ALL SELECT concat('diagnostic-event:', id), lower(severity), file, CASE WHEN line IS NULL THEN message ELSE concat(message, ' · L', line + 1, ':', coalesce(char, 0) + 1) END, coalesce(source, 'diagnostic') FROM t WHERE severity IN ('Error', 'Warning')",
    None,
)
ORACLE_SQL["timeline"] = ORACLE_SQL.pop("timeline_")
QUERIES.pop("timeline_")

graph_query(
    "files_by_analyzer",
    " SELECT language AS analyzer, count(*) AS files, CAST(CASE language WHEN 'rust' THEN 1 WHEN 'typescript' THEN 2 WHEN 'python' THEN 3 ELSE 4 END AS INT) AS place FROM nodes WHERE type = 'File' GROUP BY language",
    lambda g: V.files_by_analyzer(g.nodes.where("type = 'File'").select(F.col("file").alias("path"))),
)
ENGINES = "SELECT language AS kind, CASE WHEN module IN ('building', 'furniture') THEN 'rust-analyzer' ELSE 'parser' END AS engine, module AS label, count(*) AS files FROM nodes WHERE type = 'File' AND module <> 'machinery' GROUP BY ALL"


def engine_rows(g):
    own = g.nodes.where("type = 'File' AND module <> 'machinery'")
    return own.groupBy(F.col("language").alias("kind"), F.when(F.col("module").isin("building", "furniture"), "rust-analyzer").otherwise("parser").alias("engine"), F.col("module").alias("label")).agg(F.count("*").alias("files"))


graph_query(
    "analyzer_order",
    f" SELECT *, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'rust' THEN 1 WHEN 'typescript' THEN 2 WHEN 'python' THEN 3 ELSE 4 END, engine <> 'rust-analyzer', label) AS INT) AS place FROM ({ENGINES})",
    lambda g: V.sorted_analyzers(engine_rows(g)),
)
# The states of engines as a client is told them; those of one segment have no files.
STATES = "CASE WHEN label = 'building' THEN 'Ready' WHEN kind = 'rust' THEN 'Indexing' WHEN kind = 'python' THEN 'Starting' WHEN kind = 'qml' THEN 'Error' WHEN label = 'automobile' THEN 'Stale' ELSE 'Fallback' END"
graph_query(
    "analyzer_summary",
    f""", a AS (SELECT {STATES} AS status FROM ({ENGINES}) WHERE label <> 'household'), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Error') AS error, count(*) FILTER (WHERE status IN ('Starting', 'Indexing')) AS indexing, count(*) FILTER (WHERE status = 'Ready') AS ready,
 count(*) FILTER (WHERE status = 'Fallback') AS fallback, count(*) FILTER (WHERE status = 'Stale') AS stale FROM a)
 SELECT *, concat('Analyzers · ', coalesce(nullif(concat_ws(' · ', CASE WHEN error > 0 THEN concat(error, ' error') END, CASE WHEN indexing > 0 THEN concat(indexing, ' indexing') END, CASE WHEN ready > 0 THEN concat(ready, ' ready') END, CASE WHEN fallback > 0 THEN concat(fallback, ' fallback') END, CASE WHEN stale > 0 THEN concat(stale, ' stale') END), ''), 'none')) AS label FROM n""",
    lambda g: V.analyzer_summary(engine_rows(g).withColumn("status", F.expr(STATES)).withColumn("files", F.when(F.col("label") != "household", F.col("files")).otherwise(0))),
)
# Every ninth symbol calls itself.
SELF = "SELECT seq, concat('Calls:', id, '->', id) AS id, id AS source, id AS target, 'Calls' AS type, 'Exact' AS confidence, CAST(NULL AS STRING) AS label, CAST(NULL AS STRING) AS evidence, CAST(NULL AS STRING) AS kind FROM {nodes} WHERE seq % 9 = 0"
graph_query(
    "weighted_degree",
    f""", al AS (SELECT * FROM edges UNION ALL {SELF.format(nodes="nodes")}), bn AS (SELECT source, target, count(*) AS n FROM al GROUP BY source, target, type, CASE WHEN type = 'DataFlow' THEN concat(coalesce(kind, 'Unknown'), ':', coalesce(label, '')) END), en AS (SELECT source AS id, n FROM bn UNION ALL SELECT target, n FROM bn)
SELECT nodes.id, CAST(coalesce(sum(n), 0) AS BIGINT) AS weight FROM nodes LEFT JOIN en ON nodes.id = en.id GROUP BY nodes.id""",
    lambda g: V.weighted_degree(g.nodes, bundle(g.edges.unionByName(g.nodes.sparkSession.sql(SELF, nodes=g.nodes)))),
)
graph_query("label_counts", " SELECT crate, label, count(*) AS n FROM nodes GROUP BY ALL", lambda g: g.nodes.groupBy("crate", "label").agg(F.count("*").alias("n")))
graph_query(
    "graph_counters",
    " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE type = 'File' AND reachability = 'Active') AS active_files, (SELECT count(*) FROM nodes WHERE type = 'File' AND reachability = 'Detached') AS detached_files, (SELECT count(*) FROM edges) AS edges",
    lambda g: V.counters(g.nodes, g.edges),
)
graph_query(
    "bounded_graph",
    ", fw AS (SELECT * FROM nodes ORDER BY seq LIMIT 500) SELECT 'node' AS part, id, type FROM fw UNION ALL (SELECT 'edge', id, type FROM edges WHERE source IN (SELECT id FROM fw) AND target IN (SELECT id FROM fw) ORDER BY seq LIMIT 1000)",
    lambda g: both(*V.bounded(g.nodes, g.edges)[:2]),
)
graph_query(
    "related_list",
    ", kn AS (SELECT id FROM nodes WHERE seq % 7 <> 0), bt AS (SELECT target AS id, 0 AS way, seq, source AS other, id AS edge FROM edges UNION ALL SELECT source, 1, seq, target, id FROM edges) SELECT id, CAST(p AS INT) AS place, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way, seq, edge) AS p FROM bt WHERE other IN (SELECT id FROM kn) AND id IN (SELECT id FROM kn)) WHERE p <= 8",
    lambda g: V.related(g.nodes.where("seq % 7 <> 0"), g.edges),
)
graph_query("palette_hits", " SELECT id FROM nodes WHERE contains(lower(concat_ws(chr(10), label, file, module)), 'furniture/customer#00000001') ORDER BY seq LIMIT 10", lambda g: V.palette(g.nodes, " Furniture/Customer#00000001"))
graph_query("palette_start", " SELECT id FROM nodes WHERE type IN ('Module', 'Trait') ORDER BY seq LIMIT 8", lambda g: V.palette(g.nodes.withColumn("bookmarked", F.lit(None).cast("boolean")), ""))
graph_query(
    "diagnostics_patch",
    " SELECT id, file, severity FROM diagnostics WHERE file IS NOT NULL AND NOT contains(file, '0.') UNION ALL SELECT concat(id, ':new'), file, 'Hint' FROM diagnostics WHERE severity = 'Error' AND contains(file, '0.')",
    lambda g: V.patch_diagnostics(g.diagnostics, g.diagnostics.where("severity = 'Error' AND contains(file, '0.')").select(F.concat("id", F.lit(":new")).alias("id"), "file", F.lit("Hint").alias("severity")), g.diagnostics.where("contains(file, '0.')").select("file")),
)
CHANGED = ", ch AS (SELECT file FROM nodes WHERE type = 'File' AND contains(file, '3.')), gn AS (SELECT id FROM nodes WHERE type <> 'File' AND file IN (SELECT file FROM ch))"


def changed(g):
    return g.nodes.where("type = 'File' AND contains(file, '3.')").select("file")


graph_query(
    "changed_files",
    CHANGED + " SELECT 'node' AS part, id, type FROM nodes WHERE id NOT IN (SELECT id FROM gn) UNION ALL SELECT 'edge', id, type FROM edges WHERE source NOT IN (SELECT id FROM gn) AND target NOT IN (SELECT id FROM gn)",
    lambda g: both(*V.without_files(g.nodes, g.edges, changed(g))),
)
graph_query(
    "changed_relations",
    CHANGED + ", al AS (SELECT id FROM nodes WHERE file IN (SELECT file FROM ch)) SELECT id, type FROM edges WHERE type = 'Contains' OR (NOT (type = 'ApiCall' AND confidence = 'Heuristic') AND source NOT IN (SELECT id FROM al) AND target NOT IN (SELECT id FROM al))",
    lambda g: V.without_relations(g.nodes, g.edges, changed(g), True).select("id", "type"),
)
NEWS = f"SELECT id, type, file FROM nodes WHERE type <> 'File' AND file IN (SELECT file FROM ch) AND seq % 5 <> 0"


def read_again(g):
    g = settled(replace(g, nodes=g.nodes.select("seq", "id", "type", "file"), edges=g.edges.select("id", "source", "target", "type", "confidence")))
    fresh = g.nodes.join(changed(g), "file", "left_semi").where("type <> 'File' AND seq % 5 <> 0").select(g.nodes.columns)
    links = g.edges.join(fresh.select(F.col("id").alias("target")), "target", "left_semi").where("type = 'Contains'").select(g.edges.columns)
    return both(*V.refreshed(g.nodes, g.edges, changed(g), fresh, links))


graph_query(
    "refreshed_files",
    CHANGED + f""", nw AS ({NEWS}), nn AS (SELECT id, type FROM nodes WHERE id NOT IN (SELECT id FROM gn) UNION ALL SELECT id, type FROM nw), fi AS (SELECT id FROM nodes WHERE type = 'File' AND file IN (SELECT file FROM ch))
SELECT 'node' AS part, id, type FROM nn UNION ALL SELECT 'edge', id, type FROM edges WHERE source IN (SELECT id FROM nn) AND target IN (SELECT id FROM nn) AND ((type = 'Contains' AND target IN (SELECT id FROM nw)) OR (source NOT IN (SELECT id FROM gn) AND target NOT IN (SELECT id FROM gn)
 AND (type = 'Contains' OR (NOT (type = 'ApiCall' AND confidence = 'Heuristic') AND source NOT IN (SELECT id FROM fi) AND target NOT IN (SELECT id FROM fi)))))""",
    read_again,
)
graph_query(
    "pack_nodes",
    f""", off AS (SELECT id, coalesce(reachability = 'Detached', false) AS off FROM nodes), rk AS (SELECT *, {RANK} + 1 + CASE type WHEN 'ApiCall' THEN 4 WHEN 'EndpointHandler' THEN 4 WHEN 'DataFlow' THEN 3 WHEN 'Calls' THEN 2 ELSE 1 END + CASE WHEN evidence IS NULL THEN 0 ELSE 1 END AS r FROM edges),
rt AS (SELECT id FROM nodes WHERE type = 'Hook'), ar AS (SELECT rt.id AS pack, rk.* FROM rt JOIN rk ON rt.id = rk.source UNION SELECT rt.id, rk.* FROM rt JOIN rk ON rt.id = rk.target),
en AS (SELECT id AS pack, 1 AS sel, 0 AS r, '' AS edge, 0 AS side, id FROM rt UNION ALL SELECT pack, 0, -r, id, 0, source FROM ar UNION ALL SELECT pack, 0, -r, id, 1, target FROM ar),
ok AS (SELECT en.* FROM en JOIN off ON en.id = off.id WHERE sel = 1 OR NOT off), ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pack, id ORDER BY sel DESC, r, edge, side) AS n FROM ok) WHERE n = 1)
SELECT pack, CAST(row_number() OVER (PARTITION BY pack ORDER BY sel DESC, r, edge, side) AS INT) AS place, id FROM ft""",
    lambda g: (lambda n: V.context_nodes(n, g.edges, n.where("type = 'Hook'").select("id")).select("pack", "place", "id"))(checkpoint(g.nodes.select("id", "type", "reachability"))),
)
TRACE_SQL = RANKED + f""", ro AS (SELECT * FROM nodes WHERE type <> 'Endpoint'), lk AS (SELECT *, {STEP_KIND} AS sk FROM rk WHERE type IN ('DataFlow', 'Calls', 'ApiCall', 'EndpointHandler')),
st AS (SELECT id AS trace, 0 AS stage, 0 AS orank, '' AS oid, 0 AS inn, 0 AS r, id AS ref, CASE WHEN reachability = 'Detached' THEN 'DetachedSource' WHEN reachability = 'External' OR type = 'ExternalCrate' THEN 'ExternalDependency' ELSE 'Unknown' END AS kind FROM ro
UNION ALL SELECT ro.id, 1, 0, '', 0, r, lk.id, sk FROM ro JOIN lk ON ro.id = lk.source WHERE tk
UNION ALL SELECT ro.id, 1, 0, '', 0, r, lk.id, sk FROM ro JOIN lk ON ro.id = lk.target AND lk.source <> lk.target WHERE so)""" + NUMBERED.replace("SELECT trace, CAST(p", ", tr AS (SELECT trace, CAST(p", 1) + ")"
graph_query(
    "trace_titles",
    TRACE_SQL + """, oe AS (SELECT id, min_by({'source': source, 'target': target, 'type': type, 'label': label, 'confidence': confidence, 'evidence': evidence}, seq) AS e FROM edges GROUP BY id)
 SELECT trace, step_no, tr.kind, ref, CASE WHEN n.id IS NOT NULL THEN concat('Selected node: ', n.label) ELSE concat('Neighborhood edge: ', coalesce(s.label, 'unknown'), ' -> ', coalesce(t.label, 'unknown')) END AS title, coalesce(e.label, e.type) AS description, CASE WHEN n.id IS NULL THEN t.language ELSE n.language END AS language,
 CASE WHEN n.id IS NULL THEN t.file ELSE n.file END AS file, CASE WHEN n.id IS NULL THEN t.line ELSE n.line END AS line, e.confidence AS confidence, CASE WHEN n.id IS NULL THEN e.evidence ELSE n.signature END AS evidence, CASE WHEN n.id IS NULL THEN t.reachability ELSE n.reachability END AS reachability
 FROM tr LEFT JOIN nodes n ON n.id = ref LEFT JOIN oe ON oe.id = ref LEFT JOIN nodes s ON s.id = e.source LEFT JOIN nodes t ON t.id = e.target""",
    lambda g: (lambda s: V.traced(s.nodes, s.edges, X.node_traces(s.nodes, s.edges)))(settled(g)),
)
graph_query(
    "trace_highlights",
    TRACE_SQL + " SELECT trace, list_sort(coalesce(list(DISTINCT n.id) FILTER (WHERE n.id IS NOT NULL), [])) AS nodes, list_sort(coalesce(list(DISTINCT ref) FILTER (WHERE n.id IS NULL), [])) AS edges FROM tr LEFT JOIN nodes n ON n.id = ref GROUP BY trace",
    lambda g: (lambda s: V.highlights(X.node_traces(s.nodes, s.edges), s.nodes))(settled(g)),
)
graph_query(
    "trace_warnings",
    """ SELECT id AS trace, concat(label, ' is Detached; include with care.') AS warning FROM nodes WHERE type = 'Endpoint' AND reachability = 'Detached' UNION ALL
SELECT n.id, concat('Route ', n.label, ' has ', CAST(c AS VARCHAR), ' active endpoints.') FROM nodes n JOIN (SELECT label, count(*) AS c FROM nodes WHERE type = 'Endpoint' AND reachability = 'Active' GROUP BY label HAVING count(*) > 1) a ON n.label = a.label WHERE n.type = 'Endpoint'""",
    lambda g: V.trace_warnings(g.nodes, K.ambiguous_routes(g.nodes)),
)
BUDGET = "SELECT n_nationkey AS pack, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS INT) AS place, CAST(c_custkey * 7919 % 6000 AS BIGINT) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey"


def snippet_budget(spark, sf_dir):
    rows = spark.sql(BUDGET.replace("customer", "{customer}").replace("JOIN nation", "JOIN {nation}"), customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    return V.within_budget(rows).select("pack", "place", "size")


QUERIES["snippet_budget"] = snippet_budget
ORACLE_SQL["snippet_budget"] = f"""WITH RECURSIVE s AS ({BUDGET}),
f AS (SELECT DISTINCT pack, 0 AS place, 0 AS n, CAST(0 AS BIGINT) AS used, false AS kept, CAST(0 AS BIGINT) AS size FROM s UNION ALL
 SELECT s.pack, s.place, f.n + CASE WHEN f.n < 12 AND f.used + s.size <= 30000 THEN 1 ELSE 0 END, f.used + CASE WHEN f.n < 12 AND f.used + s.size <= 30000 THEN s.size ELSE 0 END, f.n < 12 AND f.used + s.size <= 30000, s.size FROM f JOIN s ON s.pack = f.pack AND s.place = f.place + 1)
SELECT pack, place, size FROM f WHERE kept"""


def check_lines(spark, sf_dir):
    span = lambda k, first: F.expr(f"named_struct('file_name', concat('src\\\\f', s_nationkey, '.rs'), 'line_start', {k}, 'column_start', 1, 'line_end', {k} + 2, 'column_end', 5, 'is_primary', {first})")
    level = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'help' ELSE 'failure-note' END")
    spans = F.when(F.expr("s_suppkey % 5 = 0"), F.array().cast("array<struct<file_name:string,line_start:int,column_start:int,line_end:int,column_end:int,is_primary:boolean>>")).otherwise(F.array(span("0", "false"), span("CAST(s_suppkey AS INT)", "true")))
    body = F.to_json(F.struct(F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 'build-finished' ELSE 'compiler-message' END").alias("reason"), F.struct(F.col("s_name").alias("message"), level.alias("level"), F.struct(F.lit("E1").alias("code")).alias("code"), spans.alias("spans")).alias("message")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line_no"), F.when(F.expr("s_suppkey % 11 = 0"), "{ not json").otherwise(body).alias("value"))
    return V.check_messages(rows).select("id", "file", "severity", "message", "code", "start_line", "end_line")


QUERIES["check_messages"] = check_lines
ORACLE_SQL["check_messages"] = """
WITH m AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0)
SELECT concat('diagnostic:cargo-check:src/f', s_nationkey, '.rs:', s_suppkey - 1, ':0:', i) AS id, concat('src/f', s_nationkey, '.rs') AS file, CASE s_suppkey % 4 WHEN 0 THEN 'Error' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Hint' ELSE 'Information' END AS severity,
 s_name AS message, 'E1' AS code, CAST(s_suppkey - 1 AS INT) AS start_line, CAST(s_suppkey + 1 AS INT) AS end_line FROM m WHERE s_suppkey % 5 <> 0"""
