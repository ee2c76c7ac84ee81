"""A code graph projected from the business tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.session import checkpoint, table, task_sizes

SYMBOL = "CASE o_orderkey % 6 WHEN 0 THEN 'Function' WHEN 1 THEN 'Method' WHEN 2 THEN 'Component' WHEN 3 THEN 'Hook' WHEN 4 THEN 'Handler' ELSE 'Endpoint' END"
PART = "CASE p_partkey % 6 WHEN 0 THEN 'Struct' WHEN 1 THEN 'Enum' WHEN 2 THEN 'Trait' WHEN 3 THEN 'Impl' WHEN 4 THEN 'Interface' ELSE 'TypeAlias' END"
VERB = "CASE o_orderstatus WHEN 'O' THEN 'GET' WHEN 'F' THEN 'POST' ELSE 'PUT' END"
LABEL = f"CASE WHEN o_orderkey % 6 = 5 THEN concat({VERB}, ' /api/orders/', CAST(o_orderkey % 50 AS STRING)) ELSE concat('fn_', CAST(o_orderkey % 500 AS STRING)) END"
PATH = "concat('src/', lower(c_mktsegment), '/', c_name, CASE c_custkey % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.tsx' WHEN 2 THEN '.py' ELSE '.qml' END)"
REACH = "CASE WHEN c_acctbal < 0 THEN 'Detached' ELSE 'Active' END"
CONFIDENCE = "CASE {k} % 4 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Semantic' WHEN 2 THEN 'SyntaxFallback' ELSE 'Heuristic' END"
TERA = 1_000_000_000_000  # keeps the order of the kinds of rows in seq

NODES = f"""
SELECT CAST(r_regionkey AS BIGINT) AS seq, concat('crate:', r_name) AS id, 'Module' AS type, r_name AS label, CAST(NULL AS STRING) AS file, 'crate root' AS module, r_name AS crate,
 CAST(NULL AS INT) AS line, 'pub' AS visibility, CAST(NULL AS STRING) AS signature, 'Active' AS reachability, 'rust' AS language, CAST(NULL AS INT) AS end_line FROM {{region}}
UNION ALL SELECT {TERA} + n_nationkey, concat('module:', n_name), 'Module', n_name, NULL, n_name, n_name, NULL, 'pub', NULL, 'Active', 'rust', NULL FROM {{nation}}
UNION ALL SELECT 2 * {TERA} + s_suppkey, concat('external:', s_name), 'ExternalCrate', s_name, NULL, NULL, 'external', NULL, NULL, NULL, 'External', NULL, NULL FROM {{supplier}}
UNION ALL SELECT 3 * {TERA} + c_custkey, concat('file:', {PATH}), 'File', c_name, {PATH}, lower(c_mktsegment), n_name, NULL, NULL, NULL, {REACH},
 CASE c_custkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' ELSE 'qml' END, NULL FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
UNION ALL SELECT 4 * {TERA} + o_orderkey, concat('sym:', CAST(o_orderkey AS STRING)), {SYMBOL}, {LABEL}, {PATH}, lower(c_mktsegment), n_name, CAST(o_orderkey % 400 + 1 AS INT),
 CASE o_orderstatus WHEN 'O' THEN 'pub' WHEN 'F' THEN 'private' ELSE 'pub(crate)' END, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('fn ', {LABEL}) END, {REACH},
 CASE c_custkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' ELSE 'qml' END, CAST(o_orderkey % 400 + 1 + o_orderkey % 37 AS INT)
 FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
UNION ALL SELECT 5 * {TERA} + p_partkey, concat('part:', CAST(p_partkey AS STRING)), {PART}, p_name, NULL, p_brand, p_brand, NULL, 'pub', NULL, 'Active', 'rust', NULL FROM {{part}}
"""

EDGES = f"""
SELECT seq, concat(type, ':', source, '->', target) AS id, source, target, type, confidence, label, evidence, kind FROM (
SELECT CAST(n_nationkey AS BIGINT) AS seq, concat('crate:', r_name) AS source, concat('module:', n_name) AS target, 'Contains' AS type, 'Exact' AS confidence,
 CAST(NULL AS STRING) AS label, CAST(NULL AS STRING) AS evidence, CAST(NULL AS STRING) AS kind FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT {TERA} + c_custkey, concat('module:', n_name), concat('file:', {PATH}), 'Contains', 'Exact', NULL, NULL, NULL FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
UNION ALL SELECT 2 * {TERA} + o_orderkey, concat('file:', {PATH}), concat('sym:', CAST(o_orderkey AS STRING)), 'Contains', 'Exact', NULL, NULL, NULL FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
UNION ALL SELECT 3 * {TERA} + s_suppkey, concat('module:', n_name), concat('external:', s_name), 'ExternalDependency', 'Exact', NULL, NULL, NULL FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
UNION ALL SELECT 4 * {TERA} + o_orderkey, concat('sym:', CAST(o_orderkey AS STRING)), concat('sym:', CAST(next AS STRING)),
 CASE WHEN next % 6 = 5 THEN 'ApiCall' WHEN o_orderkey % 6 = 5 THEN 'EndpointHandler' WHEN next % 6 = 2 THEN 'Renders' ELSE 'Calls' END, {CONFIDENCE.format(k="o_orderkey")}, NULL, NULL, NULL
 FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM {{orders}}) x WHERE next IS NOT NULL
UNION ALL SELECT 5 * {TERA} + l_orderkey * 100000 + l_partkey % 100000, concat('sym:', CAST(l_orderkey AS STRING)), concat('part:', CAST(l_partkey AS STRING)),
 CASE flag WHEN 'R' THEN 'TypeReference' WHEN 'A' THEN 'Uses' ELSE 'DataFlow' END, {CONFIDENCE.format(k="(l_orderkey + l_partkey)")}, flag, status,
 CASE WHEN flag IN ('R', 'A') THEN NULL WHEN least % 3 = 0 THEN 'ModelUse' WHEN least % 3 = 1 THEN 'ReturnValue' ELSE 'Assignment' END
 FROM (SELECT l_orderkey, l_partkey, substr(first, 5, 1) AS flag, substr(first, 6, 1) AS status, least FROM (SELECT l_orderkey, l_partkey, min(concat(lpad(CAST(l_linenumber AS STRING), 4, '0'), l_returnflag, l_linestatus)) AS first, min(l_linenumber) AS least FROM {{lineitem}} GROUP BY l_orderkey, l_partkey) x) y
) z"""

DIAGNOSTICS = f"""
SELECT event_id AS seq, concat('diagnostic:', CAST(event_id AS STRING)) AS id, {PATH} AS file,
 CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'view' THEN 'Information' ELSE 'Hint' END AS severity,
 CAST(event_id % 400 AS INT) AS line, event_type AS message, ts, CASE c_custkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'typescript' WHEN 2 THEN 'python' ELSE 'qml' END AS language
 FROM {{events}} JOIN {{customer}} ON user_id = c_custkey"""

CHECKS = """
SELECT concat('check:', CAST(s_suppkey AS STRING)) AS id, s_suppkey % 5 IN (0, 1) AS success, s_suppkey % 5 = 4 AS skipped, s_suppkey % 5 = 3 AS timed_out, s_nationkey AS project FROM {supplier}"""

TABLES = "region nation customer supplier part orders lineitem events".split()
PARTS = {"nodes": NODES, "edges": EDGES, "diagnostics": DIAGNOSTICS, "checks": CHECKS}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    checks: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Graph:
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    task_sizes(spark, list(tables.values()))
    return Graph(**{k: spark.sql(q, **{t: d for t, d in tables.items() if "{" + t + "}" in q}) for k, q in PARTS.items()})


def settled(graph: Graph) -> Graph:
    """The graph with its nodes and edges computed once, for queries that use them in several places."""
    return replace(graph, nodes=checkpoint(graph.nodes), edges=checkpoint(graph.edges))


def duckdb_ctes() -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS MATERIALIZED ({q.format(**{t: t for t in TABLES})})" for k, q in PARTS.items())
