"""Registered queries over manifests, stored symbol indexes and numbered rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions.session import shared_folder, table
from graphloom.operators import manifests as M
from graphloom.operators import views as V
from graphloom.operators.scan import numbered
from graphloom.operators.symbol_index import SymbolIndex
from graphloom.plans.catalogue import ORACLE_SQL, QUERIES, graph_query
from graphloom.plans.catalogue_views import RANGED
from graphloom.plans.driver_graph import TERA, load

# A workspace for every region, packages of its nations below crates or tools, one of them excluded, and a source file for every second customer.
HOME = "concat('w', CAST(n_regionkey AS STRING), CASE WHEN n_nationkey % 3 = 0 THEN '/tools/t' ELSE '/crates/n' END, CAST(n_nationkey AS STRING))"
SPACE = ["[workspace]", "members = [", '  "crates/*", # all', '  "tools/t?"', "]", 'exclude = ["crates/n4"]']


def facts(spark, sf_dir):
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    lines = lambda rows, path, text: rows.select(path.alias("path"), F.posexplode(text).alias("line_no", "line"))
    own = F.array(*(F.concat(*(F.col("n_name") if part == "{n}" else F.expr("CAST(n_nationkey % 4 AS STRING)") if part == "{d}" else F.lit(part) for part in parts)) for parts in (
        ["[package]"], ['name = "', "{n}", '"'], ["[dependencies]"], ["s", "{d}", ' = { version = "1" }'], ["log.workspace = true"], ["[dev-dependencies]"], ["s", "{d}", ' = "1"'], ["[dependencies.tokio]"], ['version = "1"'])))
    spaces = lines(regions, F.expr("concat('w', CAST(r_regionkey AS STRING), '/Cargo.toml')"), F.array(*map(F.lit, SPACE)))
    return M.cargo_facts(spaces.union(lines(nations, F.expr(f"concat({HOME}, '/Cargo.toml')"), own)))


def project_packages(spark, sf_dir):
    return M.packages(facts(spark, sf_dir)).select("folder", "name", "workspace", F.array_join("dependencies", ",").alias("dependencies"))


def project_files(spark, sf_dir):
    paths = spark.sql(f"SELECT concat({HOME}, '/src/c', CAST(c_custkey AS STRING), '.rs') AS path FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0", customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))
    return M.indexed_files(M.packages(facts(spark, sf_dir)), paths, "w1")


INSIDE = "(n_nationkey % 3 <> 0 AND n_nationkey <> 4 OR n_nationkey % 3 = 0 AND n_nationkey < 10)"
QUERIES["project_packages"], QUERIES["project_files"] = project_packages, project_files
ORACLE_SQL["project_packages"] = f"SELECT {HOME} AS folder, n_name AS name, CASE WHEN {INSIDE} THEN concat('w', n_regionkey) ELSE {HOME} END AS workspace, concat('log,s', n_nationkey % 4, ',tokio') AS dependencies FROM nation"
ORACLE_SQL["project_files"] = f"SELECT n_name AS package, concat({HOME}, '/src/c', c_custkey, '.rs') AS path, concat('c', c_custkey) AS module FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 AND n_regionkey = 1 AND {INSIDE}"


def lookups(g):
    """Look-ups of each kind, told apart by a column."""
    spark = g.nodes.sparkSession
    rows = g.nodes.selectExpr("id", "seq", "language", "type", "label", "file", "line", f"{RANGED} AS range", f"{RANGED} AS selection_range")
    index = SymbolIndex(f"{shared_folder(spark)}/symbols-{uuid.uuid4().hex}").write(V.symbols_of(rows).withColumn("kind", F.col("type")))
    file = g.nodes.where(F.col("seq") == 3 * TERA + 5).first()["file"]
    found = {"id": index.by_id(spark, "sym:7"), "name": index.by_name(spark, "fn_7"), "file": index.by_file(spark, file), "language": index.by_language(spark, "qml"), "kind": index.by_kind(spark, "Hook"), "range": index.by_range(spark, file, 95, 2)}
    out = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("look"), "id")
        out = one if out is None else out.union(one)
    return out


graph_query(
    "symbol_lookups",
    """, s AS (SELECT *, line - 1 AS a, CAST(seq % 8 AS INT) AS ac, 4 AS bc FROM nodes WHERE file IS NOT NULL AND end_line IS NOT NULL), f AS (SELECT * FROM s WHERE file = (SELECT file FROM nodes WHERE seq = {at}))
 SELECT 'id' AS look, id FROM s WHERE id = 'sym:7' UNION ALL SELECT 'name', id FROM s WHERE label = 'fn_7' UNION ALL SELECT 'file', id FROM f UNION ALL SELECT 'language', id FROM s WHERE language = 'qml' UNION ALL SELECT 'kind', id FROM s WHERE type = 'Hook'
 UNION ALL SELECT 'range', id FROM f WHERE (a < 95 OR a = 95 AND ac <= 2) AND (end_line > 95 OR end_line = 95 AND bc >= 2)""".replace("{at}", str(3 * TERA + 5)),
    lookups,
)


def numbered_events(spark, sf_dir):
    return numbered(load(spark, sf_dir).diagnostics.select("id", "file", "line"), ["file", "line", "id"], "place", first=1)


QUERIES["numbered_diagnostics"] = numbered_events
graph_query("numbered_", " SELECT id, file, line, row_number() OVER (ORDER BY file, line, id) AS place FROM diagnostics", None)
ORACLE_SQL["numbered_diagnostics"] = ORACLE_SQL.pop("numbered_")
QUERIES.pop("numbered_")
