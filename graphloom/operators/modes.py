"""Graph modes: which nodes and edges a view of the code graph holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Node types, edge types and, where a mode has them, semantic edge types by mode.
TYPES = {
    "macro": "Module File Endpoint ExternalCrate",
    "meso": "File Module Struct Class Object Enum Trait Impl Component Hook Interface TypeAlias Endpoint",
    "micro": "Function Method Handler Component Hook Property Signal Endpoint Struct Class Interface TypeAlias",
    "callflow": "Function Method Handler Component Hook Endpoint",
    "dataflow": "Function Method Component Hook Endpoint Struct Class Object Enum Trait Interface TypeAlias Property Signal Handler",
    "traits": "File Module Trait Impl Struct Class Object Enum Interface TypeAlias Method Property",
}
EDGE_TYPES = {
    "macro": "Contains Imports Uses ApiCall EndpointHandler ModDeclaration ExternalDependency",
    "meso": "Contains Imports Uses ApiCall EndpointHandler Implements TypeReference Renders",
    "micro": "Calls Renders ApiCall EndpointHandler DataFlow TypeReference Uses",
    "callflow": "Calls Renders ApiCall EndpointHandler",
    "dataflow": "DataFlow ApiCall EndpointHandler Calls",
    "traits": "Implements Contains TypeReference Imports Uses",
}
SEMANTIC = {"callflow": "Calls Renders ApiCall EndpointHandler", "dataflow": "DataFlow ApiCall EndpointHandler", "traits": "Implements TypeReference Uses Imports"}
CALLABLE = ["Function", "Method", "Handler"]


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with connections: the edges at each node, a self-loop counting once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.join(ends, "id", "left").withColumn("connections", F.coalesce("n", F.lit(0))).drop("n")


def important():
    return F.col("visibility").isin("pub", "pub(crate)") | F.col("signature").isNotNull() | (F.col("connections") >= 2)


def both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges whose source and target are among ids (id)."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def filter_snapshot(nodes: DataFrame, edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a mode. Detached nodes never show.

    Without a call edge the call flow falls back to containment. In the modes with semantic edges,
    nodes on none of these go, unless there are none at all.
    """
    allowed = F.col("type").isin(TYPES[mode].split())
    if mode == "meso":
        nodes = degree(nodes, edges)
        allowed = allowed | (F.col("type").isin(CALLABLE) & important())
    keep = nodes.where(allowed & ~F.coalesce(F.col("reachability") == "Detached", F.lit(False)))
    wanted = EDGE_TYPES[mode].split()
    fallback = ["Contains"] if mode == "callflow" else []
    found = both_ends(edges.where(F.col("type").isin(wanted + fallback)), keep)
    if fallback:
        none = found.where(F.col("type").isin(wanted)).limit(1).agg((F.count("*") == 0).alias("none"))
        found = found.crossJoin(F.broadcast(none)).where(F.col("type").isin(wanted) | F.col("none")).drop("none")
    if mode not in SEMANTIC:
        return keep, found
    touched = found.where(F.col("type").isin(SEMANTIC[mode].split())).select(F.explode(F.array("source", "target")).alias("id")).distinct()
    none = touched.limit(1).agg((F.count("*") == 0).alias("none"))
    marked = keep.join(touched.withColumn("on", F.lit(True)), "id", "left").crossJoin(F.broadcast(none))
    keep = marked.where(F.col("on") | F.col("none")).drop("on", "none")
    return keep, both_ends(found, keep)


def edge_visibility(edges: DataFrame, level: str) -> DataFrame:
    """The edges of a level of detail: all, semantic or essential."""
    sure = (F.col("type") == "Calls") & F.col("confidence").isin("Exact", "Semantic")
    essential = F.col("type").isin("Contains", "EndpointHandler", "ApiCall", "Renders") | sure
    more = F.col("type").isin("Calls", "Imports", "Uses", "DataFlow", "TypeReference")
    return edges.where({"all": F.lit(True), "semantic": essential | more, "essential": essential}[level])


def bundle(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: the first, with how many there are and their ids in order."""
    key = ["source", "target", "type", F.when(F.col("type") == "DataFlow", F.concat_ws(":", F.coalesce("kind", F.lit("Unknown")), F.coalesce("label", F.lit("")))).alias("flow")]
    first = F.min_by(F.struct("id", "confidence"), "seq").alias("first")
    many = edges.groupBy(*key).agg(first, F.count("*").alias("bundled"), F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("all"))
    name = F.when(F.col("bundled") == 1, F.col("first.id")).otherwise(F.concat("type", F.lit(":"), "source", F.lit("->"), "target", F.lit(":bundle:"), F.col("bundled")))
    return many.select(name.alias("id"), "source", "target", "type", "first.confidence", "bundled", F.col("all.id").alias("edge_ids"))
