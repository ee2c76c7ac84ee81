"""Lenses and the route flow: parts of the graph that grow from its API calls until nothing is added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.modes import both_ends
from graphloom.operators.traverse import spread

# The edge types that a lens shows.
SHOWN = {"architecture": "Contains Imports ExternalDependency Uses ApiCall EndpointHandler", "api": "Contains Calls ApiCall EndpointHandler"}


def lens(nodes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the architecture or api lens: the ends of API calls with their files and crates; and then
    modules, files and endpoints (architecture), or what contains, what is called and what handles (api)."""
    brief = nodes.select("id", "file", "crate")
    calls = both_ends(edges.where("type = 'ApiCall'"), nodes)
    ends = calls.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(brief, "id")
    files = nodes.where("type = 'File'").select("id", "file").join(ends.where("file IS NOT NULL").select("file").distinct(), "file", "left_semi")
    crates = nodes.where("type = 'Module'").select("id", "crate").join(ends.where("crate IS NOT NULL").select("crate").distinct(), "crate", "left_semi")
    keep = ends.select("id").union(files.select("id")).union(crates.select("id"))
    if kind == "architecture":
        keep = keep.union(nodes.where(F.col("type").isin("Module", "File", "Endpoint")).select("id"))
    else:
        routes = nodes.where("type = 'Endpoint'").select(F.col("id").alias("target"))
        up = edges.where("type = 'Contains'").select(F.col("target").alias("a"), F.col("source").alias("b"))
        to = edges.where("type = 'Calls'").join(routes, "target", "left_semi").select(F.col("source").alias("a"), F.col("target").alias("b"))
        by = edges.where("type = 'EndpointHandler'").select(F.col("source").alias("a"), F.col("target").alias("b"))
        keep = spread(up.union(to).union(by), keep.distinct()).select("id")
    kept = nodes.join(keep.distinct(), "id", "left_semi")
    return kept, both_ends(edges.where(F.col("type").isin(SHOWN[kind].split())), kept)


def route_flow(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the routes: API calls, their handlers and calls, the data flows beside these, and all that data flows reach."""
    lost = nodes.where("reachability = 'Detached'").select("id")
    off = lambda frame, c: frame.join(lost.withColumnRenamed("id", c), c, "left_anti")
    api = off(off(edges.where("type = 'ApiCall'"), "source"), "target").select("id", "source", "target")
    hand = off(edges.where("type = 'EndpointHandler'"), "target").join(api.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("id", "source", "target")
    call = edges.where("type = 'Calls'").join(hand.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("id", "source", "target")
    core = api.union(hand).union(call)
    starts = api.select("source").union(api.select("target")).union(hand.select("target")).union(call.select("target")).toDF("id").distinct()
    flows = edges.where("type = 'DataFlow'")
    ways = flows.select(F.col("source").alias("a"), F.col("target").alias("b")).union(flows.select("target", "source"))
    reached = spread(ways, starts).select("id")
    # every flow at a reached node is kept, so those beside calls and handlers are among them
    beside = flows.join(reached.withColumnRenamed("id", "source"), "source", "left_semi").select("id")
    shown = edges.join(core.select("id").union(beside).distinct(), "id", "left_semi")
    ended = edges.where("type = 'ApiCall'").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    ids = reached.union(nodes.where("type = 'Endpoint'").select("id").join(ended, "id", "left_semi")).distinct()
    kept = nodes.join(ids, "id", "left_semi").join(lost, "id", "left_anti")
    return kept, both_ends(shown, nodes)
