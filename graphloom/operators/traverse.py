"""Traversals: frontier joins, one checkpoint a hop, until the frontier is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.session import bucketed, checkpoint


def spread(steps: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, hop) of what is reached from start (id) along steps (a, b), of which some may be repeated; hop is the least number of steps."""
    steps = steps if depth == 1 else bucketed(steps, "a")  # read once every hop
    seen = checkpoint(start.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        met = frontier.select(F.col("id").alias("a")).join(steps, "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = checkpoint(met.withColumn("hop", F.lit(hop)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source"))


def focus(nodes: DataFrame, edges: DataFrame, centre: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """(node ids with hops, edges) around the centre (id): undirected, over all edge types; the whole component without depth.

    An edge stays if both ends were visited, even if one of them has no node of its own. A centre
    that is no node gives nothing.
    """
    found = spread(undirected(edges), centre.join(nodes, "id", "left_semi"), depth)
    inside = edges.join(found.select(F.col("id").alias("source")), "source", "left_semi").join(found.select(F.col("id").alias("target")), "target", "left_semi")
    return found.join(nodes, "id", "left_semi"), inside


def neighbourhood(nodes: DataFrame, edges: DataFrame, centre: DataFrame, depth: int) -> DataFrame:
    """Ids within depth steps of the centre, over edges between the given nodes alone."""
    ids = nodes.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return spread(undirected(inner), centre.join(nodes, "id", "left_semi"), depth)


STRUCTURAL = ["Contains", "ModDeclaration", "ExternalDependency"]
IMPORTANT = ["Endpoint", "Struct", "Class", "Object", "Enum", "Trait", "Impl", "Component", "Hook", "Interface", "TypeAlias"]


def hierarchy_depth():
    """1 to 4 by a node's kind: crates and modules, files, important symbols, the rest."""
    plain_callable = F.col("type").isin("Function", "Method", "Handler") & (F.col("visibility").isin("pub", "pub(crate)") | (F.coalesce("signature", F.lit("")) != "") | (F.col("connections") >= 2))
    return (
        F.when((F.col("type") == "ExternalCrate") | ((F.col("type") == "Module") & F.col("file").isNull()), 1)
        .when(F.col("type").isin("Module", "File"), 2)
        .when(F.col("type").isin(IMPORTANT) | F.coalesce(plain_callable, F.lit(False)), 3)
        .otherwise(4)
    )


def hierarchy(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Ids that show at a hierarchy depth. nodes need connections."""
    nodes = checkpoint(nodes.select("id", "seq", "type", hierarchy_depth().alias("depth")))  # what follows reads this and the next two several times
    ids = nodes.select("id")
    inner = edges.where(F.col("type").isin(STRUCTURAL)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    inner = checkpoint(inner.select(F.col("source").alias("a"), F.col("target").alias("b")))
    roots = checkpoint(ids.join(inner.select(F.col("b").alias("id")), "id", "left_anti"))
    if not roots.take(1):
        roots = nodes.orderBy("seq").limit(1).select("id")
    levels = spread(inner, roots)
    return nodes.where(F.col("depth") <= depth).join(levels.withColumnRenamed("hop", "level"), "id", "left").where(F.col("level").isNull() | (F.col("level") <= depth + 1)).select("id", "type", "level")


def owners(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, owner) of all that collapsed groups (id, position) contain; the first group to reach a node owns it."""
    steps = edges.where("type = 'Contains'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    seen = frontier = checkpoint(groups.select(F.col("id").alias("owner"), "position", "id"))
    while True:
        met = frontier.select("owner", "position", F.col("id").alias("a")).join(steps, "a").select("owner", "position", F.col("b").alias("id")).distinct().join(seen, ["owner", "id"], "left_anti")
        frontier = checkpoint(met.select("owner", "position", "id"))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen.where("id <> owner").groupBy("id").agg(F.min_by("owner", "position").alias("owner"))


def collapse(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the groups' contents hidden: edges go to the owner, those within one group vanish."""
    own = checkpoint(owners(edges, groups.join(nodes, "id", "left_semi")))
    left = nodes.join(own, "id", "left_anti")
    both = edges.join(own.select(F.col("id").alias("source"), F.col("owner").alias("s")), "source", "left").join(own.select(F.col("id").alias("target"), F.col("owner").alias("t")), "target", "left")
    new_s, new_t = F.coalesce("s", "source"), F.coalesce("t", "target")
    name = F.when(F.col("s").isNull() & F.col("t").isNull(), F.col("id")).otherwise(F.concat("type", F.lit(":"), new_s, F.lit("->"), new_t, F.lit(":"), "id"))
    moved = both.where(new_s != new_t).select(name.alias("id"), new_s.alias("source"), new_t.alias("target"), "type", "confidence", *(c for c in ("seq", "label", "kind") if c in edges.columns))
    ids = left.select("id")
    return left, moved.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def api_propagation(edges: DataFrame) -> DataFrame:
    """New ApiCall edges (source, target): who calls a symbol that calls an endpoint, one hop, unless it's there."""
    apis = edges.where("type = 'ApiCall'").select(F.col("source").alias("via"), "target")
    calls = edges.where("type = 'Calls'").select("source", F.col("target").alias("via"))
    new = calls.join(apis, "via").select("source", "target").distinct()
    return new.join(edges.where("type = 'ApiCall'").select("source", "target"), ["source", "target"], "left_anti")


def first_by_seq(rows: DataFrame, *key: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where("place = 1").drop("place")


def reachable_from(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, roots): for every node that roots (id) reach along steps (a, b), the sorted roots that reach it, each itself included."""
    steps = checkpoint(steps.distinct())
    seen = frontier = checkpoint(roots.select(F.col("id").alias("root"), "id").distinct())
    while True:
        met = frontier.withColumnRenamed("id", "a").join(steps, "a").select("root", F.col("b").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        frontier = checkpoint(met)
        if not frontier.take(1):
            return seen.groupBy("id").agg(F.array_sort(F.collect_set("root")).alias("roots"))
        seen = seen.unionByName(frontier)


def group_links(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(owner, incoming, outgoing): the sorted types of edges that cross each collapsed group's border; own is (id, owner)."""
    both = edges.join(own.select(F.col("id").alias("source"), F.col("owner").alias("s")), "source", "left").join(own.select(F.col("id").alias("target"), F.col("owner").alias("t")), "target", "left")
    cross = ~F.col("s").eqNullSafe(F.col("t"))
    out = both.where(cross & F.col("s").isNotNull() & (F.col("target") != F.col("s"))).select(F.col("s").alias("owner"), F.col("type").alias("outgoing"), F.lit(None).cast("string").alias("incoming"))
    into = both.where(cross & F.col("t").isNotNull() & (F.col("source") != F.col("t"))).select(F.col("t").alias("owner"), F.lit(None).cast("string"), F.col("type"))
    sets = out.union(into).groupBy("owner").agg(F.array_sort(F.collect_set("incoming")).alias("incoming"), F.array_sort(F.collect_set("outgoing")).alias("outgoing"))
    return sets
