"""Traces and packs: their results on small graphs, and how often their rows are moved."""

from graphloom.operators.traces import node_traces
from graphloom.operators.views import context_nodes

NODES, EDGES = "id string, type string, reachability string", "id string, source string, target string, type string, confidence string, evidence string, kind string"


def graph(spark):
    nodes = [("a", "Function", "Active"), ("b", "Hook", "Active"), ("d", "Hook", "Detached"), ("e", "Endpoint", "Active")]
    edges = [("ab", "a", "b"), ("ba", "b", "a"), ("bb", "b", "b"), ("bd", "b", "d"), ("ae", "a", "e"), ("xa", "x", "a"), ("_a", None, "a"), ("bx", "b", "x")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(k, s, t, "Calls", "Exact", None, None) for k, s, t in edges], EDGES)


def plan(spark, make):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_node_traces_deal_their_steps_once(spark):
    nodes, edges = graph(spark)
    got = {}
    for r in node_traces(nodes, edges).orderBy("trace", "step_no").collect():
        got.setdefault(r["trace"], []).append(r["ref"])
    assert got == {"a": ["a", "ab", "ae", "ba", "xa"], "b": ["b", "ab", "ba", "bb", "bx"], "d": ["d", "bd"]}
    assert plan(spark, lambda: node_traces(nodes, edges)).count("Exchange hashpartitioning") <= 5  # 2 sides of 2 joins and the steps


def test_packs_send_only_other_ends(spark):
    nodes, edges = graph(spark)
    make = lambda: context_nodes(nodes, edges, nodes.where("type = 'Hook'").select("id"))
    got = [(r["pack"], r["place"], r["id"]) for r in make().orderBy("pack", "place").collect()]
    assert got == [("b", 1, "b"), ("b", 2, "a"), ("d", 1, "d"), ("d", 2, "b")]
    assert "posexplode" not in plan(spark, make)
