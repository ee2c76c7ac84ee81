"""Joins by name: the results of all pairs, without the pairs."""

import itertools

from pyspark.sql import functions as F

from graphloom.operators import catalog as K
from graphloom.operators import resolve as R

NODE = "id string, type string, label string, file string, crate string, module string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of_joins(df):
    """The numbers of rows that the joins of df's plan made."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if "Join" in p.getClass().getSimpleName() and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


def places():
    return list(itertools.product(("f1", "f2", None), ("c1", "c2", None), ("m1", "m2", None)))


def test_best_handler_of_every_combination_of_places(spark):
    """Every subset of equal places, nulls equal to nothing, against all pairs; no join makes more rows than there are routes."""
    known = [(f"t{k:02}", "Function" if k % 2 else "Method", f"h{k % 2}", *p) for k, p in enumerate(places() * 2)] + [("x", "Hook", "h0", "f1", "c1", "m1")]
    asked = [(f"r{k:02}", h, *p) for k, p in enumerate(places()) for h in ("h0", "h1", "none")]
    routes = spark.createDataFrame(asked, "route string, handler string, file string, crate string, module string")
    score = lambda a, b: sum(n for x, y, n in zip(a, b, (100, 30, 20)) if x is not None and x == y)
    want = []
    for route, handler, *at in asked:
        some = [(-score(at, n[3:]), n[0]) for n in known if n[2] == handler and n[1] in ("Function", "Method")]
        want += [(route, handler, min(some)[1])] if some else []
    found = R.best_handlers(routes, spark.createDataFrame(known, NODE))
    assert rows(found) == sorted(want)
    assert max(rows_of_joins(found)) <= len(asked)


def test_calls_come_once_without_sorting_the_pairs(spark):
    """Functions of one name in every combination of places, one row twice, against all pairs; nothing is grouped after the joins."""
    known = [(f"t{k:02}", "Function", "f", *p) for k, p in enumerate(places())] + [("t00", "Function", "f", *places()[0])]
    known += [("one", "Hook", "g", "f9", "c1", "m9"), ("two", "Struct", "h", "f9", "c2", "m9"), ("three", "Hook", "h", "f8", "c2", "m8")]
    nodes = spark.createDataFrame(known, NODE)
    asked = [(n[0], name) for n in known for name in ("f", "g", "h")]
    alone = lambda name, crate: sum(n[2] == name and n[4] == crate for n in known) == 1
    near = lambda s, t: s[3] == t[3] or s[4] == t[4] and (s[5] == t[5] or alone(t[2], t[4]))
    at = {n[0]: n for n in known}
    want = {(s, t[0]) for s, name in asked for t in known if t[2] == name and t[1] in ("Function", "Hook") and near(at[s], t)}
    found = R.function_calls(spark.createDataFrame(asked, "source string, callee string"), nodes, ["Function", "Hook"])
    assert rows(found.select("source", "target")) == sorted(want)
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_route_bridge_makes_its_pairs_once(spark):
    calls = [(f"c{k}", ("get", "post", None)[k % 3], "/api/x/") for k in range(60)] + [("c0", None, "/api/x"), ("no", "get", "/api/y")]
    ends = [(f"e{k}", ("GET /api/x", "PUT /api/x")[k % 2]) for k in range(40)]
    found = K.route_bridge(spark.createDataFrame(calls, "call string, verb string, path string"), spark.createDataFrame(ends, "endpoint string, label string"))
    sure = [(c, e, "Semantic") for c, v, p in calls for e, label in ends if v and f"{v.upper()} {p.rstrip('/')}" == label]
    done = {c for c, _, _ in sure}
    loose = [(c, e, "Heuristic") for c, v, p in calls for e, label in ends if c not in done and label.endswith(p.rstrip("/"))]
    assert rows(found) == sorted(sure + loose)
    assert sum(rows_of_joins(found)) <= len(sure) + len(loose) + 2 * len(calls)
