"""Small graphs whose answers are known, and every registered query against its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.functions import columns as C
from graphloom.operators import catalog as K
from graphloom.operators import modes as M
from graphloom.operators import traverse as T
from graphloom.plans import catalogue, catalogue_sources, catalogue_views  # noqa: F401

NODE = "seq long, id string, type string, label string, file string, module string, crate string, line int, visibility string, signature string, reachability string, language string"
EDGE = "seq long, id string, source string, target string, type string, confidence string, label string, evidence string, kind string"
SF = "/root/testdata/sf0.001"


def nodes(spark, *rows):
    full = [(k, r[0], r[1], r[2] if len(r) > 2 else r[0], *(r[3] if len(r) > 3 else (None,) * 8)) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(k, f"{t}:{s}->{d}", s, d, t, "Exact", None, None, None) for k, (s, d, t) in enumerate(rows)], EDGE)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_callflow_keeps_calls_and_falls_back(spark):
    n = nodes(spark, ("f", "File"), ("a", "Function"), ("b", "Function"), ("s", "Struct"))
    e = edges(spark, ("f", "a", "Contains"), ("a", "b", "Calls"), ("a", "s", "TypeReference"))
    kept, links = M.filter_snapshot(n, e, "callflow")
    assert (ids(kept), ids(links)) == (["a", "b"], ["Calls:a->b"])
    kept, links = M.filter_snapshot(nodes(spark, ("c", "Component"), ("h", "Hook")), edges(spark, ("c", "h", "Contains")), "callflow")
    assert (ids(kept), ids(links)) == (["c", "h"], ["Contains:c->h"])


def test_detached_nodes_never_show(spark):
    n = nodes(spark, ("f", "File", "f", (None, None, None, None, None, None, "Detached", None)), ("m", "Module"))
    assert ids(M.filter_snapshot(n, edges(spark, ("m", "f", "Contains")), "macro")[0]) == ["m"]


def test_focus_depth_and_dangling_ends(spark):
    n = nodes(spark, ("a", "Function"), ("b", "Function"), ("c", "Function"))
    e = edges(spark, ("a", "b", "Calls"), ("b", "c", "Calls"), ("c", "gone", "Calls"))
    at = n.where("id = 'a'").select("id")
    assert ids(T.focus(n, e, at, 1)[0]) == ["a", "b"]
    full, links = T.focus(n, e, at, None)
    assert ids(full) == ["a", "b", "c"] and len(ids(links)) == 3
    assert T.focus(n, e, n.select(C.F.lit("nobody").alias("id")).limit(1), 2)[0].count() == 0


def test_self_loop_counts_once(spark):
    n = nodes(spark, ("a", "Function"), ("b", "Function"))
    got = {r["id"]: r["connections"] for r in M.degree(n, edges(spark, ("a", "a", "Calls"), ("a", "b", "Calls"))).collect()}
    assert got == {"a": 2, "b": 1}


def test_collapse_moves_edges_to_the_owner(spark):
    n = nodes(spark, ("g", "Module"), ("x", "File"), ("y", "Function"), ("z", "Function"))
    e = edges(spark, ("g", "x", "Contains"), ("x", "y", "Contains"), ("y", "z", "Calls"))
    left, links = T.collapse(n, e, n.where("id = 'g'").select("id", C.F.lit(0).alias("position")))
    assert ids(left) == ["g", "z"] and [(r["source"], r["target"]) for r in links.collect()] == [("g", "z")]


def test_containment_cycles_end(spark):
    n = nodes(spark, ("a", "Module"), ("b", "Module"))
    e = edges(spark, ("a", "b", "Contains"), ("b", "a", "Contains"))
    assert ids(T.hierarchy(M.degree(n, e), e, 1)) == ["a", "b"]


def test_search_ranks_equal_before_beginning_before_part(spark):
    n = nodes(spark, ("1", "Function", "myuser"), ("2", "Function", "UserHandler"), ("3", "Function", "user"))
    assert [(r["id"], r["score"]) for r in K.search(n, " User ").collect()] == [("3", 0), ("2", 1), ("1", 2)]
    assert K.search(n, "").count() == 3


def test_patch_round_trip(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "seq long, id string, label string")
    new = spark.createDataFrame([(1, "a", "x"), (2, "b", "new"), (4, "d", "w")], "seq long, id string, label string")
    ops = K.diff(old, new, ["label"])
    some = lambda op: new.join(ops.where(C.F.col("op") == op), "id", "left_semi")
    got, links = K.apply_patch(old, edges(spark, ("a", "c", "Calls"), ("a", "b", "Calls")), some("added"), some("updated"), ops.where("op = 'removed'").select("id"))
    assert sorted(map(tuple, got.select("id", "label").collect())) == [("a", "x"), ("b", "new"), ("d", "w")]
    assert ids(links) == ["Calls:a->b"]


def test_routes_and_hashes(spark):
    got = spark.range(1).select(
        C.route_key(C.F.lit(" get"), C.F.lit("api/users//")).alias("a"),
        C.route_path(C.F.lit("")).alias("b"),
        C.api_path(C.F.lit("/api/u/:id/${x}?q=1")).alias("c"),
        C.fnv1a64(C.F.lit("")).alias("d"),
        C.fnv1a64(C.F.lit("a")).alias("e"),
        C.fnv1a64(C.F.lit("é")).alias("f"),
        C.flow_identity(C.F.lit(" "), C.F.lit(None).cast("string")).alias("g"),
    ).first()

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    assert list(got) == ["GET /api/users", "/", "/api/u/:param/:param", fnv(b""), fnv(b"a"), fnv("é".encode()), "flow"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["mode_meso", "mode_traits", "focus_d2", "hierarchy_d2", "search_prefix", "endpoint_choice", "file_rollup", "diag_overlap", "check_status", "snapshot_diff", "dataflow_ids", "route_keys", "brace_delta"])
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    place = [want.columns.index(c) for c in order]
    assert sorted(map(str, (tuple(r) for r in got.select(*order).collect()))) == sorted(map(str, (tuple(r[k] for k in place) for r in want.fetchall())))
