"""Small sources whose relations are known, and edge cases of the name functions."""

from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators import extract as E
from graphloom.operators import relations as L
from graphloom.operators import resolve as R
from graphloom.operators import views as V

RUST = "trait Show {\n    fn show(&self);\n    struct Odd;\n}\nstruct Item;\nimpl Item {\n    fn new() -> Item {\n        helper(1);\n        Item::make()\n    }\n    fn make() -> Item {\n        self.new();\n    }\n}\nfn helper(n: u8) {\n    let i = Item::new();\n}\n"
SCRIPT = "import React, { useState as state, memo } from './lib'\nexport function App() {\n  const x = helper(1)\n  return <Panel />\n}\nfunction helper(a) {\n}\nconst Panel = (p) => {\n}\n"
PYTHON = "from .lib import one as first, two\n@app.get('/api/users')\n@cached\ndef users():\n    return one()\n\n@app.route(\"/api/x\", methods=['DELETE'])\nasync def gone():\n    pass\n\n@app.get('/plain')\ndef plain():\n    pass\n"
QML = "Item {\n  property string name: 'x'\n  Button {\n    onClicked: go()\n    function press() {\n    }\n  }\n  signal done\n}\nsignal late\n"


def lines(spark, **texts):
    kind = {"rs": "rust", "ts": "typescript", "py": "python", "qml": "qml"}
    rows = [(p.replace("__", "/").replace("_D_", "."), t) for p, t in texts.items()]
    return E.lines_of(spark.createDataFrame([(p, kind[p.rsplit(".", 1)[1]], t) for p, t in rows], "path string, language string, text string"))


def test_rust_calls_resolve_by_owner(spark):
    own = lines(spark, src__a_D_rs=RUST)
    symbols = E.rust_symbols(own)
    assert {(r["name"], r["type"]) for r in symbols.collect()} == {("Show", "Trait"), ("Show::show", "Method"), ("Item", "Struct"), ("Item", "Impl"), ("Item::new", "Method"), ("Item::make", "Method"), ("helper", "Function")}
    found = {(r["source"].split("::", 1)[1], r["target"].split("::", 1)[1]) for r in L.relations(own, symbols).collect()}
    assert found == {("Item::new@7", "helper@15"), ("Item::new@7", "Item::make@11"), ("Item::make@11", "Item::new@7"), ("helper@15", "Item::new@7")}


def test_scripts_call_draw_and_import(spark):
    own = lines(spark, web__app_D_ts=SCRIPT, web__lib_D_ts="export const memo = (x) => {\n}\n", app__m_D_py=PYTHON, app__lib_D_py="def one():\n    pass\n")
    symbols = E.typescript_symbols(own).unionByName(E.python_symbols(own))
    found = {(r["source"], r["target"], r["type"]) for r in L.relations(own, symbols).collect()}
    assert ("web/app.ts::App@2", "web/app.ts::helper@6", "Calls") in found and ("web/app.ts::App@2", "web/app.ts::Panel@8", "Renders") in found
    edges = {(r["source"], r["target"], r["type"]) for r in L.import_edges(own, symbols, own.select("path").distinct()).collect()}
    assert edges == {("file:web/app.ts", "file:web/lib.ts", "Imports"), ("file:web/app.ts", "web/lib.ts::memo@1", "Uses"), ("file:app/m.py", "file:app/lib.py", "Imports"), ("file:app/m.py", "app/lib.py::one@1", "Uses")}
    routes = [(r["verb"], r["route"], r["handler"]) for r in L.python_routes(own).orderBy("line_no").collect()]
    assert routes == [("GET", "/api/users", "users"), ("DELETE", "/api/x", "gone")]


def test_qml_members_know_their_object(spark):
    own = lines(spark, ui__Main_D_qml=QML)
    got = {(r["name"], r["type"], r["owner_line"]) for r in L.qml_members(own).collect()}
    assert got == {("Item", "Object", None), ("name", "Property", 1), ("Button", "Object", 1), ("onClicked", "Handler", 3), ("press", "Function", 3), ("done", "Signal", 1), ("late", "Signal", 1)}


def test_names(spark):
    cases = [
        (N.module_path(F.lit('src/main.rs'), F.lit('rust')), 'crate root'),
        (N.module_path(F.lit('src/a/mod.rs'), F.lit('rust')), 'a'),
        (N.module_path(F.lit('frontend/src/app/x.test.tsx'), F.lit('typescript')), 'app::x.test'),
        (N.module_path(F.lit('pkg/__init__.py'), F.lit('python')), 'pkg'),
        (N.module_path(F.lit('__init__.py'), F.lit('python')), 'python'),
        (N.relative_to(F.lit('C:\\w'), F.lit('C:\\w\\a\\b.rs')), 'a/b.rs'),
        (N.first_string(F.lit('x \'it is "a\\\'b" c\' y')), 'it is "a\\\'b" c'),
        (N.first_string(F.lit("don't `go`")), 'go'),
        (N.first_string(F.lit('none')), None),
        (N.receiver(F.lit('let x = a::Bee .go(1)'), 'go'), 'Bee'),
        (N.last_identifier(F.lit('a.b?.c$()')), 'c$'),
        (N.endpoint_id(F.lit('f'), F.lit('get'), F.lit('/api/{id}/:x/'), F.lit(3)), 'endpoint:f::get:api_id__x@3'),
        (N.xhr_verb(F.lit('xhr.open("post", ')), 'POST'),
        (N.xhr_verb(F.lit('nothing')), 'GET'),
        (N.node_kind(F.lit('Other'), F.lit('x')), None),
        (N.node_kind(F.lit('Other'), F.lit('impl X')), 'Impl'),
        (N.analyzer_status(F.lit('LSP unavailable')), 'Fallback'),
        (N.short_evidence(F.lit('a  b')), 'a b'),
        (N.counted(F.lit(1), 'step'), '1 step'),
    ]
    got = spark.range(1).select(*(c.alias(f"c{k}") for k, (c, _) in enumerate(cases))).first()
    assert list(got) == [want for _, want in cases]
    got = spark.range(1).select(N.imported_names(F.lit("import D, { a as b, c, 1x, c } from 'm'")).alias("t"), N.python_imports(F.lit("import a.b as c, d")).alias("p"), N.python_imports(F.lit("from ..m import (x as y, z)")).alias("q")).first()
    assert got["t"] == ["D", "b", "c"] and [(i["module"], i["level"], i["names"]) for i in got["p"] + got["q"]] == [("a.b", 0, []), ("d", 0, []), ("m", 2, ["x", "z"])]


def test_workspace_wrapper(spark):
    node = "seq long, id string, type string, label string, file string"
    nodes = spark.createDataFrame([(0, "workspace:w", "Module", "w", None), (1, "backend:python", "Module", "p", None), (2, "f", "File", "f", "f.py")], node)
    link = spark.createDataFrame([("a", "workspace:w", "backend:python", "Contains"), ("b", "backend:python", "f", "Contains")], "id string, source string, target string, type string")
    left, rest = V.wrapped(nodes, link)
    assert {r["id"] for r in left.collect()} == {"backend:python", "f"} and {r["id"] for r in rest.collect()} == {"b"}
    two = nodes.union(spark.createDataFrame([(3, "ui:qml", "Module", "q", None)], node))
    left, rest = V.wrapped(two, link)
    assert left.count() == 4 and {r["id"] for r in rest.collect()} == {"a", "b", "Contains:workspace:w->ui:qml"}


def test_parser_and_lines_and_reachability(spark):
    kind = "path string, name string, type string, line_no int"
    a, b = spark.createDataFrame([("p", "x", "Function", 1)], kind), spark.createDataFrame([("p", "x", "Component", 1), ("p", "y", "Function", 2)], kind)
    assert sorted(map(tuple, V.parsed_or_found(a, b).collect())) == [("p", "x", "Function", 1), ("p", "y", "Function", 2)]
    nodes = spark.createDataFrame([("e", "ExternalCrate", None, None), ("f", "File", "a.rs", None), ("g", "File", "b.rs", None)], "id string, type string, file string, reachability string")
    out, edges = V.marked_reachability(nodes, spark.createDataFrame([("a.rs", "Active"), ("b.rs", "Detached")], "path string, reachability string"))
    assert {r["id"]: r["reachability"] for r in out.collect()} == {"e": "External", "f": "Active", "g": "Detached"} and [r["target"] for r in edges.collect()] == ["g"]


def test_ranges_hold_their_ends(spark):
    symbols = spark.createDataFrame([("out", 0, "f", 1, 0, 500, 0), ("in", 1, "f", 10, 4, 12, 2)], "id string, seq long, file string, start_line int, start_char int, end_line int, end_char int")
    probes = spark.createDataFrame([(1, "f", 10, 4), (2, "f", 12, 2), (3, "f", 12, 3), (4, "f", 500, 1), (5, "g", 1, 1)], "probe int, file string, line int, char int")
    assert {r["probe"]: r["id"] for r in R.smallest_at(probes, symbols).collect()} == {1: "in", 2: "in", 3: "out", 4: None, 5: None}
