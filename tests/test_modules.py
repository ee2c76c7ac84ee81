from graphloom.operators import extract as X
from graphloom.operators import modules as M

RUST = {
    "src/main.rs": "mod api;\npub mod deep;\n// mod spare;\n#[path = \"../other/odd.rs\"]\n// note\nmod named;\n#[path = \"spare.rs\"]\n\nmod missing;\nmod inline { }\n",
    "src/api.rs": "pub(crate) mod inner;\nmod back;\n",
    "src/api/inner.rs": "fn f() {}\n",
    "src/api/back.rs": "#[path = \"../api.rs\"]\nmod api;\n",
    "src/deep/mod.rs": "mod leaf;\n",
    "src/deep/leaf.rs": "",
    "other/odd.rs": "fn g() {}",
    "src/spare.rs": "fn h() {}",
    "src/bin/tool.rs": "#[path = \"../spare2.rs\"] \nmod s;",
    "src/spare2.rs": "",
    "part/src/lib.rs": "mod x;",
    "part/src/x.rs": "",
    "part/notes/lib.rs": "",
}


def files(spark, texts, language):
    return spark.createDataFrame([(p, language, t) for p, t in texts.items()], "path string, language string, text string")


def test_reachability(spark):
    paths = files(spark, RUST, "rust")
    packages = spark.createDataFrame([("", 1), ("part", 2), ("part", 2)], "folder string, language int")
    got = {r["path"]: r["reachable_from"] for r in M.rust_reachability(X.lines_of(paths), paths, packages).collect()}
    main = {p: ["src/main.rs"] for p in ["src/main.rs", "src/api.rs", "src/api/inner.rs", "src/api/back.rs", "src/deep/mod.rs", "src/deep/leaf.rs", "other/odd.rs"]}
    tool = {p: ["src/bin/tool.rs"] for p in ["src/bin/tool.rs", "src/spare2.rs"]}
    part = {p: ["part/src/lib.rs"] for p in ["part/src/lib.rs", "part/src/x.rs"]}
    assert got == main | tool | part | {"src/spare.rs": None, "part/notes/lib.rs": None}
    none = M.rust_reachability(X.lines_of(paths), paths, packages.limit(0)).groupBy("reachability").count().collect()
    assert [tuple(r) for r in none] == [("Detached", len(RUST))]


def test_imports(spark):
    paths = spark.createDataFrame([(p,) for p in ["web/a.ts", "web/b.tsx", "web/b/index.ts", "web/c/index.js", "lib/d.js", "app/__init__.py", "app/m.py", "app/sub/n.py", "m.py"]], "path string")
    asked = [
        ("web/a.ts", "typescript", "./b", 0, "web/b.tsx"), ("web/a.ts", "typescript", "./c", 0, "web/c/index.js"), ("web/a.ts", "typescript", "../lib/d.js", 0, "lib/d.js"),
        ("web/a.ts", "typescript", "../../../lib/./d", 0, "lib/d.js"), ("web/a.ts", "typescript", "react", 0, None), ("web/a.ts", "typescript", None, 0, None),
        ("app/sub/n.py", "python", "app.m", 0, "app/m.py"), ("app/sub/n.py", "python", "m", 0, "m.py"), ("app/sub/n.py", "python", "m", 2, "app/m.py"),
        ("app/sub/n.py", "python", "", 2, "app/__init__.py"), ("app/sub/n.py", "python", "m", 1, None),
    ]
    imports = spark.createDataFrame([a[:4] for a in asked] * 2, "path string, language string, specifier string, level int")
    got = sorted((r["specifier"], r["level"], r["target"]) for r in M.resolve_imports(imports, paths).collect())
    assert got == sorted((a[2], a[3], a[4]) for a in asked if a[4])


def test_snippets(spark):
    texts = {"a": "\n".join(str(n) for n in range(1, 101)) + "\r\n", "b": "é" * 5000, "c": "x" + "é" * 5000, "d": "", "e": None, "f": "a\0b"}
    wanted = spark.createDataFrame([(p, n) for p in texts for n in (50, 0, 1000)] + [("none", 1)], "path string, line int")
    got = {(r["path"], r["line"]): (r["start_line"], r["end_line"], r["code"]) for r in M.snippets(files(spark, texts, "rust"), wanted).collect()}
    assert {k[0] for k in got} == {"a", "b", "c"}
    assert got["a", 50][:2] == (44, 58) and got["a", 50][2].split("\n")[0] == "44"
    assert got["a", 0][:2] == (1, 9) and got["a", 1000] == (94, 100, "94\n95\n96\n97\n98\n99\n100")
    assert got["b", 0][2] == "é" * 4000 and got["c", 0][2] == "x" + "é" * 3999
    wide = M.snippets(files(spark, texts, "rust"), wanted.where("path = 'a' AND line = 50"), 30, 30).first()
    assert (wide["start_line"], wide["end_line"]) == (20, 59)
