"""Manifests, the symbol index and listing against small projects."""

from graphloom.operators import manifests as M
from graphloom.operators.extract import lines_of
from graphloom.operators.symbol_index import SymbolIndex
from graphloom.sources.listing import source_files, source_paths

FILES = {
    "Cargo.toml": '[workspace]\nmembers = [\n  "crates/*", # all\n  "tools/one",\n]\nexclude = ["crates/old"]\n[workspace.dependencies]\nserde = "1"\n',
    "crates/a/Cargo.toml": '[package]\nname = "a" # x\nversion = "1"\n[dependencies]\nserde = { version = "1", features = ["derive"] }\nb.workspace = true\n[dev-dependencies]\ntokio = "1"\nserde = "1"\n[dependencies.log]\nversion = "1"\n',
    "crates/b/Cargo.toml": "[package]\nname = 'b'\n",
    "crates/old/Cargo.toml": '[package]\nname = "old"\n',
    "crates/a/sub/Cargo.toml": '[package]\nname = "sub"\n',
    "crates/n/Cargo.toml": '[package]\nname = "n"\n[workspace]\nmembers = ["x?"]\n',
    "crates/n/x1/Cargo.toml": '[package]\nname = "x1"\n',
    "crates/n/xx1/Cargo.toml": '[package]\nname = "xx1"\n',
    "tools/one/Cargo.toml": '[package]\nname = "one"\n[target.\'cfg(unix)\'.dependencies]\nlibc = "0"\n',
    "node_modules/q/Cargo.toml": '[package]\nname = "q"\n',
}


def test_packages_files_and_folders(spark):
    facts = M.cargo_facts(lines_of(spark.createDataFrame([(p, "toml", t) for p, t in FILES.items()], "path string, language string, text string"))).cache()
    got = {r["folder"]: r for r in facts.collect()}
    assert got[""]["members"] == ["crates/*", "tools/one"] and got[""]["exclude"] == ["crates/old"] and got[""]["workspace"] and got[""]["name"] is None
    assert got["crates/a"]["dependencies"] == ["b", "log", "serde", "tokio"] and got["crates/a"]["name"] == "a" and got["tools/one"]["dependencies"] == ["libc"] and got["crates/b"]["dependencies"] == []
    found = M.packages(facts).cache()
    assert {r["name"]: r["workspace"] for r in found.collect()} == {"a": "", "b": "", "old": "crates/old", "sub": "crates/a/sub", "n": "crates/n", "x1": "crates/n", "xx1": "crates/n/xx1", "one": "", "q": "node_modules/q"}
    paths = spark.createDataFrame([(p,) for p in ("crates/a/src/lib.rs", "crates/a/sub/src/x.rs", "crates/b/src/m/mod.rs", "crates/old/a.rs", "tools/one/b.py", "crates/n/src/main.rs", "crates/n/x1/y.rs")], "path string")
    files = lambda root: {(r["package"], r["path"], r["module"]) for r in M.indexed_files(found, paths, root).collect()}
    assert files("") == {("a", "crates/a/src/lib.rs", "crate root"), ("a", "crates/a/sub/src/x.rs", "sub::src::x"), ("b", "crates/b/src/m/mod.rs", "m")}
    assert {x[:2] for x in files("crates/n")} == {("n", "crates/n/src/main.rs"), ("n", "crates/n/x1/y.rs"), ("x1", "crates/n/x1/y.rs")} and {x[0] for x in files("crates/a")} == {"a"} and files("tools") == set()
    assert [r["folder"] for r in M.check_folders(facts).collect()] == [""]
    assert {r["folder"] for r in M.check_folders(facts.where("folder <> ''")).collect()} == set(got) - {"", "node_modules/q"}


def test_index_reads_few_files(spark, tmp_path):
    rows = [(f"id{k}", f"name{k % 7}", ["rust", "python"][k % 2], ["Function", "Struct"][k % 3 == 0], f"f{k % 5}.rs", k, (k, 0, k + 10, 3)) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, name string, language string, kind string, file string, line int, range struct<start_line:int,start_char:int,end_line:int,end_char:int>")
    index = SymbolIndex(str(tmp_path / "index"), 8).write(df)
    every = {n: len(index.table(spark, n).inputFiles()) for n in ("by_id", "by_name", "by_file")}
    looks = {
        "by_id": (index.by_id(spark, "id17"), {"id17"}, "by_id"), "by_name": (index.by_name(spark, "name3"), {r[0] for r in rows if r[1] == "name3"}, "by_name"), "language": (index.by_language(spark, "rust"), {r[0] for r in rows if r[2] == "rust"}, "by_file"),
        "kind": (index.by_kind(spark, "Struct"), {r[0] for r in rows if r[3] == "Struct"}, "by_file"), "file": (index.by_file(spark, "f2.rs"), {r[0] for r in rows if r[4] == "f2.rs"}, "by_file"),
        "range": (index.by_range(spark, "f2.rs", 20, 2), {r[0] for r in rows if r[4] == "f2.rs" and (r[6][0], 0) <= (20, 2) <= (r[6][2], 3)}, "by_file"),
    }
    for name, (df, want, table) in looks.items():
        assert {r["id"] for r in df.collect()} == want, name
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [(" in plan, (name, plan)
        read = df.select("id").distinct().rdd.count() and len(df.selectExpr("_metadata.file_path AS f").distinct().collect())
        assert read < every[table], name
    assert index.by_id(spark, "none").count() == 0


def test_listing(spark, tmp_path):
    files = ["a.rs", "src/x.ts", "src/types.d.ts", "src/__init__.py", ".hidden/y.py", ".z.py", "node_modules/p/i.js", "py/.mypy_cache/c.py", "deep/er/and/er/q.qml", "bad.py", "t.txt", "js/w.jsx"]
    for f in files:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"\xff\xfe" if f == "bad.py" else f.encode())
    root = tmp_path.as_uri()
    got = source_paths(spark, root)
    assert {(r["path"], r["language"]) for r in got.collect()} == {("a.rs", "rust"), ("src/x.ts", "typescript"), ("src/__init__.py", "python"), (".hidden/y.py", "python"), (".z.py", "python"), ("py/.mypy_cache/c.py", "python"), ("deep/er/and/er/q.qml", "qml"), ("bad.py", "python"), ("js/w.jsx", "javascript")}
    assert {r["path"] for r in source_paths(spark, root, "python", hidden=False).collect()} == {"src/__init__.py", "bad.py"}
    assert {r["path"] for r in source_paths(spark, root, "python").collect()} == {"src/__init__.py", ".hidden/y.py", ".z.py", "bad.py"}
    assert {r["path"]: r["text"] for r in source_files(spark, root, source_paths(spark, root, "python")).collect()} == {p: p for p in ("src/__init__.py", ".hidden/y.py", ".z.py")}
    assert source_paths(spark, (tmp_path / "none").as_uri()).count() == 0
