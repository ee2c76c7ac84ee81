"""Type patterns against plain substring search of every label in every line; views by small graphs."""

import random

from pyspark.sql import functions as F

from graphloom.operators.patterns import type_mentions, type_references
from graphloom.operators.views import visible_graph

SIGNS = {"construct": "{} {{", "associated": "{}::", "annotation": ": {}", "reference": ": &{}", "return": "-> {}"}


def test_equals_substring_search(spark):
    rng = random.Random(3)
    labels = ["A", "Ab", "Shop", "ShopItem", "a::Shop", "Vec<Shop>", "op", "Item", "é", "Böx {", " Shop", "::"] + ["".join(rng.choice("abS:") for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    parts = labels + ["::", " {", ": ", ": &", "-> ", " ", "x", ":::", "{{", "&"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", "ShopItem { a: Shop }", "let x: &Shop = Vec<Shop>::new() -> a::Shop", "::", "a:::b"]
    got = {}
    df = spark.createDataFrame(list(enumerate(lines)), "key int, line string")
    for r in type_mentions(df, spark.createDataFrame([(x,) for x in labels] + [("",), (None,)], "label string")).collect():
        got[r["key"], r["label"]] = r["signs"]
    want = {(k, x): sorted(n for n, s in SIGNS.items() if s.format(x) in line) for k, line in enumerate(lines) for x in labels}
    assert got == {k: v for k, v in want.items() if v}
    assert type_mentions(df, spark.createDataFrame([], "label string")).count() == 0


def test_references_and_flows(spark):
    nodes = spark.createDataFrame([("s:Shop", "Struct", "Shop"), ("t:Sell", "Trait", "Sell"), ("s:Shop2", "Enum", "Shop"), ("f:Shop", "Function", "Shop")], "id string, type string, label string")
    own = spark.createDataFrame([("f1", "  Shop { a: 1 }"), ("f1", "Shop { a: 1 }"), ("f1", "Shop  {"), ("f1", "x: Sell,"), ("f2", "// Shop::x()"), ("f2", "Shop::x()"), ("f2", "Shop(1)")], "source string, line string")
    got = {tuple(r) for r in type_references(own, nodes).collect()}
    shops = ("s:Shop", "s:Shop2")
    assert got == {("f1", s, "TypeReference", None, None, None) for s in (*shops, "t:Sell")} | {("f2", s, "TypeReference", None, None, None) for s in shops} | {
        (s, f, "DataFlow", "ModelUse", "Shop", e) for s in shops for f, e in (("f1", "Shop { a: 1 }"), ("f2", "Shop::x()"))
    }


def test_visible_graph_keeps_flows_of_different_kinds_apart_and_notes_collapsed_groups(spark):
    rows = [("m", "Module", None), ("fa", "File", "a.rs"), ("a", "Struct", "a.rs"), ("b", "Struct", "b.rs"), ("c", "Struct", "b.rs"), ("fb", "File", "b.rs")]
    nodes = spark.createDataFrame([(k, i, t, i, f, None, None, "rust", "Active", "pub", "sig") for k, (i, t, f) in enumerate(rows)], "seq long, id string, type string, label string, file string, module string, crate string, language string, reachability string, visibility string, signature string")
    links = [("m", "fa", "Contains", None), ("m", "fb", "Contains", None), ("fa", "a", "Contains", None), ("fb", "b", "Contains", None), ("fb", "c", "Contains", None), ("b", "c", "DataFlow", "ModelUse"), ("b", "c", "DataFlow", "ReturnValue"), ("b", "c", "DataFlow", "ModelUse"), ("a", "b", "Calls", None), ("a", "c", "Calls", None)]
    edges = spark.createDataFrame([(k, f"e{k}", s, t, ty, "Exact", None, None, kd) for k, (s, t, ty, kd) in enumerate(links)], "seq long, id string, source string, target string, type string, confidence string, label string, evidence string, kind string")
    shown, left = visible_graph(nodes, edges, ["rust"], ["Active"], "all", spark.createDataFrame([("fa", 1)], "id string, position int"), 4)
    got = {r["id"]: (r["source"], r["target"], r["bundled"]) for r in left.collect()}
    assert got["DataFlow:b->c:bundle:2"] == ("b", "c", 2) and got["e6"] == ("b", "c", 1) and got["Calls:fa->b:e8"] == ("fa", "b", 1)
    notes = {r["id"]: (r["connections"], r["description"]) for r in shown.collect()}
    assert notes["fa"] == (1, "Collapsed: 1 hidden · Calls") and notes["b"][1] is None and set(notes) == {"m", "fa", "fb", "b", "c"}
    only = visible_graph(nodes, edges, ["rust"], ["Active"], "all", spark.createDataFrame([], "id string, position int"), 4, lens=lambda n, e: (n.where("type = 'Struct'"), e.where("type = 'Calls'")))
    assert {r["id"] for r in only[0].collect()} == {"a", "b", "c"} and only[1].where(F.col("type") != "Calls").count() == 0


def test_context_packs_by_a_plain_fold(spark):
    from graphloom.operators.views import context_packs

    rng = random.Random(9)
    states = ["Active", "Detached", "External", None]
    nodes = [(f"n{k:02}", rng.choice(["Function", "ExternalCrate", "Struct"]), f"label{k}", states[k % 4] if k % 5 else "Active") for k in range(40)]
    links = [(f"e{k:03}", "n00" if k < 45 else f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}", rng.choice(["Calls", "Uses"]), rng.choice(["Exact", "Heuristic"])) for k in range(90)]
    code = {i: (f"f{k % 9}:1", "x" * rng.choice([10, 9000, 4000, 200])) for k, (i, *_) in enumerate(nodes) if k % 6}
    diags = [(f"n{k % 40:02}", f"d{k}", k) for k in range(50)]
    nf = spark.createDataFrame(nodes, "id string, type string, label string, reachability string")
    ef = spark.createDataFrame([(*x, None) for x in links], "id string, source string, target string, type string, confidence string, evidence string")
    got = {}
    for r in context_packs(nf, ef, spark.createDataFrame([("n00",), ("n07",), ("gone",)], "id string"), spark.createDataFrame([(i, *c) for i, c in code.items()], "id string, snippet string, text string"), spark.createDataFrame(diags, "node string, id string, seq int")).collect():
        got.setdefault((r["pack"], r["part"]), []).append((r["place"], r["id"], r["text"]))
    known = {n[0]: n for n in nodes}
    for pack in ("n00", "n07"):
        own = sorted((x for x in links if pack in x[1:3]), key=lambda x: (-({"Exact": 3, "Heuristic": 0}[x[4]] + {"Calls": 2, "Uses": 1}[x[3]]), x[0]))
        order = [pack]
        for x in own:
            order += [i for i in x[1:3] if i not in order and known[i][3] not in ("Detached", "Generated")]
        assert [i for _, i, _ in sorted(got[pack, "node"])] == order and [i for _, i, _ in sorted(got[pack, "edge"])] == [x[0] for x in own]
        kept, used, warned = [], 0, set()
        for i in order:
            if i not in code or known[i][1] == "ExternalCrate" or known[i][3] == "External":
                continue
            name, text = code[i]
            if len(kept) >= 12:
                warned.add("Context pack limited to 12 snippets.")
            elif used + len(text) > 30_000:
                warned.add("Context pack limited to 30000 characters.")
            elif name not in kept:
                kept.append(name)
                used += len(text)
        if known[pack][3] == "Detached":
            warned.add(f"{known[pack][2]} is Detached; include with care.")
        assert [i for _, i, _ in sorted(got.get((pack, "snippet"), []))] == kept and {t for *_, t in got.get((pack, "warning"), [])} == warned
        assert [i for _, i, _ in sorted(got[pack, "diagnostic"])] == [d for i in order for n, d, _ in diags if n == i]
        n = [len(got.get((pack, p), [])) for p in ("snippet", "node", "edge", "diagnostic")]
        assert got[pack, "summary"][0][2] == ", ".join(f"{k} {w}{'' if k == 1 else 's'}" for k, w in zip(n, ("snippet", "node", "edge", "diagnostic"))) + "."
    assert not [k for k in got if k[0] == "gone"]
