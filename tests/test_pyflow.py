"""Python ranges, calls and flows against what a source plainly says."""

from graphloom.operators.extract import lines_of
from graphloom.operators.lexing import lex
from graphloom.operators.pyflow import python_relations, python_symbols, python_tokens

SOURCE = '''"""def hidden():
    load()
"""
import os

@route("/x")
def load(path="=", size=1):
    # save(1)
    text = read(
        path,
        size=clean(path),
    )
    if ready(text): return text
    return clean(text) == text


class Store(Base):
    limit = clean(3)

    def save(self, item):
        self.items[key(item)] = item
        total += load(item)
        def inner():
            return self.flush(item)
        x: int = inner(); load("save(2)")
        return f"""
load()
"""

    def flush(self): return read(1).strip()

def read(path): pass
async def clean(x):
  return [clean(y) for y in x] or load(x)
def ready(t): y = key(t) if t <= load(t) else None
def key(t):
    return t
'''


def test_ranges_calls_and_flows(spark):
    lexed = lex(lines_of(spark.createDataFrame([("a.py", "python", SOURCE)], "path string, language string, text string"))).cache()
    tokens = python_tokens(lexed)
    symbols = python_symbols(lexed, tokens).cache()
    lines = SOURCE.split("\n")
    at = lambda s: next(k + 1 for k, x in enumerate(lines) if s in x)
    got = {(r["name"], r["type"], r["line_no"], r["end_line"]) for r in symbols.collect()}
    assert {g[0] for g in got} == {"load", "Store", "Store::save", "Store::inner", "Store::flush", "read", "clean", "ready", "key"}
    ends = {g[0]: g[3] for g in got}
    assert ends["Store"] == at("def read") - 1 and ends["Store::save"] == at("def flush") - 1 and ends["Store::inner"] == at("x: int") - 1 and ends["load"] == at("class Store") - 1 and ends["key"] == len(lines) - 1
    name = {r["id"]: r["name"] for r in symbols.collect()}
    rows = python_relations(lexed, symbols, tokens).collect()
    calls = {(name[r["source"]], name[r["target"]]): r["confidence"] for r in rows if r["type"] == "Calls"}
    assert calls == {
        ("load", "read"): "Heuristic", ("load", "clean"): "Heuristic", ("load", "ready"): "Heuristic", ("Store", "clean"): "Heuristic", ("Store::save", "key"): "Heuristic", ("Store::save", "load"): "Heuristic",
        ("Store::save", "Store::inner"): "Heuristic", ("Store::inner", "Store::flush"): "Semantic", ("Store::flush", "read"): "Heuristic", ("clean", "load"): "Heuristic", ("ready", "key"): "Heuristic", ("ready", "load"): "Heuristic",
    }
    flows = {(name[r["source"]], name[r["target"]], r["kind"], r["evidence"]) for r in rows if r["type"] == "DataFlow"}
    assert flows == {
        ("read", "load", "Assignment", "read(\n        path,\n        size=clean(path),\n    )"), ("clean", "load", "Assignment", "clean(path)"), ("ready", "load", "ReturnValue", "ready(text)"), ("clean", "load", "ReturnValue", "clean(text)"),
        ("clean", "Store", "Assignment", "clean(3)"), ("key", "Store::save", "Assignment", "key(item)"), ("load", "Store::save", "ReturnValue", "load(item)"), ("Store::inner", "Store::save", "Assignment", "inner()"),
        ("load", "Store::save", "ReturnValue", 'load("save(2)")'), ("Store::flush", "Store::inner", "ReturnValue", "self.flush(item)"), ("read", "Store::flush", "ReturnValue", "read(1)"), ("load", "clean", "ReturnValue", "load(x)"),
        ("key", "ready", "Assignment", "key(t)"), ("load", "ready", "Assignment", "load(t)"),
    }
