"""QML relations of a small project against what its files plainly say."""

from graphloom.operators.extract import lines_of
from graphloom.operators.qml import marked, owned, qml_relations

MAIN = """import QtQuick 2.15
import "./parts" // all of them
import '../shared/Theme'
import "nowhere"
Window {
    property string title: theme.name
    signal opened(int x)
    Card {
        label: store.items + theme.x
        Row { }
        width: Math.max(1, refresh())
    }
    onOpened: refresh(); load.send("/api/none")
    function refresh() {
        xhr.open("POST", "/api/users/")
        fetch("/api/users")
    }
    // Card { }
}
property int theme: 1
"""
FILES = {"ui/Main.qml": MAIN, "ui/parts/Card.qml": "Item {\n  id: card\n}", "ui/parts/deep/Row.qml": "// empty", "shared/Theme.qml": "Theme {\n}", "shared/Theme/x.qml": "Item {\n}", "other/No.qml": ""}


def test_relations(spark):
    lines = lines_of(spark.createDataFrame([(p, "qml", t) for p, t in FILES.items()], "path string, language string, text string"))
    ends = spark.createDataFrame([("e1", "POST /api/users"), ("e2", "GET /api/users"), ("e3", "GET /api/none"), ("e4", "plain")], "id string, label string")
    at = {s: k + 1 for k, s in enumerate(x.strip() for x in MAIN.split("\n"))}
    owner = {r["text"]: r["owner"] for r in owned(marked(lines)).where("path = 'ui/Main.qml'").collect()}
    window, card, row = f"qml-object:ui/Main.qml::Window@{at['Window {']}", f"qml-object:ui/Main.qml::Card@{at['Card {']}", f"qml-object:ui/Main.qml::Row@{at['Row { }']}"
    assert owner["Card {"] == window and owner["Row { }"] == card and owner["width: Math.max(1, refresh())"] == row and owner["function refresh() {"] == window and owner["property int theme: 1"] is None
    title, opened = f"qml-property:ui/Main.qml::title@{at['property string title: theme.name']}", f"qml-handler:ui/Main.qml::onOpened@{at['onOpened: refresh(); load.send(' + chr(34) + '/api/none' + chr(34) + ')']}"
    refresh, theme = f"qml-fn:ui/Main.qml::refresh@{at['function refresh() {']}", f"qml-property:ui/Main.qml::theme@{at['property int theme: 1']}"
    got = {(r["source"], r["target"], r["type"], r["kind"], r["label"]) for r in qml_relations(lines, ends).collect()}
    f = lambda p: f"file:{p}"
    want = {(f("ui/Main.qml"), f(p), "Imports", None, None) for p in ("ui/parts/Card.qml", "ui/parts/deep/Row.qml", "shared/Theme.qml", "shared/Theme/x.qml")}
    want |= {(window, "qml-object:ui/parts/Card.qml::Item@1", "Renders", None, None), (card, f("ui/parts/deep/Row.qml"), "Renders", None, None)}
    want |= {(row, refresh, "Calls", None, None), (opened, refresh, "Calls", None, None)}
    for s in (title, card):
        want |= {(s, theme, "Uses", None, None), (theme, s, "DataFlow", "PropertyBinding", "theme")}
    want |= {(card, card, "DataFlow", "PropertyBinding", "store"), (row, row, "DataFlow", "PropertyBinding", "Math")}
    want |= {(opened, "e3", "ApiCall", None, None), (opened, "e3", "DataFlow", "ApiRequest", "GET /api/none"), (window, "e1", "ApiCall", None, None), (window, "e1", "DataFlow", "ApiRequest", "POST /api/users")}
    want |= {(window, "e2", "ApiCall", None, None), (window, "e2", "DataFlow", "ApiRequest", "GET /api/users")}
    assert got == want, (got - want, want - got)
    assert qml_relations(lines.limit(0), ends).count() == 0
