"""QML files: objects and their members by depth of braces, and what they import, draw, call, bind and request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import names as N
from graphloom.functions.session import checkpoint
from graphloom.operators import resolve as R
from graphloom.operators.modules import folder, inside

# How ids begin, names before a bracket that call nothing, what ends an API path.
PREFIX = {"Object": "qml-object", "Property": "qml-property", "Signal": "qml-signal", "Handler": "qml-handler", "Function": "qml-fn"}
NO_CALL = "if for while fetch".split()
API = r"""(/api/[^"'`),;} ]*)"""
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"


def marked(lines: DataFrame) -> DataFrame:
    """Lines of QML files with text (without a // comment), the depth of braces before them, and name and type of the symbol that they declare, if any."""
    own = lines.where("language = 'qml'").select("path", "line_no", "line", F.trim(F.substring_index("line", "//", 1)).alias("text"), C.brace_delta(F.col("line")).alias("delta"))
    before = F.sum("delta").over(Window.partitionBy("path").orderBy("line_no")) - F.col("delta")
    rules = [
        ("Object", r"^([A-Z][A-Za-z0-9_]*)\s*\{"), ("Property", r"^property\s+\S+\s+([A-Za-z_][A-Za-z0-9_]*):*(?=\s|$)"), ("Signal", r"^signal ([A-Za-z_][A-Za-z0-9_]*)(?=[(\s]|$)"),
        ("Handler", r"^(on[A-Z][^:]*?)\s*:"), ("Function", r"^function\s+([A-Za-z_][A-Za-z0-9_]*)\s*(?:\(|$)"),
    ]
    found = F.coalesce(*(F.when(F.col("text").rlike(p), F.struct(F.regexp_extract("text", p, 1).alias("name"), F.lit(k).alias("type"))) for k, p in rules))
    rows = own.withColumn("before", before).withColumn("s", found)
    name = F.concat(C.lookup(F.col("s.type"), PREFIX, "qml-symbol"), F.lit(":"), "path", F.lit("::"), "s.name", F.lit("@"), F.col("line_no").cast("string"))
    return rows.select("path", "line_no", "text", "delta", "before", "s.name", "s.type", F.when(F.col("s").isNotNull(), name).alias("id"))


def owned(rows: DataFrame) -> DataFrame:
    """marked lines with `owner`: the last object begun before the line that is still open, that is, since whose line the depth never fell below what it was after it.

    An object that opens and closes on its line so holds what follows it in the object around, and one at depth 0 all the rest of its file. Where an object ends is the next line of
    lower depth: lines are put in order for each depth of an object in their file, and an object takes the next one of its own.
    """
    c = F.col
    objects = rows.where("type = 'Object'").select("path", "line_no", "id", (c("before") + c("delta")).alias("depth"))
    depths = objects.where("depth > 0").select("path", "depth").distinct()
    lower = rows.select("path", "line_no", "before").join(depths, "path").where("before < depth").select("path", "depth", "line_no", F.lit(None).cast("string").alias("id"))
    ruler = lower.union(objects.select("path", "depth", "line_no", "id"))
    down = Window.partitionBy("path", "depth").orderBy(c("line_no").desc(), c("id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ruler.withColumn("end", F.last(F.when(c("id").isNull(), c("line_no")), ignorenulls=True).over(down)).where("id IS NOT NULL")
    last = rows.groupBy("path").agg(F.max("line_no").alias("last"))
    spans = ends.join(last, "path").select("id", c("line_no").alias("seq"), c("path").alias("file"), (c("line_no") + 1).alias("start_line"), F.lit(0).alias("start_char"), F.coalesce(F.when(c("depth") > 0, c("end") - 1), c("last")).alias("end_line"), F.lit(1).alias("end_char"))
    probes = rows.select(F.struct("path", "line_no").alias("probe"), c("path").alias("file"), c("line_no").alias("line"), F.lit(0).alias("char"))
    held = R.smallest_at(probes, spans.where("end_line >= start_line")).select("probe.path", "probe.line_no", c("id").alias("owner"))
    return rows.join(held, ["path", "line_no"], "left")


def imports(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, target) files: what relative imports mean, every file below a folder of that name, at any depth, or the file of that name.

    A prefix join by equality: each file is keyed by all folders above it and by its own path without the ending.
    """
    module = F.regexp_replace(F.trim(F.substring("text", 8, 1 << 20)), r"""^["']+|["']+$""", "")
    asked = rows.where("text LIKE 'import %'").select("path", module.alias("module")).where(F.col("module").rlike(r"^\.\.?/"))
    asked = asked.select("path", inside(folder(F.col("path")), F.col("module")).alias("key")).where("key <> ''").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keys = F.concat(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0))), F.array(F.regexp_replace("path", r"\.qml$", "")))
    known = paths.select(F.col("path").alias("target"), F.explode(keys).alias("key"))
    return asked.join(known, "key").select(F.col("path").alias("source"), "target").distinct()


def last_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, id): of symbols or files of one key the last by file, line and id."""
    return rows.groupBy(key).agg(F.max_by("id", F.struct("path", "line_no", "id")).alias("id"))


def qml_relations(lines: DataFrame, endpoints: DataFrame) -> DataFrame:
    """lines, endpoints (id, label `VERB /path`) -> (source, target, type, confidence, kind, label, evidence) of QML files.

    Imports between files; Renders of the first outer object of the file that is called like an object inside another (or of that file); Calls of the last symbol of a called name; Uses of the last symbol of a
    name before a dot where the line binds, with a PropertyBinding flow from it, or from the symbol to itself if there is none; ApiCall and an ApiRequest flow to endpoints of
    exactly that verb and route.
    """
    c = F.col
    rows = checkpoint(owned(checkpoint(marked(lines))))
    file = lambda x: F.concat(F.lit("file:"), x)
    paths = rows.select("path").distinct()
    none = F.lit(None).cast("string")

    def edge(d: DataFrame, kind: str, confidence: str, flow: Column = none, label: Column = none, evidence: Column = none) -> DataFrame:
        return d.select("source", "target", F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), flow.alias("kind"), label.alias("label"), evidence.alias("evidence"))

    symbols = rows.where("id IS NOT NULL")
    last = checkpoint(last_of(symbols, "name"))
    roots = symbols.where("type = 'Object' AND owner IS NULL").groupBy("path").agg(F.min_by("id", "line_no").alias("root"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    parts = paths.select(stem.alias("name"), "path", F.lit(0).alias("line_no"), c("path").alias("id"))
    drawn = symbols.where("type = 'Object' AND owner IS NOT NULL").select(c("owner").alias("source"), "name").join(last_of(parts, "name").withColumnRenamed("id", "path"), "name").join(roots, "path", "left")
    drawn = drawn.select("source", F.coalesce("root", file("path")).alias("target"))
    # a symbol's own line speaks for it, other lines for the object that holds them
    speaks = rows.select("text", F.coalesce("id", "owner").alias("source"), "type").where("source IS NOT NULL")
    binds = speaks.where("type IS NULL OR type = 'Property'").where(F.contains("text", F.lit(":")))
    dotted = F.filter(F.split("text", r"[^A-Za-z0-9_.]+"), lambda p: F.contains(p, F.lit(".")))
    names = binds.select("source", F.explode(F.transform(dotted, lambda p: F.substring_index(p, ".", 1))).alias("name")).where(c("name").rlike(IDENTIFIER)).distinct()
    used = names.join(last, "name", "left")
    calls = speaks.where("type IS NULL OR type = 'Handler'").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_.]+)\("), F.lit(1))).alias("called"))
    calls = calls.select("source", F.substring_index("called", ".", -1).alias("name")).where(c("name").rlike(IDENTIFIER) & ~c("name").isin(NO_CALL)).join(last, "name").select("source", c("id").alias("target")).where("source <> target")
    asks = speaks.where("type IS NULL OR type IN ('Handler', 'Function')").where(F.contains("text", F.lit("/api/")))
    asks = asks.select("source", "text", F.posexplode(F.split("text", "(?=/api/)")).alias("pos", "part")).where("part LIKE '/api/%'")
    before = F.array_join(F.slice(F.split("text", "(?=/api/)"), F.lit(1), c("pos")), "")
    asks = asks.select("source", N.xhr_verb(before).alias("verb"), F.regexp_replace(F.regexp_extract("part", API, 1), "/+$", "").alias("route"))
    known = endpoints.select(c("id").alias("target"), C.route_key_of_label(c("label")).alias("key")).where("key IS NOT NULL")
    requests = asks.withColumn("key", C.route_key(c("verb"), c("route"))).join(known, "key").select("source", "target", F.concat_ws(" ", "verb", "route").alias("asked"))
    found = used.where("id IS NOT NULL").select("source", c("id").alias("target"), "name")
    lost = used.where("id IS NULL").select("source", c("source").alias("target"), "name")
    kinds = [
        edge(imports(rows, paths).select(file("source").alias("source"), file("target").alias("target")), "Imports", "Semantic"), edge(drawn, "Renders", "Semantic"), edge(calls, "Calls", "Semantic"), edge(found, "Uses", "Heuristic"),
        edge(found.select(c("target").alias("source"), c("source").alias("target"), "name"), "DataFlow", "Heuristic", F.lit("PropertyBinding"), c("name"), F.lit("QML binding/reference")),
        edge(lost, "DataFlow", "Heuristic", F.lit("PropertyBinding"), c("name"), F.lit("QML unresolved binding/reference")),
        edge(requests, "ApiCall", "Semantic"), edge(requests, "DataFlow", "Semantic", F.lit("ApiRequest"), c("asked"), F.lit("QML API call")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.union(k)
    return out.distinct()
