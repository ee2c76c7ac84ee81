"""Search, details, endpoints, traces, roll-ups, diagnostics, patches: the graph's query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import names as N
from graphloom.operators.modes import degree


def search(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Ranked symbol search: equal 0, beginning 1, part 2 over five lower-cased fields; an empty query ranks all 3."""
    q = F.lit(query.strip().lower())
    fields = [F.lower(F.coalesce(c, F.lit(""))) for c in ("label", "file", "module", "crate", "type")]
    some = lambda test: F.greatest(*(test(f).cast("int") for f in fields)) == 1
    score = F.when(q == "", 3).when(some(lambda f: f == q), 0).when(some(lambda f: F.startswith(f, q)), 1).when(some(lambda f: F.contains(f, q)), 2)
    return nodes.withColumn("score", score).where("score IS NOT NULL").orderBy("score", "label", "seq").limit(limit).select("id", "label", "score")


def neighbours(nodes: DataFrame, edges: DataFrame, incoming: bool) -> DataFrame:
    """Callers (incoming) or callees of every node, one row an edge."""
    here, there = ("target", "source") if incoming else ("source", "target")
    calls = edges.where(F.col("type").isin("Calls", "EndpointHandler"))
    return calls.join(nodes.select(F.col("id").alias(there), F.col("label").alias("other_label")), there).select(F.col(here).alias("id"), F.col(there).alias("other"), "other_label", "type")


TYPE_KINDS = ["Struct", "Enum", "Trait", "Impl", "Interface", "TypeAlias"]


def related_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, related): type nodes at either end of a node's TypeReference and Implements edges."""
    about = edges.where(F.col("type").isin("TypeReference", "Implements"))
    pairs = about.select(F.explode(F.array("source", "target")).alias("id"), F.array("source", "target").alias("ends")).select("id", F.explode("ends").alias("related")).distinct()
    kinds = nodes.where(F.col("type").isin(TYPE_KINDS)).select(F.col("id").alias("related"))
    return pairs.join(kinds, "related", "left_semi").select("id", "related")


def references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, file, line, from_id): where a node is referred to; sources with a file, each place once."""
    kinds = edges.where(F.col("type").isin("Calls", "EndpointHandler", "TypeReference", "Uses", "DataFlow"))
    where = nodes.where("file IS NOT NULL").select(F.col("id").alias("source"), "file", F.coalesce("line", F.lit(0)).alias("line"))
    return kinds.join(where, "source").select(F.col("target").alias("id"), "file", "line", F.col("source").alias("from_id")).distinct()


def endpoint_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, route, handlers) of endpoints; handlers sorted."""
    ends = nodes.where("type = 'Endpoint'").select("id", C.route_key_of_label(F.col("label")).alias("route"))
    hands = edges.where("type = 'EndpointHandler'").join(nodes.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("handlers"))
    return ends.join(hands, "id", "left").select("id", "route", F.coalesce("handlers", F.array().cast("array<string>")).alias("handlers"))


def endpoint_choice(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, id, score): the endpoint that answers each route, Detached ones aside."""
    ends = nodes.where("type = 'Endpoint' AND coalesce(reachability, '') <> 'Detached'").withColumn("route", C.route_key_of_label(F.col("label"))).where("route IS NOT NULL")
    other = nodes.select(F.col("id").alias("target"), F.col("file").alias("h_file"), F.col("crate").alias("h_crate"), F.col("module").alias("h_module"))
    near = F.col("h_file").eqNullSafe(F.col("file")) | (F.col("h_crate").eqNullSafe(F.col("crate")) & F.col("h_module").eqNullSafe(F.col("module")))
    local = edges.where("type = 'EndpointHandler'").select(F.col("source").alias("id"), "target").join(ends.select("id", "file", "crate", "module"), "id").join(other, "target").where(near).select("id").distinct()
    text = lambda c: F.coalesce(c, F.lit(""))
    plus = (
        F.when(F.coalesce("reachability", F.lit("Active")) == "Active", 100).otherwise(0)
        + F.when(F.col("local"), 80).otherwise(0)
        + F.when(F.contains(text("crate"), F.lit("server")) | F.contains(text("file"), F.lit("server")) | F.contains(text("module"), F.lit("server")), 60).otherwise(0)
        + F.when(text("file").rlike(r"src/(main|lib)\.rs$"), 15).otherwise(0)
    )
    score = F.when(text("file").rlike(r"/tests/|\.test\.|__tests__"), F.greatest(plus - 80, F.lit(0))).otherwise(plus)
    rated = ends.join(local.withColumn("local", F.lit(True)), "id", "left").withColumn("score", score)
    best = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("score"), "id"))
    return rated.withColumn("place", best).where("place = 1").select("route", "id", "score")


def ambiguous_routes(nodes: DataFrame) -> DataFrame:
    """(route, n): routes with more than one active endpoint."""
    ends = nodes.where("type = 'Endpoint' AND coalesce(reachability, 'Active') = 'Active'").withColumn("route", C.route_key_of_label(F.col("label")))
    return ends.where("route IS NOT NULL").groupBy("route").agg(F.count("*").alias("n")).where("n > 1")


def edge_trace(nodes: DataFrame, edges: DataFrame, chosen: DataFrame, cap: int = 20) -> DataFrame:
    """(trace, step_no, kind, ref) of chosen edges (id): source, the edge, target, then edges that share an end, best rank first; at most cap steps."""
    own = edges.join(chosen, "id", "left_semi").select(F.col("id").alias("trace"), "source", "target", "id")
    step = lambda stage, ref, kind: F.struct(F.lit(stage).alias("stage"), F.col(ref).alias("ref"), F.lit(kind).alias("kind"))
    steps = own.select("trace", F.explode(F.array(step(0, "source", "Source"), step(1, "id", "Edge"), step(2, "target", "Target"))).alias("s"))
    steps = steps.select("trace", "s.stage", "s.ref", "s.kind", F.lit(0).alias("rank"))
    ends = own.select("trace", F.explode(F.array_distinct(F.array("source", "target"))).alias("end"))
    touching = edges.select("id", "type", "confidence", "evidence", F.explode(F.array_distinct(F.array("source", "target"))).alias("end"))
    related = ends.join(touching, "end").where("id <> trace").select("trace", F.lit(3).alias("stage"), F.col("id").alias("ref"), F.lit("Related").alias("kind"), C.trace_rank(F.col("type"), F.col("confidence"), F.col("evidence")).alias("rank")).distinct()
    place = F.row_number().over(Window.partitionBy("trace").orderBy("stage", F.desc("rank"), "ref"))
    return steps.unionByName(related).withColumn("step_no", place).where(F.col("step_no") <= cap).select("trace", "step_no", "kind", "ref")


def file_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, functions, links, complexity) of files: callables inside and edges at the file node."""
    files = nodes.where("type = 'File'").select("id", F.col("file").alias("path"))
    inside = nodes.where(F.col("type").isin("Function", "Method", "Component", "Hook", "Endpoint")).groupBy(F.col("file").alias("path")).agg(F.count("*").alias("functions"))
    out = degree(files, edges).join(inside, "path", "left").withColumn("functions", F.coalesce("functions", F.lit(0)))
    return out.select("path", "functions", F.col("connections").alias("links"), C.complexity(F.col("functions")).alias("complexity"))


def diagnostics_by_file(diagnostics: DataFrame) -> DataFrame:
    """(file, errors, warnings, infos, hints, worst)."""
    of = lambda s: F.count_if(F.col("severity") == s)
    counts = diagnostics.groupBy("file").agg(of("Error").alias("errors"), of("Warning").alias("warnings"), of("Information").alias("infos"), of("Hint").alias("hints"))
    worst = F.when(F.col("errors") > 0, "Error").when(F.col("warnings") > 0, "Warning").when(F.col("infos") > 0, "Information").otherwise("Hint")
    return counts.withColumn("worst", worst)


def top_diagnostics(diagnostics: DataFrame, severity: str | None = None, language: str | None = None, limit: int = 100) -> DataFrame:
    """The first diagnostics by file and id, of a severity and a language (by any of its names) where given."""
    own = diagnostics.where(F.col("severity") == severity) if severity else diagnostics
    own = own.where(F.col("language") == N.language_of_name(F.lit(language))) if language else own
    return own.orderBy("file", "id").limit(limit).select("id", "file", "severity", "language")


def detached_files(nodes: DataFrame, limit: int = 200) -> DataFrame:
    """(id, file, total): the first detached Rust files by file and label, and how many there are in all."""
    own = nodes.where("type = 'File' AND language = 'rust' AND reachability = 'Detached'")
    total = F.broadcast(own.agg(F.count("*").alias("total")))  # one row
    return own.orderBy("file", "label").limit(limit).crossJoin(total).select("id", "file", "total")


def check_status(projects: DataFrame, checks: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(project, run, passed, failed, skipped, timed_out, diagnostics, complete, clean, status, message, warnings) of every project (project).

    checks (project, success, skipped, timed_out), diagnostics (project), a row each. Skipped checks weren't run; one that timed out may have failed too. Checks are complete if
    there are some and none was skipped, failed or timed out, and the project clean if there are no diagnostics either.
    """
    c = F.col
    sums = checks.groupBy("project").agg(
        F.count("*").alias("n"), F.count_if(~c("skipped")).alias("run"), F.count_if("success").alias("passed"), F.count_if(~c("success") & ~c("skipped")).alias("failed"), F.count_if("skipped").alias("skipped"), F.count_if("timed_out").alias("timed_out")
    )
    found = diagnostics.groupBy("project").agg(F.count("*").alias("diagnostics"))
    all_ = projects.select("project").distinct().join(sums, "project", "left").join(found, "project", "left").na.fill(0, ["n", "run", "passed", "failed", "skipped", "timed_out", "diagnostics"])
    complete = (c("n") > 0) & (c("skipped") == 0) & (c("failed") == 0) & (c("timed_out") == 0)
    clean = complete & (c("diagnostics") == 0)
    status = F.when(c("n") == 0, "Stale").when((c("failed") > 0) | (c("timed_out") > 0), "Error").when(c("skipped") > 0, "Fallback").otherwise("Ready")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    n = lambda name: c(name).cast("string")
    warnings = [
        F.when(c("n") == 0, F.lit("Project checks have not been run; empty diagnostics do not prove the project is clean.")),
        F.when(c("skipped") > 0, say(n("skipped"), " project check(s) were skipped; do not claim full project cleanliness.")),
        F.when(c("timed_out") > 0, say(n("timed_out"), " project check(s) timed out; diagnostics may be incomplete.")),
        F.when(c("failed") > 0, say(n("failed"), " project check(s) failed; inspect check results and diagnostics.")),
    ]
    counted = say(n("passed"), "/", n("n"), " check(s) passed, ", n("failed"), " failed, ", n("skipped"), " skipped, ", n("timed_out"), " timed out, ", n("diagnostics"), " diagnostic(s).")
    message = F.when(clean, "All requested project checks passed and no diagnostics were reported.").when(c("n") == 0, "Checks not run.").otherwise(counted)
    return all_.select("project", "run", "passed", "failed", "skipped", "timed_out", "diagnostics", complete.alias("complete"), clean.alias("clean"), status.alias("status"), message.alias("message"), F.array_compact(F.array(*warnings)).alias("warnings"))


def diff(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(op, id): added, updated or removed between two snapshots' rows."""
    content = F.struct(*columns)
    both = old.select("id", content.alias("a"), F.lit(True).alias("was")).join(new.select("id", content.alias("b"), F.lit(True).alias("is")), "id", "full")
    op = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "updated")
    return both.select(op.alias("op"), "id").where("op IS NOT NULL")


def apply_patch(nodes: DataFrame, edges: DataFrame, added: DataFrame, updated: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a patch: removed nodes take their edges along; an update keeps what isn't in it."""
    left = nodes.join(removed, "id", "left_anti")
    kept = left.join(updated, "id", "left_anti")
    changed = updated.join(left, "id", "left_semi")
    new = added.join(left, "id", "left_anti")
    gone = removed.select("id")
    rest = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept.unionByName(changed.select(kept.columns)).unionByName(new.select(kept.columns)), rest


def merge_edges(edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges of one key as one: the first, of equal seq the smallest id, with the strongest confidence of all."""
    rank = C.lookup(F.col("confidence"), C.MERGE_RANK, 0)
    return edges.groupBy(*key).agg(F.min(F.struct("seq", "id")).getField("id").alias("id"), F.max_by("confidence", rank).alias("confidence"), F.count("*").alias("n"))


def route_bridge(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls (call, verb, path) to endpoints (endpoint, label): by route key where the verb is known and fits, else by path, heuristically."""
    ends = endpoints.withColumn("route", C.route_key_of_label(F.col("label"))).where("route IS NOT NULL").select("endpoint", "route", C.api_path(F.regexp_extract("route", r" (.*)$", 1)).alias("api"))
    asked = calls.withColumn("route", F.when(F.col("verb").isNotNull(), C.route_key(F.col("verb"), F.col("path")))).withColumn("api", C.api_path(F.col("path")))
    sure = asked.join(ends.select("endpoint", "route"), "route").select("call", "endpoint", F.lit("Semantic").alias("confidence"))
    known = asked.join(ends.select("route").distinct(), "route", "left_semi").select("call").distinct()  # without the pairs, which grow with the square of the table
    rest = asked.join(known, "call", "left_anti")
    loose = rest.join(ends.select("endpoint", "api").where("api IS NOT NULL"), "api").select("call", "endpoint", F.lit("Heuristic").alias("confidence"))
    return sure.unionByName(loose)
