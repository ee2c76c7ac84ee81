"""What a client sees: filters, lists, counters, patches, bounded answers and context packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import columns as C
from graphloom.functions import names as N
from graphloom.functions.session import checkpoint
from graphloom.operators.modes import both_ends, bundle, edge_visibility
from graphloom.operators.scan import numbered

# Analyzers in the order in which they are listed, and engines that know meanings.
ANALYZERS = "rust typescript python qml".split()
SEMANTIC_ENGINES = ["rust-analyzer", "ty", "typescript-lsp", "qml-lsp"]
LANGUAGE_ROOTS = ["frontend:typescript", "backend:python", "ui:qml"]
PACK_SNIPPETS, PACK_CHARS = 12, 30_000


def client_filter(nodes: DataFrame, edges: DataFrame, languages: list[str], reachability: list[str], level: str, types: list[str] | None = None, edge_types: list[str] | None = None):
    """(nodes, edges) of the languages and states shown, edges with both ends, then the level of detail and the ticked types.

    Nodes without a language switch always show; a null state is Active; no types mean all.
    """
    shown = N.language_filter(N.client_language(*(F.col(c) for c in ("type", "crate", "file", "language", "id", "label"))))
    keep = nodes.where(F.coalesce(shown.isin(languages), F.lit(True)) & F.coalesce("reachability", F.lit("Active")).isin(reachability))
    keep = keep.where(F.col("type").isin(types)) if types else keep
    left = edge_visibility(both_ends(edges, keep), level)
    return keep, left.where(F.col("type").isin(edge_types)) if edge_types else left


def visible_graph(nodes: DataFrame, edges: DataFrame, languages: list[str], reachability: list[str], level: str, groups: DataFrame, depth: int, lens=None):
    """(nodes, edges) as a view draws them: the lens (nodes, edges -> both), collapsed groups' notes, filters, the groups collapsed, the hierarchy's depth, then parallel edges as one.

    A collapsed group's connections are its hidden nodes, and its description says how many and the first three types of edges across its border. Edges keep their
    order, label and kind of flow, so flows of different kinds stay apart.
    """
    from graphloom.operators.modes import degree
    from graphloom.operators.traverse import collapse, group_links, hierarchy, owners

    if lens:
        nodes, edges = lens(nodes, edges)
    own = owners(edges, groups.join(nodes, "id", "left_semi"))
    types = F.slice(F.array_distinct(F.concat(F.coalesce("incoming", F.array().cast("array<string>")), F.coalesce("outgoing", F.array().cast("array<string>")))), 1, 3)
    hidden = own.groupBy("owner").agg(F.count("*").alias("hidden")).join(group_links(edges, own), "owner", "left")
    note = F.concat(F.lit("Collapsed: "), F.col("hidden").cast("string"), F.lit(" hidden"), F.when(F.size(types) > 0, F.concat(F.lit(" · "), F.array_join(types, ", "))).otherwise(""))
    notes = hidden.select(F.col("owner").alias("id"), "hidden", note.alias("note"))
    keep, left = client_filter(nodes, edges, languages, reachability, level)
    keep, left = collapse(keep, left, groups)
    ids = hierarchy(degree(keep, left), left, depth).select("id")
    shown = degree(keep, left).join(ids, "id", "left_semi").join(notes, "id", "left").withColumn("connections", F.coalesce("hidden", "connections"))
    return shown.withColumn("description", F.col("note")).drop("hidden", "note"), bundle(both_ends(left, ids))


def symbols_of(nodes: DataFrame) -> DataFrame:
    """(id, language, type, label, name, file, line, character, range, selection_range) of the nodes that have a file and both ranges.

    The name is the whole label; language is rust by default, the line the one after the selection's start.
    """
    own = nodes.where("file IS NOT NULL AND range IS NOT NULL AND selection_range IS NOT NULL")
    start = F.col("selection_range.start_line")
    return own.select("id", F.coalesce("language", F.lit("rust")).alias("language"), "type", "label", F.col("label").alias("name"), "file", F.coalesce("line", start + 1).alias("line"), F.col("selection_range.start_char").alias("character"), "range", "selection_range")


def timeline(events: DataFrame, diagnostics: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(id, kind, file, message, at): events (the same columns) and the errors and warnings among diagnostics, of the ticked kinds.

    A diagnostic's message ends with its place, counted from 1, where it has one; its time is what its source is called, else `diagnostic`.
    """
    place = F.concat(F.lit(" · L"), F.col("line") + 1, F.lit(":"), F.coalesce("char", F.lit(0)) + 1)
    marks = diagnostics.where("severity IN ('Error', 'Warning')").select(
        F.concat(F.lit("diagnostic-event:"), "id").alias("id"), F.lower("severity").alias("kind"), "file", F.concat("message", F.coalesce(place, F.lit(""))).alias("message"), F.coalesce("source", F.lit("diagnostic")).alias("at")
    )
    both = events.select("id", "kind", "file", "message", "at").unionByName(marks)
    return both.where(F.col("kind").isin(kinds)) if kinds else both


def files_by_analyzer(paths: DataFrame) -> DataFrame:
    """(analyzer, files, place): source files of each analyzer, scripts of both kinds as one, only of those that have some, in the listed order."""
    kind = C.language_of_path(F.col("path"))
    own = paths.select(F.when(kind == "javascript", "typescript").otherwise(kind).alias("analyzer")).where("analyzer IS NOT NULL")
    return own.groupBy("analyzer").agg(F.count("*").alias("files")).withColumn("place", F.array_position(F.array(*map(F.lit, ANALYZERS)), F.col("analyzer")).cast("int"))


def sorted_analyzers(analyzers: DataFrame) -> DataFrame:
    """analyzers (kind, engine, label, files) that have files, with their place: by kind, engines that know meanings first, then label."""
    order = [F.array_position(F.array(*map(F.lit, ANALYZERS)), F.col("kind")), (~F.col("engine").isin(SEMANTIC_ENGINES)).cast("int"), F.col("label")]
    shown = analyzers.where("files > 0").select("kind", "engine", "label", "files", F.array(*(o.cast("string") for o in order)).alias("order"))
    return shown.withColumn("place", F.row_number().over(Window.orderBy("order"))).drop("order")  # one row an engine


def analyzer_summary(analyzers: DataFrame) -> DataFrame:
    """One row over the analyzers that have files: how many are in each state (starting counts as indexing), total, and a label that names the states in use."""
    states = {"error": ["Error"], "indexing": ["Starting", "Indexing"], "ready": ["Ready"], "fallback": ["Fallback"], "stale": ["Stale"]}
    row = analyzers.where("files > 0").agg(F.count("*").alias("total"), *(F.count_if(F.col("status").isin(s)).alias(n) for n, s in states.items()))
    parts = F.concat_ws(" · ", *(F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {n}"))) for n in states))
    return row.withColumn("label", F.concat(F.lit("Analyzers · "), F.coalesce(F.nullif(parts, F.lit("")), F.lit("none"))))


def weighted_degree(nodes: DataFrame, bundles: DataFrame) -> DataFrame:
    """(id, weight): the edges at each node of a view, a bundle counting all its edges and one from a node to itself twice; ends that aren't in the view count for nothing."""
    n = F.coalesce("bundled", F.lit(1)).alias("n")
    ends = bundles.select(F.col("source").alias("id"), n).union(bundles.select("target", n))
    return nodes.select("id").join(ends.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("weight"))


def counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, active and detached files."""
    own = nodes.agg(F.count("*").alias("nodes"), F.count_if((F.col("type") == "File") & (F.coalesce("reachability", F.lit("Active")) == "Active")).alias("active_files"), F.count_if((F.col("type") == "File") & (F.col("reachability") == "Detached")).alias("detached_files"))
    return own.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def bounded(nodes: DataFrame, edges: DataFrame, most_nodes: int = 500, most_edges: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row (nodes, edges, truncated)): the first nodes, then the first edges between them; the totals are those before the cut."""
    few = nodes.orderBy("seq").limit(most_nodes)
    some = both_ends(edges, few).orderBy("seq").limit(most_edges)
    row = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    return few, some, row.withColumn("truncated", (F.col("nodes") > most_nodes) | (F.col("edges") > most_edges))


def related(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(id, place, other): for every node the sources of its incoming edges, then the targets of its outgoing ones, in order, duplicates and all, as far as they are nodes."""
    both = edges.select(F.col("target").alias("id"), F.lit(0).alias("way"), "seq", F.col("source").alias("other"), F.col("id").alias("edge")).union(edges.select("source", F.lit(1), "seq", "target", "id"))
    known = both.join(nodes.select(F.col("id").alias("other")), "other", "left_semi").join(nodes.select("id"), "id", "left_semi")
    return known.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("way", "seq", "edge"))).where(F.col("place") <= most).select("id", "place", "other")


def palette(nodes: DataFrame, query: str) -> DataFrame:
    """Ids of a palette's first ten hits by label, file or module; without a query the first eight modules and traits."""
    q = query.strip().lower()
    if not q:
        return nodes.where("type IN ('Module', 'Trait') OR coalesce(bookmarked, false)").orderBy("seq").limit(8).select("id")
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q)) for c in ("label", "file", "module")))
    return nodes.where(hit).orderBy("seq").limit(10).select("id")


def wrapped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without a workspace node that only wraps one language root, else with the Contains edges to the roots that lack one."""
    space = nodes.where("type = 'Module' AND coalesce(file, '') = '' AND id LIKE 'workspace:%'").orderBy("seq").limit(1).select(F.col("id").alias("space"))
    roots = nodes.where((F.col("type") == "Module") & F.col("id").isin(LANGUAGE_ROOTS)).select(F.col("id").alias("root"))  # three at most
    about = edges.join(F.broadcast(space), (F.col("source") == F.col("space")) | (F.col("target") == F.col("space"))).join(F.broadcast(roots), F.col("target") == F.col("root"), "left")
    other = about.where("target = space OR root IS NULL").select("space").distinct()
    single = F.broadcast(roots.agg((F.count("*") == 1).alias("single")))
    hide = F.broadcast(space.join(other, "space", "left_anti").crossJoin(single).where("single").select(F.col("space").alias("id")))
    left = nodes.join(hide, "id", "left_anti")
    rest = edges.join(hide.withColumnRenamed("id", "source"), "source", "left_anti").join(hide.withColumnRenamed("id", "target"), "target", "left_anti")
    missing = space.join(hide.withColumnRenamed("id", "space"), "space", "left_anti").crossJoin(F.broadcast(roots))
    missing = missing.join(edges.select(F.col("source").alias("space"), F.col("target").alias("root")), ["space", "root"], "left_anti")
    return left, rest.select("id", "source", "target", "type").union(missing.select(N.edge_id(F.lit("Contains"), F.col("space"), F.col("root")), "space", "root", F.lit("Contains")))


def patch_diagnostics(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """old without those of the changed files (file), then new."""
    return old.join(changed.select("file").distinct(), "file", "left_anti").select(*new.columns).unionByName(new)


def without_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the symbols of changed files (file) and all edges at these; the files' own nodes stay."""
    gone = nodes.where("type <> 'File' AND file IS NOT NULL").join(changed.select("file").distinct(), "file", "left_semi").select("id")
    rest = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(gone, "id", "left_anti"), rest


def without_relations(nodes: DataFrame, edges: DataFrame, changed: DataFrame, scripts: bool) -> DataFrame:
    """edges without the relations at changed files and their symbols; all containment stays; of scripts every heuristic API call goes."""
    ids = nodes.where("file IS NOT NULL").join(changed.select("file").distinct(), "file", "left_semi").select("id")
    return edges.where("type = 'Contains'").unionByName(without_ends(relations(edges, scripts), ids))


def relations(edges: DataFrame, scripts: bool) -> DataFrame:
    """The edges that are no containment and, of scripts, no heuristic API calls."""
    return edges.where("type <> 'Contains' AND NOT (type = 'ApiCall' AND confidence = 'Heuristic')" if scripts else "type <> 'Contains'")


def without_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges at none of ids (id)."""
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti").join(ids.select(F.col("id").alias("target")), "target", "left_anti")


def refreshed(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after changed files (file) were read again: their old symbols and relations go, what was read comes, the first of equal ids stays.

    As without_files and then without_relations, but each edge meets the changed ids once at either end: relations all of them, containment only the symbols.
    """
    at = checkpoint(nodes.where("file IS NOT NULL").join(changed.select("file").distinct(), "file", "left_semi").select("id", "type"))
    gone = at.where("type <> 'File'")
    left = checkpoint(without_ends(edges.where("type = 'Contains'"), gone).unionByName(without_ends(relations(edges, True), at)))
    add = lambda a, b: a.unionByName(b.select(a.columns).join(a.select("id"), "id", "left_anti").dropDuplicates(["id"]))
    every = checkpoint(add(nodes.join(gone, "id", "left_anti"), new_nodes))
    return every, both_ends(add(left, new_edges), every)


def parsed_or_found(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols of a parser and of lines: those of lines only where the parser has none of that path, name and line."""
    return parsed.unionByName(found.join(parsed.select("path", "name", "line_no"), ["path", "name", "line_no"], "left_anti").select(parsed.columns))


def needs_refresh(patches: DataFrame) -> DataFrame:
    """patches (id, added_nodes, ..., changed_files) with `refresh`: whether a patch touches the graph and not diagnostics alone."""
    parts = [f"{op}_{what}" for op in ("added", "updated", "removed") for what in ("nodes", "edges")]
    return patches.withColumn("refresh", reduce(lambda a, b: a | b, (F.col(p) > 0 for p in parts)))


def traced(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """steps (trace, step_no, kind, ref, word) as a trace shows them: title, description, language, file, line, confidence, evidence and state.

    A node's title is the word of its place in the trace and its label, its evidence its signature; an edge's is the word and its ends' labels, unknown for ends without
    a node, its description its label, else its type, the rest its target's.
    """
    c = F.col
    own = nodes.select(c("id").alias("ref"), F.struct("label", "language", "file", "line", "signature", "reachability").alias("n"))
    ends = edges.groupBy(c("id").alias("ref")).agg(F.min_by(F.struct("source", "target", "type", "label", "confidence", "evidence"), "seq").alias("e")).select("ref", "e.source", "e.target", F.struct("e.type", "e.label", "e.confidence", "e.evidence").alias("e"))
    source = nodes.select(c("id").alias("source"), c("label").alias("s_label"))
    target = nodes.select(c("id").alias("target"), F.struct("label", "language", "file", "line", "reachability").alias("t"))
    both = steps.join(own, "ref", "left").join(ends, "ref", "left").join(source, "source", "left").join(target, "target", "left")
    node = c("n").isNotNull()
    edge = F.concat(F.coalesce("s_label", F.lit("unknown")), F.lit(" -> "), F.coalesce("t.label", F.lit("unknown")))
    pick = lambda name: F.when(node, c(f"n.{name}")).otherwise(c(f"t.{name}")).alias(name)
    return both.select(
        "trace", "step_no", "kind", "ref", F.concat("word", F.lit(": "), F.when(node, c("n.label")).otherwise(edge)).alias("title"), F.when(~node, F.coalesce("e.label", "e.type")).alias("description"),
        *map(pick, ("language", "file", "line")), c("e.confidence").alias("confidence"), F.when(node, c("n.signature")).otherwise(c("e.evidence")).alias("evidence"), pick("reachability"),
    )


def trace_warnings(nodes: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(trace, warning) of endpoints: detached or generated ones, and those whose route (route, n) more than one active endpoint answers."""
    ends = nodes.where("type = 'Endpoint'").select("id", "label", "reachability", C.route_key_of_label(F.col("label")).alias("route"))
    state = ends.where("reachability IN ('Detached', 'Generated')").select(F.col("id").alias("trace"), F.concat("label", F.lit(" is "), "reachability", F.lit("; include with care.")).alias("warning"))
    many = ends.join(ambiguous, "route").select(F.col("id").alias("trace"), F.concat(F.lit("Route "), "route", F.lit(" has "), F.col("n").cast("string"), F.lit(" active endpoints.")).alias("warning"))
    return state.union(many)


def highlights(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(trace, nodes, edges): the distinct ids that a trace's steps name."""
    own = steps.join(nodes.select(F.col("id").alias("ref"), F.lit(True).alias("is_node")), "ref", "left")
    return own.groupBy("trace").agg(F.array_sort(F.collect_set(F.when(F.col("is_node"), F.col("ref")))).alias("nodes"), F.array_sort(F.collect_set(F.when(F.col("is_node").isNull(), F.col("ref")))).alias("edges"))


def context_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(pack, place, id, edge, selected): for every root (id) the root itself, then the ends of its edges, ranked, each node at its first place.

    Nodes that are detached or generated come only if they are the root. An edge adds its source,
    then its target.
    """
    own = roots.select(F.col("id").alias("pack"), F.lit(0).alias("rank"), F.lit("").alias("edge"), F.lit(0).alias("side"), "id", F.lit(True).alias("selected"))
    rank = -C.trace_rank(F.col("type"), F.col("confidence"), F.col("evidence"))
    # of an edge's ends one is the root, whose own row comes before any edge's, so only the other one can be new
    ways = F.array(F.struct(F.col("source").alias("pack"), F.lit(1).alias("side"), F.col("target").alias("id")), F.struct(F.col("target").alias("pack"), F.lit(0).alias("side"), F.col("source").alias("id")))
    at = edges.select(F.col("id").alias("edge"), rank.alias("rank"), F.explode(ways).alias("w")).select("w.pack", "rank", "edge", "w.side", "w.id").where("pack <> id")
    ends = at.join(roots.select(F.col("id").alias("pack")), "pack", "left_semi").select("pack", "rank", "edge", "side", "id", F.lit(False))
    state = nodes.select("id", F.coalesce(F.col("reachability").isin("Detached", "Generated"), F.lit(False)).alias("off"))
    every = own.union(ends).join(state, "id").where("selected OR NOT off")
    order = [F.desc("selected"), "rank", "edge", "side"]
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("pack", "id").orderBy(*order))).where("n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy(*order))).select("pack", "place", "id", "edge", "selected")


def within_budget(snippets: DataFrame, most: int = PACK_SNIPPETS, chars: int = PACK_CHARS) -> DataFrame:
    """snippets (pack, place, size, ...) that fit: in order, at most `most` of a pack; one that would pass `chars` in all is left out and the next one is tried."""
    return budgeted(snippets.withColumn("budget__id", F.col("place").cast("string")), "budget__id", most, chars).where("verdict = 'kept'").drop("verdict", "budget__id")


def budgeted(snippets: DataFrame, key: str, most: int = PACK_SNIPPETS, chars: int = PACK_CHARS) -> DataFrame:
    """snippets (pack, place, size, key, ...) with `verdict`: kept, again (a key that its pack has kept), many (the pack is full) or long (it would pass `chars`).

    Packs are sorted within partitions and folded as they stream by, across batches; a task holds one pack's few kept keys, never a pack. Limits are tried before repetition.
    """
    import pyarrow as pa

    def run(batches):
        pack, used, kept = object(), 0, set()
        for b in batches:
            said = []
            for p, size, k in zip(b["pack"].to_pylist(), b["size"].to_pylist(), b[key].to_pylist()):
                if p != pack:
                    pack, used, kept = p, 0, set()
                verdict = "many" if len(kept) >= most else "long" if used + size > chars else "again" if k in kept else "kept"
                if verdict == "kept":
                    kept.add(k)
                    used += size
                said.append(verdict)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], names=[*b.schema.names, "verdict"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in snippets.schema)
    return snippets.repartition("pack").sortWithinPartitions("pack", "place").mapInArrow(run, f"{fields}, verdict string")


def context_packs(nodes: DataFrame, edges: DataFrame, roots: DataFrame, code: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(pack, part, place, id, text) of the context of every root (id): its nodes, edges, snippets, diagnostics, warnings and summary, each part in its order.

    code (id, snippet, text) has a snippet for a node with a file and a line, snippet naming its file and lines; diagnostics (node, id, seq). Nodes come as context_nodes has them; an external one has no snippet. Snippets are
    tried in the order of their nodes within both budgets, one of the same lines once. Warnings, each once: nodes that are detached or generated, packs that were cut. A root that is no node has no pack.
    """
    c = F.col
    own = context_nodes(nodes, edges, roots)
    about = nodes.select("id", "label", "type", "reachability")
    state = own.join(about, "id")
    known = roots.select("id").distinct().join(nodes.select("id"), "id", "left_semi").select(c("id").alias("pack"))
    rank = -C.trace_rank(c("type"), c("confidence"), c("evidence"))
    at = edges.select(c("id").alias("edge"), rank.alias("rank"), F.explode(F.array_distinct(F.array("source", "target"))).alias("pack")).dropDuplicates(["pack", "edge"]).join(known, "pack", "left_semi")
    linked = at.withColumn("place", F.row_number().over(Window.partitionBy("pack").orderBy("rank", "edge")))
    tried = state.where("NOT (type = 'ExternalCrate' OR coalesce(reachability = 'External', false))").join(code.select("id", "snippet", "text"), "id").select("pack", "place", "snippet", "text", F.length("text").alias("size"))
    judged = budgeted(tried, "snippet")
    found = state.join(diagnostics.select(c("node").alias("id"), c("id").alias("diagnostic"), "seq"), "id")
    risky = state.where("reachability IN ('Detached', 'Generated')").select("pack", F.concat(c("label"), F.lit(" is "), c("reachability"), F.lit("; include with care.")).alias("text"))
    cut = judged.where("verdict IN ('many', 'long')").select("pack", F.when(c("verdict") == "many", f"Context pack limited to {PACK_SNIPPETS} snippets.").otherwise(f"Context pack limited to {PACK_CHARS} characters.").alias("text"))
    none = F.lit(None).cast("string")
    row = lambda d, part, place, id_, text: d.select("pack", F.lit(part).alias("part"), place.cast("bigint").alias("place"), id_.alias("id"), text.alias("text"))
    parts = [
        row(state, "node", c("place"), c("id"), c("label")), row(linked, "edge", c("place"), c("edge"), none), row(judged.where("verdict = 'kept'"), "snippet", c("place"), c("snippet"), c("text")),
        row(found, "diagnostic", c("place") * 1_000_000 + c("seq"), c("diagnostic"), none), row(risky.union(cut).distinct(), "warning", F.lit(0), none, c("text")),
    ]
    every = reduce(DataFrame.union, parts)
    n = {p: F.count_if(c("part") == p) for p in ("snippet", "node", "edge", "diagnostic")}
    summary = every.groupBy("pack").agg(F.concat(F.concat_ws(", ", *(N.counted(v, p) for p, v in n.items())), F.lit(".")).alias("text"))
    return every.union(row(summary, "summary", F.lit(0), none, c("text")))


def check_messages(lines: DataFrame) -> DataFrame:
    """lines (line_no, value) of a checker's JSON output -> (id, file, severity, message, code, start_line, start_char, end_line, end_char).

    Lines that are no JSON or no compiler message are passed over; messages are numbered before
    those without a span leave; the primary span counts, else the first one; positions begin at 0.
    """
    span = "struct<file_name:string,line_start:int,column_start:int,line_end:int,column_end:int,is_primary:boolean>"
    kind = f"reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<{span}>>"
    read = lines.withColumn("j", F.from_json("value", kind)).where("j.reason = 'compiler-message' AND j.message IS NOT NULL")
    read = numbered(read, ["line_no"], "index")
    best = F.coalesce(F.get(F.filter("j.message.spans", lambda s: s["is_primary"]), F.lit(0)), F.get("j.message.spans", F.lit(0)))
    own = read.withColumn("s", best).where("s IS NOT NULL")
    zero = lambda c: F.greatest(F.col(f"s.{c}") - 1, F.lit(0))
    file = F.replace("s.file_name", F.lit("\\"), F.lit("/"))
    place = F.concat(F.lit("diagnostic:cargo-check:"), file, F.lit(":"), zero("line_start").cast("string"), F.lit(":"), zero("column_start").cast("string"), F.lit(":"), F.col("index").cast("string"))
    return own.select(
        place.alias("id"), file.alias("file"), C.lookup(F.col("j.message.level"), N.CARGO_SEVERITY, "Information").alias("severity"), F.col("j.message.message").alias("message"), F.col("j.message.code.code").alias("code"),
        zero("line_start").alias("start_line"), zero("column_start").alias("start_char"), zero("line_end").alias("end_line"), zero("column_end").alias("end_char"),
    )


def marked_reachability(nodes: DataFrame, reachable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): external crates External, symbols of Rust files Active or Detached as reachable (path, reachability) has it, others as they are; detached files in a group of their own."""
    known = reachable.select(F.col("path").alias("file"), F.col("reachability").alias("found"))
    state = F.when(F.col("type") == "ExternalCrate", "External").otherwise(F.coalesce("found", "reachability"))
    out = nodes.join(known, "file", "left").withColumn("reachability", state).drop("found").select(nodes.columns)
    lost = out.where("type = 'File' AND reachability = 'Detached'")
    group = F.lit("module:detached-rust-files")
    return out, lost.select(N.edge_id(F.lit("Contains"), group, F.col("id")).alias("id"), group.alias("source"), F.col("id").alias("target"), F.lit("Contains").alias("type"))
