"""Column functions over names, paths and source text: languages, module paths, ids, strings, verbs, imports. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import columns as C

# Other names of languages, by whom they are understood.
ALIASES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python"}
CLIENT_ALIASES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "api": "endpoints", "endpoint": "endpoints", "ws": "workspace"}
CLIENT_LANGUAGES = "rust typescript javascript python qml endpoints external workspace".split()
# How sure an edge is by its type, where nothing else says so.
DEFAULT_CONFIDENCE = {
    **dict.fromkeys("Contains EndpointHandler ExternalDependency".split(), "Exact"),
    **dict.fromkeys("Calls Renders TypeReference DataFlow Implements".split(), "SyntaxFallback"),
    **dict.fromkeys("ApiCall Imports ModDeclaration".split(), "Semantic"),
    "Uses": "Heuristic",
}
# Node types of symbol kinds that have another name.
KINDS = {"Package": "Module", "Namespace": "Module", "Constructor": "Method"}
CARGO_SEVERITY = {"error": "Error", "warning": "Warning", "help": "Hint", "note": "Information"}
VERBS = "GET POST PUT PATCH DELETE HEAD OPTIONS".split()


def language_of_name(name: Column) -> Column:
    """A language by its name or extension, in any case; other names as they are, in lower case."""
    low = F.lower(F.trim(name))
    return F.coalesce(C.lookup(low, ALIASES, None), low)


def node_language(kind: Column, file: Column, module: Column, crate: Column) -> Column:
    """What a node is written in: by its file, else by what module, crate and kind say; null if nothing does."""
    script = F.contains(module, F.lit("typescript")) | (crate == "frontend") | kind.isin("Component", "Hook", "Interface", "TypeAlias")
    return F.coalesce(
        C.language_of_path(file),
        F.when((module == "python") | (crate == "python"), "python")
        .when((module == "qml") | (crate == "qml"), "qml")
        .when(script, "typescript")
        .when((kind == "ExternalCrate") | (crate.isNotNull() & (crate != "frontend")), "rust"),
    )


def client_language(kind: Column, crate: Column, file: Column, language: Column, node: Column, label: Column) -> Column:
    """The language under which a view shows a node; 'unknown' if nothing tells."""
    low = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    given = F.coalesce(C.lookup(low, CLIENT_ALIASES, None), F.when(low.isin(CLIENT_LANGUAGES), low))
    text = F.lower(F.concat_ws(" ", F.coalesce(file, F.lit("")), F.coalesce(node, F.lit("")), F.coalesce(label, F.lit(""))))
    has = lambda part: F.contains(text, F.lit(part))
    guess = F.when(has(".rs"), "rust").when(has(".py"), "python").when(has(".qml"), "qml").when(has(".ts"), "typescript").when(has(".js"), "javascript").otherwise("unknown")
    workspace = (kind == "Module") & F.coalesce(file == "", F.lit(True)) & node.startswith("workspace:")
    return F.when(kind == "Endpoint", "endpoints").when((kind == "ExternalCrate") | (crate == "external"), "external").when(workspace, "workspace").otherwise(F.coalesce(given, guess))


def language_filter(language: Column) -> Column:
    """The switch that hides a client language; null for what always shows."""
    return F.when(language == "javascript", "typescript").when(~language.isin("workspace", "unknown"), language)


def module_path(path: Column, language: Column) -> Column:
    """A file's module path: parts joined by ::, without endings, entry files and the folders that name no module."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rust = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.rs$", ""), "/"), lambda p: p != "")
    named = F.filter(rust, lambda p: ~p.isin("mod", "main", "lib"))
    top = (F.size(rust) == 1) & F.get(rust, F.lit(0)).isin("main", "lib")
    drop = lambda a, first: F.when(F.get(a, F.lit(0)) == first, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    joined = lambda a, ending: F.regexp_replace(F.array_join(a, "::"), ending, "")
    script = joined(drop(drop(parts, "frontend"), "src"), r"(\.tsx)*(\.ts)*(\.jsx)*(\.js)*$")
    python = F.regexp_replace(joined(parts, r"(\.py)+$"), r"(^|::)__init__$", "")
    return (
        F.when(language == "rust", F.when(top, "crate root").otherwise(F.array_join(named, "::")))
        .when(language.isin("typescript", "javascript"), F.coalesce(F.nullif(script, F.lit("")), F.lit("frontend")))
        .when(language == "python", F.coalesce(F.nullif(python, F.lit("")), F.lit("python")))
        .when(language == "qml", F.coalesce(F.nullif(joined(parts, r"(\.qml)+$"), F.lit("")), F.lit("qml")))
    )


def relative_to(root: Column, path: Column) -> Column:
    """path below root, whole where it isn't below it, with forward slashes."""
    bare = F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", "")
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(unix, F.concat(bare, F.lit("/"))), F.substr(unix, F.length(bare) + 2)).otherwise(unix)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(kind, F.lit(":"), source, F.lit("->"), target)


def endpoint_id(file: Column, verb: Column, path: Column, line: Column) -> Column:
    safe = F.translate(F.translate(F.regexp_replace(path, "^/+|/+$", ""), "/:", "__"), "{}$", "")
    return F.concat(F.lit("endpoint:"), file, F.lit("::"), verb, F.lit(":"), safe, F.lit("@"), line.cast("string"))


def visibility(signature: Column) -> Column:
    return F.when(signature.startswith("pub(crate)"), "pub(crate)").when(signature.startswith("pub "), "pub").otherwise("private")


def first_string(line: Column) -> Column:
    """The first quoted string; an escaped sign stays as it is written; an opening quote that is never closed is passed over."""
    body = r"(?:\\.|[^\\{q}])*"
    found = F.regexp_substr(line, F.lit("|".join(q + body.replace("{q}", q) + q for q in ("\"", "'", "`"))))
    return F.substring(found, F.lit(2), F.length(found) - 2)


def receiver(line: Column, method: str) -> Column:
    """What a method is called on: the last name before the first `.method(`; null without one."""
    before = F.regexp_replace(F.substring_index(line, f".{method}(", 1), r"\s+$", "")
    name = F.substring_index(F.regexp_extract(before, r"([A-Za-z0-9_:]*)$", 1), "::", -1)
    return F.when(F.contains(line, F.lit(f".{method}(")) & (name != ""), name)


def last_identifier(callee: Column) -> Column:
    return F.nullif(F.regexp_extract(callee, r"([A-Za-z0-9_$]+)[^A-Za-z0-9_$]*$", 1), F.lit(""))


def api_verb(before: Column, after: Column) -> Column:
    """The verb of an API path by the text around it: an option behind it, a quoted verb before it, a call verb( right before it, or fetch(."""
    option = F.upper(F.trim(F.regexp_extract(F.substring(after, 1, 220), r"""(?s)^.*?method.*?(["'`])(.*?)\1""", 2)))
    near = F.right(before, F.least(F.length(before), F.lit(120)))
    quoted = F.coalesce(*(F.when(near.rlike(rf"""(["'`])({v}|{v.lower()})\1"""), v) for v in VERBS))
    called = F.upper(F.regexp_extract(F.lower(F.right(before, F.least(F.length(before), F.lit(80)))), r"(get|post|put|patch|delete)\($", 1))
    return F.coalesce(F.when(option.isin(VERBS), option), quoted, F.nullif(called, F.lit("")), F.when(F.contains(near, F.lit("fetch(")), "GET"))


def xhr_verb(before: Column) -> Column:
    """The verb of a request that an xhr.open before it names first; GET by default."""
    named = F.regexp_extract(F.substring_index(before, "xhr.open", -1), r"""["']([A-Za-z]+)["']""", 1)
    return F.when(F.contains(before, F.lit("xhr.open")) & (named != ""), F.upper(named)).otherwise("GET")


IDENTIFIER = "^[A-Za-z_$][A-Za-z0-9_$]*$"


def imported_names(statement: Column) -> Column:
    """The names that a TypeScript import binds, sorted, each once; an alias counts instead of its name."""
    head = F.trim(F.regexp_replace(F.substring_index(statement, " from ", 1), "^import", ""))
    default = F.trim(F.regexp_replace(F.trim(F.substring_index(head, "{", 1)), ",+$", ""))
    inner = F.regexp_extract(head, r"\{([^}]*)\}", 1)
    bound = F.transform(F.split(inner, ","), lambda b: F.trim(F.substring_index(b, " as ", -1)))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(default), bound), lambda n: n.rlike(IDENTIFIER))))


def python_imports(statement: Column) -> Column:
    """array of (module, level, names) that a Python import statement means; names are those before `as`."""
    text = F.trim(statement)
    plain = F.transform(
        F.filter(F.transform(F.split(F.substr(text, F.lit(8)), ","), lambda p: F.trim(F.substring_index(p, " as ", 1))), lambda m: m != ""),
        lambda m: F.struct(m.alias("module"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("names")),
    )
    raw, names = F.regexp_extract(text, r"(?s)^from (.*?) import (.*)$", 1), F.regexp_extract(text, r"(?s)^from (.*?) import (.*)$", 2)
    bound = F.transform(F.split(F.regexp_replace(names, "^[()]+|[()]+$", ""), ","), lambda n: F.trim(F.substring_index(n, " as ", 1)))
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    one = F.array(F.struct(F.regexp_replace(raw, r"^\.+", "").alias("module"), dots.alias("level"), F.filter(bound, lambda n: n.rlike("^[A-Za-z_][A-Za-z0-9_]*$")).alias("names")))
    kind = "array<struct<module:string,level:int,names:array<string>>>"
    return F.when(text.startswith("import "), plain.cast(kind)).when(text.rlike("(?s)^from .* import "), one.cast(kind)).otherwise(F.array().cast(kind))


def range_span(start_line: Column, start_char: Column, end_line: Column, end_char: Column) -> Column:
    """The size of a range: ten thousand a line, one a character, neither below nothing."""
    return F.greatest(end_line - start_line, F.lit(0)) * 10_000 + F.greatest(end_char - start_char, F.lit(0))


def node_kind(symbol_kind: Column, name: Column) -> Column:
    """The node type of a symbol kind; null for kinds that make no node."""
    return F.when(name.startswith("impl ") | F.contains(name, F.lit(" impl ")), "Impl").when(symbol_kind != "Other", F.coalesce(C.lookup(symbol_kind, KINDS, None), symbol_kind))


def analyzer_status(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *parts: low.rlike("|".join(parts))
    return F.when(has("ready"), "Ready").when(has("restart", "starting"), "Starting").when(has("error"), "Error").when(has("unavailable", "parser only"), "Fallback").otherwise("Stale")


def short_evidence(text: Column, most: int = 96) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def counted(n: Column, noun: str) -> Column:
    """'1 step', '2 steps'."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
