"""Files found through other files: mod declarations and imports as joins of candidate paths, and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.traverse import reachable_from

# Where a crate begins, and why a file is detached.
CRATE_ROOT = r"^(src/(main|lib)\.rs|build\.rs|src/bin/[^/]+\.rs|(examples|tests|benches)/[^/]+\.rs)$"
DETACHED = "Rust file is not referenced by any crate root or mod declaration"
# What an import may mean, the first that exists first.
TYPESCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
PYTHON_ENDINGS = [".py", "/__init__.py"]
SNIPPET_LINES, SNIPPET_BYTES = 40, 8000


def simple_path(path: Column) -> Column:
    """Without '.' and empty parts; '..' takes the part before it away, and nothing at the top."""
    shorter = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, part: F.when(part == "..", shorter(done)).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inside(parent: Column, rest: Column) -> Column:
    return simple_path(F.concat(parent, F.lit("/"), rest))


def crate_roots(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """Paths at which a crate begins; each path counts for the deepest package folder (packages: folder, '' for the top) above it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = paths.select("path", F.explode(above).alias("folder")).join(packages.select("folder").distinct(), "folder")
    own = met.groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    return own.where(below.rlike(CRATE_ROOT)).select("path")


def mod_candidates(lines: DataFrame) -> DataFrame:
    """(a, b): each Rust file with the paths that its mod declarations may mean; a path attribute on the line before decides alone.

    Comment lines don't part an attribute from its declaration; any other line does.
    """
    own = lines.where("language = 'rust'").select("path", "line_no", F.trim("line", F.lit(" \t")).alias("line")).where("NOT line LIKE '//%'")
    attribute = F.when(F.col("line").startswith("#[path"), F.nullif(F.regexp_extract("line", r"""["']([^"']*)["']""", 1), F.lit("")))
    seen = own.withColumn("given", F.lag(attribute).over(Window.partitionBy("path").orderBy("line_no")))
    before = F.substring_index("line", "mod ", 1)
    name = F.regexp_extract(F.expr("rtrim(';', substring(line, length(substring_index(line, 'mod ', 1)) + 5))"), r"^\s*(\S+)", 1)
    seen = seen.withColumn("name", name).where(F.col("line").endswith(";") & F.contains("line", F.lit("mod ")) & ~F.contains("line", F.lit("{")) & ((before == "") | before.endswith(" ")))
    seen = seen.where(F.col("name").rlike("^[A-Za-z0-9_]+$") & ~F.col("line").startswith("#[path"))
    parent = folder(F.col("path"))
    base = F.when(F.col("path").rlike(r"(^|/)(mod|main|lib|build)\.rs$"), parent).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    found = F.when(F.col("given").isNotNull(), F.array(inside(parent, F.col("given")))).otherwise(F.array(inside(base, F.concat("name", F.lit(".rs"))), inside(base, F.concat("name", F.lit("/mod.rs")))))
    return seen.select(F.col("path").alias("a"), F.explode(found).alias("b")).distinct()


def rust_reachability(lines: DataFrame, paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, reachability, reachable_from, detached_reason) of every Rust file: Active with its crate roots, or Detached.

    Cycles of declarations end; without packages every file is detached; empty files count.
    """
    own = paths.where("language = 'rust'").select("path").distinct()
    steps = mod_candidates(lines).join(own.select(F.col("path").alias("b")), "b", "left_semi").select("a", "b")
    found = reachable_from(steps, crate_roots(own, packages).select(F.col("path").alias("id")))
    state = own.join(found.select(F.col("id").alias("path"), F.col("roots").alias("reachable_from")), "path", "left")
    lost = F.col("reachable_from").isNull()
    return state.select("path", F.when(lost, "Detached").otherwise("Active").alias("reachability"), "reachable_from", F.when(lost, DETACHED).alias("detached_reason"))


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, specifier, level, target): the first existing file that an import may mean; what means none has no row.

    imports: path, language, specifier, level (the leading dots of a Python import, else 0). TypeScript
    specifiers count only if they begin with a dot. Null specifiers mean nothing.
    """
    parent = folder(F.col("path"))
    python = F.col("language") == "python"
    dotted = F.replace("specifier", F.lit("."), F.lit("/"))
    up = F.repeat(F.lit("/.."), F.greatest(F.col("level") - 1, F.lit(0)))
    base = F.when(python & (F.col("level") == 0), simple_path(dotted)).when(python, inside(F.concat(parent, up), dotted)).otherwise(inside(parent, F.col("specifier")))
    endings = F.when(python, F.array(*map(F.lit, PYTHON_ENDINGS))).otherwise(F.array(*map(F.lit, TYPESCRIPT_ENDINGS)))
    able = imports.where(python | F.col("specifier").startswith(".")).select("path", "specifier", "level", base.alias("base"), endings.alias("endings")).distinct()
    tried = able.select("path", "specifier", "level", "base", F.posexplode("endings").alias("place", "ending")).select("path", "specifier", "level", "place", F.concat("base", "ending").alias("target"))
    met = tried.join(paths.select(F.col("path").alias("target")).distinct(), "target")
    return met.groupBy("path", "specifier", "level").agg(F.min_by("target", "place").alias("target"))


def snippets(files: DataFrame, wanted: DataFrame, before: int = 6, after: int = 8) -> DataFrame:
    """(path, line, start_line, end_line, code): the lines around each wanted (path, line), 40 lines and 8,000 bytes at most.

    The line is moved into the file. Files that are null, empty or hold NUL give no row. Code is cut
    between characters. The line arrays are built before the join, once a file.
    """
    bare = F.regexp_replace("text", "\n$", "")
    rows = files.where(F.col("text").isNotNull() & (F.col("text") != "") & ~F.contains("text", F.lit("\0"))).select("path", F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(x, "\r$", "")).alias("rows"))
    met = wanted.select("path", "line").distinct().join(rows, "path")
    n = F.size("rows")
    met = met.withColumn("centre", F.least(F.greatest(F.col("line"), F.lit(1)), n)).withColumn("start_line", F.greatest(F.col("centre") - before, F.lit(1)).cast("int"))
    met = met.withColumn("end_line", F.least(F.col("centre") + after, n, F.col("start_line") + (SNIPPET_LINES - 1)).cast("int"))
    code = F.array_join(F.slice("rows", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    met = met.select("path", "line", "start_line", "end_line", code.alias("code"))
    part = lambda k: F.substring(F.encode("code", "UTF-8"), 1, k).cast("string")
    cut = F.coalesce(*[F.when(F.is_valid_utf8(part(k)), part(k)) for k in range(SNIPPET_BYTES, SNIPPET_BYTES - 4, -1)])
    return met.withColumn("code", F.when(F.octet_length("code") <= SNIPPET_BYTES, F.col("code")).otherwise(cut))
