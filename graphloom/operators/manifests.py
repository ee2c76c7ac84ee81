"""Packages of Cargo manifests: facts by line, workspace members by a glob join, the files of each package, the folders to check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names as N
from graphloom.operators.modules import folder, inside

# Folders that are not searched for manifests.
SKIPPED = ".git target node_modules dist .next .venv venv".split()
DEPENDENCIES = r"(^|\.)(dev-|build-)?dependencies$"
STRING = r"""["']([^"']*)["']"""


def cargo_facts(lines: DataFrame) -> DataFrame:
    """lines (path, line_no, line) -> (folder, name, workspace, members, exclude, dependencies) of every Cargo.toml.

    A line belongs to the last section, and its strings to the last key, so lists may go over lines. Dependencies are the keys of sections that end in dependencies, and the last
    part of sections below one ([dependencies.x]), each once and sorted; a package without a name has null. Comment lines don't count.
    """
    c = F.col
    text = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    own = lines.where(F.regexp_extract("path", "([^/]+)$", 1) == "Cargo.toml").select(folder(c("path")).alias("folder"), "line_no", text.alias("text")).where("text <> ''")
    section = F.nullif(F.regexp_extract("text", r"^\[+\s*([^\]]+?)\s*\]+$", 1), F.lit(""))
    order = Window.partitionBy("folder").orderBy("line_no")
    own = own.withColumn("head", section).withColumn("section", F.last("head", ignorenulls=True).over(order))
    key = F.when(c("head").isNull(), F.nullif(F.regexp_extract("text", r"""^["']?([A-Za-z0-9_.-]+)["']?\s*=""", 1), F.lit("")))
    own = own.withColumn("own_key", key).withColumn("key", F.last(F.when(c("head").isNotNull(), F.lit("")).otherwise(c("own_key")), ignorenulls=True).over(order))
    values = F.regexp_extract_all("text", F.lit(STRING), F.lit(1))
    listed = lambda name: F.flatten(F.array_sort(F.collect_list(F.when((c("section") == "workspace") & (c("key") == name) & c("head").isNull(), F.struct("line_no", values.alias("v"))))).getField("v"))
    below = F.regexp_extract("head", r"dependencies\.(.+)$", 1)
    named = F.when(c("section").rlike(DEPENDENCIES) & c("own_key").isNotNull(), F.regexp_replace("own_key", r"\.(workspace|version|path)$", "")).otherwise(F.nullif(F.regexp_replace(below, "[\"']", ""), F.lit("")))
    return own.groupBy("folder").agg(
        F.min(F.when((c("section") == "package") & (c("own_key") == "name"), F.get(values, F.lit(0)))).alias("name"), F.coalesce(F.bool_or(c("section") == "workspace"), F.lit(False)).alias("workspace"),
        listed("members").alias("members"), listed("exclude").alias("exclude"), F.array_sort(F.collect_set(named)).alias("dependencies"),
    )


def ancestors(path: Column, whole: bool) -> Column:
    """The folders above a path from the top one, '', down; with whole the path itself too."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - (0 if whole else 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def globbed(patterns: DataFrame, folders: DataFrame) -> DataFrame:
    """patterns (workspace, pattern), folders (folder) -> (workspace, folder) that match; * stands for any letters of one part, ? for one.

    A join by the folder before the first part with a wildcard and the number of parts, so a pattern meets what lies there, not every folder.
    """
    c = F.col
    whole = inside(c("workspace"), c("pattern"))
    parts = F.split(whole, "/")
    fixed = F.size(parts) - F.size(F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: p.rlike(r"[*?]")))
    rule = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\*", "[^/]*"), r"\?", "[^/]")
    asked = patterns.select("workspace", F.size(parts).alias("n"), F.array_join(F.slice(parts, F.lit(1), fixed), "/").alias("top"), F.concat(F.lit("^"), rule, F.lit("$")).alias("rule"))
    known = folders.select("folder", F.size(F.split("folder", "/")).alias("n"), F.explode(ancestors(c("folder"), True)).alias("top"))
    return asked.join(known, ["top", "n"]).where(F.expr("folder RLIKE rule")).select("workspace", "folder").distinct()


def packages(facts: DataFrame) -> DataFrame:
    """(folder, name, dependencies, workspace): every named package with the folder of its workspace.

    That is the nearest one above it, or itself, of which it is a member, by a glob that no exclude undoes (an exclude takes all below it); a workspace's own package is always one. A package of no workspace is its own.
    """
    c = F.col
    spaces = facts.where("workspace")
    named = facts.where("name IS NOT NULL").select("folder", "name", "dependencies")
    members = globbed(spaces.select(c("folder").alias("workspace"), F.explode("members").alias("pattern")), named.select("folder"))
    outside = spaces.select(c("folder").alias("workspace"), F.explode("exclude").alias("e")).select("workspace", inside(c("workspace"), c("e")).alias("above"))
    below = named.select("folder", F.explode(ancestors(c("folder"), True)).alias("above"))
    members = members.join(below.join(outside, "above").select("workspace", "folder"), ["workspace", "folder"], "left_anti")
    own = spaces.select(c("folder").alias("workspace"), "folder")
    best = members.union(own).groupBy("folder").agg(F.max_by("workspace", F.length("workspace")).alias("workspace"))
    return named.join(best, "folder", "left").withColumn("workspace", F.coalesce("workspace", "folder"))


def indexed_files(found: DataFrame, paths: DataFrame, root: str = "") -> DataFrame:
    """(package, path, module) of the Rust files of the packages that a project at `root` shows: all members if root is their workspace, else those at or below root.

    A package has all Rust files below its folder, so a file below a package in a package is in both. The root needs a package or workspace; without there are no rows.
    """
    c = F.col
    here = found.where((c("workspace") == root) | (c("folder") == root) | (F.lit(root) == "") | c("folder").startswith(root + "/"))
    spaces = found.where(c("folder") == root).select("workspace").union(found.where(c("workspace") == root).select("workspace")).distinct()
    shown = here.join(spaces, "workspace", "left_semi").select("name", "folder")
    files = paths.where(c("path").endswith(".rs")).select("path", F.explode(ancestors(c("path"), False)).alias("folder"))
    met = files.join(shown, "folder")
    local = F.when(c("folder") == "", c("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    return met.select(c("name").alias("package"), "path", N.module_path(local, F.lit("rust")).alias("module"))


def check_folders(facts: DataFrame) -> DataFrame:
    """Folders (folder) in which checks run: those with a manifest and no skipped folder above it; the top one alone if it is a workspace."""
    left = facts.where(~F.arrays_overlap(F.split("folder", "/"), F.array(*map(F.lit, SKIPPED))))
    top = F.broadcast(facts.where("folder = '' AND workspace").select(F.lit(True).alias("alone")))  # one row at most
    return left.select("folder").join(top, F.lit(True), "left").where("alone IS NULL OR folder = ''").select("folder")
