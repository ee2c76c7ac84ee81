"""Listing of source trees in tasks: a frontier of folders, level by level, without a list of paths on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import LANGUAGES
from graphloom.functions.session import stored

# Folders that hold no sources, for all languages and for some.
IGNORED = "target node_modules .git dist build .next .cache __pycache__ .venv venv coverage .vite".split()
MORE = {"python": ".mypy_cache .pytest_cache .ruff_cache".split()}


def listed(batches, root: str, ignored: list[str], hidden: bool):
    """Rows (folder) -> (path, folder): what lies in each, below the root; unreadable folders have nothing."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    for b in batches:
        out = []
        for folder in b["folder"].to_pylist():
            try:
                found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
            except OSError:
                continue
            for info in found:
                path, name = f"{folder}/{info.base_name}".lstrip("/"), info.base_name
                if name in ignored or (hidden is False and name.startswith(".")):
                    continue
                out.append((path, info.type == fs.FileType.Directory))
        yield pa.record_batch({"path": pa.array([p for p, _ in out], pa.string()), "folder": pa.array([d for _, d in out], pa.bool_())})


def source_paths(spark: SparkSession, root: str, language: str | None = None, hidden: bool = True) -> DataFrame:
    """(path, language) of the source files below root (a URI of a store that tasks can read, such as file:// or s3://), of one language or of all.

    Each level of folders is a table that tasks list; ignored folders are pruned where they stand, those of one language's tools only when that language is asked for; without hidden, names that
    begin with a dot are passed over, files too. Declarations (.d.ts) are no sources. An empty or unreadable root gives no rows.
    """
    ignored = IGNORED + MORE.get(language, [])
    fits = [e for e, x in LANGUAGES.items() if language is None or x == language or (language == "typescript" and x == "javascript")]
    frontier = spark.createDataFrame([("",)], "folder string")
    found = None
    while True:
        level = stored(frontier.repartition("folder").mapInArrow(lambda b: listed(b, root, ignored, hidden), "path string, folder boolean"))
        files = level.where("NOT folder").select("path")
        found = files if found is None else found.union(files)
        frontier = level.where("folder").select(F.col("path").alias("folder"))
        if frontier.isEmpty():
            break
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    kinds = F.coalesce(*(F.when(ending == e, x) for e, x in LANGUAGES.items()))
    return found.where(ending.isin(fits) & ~F.col("path").endswith(".d.ts")).select("path", kinds.alias("language"))


def source_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """paths (path, language) -> (path, language, text), read in tasks; files that can't be read or aren't UTF-8 have no row."""

    def read(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, language in zip(b["path"].to_pylist(), b["language"].to_pylist()):
                try:
                    with store.open_input_stream(f"{base}/{path}") as f:
                        text = f.read().decode()
                except (OSError, UnicodeDecodeError):
                    continue
                yield pa.record_batch({"path": pa.array([path]), "language": pa.array([language], pa.string()), "text": pa.array([text])})

    return paths.select("path", "language").mapInArrow(read, "path string, language string, text string")
