"""Source trees as a batch data source: spark.read.format("srctree").load(root).

Spark's own file readers skip names that begin with _ or ., such as __init__.py; this reader lists
the tree itself, prunes ignored folders and hands the files to tasks in groups.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.columns import LANGUAGES

# Folders that hold no sources of their own.
IGNORED = "target node_modules .git dist build .next .cache __pycache__ .venv venv coverage .vite .mypy_cache .pytest_cache .ruff_cache".split()
GROUP = 200


class SourceTree(DataSource):
    """Columns path (relative, with /), language, text. Options: path, extensions (comma-separated)."""

    @classmethod
    def name(cls):
        return "srctree"

    def schema(self):
        return "path string, language string, text string"

    def reader(self, schema):
        return SourceTreeReader(self.options["path"], self.options.get("extensions", ",".join(LANGUAGES)).split(","))


class SourceTreeReader(DataSourceReader):
    def __init__(self, root: str, extensions: list[str]):
        self.root, self.extensions = root, tuple("." + e.strip() for e in extensions)

    def partitions(self):
        found = []
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(d for d in folders if d not in IGNORED)
            found += [os.path.join(folder, n) for n in sorted(names) if n.endswith(self.extensions) and not n.endswith(".d.ts")]
        return [InputPartition(found[k : k + GROUP]) for k in range(0, len(found), GROUP)]

    def read(self, partition):
        for path in partition.value:
            try:
                with open(path, encoding="utf-8", newline="") as f:
                    text = f.read()
            except (OSError, UnicodeDecodeError):  # unreadable files are not sources
                continue
            yield os.path.relpath(path, self.root).replace(os.sep, "/"), LANGUAGES[path.rsplit(".", 1)[1]], text


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
