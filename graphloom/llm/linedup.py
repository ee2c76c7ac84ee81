"""Cross-site boilerplate lines by distinct-site spread (HyperLogLog, then exact near the threshold)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, remove, salted_join, unused, written

#: log2 of a sketch's registers; the relative standard error is 1.04 / sqrt(2^12), under 2 %.
LG_K = 12


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, text hash, pos, key, site) of every line that isn't blank; key is a hash of the trimmed line."""
    line = F.posexplode(F.split(text_col, "\n"))
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), F.col(site_col).cast("string").alias("site"), line.alias("pos", "line"))
    trimmed = F.trim(F.regexp_replace("line", r"[\x09-\x0D]", " "))
    return cut.withColumn("line", trimmed).where("line <> ''").select("id", "of", "pos", "site", F.xxhash64("line").alias("key"), F.xxhash64(F.reverse("line")).alias("key2"))


def boilerplate(lines: DataFrame, min_sites: int, sigmas: float = 4.0, lg_k: int = LG_K) -> DataFrame:
    """(key, key2, sites, first) of the lines that stand on at least min_sites distinct sites.

    One aggregation gives each line its count, its first occurrence and its HyperLogLog sketch of
    sites; sketches are built before the shuffle and merged after it, so a line that is everywhere
    sends one row a task. Estimates further than `sigmas` standard errors from the threshold
    decide; lines nearer to it are counted exactly, over distinct (line, site) pairs.
    """
    sketch = F.hll_sketch_agg("site", F.lit(lg_k))
    seen = lines.groupBy("key", "key2").agg(F.count("*").alias("n"), F.min(F.struct("id", "of", "pos")).alias("first"), sketch.alias("sketch"))
    error = 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - sigmas * error), min_sites * (1 + sigmas * error)
    spread = seen.where(F.col("n") >= min_sites).select("key", "key2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = checkpoint(spread.where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high)
    pairs = lines.where("site IS NOT NULL").select("key", "key2", "site").distinct().join(near.select("key", "key2"), ["key", "key2"], "left_semi")
    exact = pairs.groupBy("key", "key2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("sites") > high).select("key", "key2", "sites", "first")
    return sure.unionByName(exact.join(near.select("key", "key2", "first"), ["key", "key2"]))


def remove_boilerplate(
    docs: DataFrame, min_sites: int = 10, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K
) -> DataFrame:
    """docs with cross-site boilerplate lines taken out of the text, and line__count, line__removed.

    A line is what stands between newlines; it is compared by its 128-bit hash after trimming
    white space. A line on at least min_sites distinct sites is boilerplate and goes from every
    document, but for its first occurrence (by id, then text, then position; keep_first), so that
    what many sites copied isn't lost altogether. Other lines and blank ones stay as they are, in
    order. The texts are split once, into a table of line hashes in the checkpoint folder; only
    texts that lose lines are split again. Rows of one line are spread over tasks by a salt.

    A null text stays null and an empty one empty, with no line removed. A null site is no site:
    it adds nothing to a line's spread, but the line goes from that document as from any other.
    Repeated rows are told apart by nothing: both keep a first occurrence. A null id comes first.
    All other columns pass through; line__count and line__removed replace columns of these
    names. No rows give no rows.
    """
    lines, path = written(lines_of(docs, id_col, text_col, site_col))
    found = checkpoint(boilerplate(lines, min_sites, lg_k=lg_k).select("key", "key2", "first"))
    hit = salted_join(lines.select("key", "key2", "id", "of", "pos"), found, ["key", "key2"], ["id", "pos"])
    if keep_first:
        hit = hit.where(~F.struct("id", "of", "pos").eqNullSafe(F.col("first")))
    gone = checkpoint(hit.groupBy("id", "of").agg(F.array_distinct(F.collect_list("pos")).alias("gone")))
    remove(docs.sparkSession, path)
    rest = docs.drop("line__count", "line__removed")
    key, of, lost = (unused(f"line__{c}", rest) for c in ("id", "of", "gone"))
    gone = gone.select(F.col("id").alias(key), F.col("of").alias(of), F.col("gone").alias(lost))
    both = rest.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(of)), "left")
    parts = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n"))
    breaks = F.length(text_col) - F.length(F.translate(text_col, "\n", ""))
    return both.select(
        *(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in rest.columns),
        F.when(F.col(text_col).isNull(), 0).otherwise(breaks + 1).cast("bigint").alias("line__count"),
        F.coalesce(F.size(lost), F.lit(0)).cast("bigint").alias("line__removed"),
    )
